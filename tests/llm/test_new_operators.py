"""Substring dedup, periodic runs and centroid clustering, held against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from furlong.llm import centroid_clustering, periodic_runs, queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def all_runs(w):
    """Every run of a list of words, by trying every period."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            part = w[start : start + length]
            if length >= max(6, 4 * q) and all(part[r:] != part[: length - r] for r in range(1, q)):
                out.append((start, length, q))
            i += 1
    return sorted(out)


def random_words(rnd):
    w = [rnd.randrange(rnd.choice([1, 2, 3, 5])) for _ in range(rnd.randrange(60))]
    for _ in range(rnd.randrange(4)):
        p = rnd.randrange(1, 20)
        unit = [rnd.randrange(rnd.choice([1, 2, 4, 300])) for _ in range(p)]
        at = rnd.randrange(len(w) + 1)
        w[at:at] = [unit[i % p] for i in range(rnd.randrange(p * 7))]
    return [f"w{x}" for x in w]


def test_runs_by_brute_force():
    rnd, seen = random.Random(3), 0
    for _ in range(500):
        w = random_words(rnd)
        expected = all_runs(w)
        assert periodic_runs.runs(periodic_runs.numbered(w)) == expected
        seen += len(expected)
    assert seen > 300


@pytest.mark.parametrize("ids", [[0] * 200_000, [0] * 100_000 + [1] + [0] * 100_000, [i * i % 7919 % 3001 for i in range(200_000)]])
def test_long_texts_take_seconds(ids):
    began = time.time()
    found = periodic_runs.runs(np.array(ids, dtype=np.int64))
    assert time.time() - began < 30
    assert all(m >= max(6, 4 * q) for _, m, q in found)


def test_query_of_runs_by_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    texts = [None, "", " \n", "a", "a a a a a a", "b\x0ba\tb\n" * 5, "é 中 " * 9, "x " * 3000]
    texts += [" ".join(random_words(rnd)) for _ in range(150)] + [" ".join(f"u{i}" for i in range(k)) for k in range(1, 60)]
    rows = [(i, t, "doc_id") for i, t in enumerate(texts)] + [(4, texts[4], "again")]
    spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        w, h = WORD.findall(texts[r.doc_id] or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = all_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (math.floor(Fraction(1000 * best[1], best[2])) if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_of_no_rows(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_annulus_finds_the_nearest_with_ties():
    rng = np.random.default_rng(1)
    for scale in (2, 5, 1000):
        centroids = rng.integers(-scale, scale + 1, (12, 3))
        centroids[7] = centroids[2]
        vectors = rng.integers(-scale, scale + 1, (500, 3))
        number, distance = centroid_clustering.Rings(centroids).nearest(vectors)
        all_of_them = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (distance == all_of_them.min(axis=1)).all()
        assert (number == all_of_them.argmin(axis=1)).all()


def clusters(rows, dim, k, rounds):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in kept]
    start = sorted(kept, key=lambda x: (sha(f"2:{x[0]}"), x[1]))[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        to = [nearest(v)[0] for _, v in kept]
        centroids = [
            [sum(c) // len(c) for c in zip(*held, strict=True)] if (held := [v for (_, v), j in zip(kept, to, strict=True) if j == n]) else old
            for n, old in enumerate(centroids)
        ]
    return sorted((i, *nearest(v)) for i, v in kept), [tuple(c) for c in centroids]


@pytest.mark.parametrize("k", [1, 4, 500])
def test_clusters_by_brute_force(spark, k):
    rnd = random.Random(k)
    rows = [(i, [rnd.choice([-1.5, 0.25, 0.001, 3.0]) * rnd.randrange(3) for _ in range(4)]) for i in range(120)]
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [0.0, 1.0, 2.0, float("-inf")])]
    rows += rows[:5]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    assigned, centroids = centroid_clustering.cluster_vectors(df, dim=4, k=k)
    expected = clusters([(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 4, k, 5)
    assert (sorted(map(tuple, assigned.collect())), centroids) == expected


def test_clusters_of_no_rows(spark):
    assigned, centroids = centroid_clustering.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert (assigned.count(), centroids) == (0, [])


def without_repeats(rows, window):
    """(id, words, removed words, kept text) of each (id, text); None is behind every id."""
    order = lambda i: math.inf if i is None else i
    least = {}
    held = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in held:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, math.inf), order(i))
    out = []
    for i, w in held:
        gone = {k + j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < order(i) for j in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def passages(rnd, n):
    """Texts that share passages of all lengths, very common ones and repeats of their own among them."""
    common = [f"c{i}" for i in range(40)]
    pool = [[f"p{k}_{i}" for i in range(rnd.randrange(5, 60))] for k in range(12)]
    texts = [None, "", " \x0b\n", "one", "same " * 200, "same " * 90, "é 中 x\u00a0y " * 20]
    for k in range(n):
        w = []
        for _ in range(rnd.randrange(6)):
            part = rnd.choice([common, rnd.choice(pool), [f"u{k}_{i}" for i in range(rnd.randrange(20))], ["same"] * rnd.randrange(30)])
            a = rnd.randrange(len(part) + 1)
            w += rnd.choice([part, part[a:], part[:a]])
        texts.append(rnd.choice([" ", "\n", "  "]).join(w))
    return texts


@pytest.mark.parametrize(("window", "group", "batch"), [(13, 1 << 21, 1 << 21), (13, 300, 500), (2, 50, 10), (5, 1, 3000)])
def test_substrings_by_brute_force(spark, window, group, batch):
    rnd = random.Random(window + group)
    rows = list(enumerate(passages(rnd, 120)))
    rnd.shuffle(rows)
    rows += rows[:4] + [(3, rows[7][1]), (None, rows[8][1]), (None, rows[9][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, places int").repartition(5)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.drop_repeats(df, window=window, group=group, batch=batch).collect()]
    assert sorted(got, key=str) == without_repeats(rows, window)


def test_prefixes_split_groups_by_memory():
    prefixes = substring_dedup.Prefixes()
    h = np.array([1 << 56, 2 << 56, 3 << 56, 1 << 56, 2 << 56, 4 << 56], dtype=np.uint64)
    prefixes.first[:] = 5
    prefixes.first[(1 << 8) | 2] = -1
    prefixes.more = np.arange(256).reshape(1, 256)
    group, place = prefixes.groups(h, np.array([0, 1, 3]))
    assert group.tolist() == [3, 5, 4] and place.tolist() == [3, 3, 6]


def test_removed_spans_and_no_rows(spark):
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "a b " + " ".join(words[3:20]) + " c")], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in substring_dedup.drop_repeats(df).collect()}
    assert got == {1: [], 2: [(2, 19)]}
    assert substring_dedup.drop_repeats(df.limit(0)).count() == 0
