"""The whole pipeline against plain Python, and on edge rows and empty tables."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from furlong.llm import packing, queries, secret_scan, toxicity
from tests.llm.test_corpus_operators import TEXTS, brute_components

SF = "/root/testdata/sf0.001"


def masked(text):
    found = []
    for kind, pattern, group, least in secret_scan.BASE:
        pattern = pattern.replace("{24,}", "+")
        found += [(m.start(), m.end(), kind, True) for m in re.finditer(pattern, text, re.A) if len(m.group(group)) >= least]
    found += [(m.start(), m.end(), kind, False) for kind, pattern, _ in secret_scan.WEAK for m in re.finditer(pattern, text, re.A)]
    part = lambda x: secret_scan.PARTS[x[2]]

    def linked(x, y):
        return part(x) != part(y) and "secret" in (part(x), part(y)) and y[0] - x[1] <= 200 and x[0] - y[1] <= 200

    out, at = "", 0
    for start, end, *_ in sorted(x for x in found if x[3] or any(linked(x, y) for y in found)):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def pieces_of(i, text, tokenizer):
    ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    edges = [0, *range(len(ids) - (-(-len(ids) // 2048) - 1) * 2048, len(ids) + 1, 2048)]
    cut = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [(i, k, edges[k], len(own), zlib.crc32(np.array(own, "<u4").tobytes())) for k, own in enumerate(cut)]


def brute_run(rows):
    """Pieces of (doc_id, text) rows that the toxicity stage kept, all ids distinct."""
    last = {}
    for i, t in rows:
        last[t or ""] = max(i, last.get(t or "", i))
    kept = {i: t for i, t in rows if last[t or ""] == i}
    component = brute_components(list(kept.items()), 5, 80)
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    return sorted(p for i, t in kept.items() if component[i][1] == i for p in pieces_of(i, masked(t or ""), tokenizer))


def check_sequences(rows):
    """Offsets of every sequence are gapless and end within the capacity; the count is near its lower bound."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 2048
    bound = packing.lower_bound(np.array([r.length for r in rows]), 2048)
    assert bound <= len(held) <= bound + max(1, bound // 50)


def columns(rows):
    return sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)


def test_run_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    judged = toxicity.score(docs, toxicity.fit(docs, labels)).where("kept").select("doc_id")
    clean = docs.join(judged, "doc_id").select("doc_id", "text").collect()
    got = corpus_pipeline.run(spark, SF).collect()
    assert columns(got) == brute_run([tuple(r) for r in clean])
    check_sequences(got)
    calm = labels.where("toxic = 0").join(docs, "doc_id")
    assert calm.join(judged, "doc_id").count() >= 0.98 * calm.count()


@pytest.mark.parametrize("n", [len(TEXTS), 0])
def test_run_on_edge_rows_and_empty_tables(spark, tmp_path, n):
    """Without a label nothing is toxic; all other stages act on null, empty and long texts, with clashing columns."""
    rows = [(i, t, None, i, "x") for i, t in enumerate(TEXTS)][:n]
    schema = "doc_id long, text string, secrets string, node int, marked string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert columns(got) == brute_run(list(enumerate(TEXTS[:n])))
    if n:
        check_sequences(got)
