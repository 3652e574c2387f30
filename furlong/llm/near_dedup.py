"""Near-duplicate classes by SetSketch: registers, bands of registers, joint likelihood, exact check."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import textcodes as X
from furlong.llm.common import Scratch, cut, free_name, named

#: Registers hold floor(1 - log_BASE(h)) for the least h of an exponential draw of rate RATE per element.
BASE, RATE, TOP = 1.001, 20.0, 65535
ROWS, BANDS = 4, 28
REGISTERS = ROWS * BANDS
#: Pairs whose likelihood peaks this far below the threshold are not checked: over five standard deviations.
SLACK = 0.2

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MASKS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles.

    A-Z are lower-cased. A text of fewer than k words gives its whole word sequence as one
    shingle, a text without words none.
    """
    _, c, starts = X.codes(texts)
    c = X.lower_ascii(c)
    begin, end, text_no = X.words(c, starts, X.white(c))
    h = X.span_hash(X.prefix_sums(c), begin, end)
    first = np.searchsorted(text_no, np.arange(len(texts) + 1))
    n = np.diff(first)
    rolled = np.zeros(len(h), dtype=np.uint64)
    for i in range(min(k, len(h))):
        rolled[: len(h) - i] = X.mix(rolled[: len(h) - i] * X.ODD + h[i:] + np.uint64(i))
    sets = []
    for j, m in enumerate(n):
        a = first[j]
        if m >= k:
            sets.append(np.unique(rolled[a : a + m - k + 1]))
        elif m:
            whole = np.uint64(m)
            with np.errstate(over="ignore"):
                for x in h[a : a + m]:
                    whole = X.mix(np.array([whole * X.ODD + x], dtype=np.uint64))[0]
            sets.append(np.array([whole], dtype=np.uint64))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def minima(elements: np.ndarray) -> np.ndarray:
    """Per register the least of the elements' uniform draws; minima of parts merge by ``np.minimum``."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(elements), 512):
        x = elements[i : i + 512, None]
        np.minimum(least, ((x ^ _MASKS) * _FACTORS).min(axis=0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Exponentially spaced, truncated register values of ``minima``."""
    u = (least.astype(np.float64) + 1.0) / 2.0**64
    h = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype("<u2")


def joint_likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair, from which registers are larger, smaller, equal.

    a, b: (pairs, REGISTERS); n_a, n_b: known set sizes. Evaluates the log-likelihood on a grid.
    """
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    score = (
        larger[:, None] * np.log(np.maximum(up, tiny))
        + smaller[:, None] * np.log(np.maximum(down, tiny))
        + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    )
    return grid[np.arange(len(grid)), score.argmax(axis=1)]


def set_key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _sketch(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at, held in X.batches(batch.column(2)):
                n, keys, sketches = [], [], []
                for s in shingle_sets(held, k):
                    n.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    sketches.append(registers(minima(s)).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(held)), batch.column(1).slice(at, len(held)),
                     pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "set_key", "sketch"],
                )

    return run


def _sets(k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for _, held in X.batches(batch.column(0)):
                sets = shingle_sets(held, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_key", "elements"]
                )

    return run


def _bands(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node its band keys: a hash of the band's number and register values."""
    for batch in rows:
        if not batch.num_rows:
            continue
        r = np.stack([np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()]).astype(np.uint64)
        r = r.reshape(len(r), BANDS, ROWS)
        key = X.mix(np.arange(BANDS, dtype=np.uint64) + X.ODD)[None, :] + np.zeros((len(r), 1), dtype=np.uint64)
        for i in range(ROWS):
            key = X.mix(key * X.ODD + r[:, :, i])
        flat = pa.array(key.view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * BANDS, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "bands"])


def _likely(threshold: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if not batch.num_rows:
                continue
            a, b = (np.stack([np.frombuffer(x, "<u2") for x in batch.column(i).to_pylist()]) for i in (2, 3))
            n_a, n_b = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            good = joint_likelihood(a, b, n_a, n_b) >= threshold - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good)) for i in (0, 1)], ["a", "b"])

    return run


def _common(detail: bool):
    """Sizes of both sets and of what they share; with ``detail`` also the elements that only b has and a map of those it misses.

    The map has 256 bits in four numbers; bit i stands for the missed elements whose highest byte is i.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            n_a, n_b, both, own, maps = [], [], [], [], np.zeros((batch.num_rows, 4), dtype=np.uint64)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                found = np.isin(y, x, assume_unique=True)
                n_a.append(len(x))
                n_b.append(len(y))
                both.append(int(found.sum()))
                if detail:
                    own.append(y[~found].view(np.int64))
                    place = np.unique(np.setdiff1d(x, y, assume_unique=True) >> np.uint64(56))
                    np.bitwise_or.at(maps[i], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
            columns, names = [batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (n_a, n_b, both))], ["a", "b", "n_a", "n_b", "both"]
            if detail:
                columns += [pa.array(own, pa.list_(pa.int64())), *(pa.array(maps[:, k].view(np.int64)) for k in range(4))]
                names += ["own", *MAPS]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


#: The columns of the map of missed elements.
MAPS = ("m0", "m1", "m2", "m3")


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b): comp is the least node that it reaches.

    Each round a node takes the least label around it and then that label's own label, so a
    chain shortens geometrically. A round reads and writes one table of labels.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp"), F.lit(True).alias("moved")))
    while True:
        via = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        around = both.join(via, both["b"] == F.col("via")).groupBy("a").agg(F.min("far").alias("least"))
        near = labels.join(around, labels["node"] == around["a"]).select("node", "comp", F.least("comp", "least").alias("new"))
        jumped = near.join(via, near["new"] == F.col("via")).select("node", F.least("new", "far").alias("new"), F.col("comp").alias("old"))
        after = scratch.write(jumped.select("node", F.col("new").alias("comp"), (F.col("new") < F.col("old")).alias("moved")))
        scratch.drop(labels)
        labels = after
        if labels.where("moved").isEmpty():
            scratch.drop(both)
            return labels


class _Classes:
    """The steps of ``near_classes``. Nodes are numbers of rows; each stands for one set of shingles."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> None:
        self.scratch = Scratch(df.sparkSession)
        self.shingle, self.percent = shingle, percent
        text = named(text_col)
        self.source = df.select(named(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
        sketched = self.source.mapInArrow(
            _sketch(shingle), f"doc_id {dict(self.source.dtypes)['doc_id']}, text_hash long, n_shingles long, set_key binary, sketch binary"
        )
        write = self.scratch.write
        self.rows = write(sketched.withColumn("row", F.monotonically_increasing_id()))
        self.nodes = write(
            self.rows.where("set_key is not null")
            .groupBy("set_key")
            .agg(F.min(F.struct("row", "doc_id")).alias("first"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
            .select("set_key", F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), "least_id", "n", "sketch")
        )
        self.comps: DataFrame | None = None

    def bands(self) -> DataFrame:
        """(key, node) of the bands that two nodes at least share, and each node's company there as ``pop``."""
        write = self.scratch.write
        members = self.nodes.select("node", "sketch").mapInArrow(_bands, "node long, bands array<bigint>").select(F.explode("bands").alias("key"), "node")
        shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        held = write(members.join(shared, "key").select("key", "node", "m"))
        pop = write(held.groupBy("node").agg(F.sum("m").alias("pop")))
        out = write(held.join(pop, "node").select("key", "node", "pop"))
        self.scratch.drop(held)
        self.pop = pop
        return out

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that set sizes and joint likelihood leave, with both sets' keys."""
        sides = [self.nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}")) for s in "ab"]
        sized = pairs.join(sides[0], "a").join(sides[1], "b")
        sized = sized.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        return sized.select("a", "b", "s_a", "s_b", "n_a", "n_b").mapInArrow(_likely(self.percent / 100), "a long, b long")

    def compare(self, pairs: DataFrame, detail: bool = False) -> DataFrame:
        """(a, b, n_a, n_b, both) of the pairs, from the full sets, and with ``detail`` what ``_common`` adds."""
        write = self.scratch.write
        pairs = write(pairs)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = write(self.nodes.join(ends, "node", "left_semi").select("node", "doc_id", F.col("set_key").alias("wanted_key")))
        ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
        texts = self.source.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
        # An id can repeat with other texts, so the key of the set decides which one a node stands for.
        sets = texts.mapInArrow(_sets(self.shingle), "set_key binary, elements binary")
        sets = write(sets.join(wanted.select("node", "wanted_key"), F.col("set_key") == F.col("wanted_key")).dropDuplicates(["node"]).select("node", "elements"))
        self.scratch.drop(wanted)
        heads = pairs.select("a").distinct()
        of_a = sets.join(heads, F.col("node") == F.col("a"), "left_semi").select(F.col("node").alias("a"), F.col("elements").alias("x"))
        full = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b").join(of_a, "a")
        more = ", own array<bigint>" + "".join(f", {m} long" for m in MAPS) if detail else ""
        return full.select("a", "b", "x", "y").mapInArrow(_common(detail), "a long, b long, n_a long, n_b long, both long" + more)

    def linked(self, compared: DataFrame) -> DataFrame:
        return compared.where(100 * F.col("both") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")

    def labelled(self, df: DataFrame, col: str = "node", out: str = "comp") -> DataFrame:
        """``df`` with the component of its column ``col``; a node without links is its own."""
        if self.comps is None:
            return df.withColumn(out, F.col(col))
        known = self.comps.select(F.col("node").alias("known"), F.col("comp").alias("known_comp"))
        joined = df.join(known, F.col(col) == F.col("known"), "left").withColumn(out, F.coalesce("known_comp", col))
        return joined.drop("known", "known_comp")

    def merge(self, links: DataFrame) -> bool:
        """Take ``links`` (a, b) into the components; whether any two of them became one."""
        write = self.scratch.write
        links = write(links.distinct())
        between = self.labelled(self.labelled(links, "a", "ca"), "b", "cb").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        between = write(between.distinct())
        if between.isEmpty():
            self.scratch.drop(links, between)
            return False
        up = connected(between, self.scratch)
        own = links.select(F.col("a").alias("node"), F.col("a").alias("comp")).union(links.select("b", "b"))
        if self.comps is not None:
            own = own.union(self.comps)
        own = own.groupBy("node").agg(F.min("comp").alias("comp"))
        lifted = up.select(F.col("node").alias("was"), F.col("comp").alias("top"))
        after = write(own.join(lifted, F.col("comp") == F.col("was"), "left").select("node", F.coalesce("top", "comp").alias("comp")))
        self.scratch.drop(links, between, up, self.comps)
        self.comps = after
        return True

    def unsettled(self, held: DataFrame) -> DataFrame:
        """The rows of ``held`` (key, node, pop) in bands with several components, with node's and the largest one's, and their number."""
        labelled = self.labelled(held)
        per = labelled.groupBy("key", "comp").agg(F.count("*").alias("m"))
        split = per.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        return self.scratch.write(labelled.join(split, "key").select("key", "node", "pop", "comp", "main", "parts"))

    def to_heads(self, held: DataFrame) -> DataFrame:
        """One pair for each node of ``held`` (key, node, pop, comp): the head that most of its bands have.

        A band's head is its node that keeps most company in all its bands, so near copies of
        one text agree on a head and each is compared once.
        """
        heads = held.groupBy("key").agg(F.max_by(F.struct("node", "comp"), F.struct("pop", "node")).alias("head"))
        pairs = held.join(heads, "key").where("head.comp <> comp").select("node", F.col("head.node").alias("head"))
        return pairs.groupBy("node").agg(F.mode("head", True).alias("head")).select(F.col("head").alias("a"), F.col("node").alias("b"))

    def star_rounds(self, held: DataFrame, rounds: int = 5) -> DataFrame:
        """Compare with heads, then those outside a band's largest component with heads of their own, while that links.

        The bands that still hold several components are returned; no round decides against a pair.
        """
        first = active = None
        for _ in range(rounds):
            now = held.withColumn("comp", F.col("node")) if active is None else active
            moved = self.merge(self.linked(self.compare(self.likely(self.to_heads(now)))))
            if first is None:
                first = self.unsettled(held)
                left = first
            else:
                left = self.unsettled(active.select("key", "node", "pop"))
            outside = self.scratch.write(left.where("comp <> main and parts > 2").select("key", "node", "pop", "comp"))
            if active is not None:
                self.scratch.drop(active, left)
            active = outside
            if not moved or active.isEmpty():
                break
        self.scratch.drop(active, held)
        return first

    def near_hubs(self, first: DataFrame) -> None:
        """Link what is left in bands with several components, by way of a hub for each band.

        The hub is the node of the band's largest component that keeps most company; all nodes of
        the band are compared with it. What two nodes share lies in the hub or beside it. Their maps
        of the hub's elements that they miss bound the first part, so it is known how many elements
        beside the hub they must share. Pairs that need any are found by joining those elements; the others are
        those of like size whose bound does alone. Only such pairs of two components are compared.
        """
        write, p = self.scratch.write, self.percent
        open_ = self.unsettled(first.select("key", "node", "pop"))
        self.scratch.drop(first)
        if open_.isEmpty():
            self.scratch.drop(open_)
            return
        # Written before the join, so that Spark can broadcast it or split a component with very many open nodes.
        center = self.labelled(self.pop).groupBy("comp").agg(F.max_by("node", F.struct("pop", "node")).alias("hub"))
        center = write(center.withColumnRenamed("comp", "main"))
        spokes = write(open_.join(center, "main").where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
        self.scratch.drop(center)
        to_hub = write(self.compare(spokes, detail=True))
        self.merge(self.linked(to_hub))
        bits = sum((F.bit_count(m) for m in MAPS), F.lit(0))
        known = self.labelled(self.labelled(to_hub, "b"), "a", "main")
        known = known.withColumns({"n_own": F.size("own"), "missed": F.col("n_a") - F.col("both"), "bits": bits})
        known = write(known)
        per_hub = known.groupBy("a").agg(F.min("n_b").alias("least_n"), F.count("*").alias("members"))
        element = known.select("a", "b", F.explode("own").alias("e"))
        common = element.groupBy("a", "e").agg(F.count("*").alias("f")).where("f > 1")
        # Rarest first; elements that no other node of the hub has would come before all and meet nothing.
        ordered = element.join(common, ["a", "e"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("met"))
        hot = F.size(F.filter("met", lambda x: 2 * x["f"] > F.col("members")))
        around = known.drop("own").join(per_hub, "a").join(ordered, ["a", "b"], "left")
        around = around.withColumn("met", F.coalesce("met", F.array().cast(dict(ordered.dtypes)["met"]))).withColumn("n_hot", hot)
        # The fewest elements that any partner's need leaves beside the hub and the elements that most of its nodes
        # have; so the last but that many, in any order, need not be looked at.
        partner = F.greatest(F.ceil(p * F.col("n_b") / 100), "least_n")
        around = around.withColumn("partner", partner).withColumn(
            "fewest", F.greatest(F.lit(1), F.ceil(p * (F.col("n_b") + F.col("partner")) / (100 + p)) - F.col("both") - F.col("n_hot"))
        )
        first_met = F.size("met") - F.col("n_hot") - F.col("fewest") + 1
        met = F.transform(F.slice("met", F.lit(1), F.greatest(F.lit(0), first_met).cast("int")), lambda x: x["e"])
        around = write(around.withColumn("n_rare", F.col("n_own") - F.col("n_hot")).withColumn("met", met).drop("least_n", "members", "n_own"))
        self.scratch.drop(open_, spokes, to_hub, known)
        plain = [c for c in around.columns if c != "met"]
        other_side = ["a", *[F.col(c).alias("l_" + c) for c in plain if c not in ("a", "n_a", "main")]]
        left = around.where("comp <> main").select(*other_side)
        # Common missed elements: one for each common bit, and no more beside than either has elements above its bits.
        common_bits = sum((F.bit_count(F.col(m).bitwiseAND(F.col("l_" + m))) for m in MAPS), F.lit(0))
        both_miss = F.least("missed", "l_missed", common_bits + F.least(F.col("missed") - F.col("bits"), F.col("l_missed") - F.col("l_bits")))
        in_hub = F.col("n_a") - F.col("missed") - F.col("l_missed") + both_miss
        need = F.ceil(p * (F.col("n_b") + F.col("l_n_b")) / (100 + p)) - in_hub - F.least("n_hot", "l_n_hot")
        apart = (F.col("comp") != F.col("l_comp")) & ((F.col("comp") == F.col("main")) | (F.col("b") > F.col("l_b")))
        like = 100 * F.least("n_b", "l_n_b") >= p * F.greatest("n_b", "l_n_b")
        pair = [F.least("b", "l_b").alias("a"), F.greatest("b", "l_b").alias("b")]
        one = around.select(*plain, F.explode("met").alias("e"))
        other = around.where("comp <> main").select(*other_side, F.explode("met").alias("e"))
        meet = one.join(other, ["a", "e"]).where(apart & like & (need > 0) & (F.least("n_rare", "l_n_rare") >= need))
        beyond = F.greatest("fewest", "l_fewest") - 1
        meet = meet.groupBy("a", "b", "l_b").agg(F.count("*").alias("shared"), F.first(need - beyond).alias("need")).where("shared >= need").select(*pair)
        # Sizes of pairs are in neighbouring classes of a geometric scale. A node whose share of the hub is too
        # small for a link with the least partner there takes no part.
        size = lambda n: F.floor(F.log(F.col(n).cast("double")) / max(np.log(100 / p), 1e-6)).cast("long")
        close = left.where((100 + p) * (F.col("l_both") + F.col("l_n_hot")) >= p * (F.col("l_n_b") + F.col("l_partner")))
        close = close.withColumn("size", F.explode(F.array(*[size("l_n_b") + d for d in (-1, 0, 1)])))
        alone = around.select(*plain, size("n_b").alias("size")).join(close, ["a", "size"]).where(apart & like & (need <= 0)).select(*pair)
        pairs = write(meet.union(alone).distinct())
        self.merge(self.linked(self.compare(self.likely(pairs))))
        self.scratch.drop(around, pairs)

    def result(self) -> DataFrame:
        """One row per input row: doc_id, text_hash, n_shingles, component_id."""
        nodes = self.labelled(self.nodes.select("set_key", "node", "least_id"))
        ids = self.scratch.write(nodes.groupBy("comp").agg(F.min("least_id").alias("component_id")))
        by_set = self.scratch.write(nodes.join(ids, "comp").select("set_key", "component_id"))
        return self.rows.join(by_set, "set_key", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _classes(df: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    job = _Classes(df, id_col, text_col, shingle, percent)
    job.near_hubs(job.star_rounds(job.bands()))
    return job.result()


def near_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows are linked when 100 * |intersection| >= percent * |union| of their shingle sets
    (hashes of 64 bits stand for shingles); component_id is the least id that links reach.

    Copies (equal sets) become one node. Nodes share a band when ROWS registers agree. A node is
    first compared with the one head that most of its bands agree on, which joins nearly all of a group;
    what is left is found by way of hubs (``_Classes.near_hubs``), whose bound is exact. No bucket
    is capped; a pair at the threshold misses all bands with probability 4e-7.

    Texts without a word, and null texts, are linked with nothing. Rows with a null id can
    link others but get a null component_id only when all reachable ids are null, and are kept. Repeated
    rows are copies; an id with several texts is several nodes. Extra columns are ignored. An empty
    table gives an empty result.
    """
    same = F.col("doc_id") == F.col("component_id")
    return _classes(df, id_col, text_col, shingle, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(same, F.lit(True)).alias("kept"))


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """``df`` with the rows of each component that have its least id, all columns unchanged.

    Of an id with several texts only texts of a component with a lesser id go. Repeated rows stay or go together,
    rows with a null id stay. Column names of ``df`` cannot clash. An empty table gives an empty result.
    """
    gone = _classes(df, id_col, text_col, shingle, percent).where("doc_id <> component_id")
    gone = cut(gone.select(F.struct(F.col("doc_id").alias("id"), "text_hash").alias(free_name(df, "gone"))).distinct())
    match = (named(id_col) == gone[gone.columns[0]]["id"]) & (F.xxhash64(named(text_col)) == gone[gone.columns[0]]["text_hash"])
    return df.join(gone, match, "left_anti")
