"""N-gram Jaccard join in metric space.

A document is the set of its 5-word shingles; documents link at a Jaccard similarity of
``PERCENT`` / 100 or more, and the result is the connected component of each.  Jaccard distance is
a metric, so the join runs by pivots: documents that could link meet in regions, each region gets
pivots, the distances of its documents to them are exact wherever a link is possible, every
document goes to the Voronoi region of its nearest pivot, and by the triangle inequality also to
each region that it could link into.  Regions are joined recursively, with three times the pivots
each time, for ROUNDS rounds; in the regions that still hold two components the documents are
compared in blocks by a matrix product, so that no pair of them is a row.

Documents far apart share no pivot, so the first division is by shingles: linked documents share
one of the first shingles of their sets in any common order.  The order puts the most frequent
shingles last, which keeps common passages from making regions.  Where pivots link nothing, a
region is divided the same way by a second and a third shingle.  Equal sets are one node
throughout, a pivot meets the nodes of other components only, most pivots are of a region's largest
component, and regions with the same largest component become one: a large group of copies or near
copies costs a few rows a document and isn't expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, PERCENT = 5, 75
#: Counters of each task's frequency summary, and most of the frequent shingles put last: a bound on what is broadcast (16 bytes each).
COUNTERS, FREQUENT, OFTEN = 1 << 16, 1 << 17, 3
#: Shingles by which a region may be divided: two different sets that link have at least three in common.
DEPTH = 3
#: Rounds of pivots, after which the regions left are compared in blocks: nodes, and shingles of them, on either side of one.
ROUNDS, BLOCK, HELD = 2, 1024, 1 << 20
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def normal(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, with one space between them."""
    return b" ".join(words_of(text))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word windows in order; of fewer words, one of all; of none, none."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _MULTIPLIERS[k % 5] * np.uint64(2 * (k // 5) + 1)
    return mix(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; a sort is several times faster here than numpy's hash table."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def shingle_set(text: str | None) -> np.ndarray:
    return distinct(shingles(words_of(text)))


def node_of(members: np.ndarray) -> int:
    """The number by which equal sets are one node."""
    return xxhash.xxh3_64_intdigest(members.tobytes()) - (1 << 63)


def survey(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, n_shingles and node (null without words) of every row, and
    (kind 1) the shingles that many documents have: each task keeps a Misra-Gries summary of
    COUNTERS counters and adds it at its end."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "n_shingles", "node"]
        kept, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sets = [shingle_set(t) for t in part.column(1).to_pylist()]
                rows = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), *rows], names=names)
                found = np.sort(np.concatenate(sets)) if sets else kept
                starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
                found, n = found[starts], np.diff(np.append(starts, len(found)))
                known = (n > 1) | np.isin(found, kept, assume_unique=True)
                merged, at = np.unique(np.concatenate([kept, found[known]]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n[known]]), len(merged)).astype(np.int64)
                if len(merged) > COUNTERS:
                    counts -= np.partition(counts, -COUNTERS - 1)[-COUNTERS - 1]
                    merged, counts = merged[counts > 0], counts[counts > 0]
                kept = merged
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(kept), np.int32)), pa.nulls(len(kept), pa.int64()), pa.array(counts), pa.array(kept.view(np.int64))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, "kind int, doc_id long, n_shingles long, node long")


def frequent_shingles(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Up to FREQUENT shingles that most documents have, over all documents, in order of number,
    and the rank of each from the rarest.  They only set the order of shingles, which may be any;
    results don't depend on them."""
    found = surveyed.where("kind = 1").groupBy(F.col("node").alias("shingle")).agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= OFTEN)
    top = found.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").collect()
    by_number = np.array([r["shingle"] for r in reversed(top)], np.int64).view(np.uint64)
    rank = np.argsort(by_number)
    return by_number[rank], rank


def first_shingles(members: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int, more: int = 1) -> np.ndarray:
    """The first shingles of a set, frequent ones last: as many as make sure that two linked
    documents have ``more`` in common."""
    often, rank = frequent
    if len(often) and len(members):
        at = np.minimum(np.searchsorted(often, members), len(often) - 1)
        late = often[at] == members
        members = np.concatenate([members[~late], members[late][np.argsort(rank[at[late]])]])
    return members[: len(members) - (percent * len(members) + 99) // 100 + more]


def postings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], bits: int, percent: int) -> DataFrame:
    """block (``bits`` bits of the shingle), node and n (shingles) for the first shingles of each
    set; of equal sets in a batch, once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                sets = [shingle_set(t) for t in batch.column(0).slice(a, 1000).to_pylist()]
                sets = [*{node_of(m): m for m in sets if len(m)}.items()]
                blocks = [distinct(first_shingles(m, frequent, percent) >> np.uint64(64 - bits)).view(np.int64) for _, m in sets]
                sizes = [len(b) for b in blocks]
                node, n = (np.repeat(np.array(x, np.int64), sizes) for x in ([k for k, _ in sets], [len(m) for _, m in sets]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks) if blocks else np.zeros(0, np.int64)), pa.array(node), pa.array(n)], names=["block", "node", "n"])

    return docs.select("text").mapInArrow(emit, "block long, node long, n long")


def texts_of(docs: DataFrame, wanted: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """node, n (shingles), sketch (16 bits of each of the first shingles, enough for DEPTH in common) and body (the normal
    text, compressed) for the nodes in ``wanted`` (node, doc_id)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = normal(text.as_py())
                members = distinct(shingles(body.split()))
                if node_of(members) == node:  # a repeated doc_id may have another text too
                    sketch = (first_shingles(members, frequent, percent, DEPTH) >> np.uint64(48)).astype(np.uint16)
                    for column, x in zip(out, (node, len(members), sketch.tobytes(), press.compress(body))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "n", "sketch", "body"])

    docs = docs.select(F.col("doc_id").cast("long").alias("_id"), "text")
    return docs.join(wanted, docs["_id"].eqNullSafe(wanted["doc_id"])).select("node", "text").mapInArrow(emit, "node long, n long, sketch binary, body binary").dropDuplicates(["node"])


def possible(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link.  Of two sets the one whose first shingles end first, x, has
    in common with the other at most the first shingles that both have and what follows its own:
    a bound that holds whichever of the two it is, and that equal sketch codes can only raise."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, x, m, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
                both = min(int(np.isin(x, y, kind="table").sum()), len(x), len(y)) if len(x) and len(y) else 0
                most = min(n, m, both + max(n - len(x), m - len(y)))
                keep.append(100 * most >= percent * (n + m - most))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(chosen) for k in (0, 1)], names=["a", "b"])

    sides = [bodies.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b").mapInArrow(sift, "a long, b long")


def verify(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """a, b, common and union: the exact sizes for pairs of nodes."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, last, held = zstandard.ZstdDecompressor(), None, None
        members = lambda body: distinct(shingles(press.decompress(body).split()))
        for batch in batches:
            found = []
            for k, b in enumerate(batch.column(1).to_pylist()):
                if b != last:
                    last, held = b, members(batch.column(3)[k].as_py())
                own = members(batch.column(2)[k].as_py())
                both = len(np.intersect1d(own, held, assume_unique=True))
                found.append((both, len(own) + len(held) - both))
            more = [pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=["a", "b", "common", "union"])

    first, second = bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a")), bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "body_a", "body_b").mapInArrow(sizes, "a long, b long, common long, union long")


def needed(bodies: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``bodies`` of the nodes in ``pairs`` (a, b; a written table).  The nodes are written too,
    so that Spark knows their size: it broadcasts them where they are below its threshold, and no
    other body is shuffled then; else both sides are dealt by node, as the joins to come need them."""
    ends = common.cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends-of-pairs")
    return bodies.join(ends, "node", "left_semi")


def distinct_regions(regions: DataFrame) -> DataFrame:
    """``regions`` (region, codes, node) without those of one node, and with one each of those that
    hold the same nodes."""
    parts = [F.bit_xor(F.xxhash64("node")).alias("_x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_y"), F.count("*").alias("_n")]
    per = regions.groupBy("region").agg(*parts).where("_n > 1")
    kept = per.groupBy("_x", "_y", "_n").agg(F.min("region").alias("region")).select("region")
    return regions.join(kept, "region", "left_semi")


def unsettled(regions: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``regions`` with each node's comp and the region's main (largest) component, without those of
    one component.  Regions with the same main component become one, without codes, where that is
    less work: nodes outside it, times nodes."""
    if comps is None:
        return regions.withColumns({"comp": F.col("node"), "main": F.lit(None).cast("long")})
    known = regions.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    per = known.groupBy("region", "comp").agg(F.count("*").alias("_c")).groupBy("region").agg(F.max(F.struct("_c", "comp")).alias("_top"), F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    per = per.where("_k > 1").select("region", F.col("_top.comp").alias("main"), ((F.col("_n") - F.col("_top._c")) * F.col("_n")).alias("_work"), F.col("_top._c").alias("_c"))
    known = known.join(per, "region")
    members = known.where("_c > 1").groupBy("main", "node").agg(F.first("comp").alias("comp"))
    merged = members.groupBy("main").agg((F.sum(F.when(F.col("comp") != F.col("main"), 1).otherwise(0)) * F.count("*")).alias("_after"))
    before = known.where("_c > 1").groupBy("region", "main").agg(F.first("_work").alias("_work")).groupBy("main").agg(F.sum("_work").alias("_before"), F.count("*").alias("_r"))
    joint = merged.join(before, "main").where("_r > 1 AND _after < _before").select(F.col("main").alias("_joint"))
    own = known.join(joint, (F.col("main") == F.col("_joint")) & (F.col("_c") > 1), "left")
    own = own.select(F.when(F.col("_joint").isNull(), F.col("region")).otherwise(F.xxhash64(F.lit("joint"), "main")).alias("region"), F.when(F.col("_joint").isNull(), F.col("codes")).otherwise(F.array().cast("array<int>")).alias("codes"), "node", "comp", "main")
    return own.distinct()


def by_shingle(regions: DataFrame, bodies: DataFrame) -> DataFrame:
    """The parts of ``regions`` (region, codes, node) by one shingle more: a row for each code of a
    node's first shingles besides the region's own."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                parts = []
                for own, sketch in zip(part.column(1).to_pylist(), part.column(3).to_pylist()):
                    codes = np.sort(np.frombuffer(sketch, np.uint16).astype(np.int32))
                    for code in own:  # one shingle each: another with the same code stays
                        codes = np.delete(codes, np.searchsorted(codes, code)) if code in codes else codes
                    parts.append(codes[np.append(True, codes[1:] != codes[:-1])[: len(codes)]])
                at = pa.array(np.repeat(np.arange(part.num_rows), [len(p) for p in parts]))
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(3)), pa.array(np.concatenate(parts), pa.int32())], names=["region", "codes", "node", "code"])

    made = regions.join(bodies.select("node", "sketch"), "node").select("region", "codes", "node", "sketch").mapInArrow(emit, "region long, codes array<int>, node long, code int")
    return made.select(F.xxhash64("region", "code").alias("part"), F.concat("codes", F.array("code")).alias("codes"), "node", "region")


def divided(regions: DataFrame, pivots: DataFrame, met: DataFrame, known: DataFrame, radius: float) -> DataFrame:
    """``regions`` (region, codes, node) by Voronoi region, where that is less work.  ``met``:
    region, node, pivot and the two as a and b; ``known``: the measured pairs.  A node y of the
    region of q could link into the region of p only if d(y, p) <= d(y, q) + 2 r, r the largest
    distance of a link; one whose distance isn't measured stays in.  As no distance is over 1, only
    nodes nearer than 1 - 2 r to some pivot leave any, and only such rows are joined."""
    distance = 1 - F.col("common") / F.col("union")
    close = known.where(distance < 1 - 2 * radius).select("a", "b", distance.alias("d"))
    nearest = common.cut(met.select("region", "node", "a", "b").join(close, ["a", "b"]).groupBy("region", "node").agg(F.min("d").alias("nearest")), "nearest")
    if nearest.isEmpty():
        return regions
    far = known.where(distance > 2 * radius).select("a", "b", distance.alias("d"))
    beyond = met.join(nearest, ["region", "node"]).join(far, ["a", "b"]).where(F.col("d") > F.col("nearest") + 2 * radius + 1e-9).select("region", "node", "pivot")
    beyond = common.cut(beyond, "beyond")
    if beyond.isEmpty():
        return regions
    some = beyond.select("region").distinct()
    parts = regions.join(some, "region", "left_semi").join(pivots.select("region", "pivot"), "region").join(beyond, ["region", "node", "pivot"], "left_anti")
    parts = parts.select(F.xxhash64("region", "pivot").alias("part"), "codes", "node", "region")
    return chosen(regions, common.cut(parts, "voronoi"))


def chosen(regions: DataFrame, parts: DataFrame) -> DataFrame:
    """``regions`` with those replaced by their ``parts`` (part, codes, node, region) whose parts
    are less work: the sum of the squares of their sizes is lower."""
    whole = regions.groupBy("region").agg(F.count("*").alias("_n"))
    split = parts.groupBy("region", "part").agg(F.count("*").alias("_m")).groupBy("region").agg(F.sum(F.col("_m") * F.when(F.col("_m") > 1, F.col("_m")).otherwise(0)).alias("_sum"))
    better = whole.join(split, "region").where("_sum < _n * _n").select("region")
    new = distinct_regions(parts.join(better, "region", "left_semi").select(F.col("part").alias("region"), "codes", "node"))
    return common.cut(regions.join(better, "region", "left_anti").unionByName(new), "divided")


def hooked(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after the links (a, b): each component takes the smallest number among
    those linked with it, and then that one's own.  Equal numbers are always connected; where
    connected nodes still differ, later rounds or the end bring them together."""
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if comps is not None:
        ends = ends.join(comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        ends = ends.select("a", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    else:
        ends = ends.select("a", F.col("a").alias("ca"), F.col("b").alias("cb"))
    ends = common.cut(ends, "ends")
    least = common.cut(ends.groupBy("ca").agg(F.least("ca", F.min("cb")).alias("low")), "hooks")
    least = least.join(least.select(F.col("ca").alias("low"), F.col("low").alias("lower")), "low").select("ca", F.least("low", "lower").alias("low"))
    nodes = ends.select(F.col("a").alias("node"), F.col("ca").alias("comp"))
    nodes = (nodes if comps is None else nodes.unionByName(comps.select("node", "comp"))).distinct()
    return common.cut(nodes.join(least, nodes["comp"] == least["ca"], "left").select("node", F.coalesce("low", "comp").alias("comp")), "labels")


def in_common(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``own`` has in common with each of ``other``.  Shingles that
    many pairs have go through a matrix product, the others pair by pair."""
    n, m = len(own), len(other)
    sides = []
    for sets in (own, other):
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(values, kind="stable")
        sides.append((values[order], owner[order]))
    (x, xs), (y, ys) = sides
    low, high = np.searchsorted(y, x), np.searchsorted(y, x, side="right")
    met = high > low
    x, xs, low, size = x[met], xs[met], low[met], (high - low)[met]
    known, at, a = np.unique(x, return_inverse=True, return_counts=True)
    first = np.searchsorted(x, known)
    often = a * size[first] * 200 > n * m
    out = np.zeros((n, m), np.float32)
    column = np.cumsum(often) - 1
    of_y = np.minimum(np.searchsorted(known, y), max(len(known) - 1, 0))
    in_y = known[of_y] == y if len(known) else np.zeros(len(y), bool)
    for start in range(0, int(often.sum()), BLOCK):
        made = []
        for rows, owner, kind in ((n, xs, at), (m, ys[in_y], of_y[in_y])):
            chosen = often[kind] & (column[kind] >= start) & (column[kind] < start + BLOCK)
            made.append(np.zeros((rows, BLOCK), np.float32))
            made[-1][owner[chosen], column[kind[chosen]] - start] = 1
        out += made[0] @ made[1].T
    few = ~often[at]
    xs, low, size = xs[few], low[few], size[few]
    ends = np.cumsum(size)
    edges = [0, *np.searchsorted(ends, np.arange(1 << 21, ends[-1], 1 << 21)).tolist(), len(size)] if len(size) else []
    for p, q in zip(edges, edges[1:]):
        place = np.arange(size[p:q].sum()) - np.repeat(np.cumsum(size[p:q]) - size[p:q], size[p:q])
        out += np.bincount(np.repeat(xs[p:q], size[p:q]) * m + ys[np.repeat(low[p:q], size[p:q]) + place], minlength=n * m).reshape(n, m)
    return out.astype(np.int64)


def forest(linked: np.ndarray, own: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (rows by columns) as many as hold the components ``own`` and ``other`` together."""
    labels, at = np.unique(np.concatenate([own, other]), return_inverse=True)
    labels, found = np.arange(len(labels)), []
    rows, columns = at[: len(own)], at[len(own) :]
    for i in np.flatnonzero(linked.any(axis=1)).tolist():
        there = np.flatnonzero(linked[i])
        far, first = np.unique(labels[columns[there]], return_index=True)
        mine = labels[rows[i]]
        found += [(i, int(there[k])) for k, label in zip(first, far) if label != mine]
        labels[np.isin(labels, far)] = mine
    return found


def compared(regions: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold together the components that link within ``regions`` (region, node,
    comp, main).  Of a region the nodes outside its main component meet all, in blocks; only what
    links becomes a row."""
    known = regions.join(bodies.select("node", "n"), "node").withColumn("_own", F.col("main").isNull() | (F.col("comp") != F.col("main")))
    parts = lambda of: F.ceil(F.greatest(F.sum(F.when(of, 1).otherwise(0)) / BLOCK, F.sum(F.when(of, F.col("n")).otherwise(0)) / HELD))
    dealt = known.join(known.groupBy("region").agg(parts(F.col("_own")).alias("_i"), parts(F.lit(True)).alias("_j")).where("_i > 0"), "region")
    part = lambda of: F.pmod(F.xxhash64("node"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    left = dealt.where("_own").select("region", part("_i").alias("i"), every("_j").alias("j"), F.lit(0).alias("side"), "node", "comp")
    right = dealt.select("region", every("_i").alias("i"), part("_j").alias("j"), F.lit(1).alias("side"), "node", "comp")

    def block(table: pa.Table) -> pa.Table:
        table, tool = table.combine_chunks(), zstandard.ZstdDecompressor()
        side, node, comp = (table.column(c).to_numpy() for c in ("side", "node", "comp"))
        sets = [distinct(shingles(tool.decompress(body).split())) for body in table.column("body").to_pylist()] if len(np.unique(comp)) > 1 else []
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not sets or not len(own) or not len(other):
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        size, both = np.array([len(x) for x in sets]), in_common([sets[k] for k in own], [sets[k] for k in other])
        linked = (both * 100 >= percent * (size[own][:, None] + size[other][None, :] - both)) & (comp[own][:, None] != comp[other][None, :])
        ends = np.array(forest(linked, comp[own], comp[other]), np.int64).reshape(-1, 2)
        return pa.table({"a": node[own[ends[:, 0]]], "b": node[other[ends[:, 1]]]})

    met = left.unionByName(right).join(bodies.select("node", "body"), "node")
    return met.groupBy("region", "i", "j").applyInArrow(block, "a long, b long")


def join_regions(regions: DataFrame, bodies: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """node and comp of the nodes that link within ``regions`` (region, codes, node); None if none does.

    Each round: pivots of every region (the smallest by hash in each of 1, 3, 9, ... parts),
    exact distances to them of the nodes of other components that may link
    with them, components so far, and the regions that are left.  A pivot has met all that it could
    link with in its region and leaves it.  What is left after ROUNDS is compared in blocks."""
    radius, level, comps, known = (100 - percent) / 100, 0, None, None
    linked = F.col("common") * 100 >= F.col("union") * percent
    while True:
        regions = common.cut(unsettled(regions, comps), "regions")
        if regions.isEmpty():
            return None if comps is None else components(known.where(linked))
        if level == ROUNDS:
            links = common.cut(compared(regions, bodies, percent), "links")
            if comps is None and links.isEmpty():
                return None
            return components(known.where(linked).select("a", "b").unionByName(links))
        part = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(3**level))
        pivots = regions.groupBy("region", part.alias("_part")).agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "comp")).alias("_p"))
        pivots = common.cut(pivots.select("region", F.col("_p.node").alias("pivot"), F.col("_p.comp").alias("_comp")), "pivots")
        met = regions.join(pivots, "region").where("comp <> _comp").select("region", "node", "pivot", F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        met = common.cut(met, "met")
        pairs = met.select("a", "b").distinct()
        pairs = common.cut(possible(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), bodies, percent), "possible")
        fresh = common.cut(verify(pairs, needed(bodies, pairs)), "distances")
        known = fresh if known is None else known.unionByName(fresh)
        if not fresh.where(linked).isEmpty():
            comps = hooked(comps, fresh.where(linked))
        left = regions.select("region", "codes", "node").join(pivots.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti")
        left = common.cut(left, "left")
        if level:  # with one pivot a region there is nothing to divide by
            left = divided(left, pivots, met, known, radius)
        # where no pivot linked anything, documents have little but the region's shingle in common
        held = met.join(known.where(linked).select("a", "b"), ["a", "b"], "left_semi").select("region").distinct()
        idle = left.where(F.size("codes").between(1, DEPTH - 1)).join(held, "region", "left_anti")
        wide = idle.join(bodies.select("node", "n"), "node").groupBy("region").agg(F.count("*").alias("_n"), F.sum("n").alias("_s"))
        wide = wide.where("_n * _n > _s").select("region")  # less is cheaper met by pivots
        if not wide.isEmpty():
            left = chosen(left, common.cut(by_shingle(left.join(wide, "region", "left_semi"), bodies), "by-shingle"))
        regions, level = left, level + 1


def cluster(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Null and empty texts, and texts of white space, have no shingles and link with nothing; texts
    of fewer than five words are one shingle; repeated rows fall together; an empty table stays
    empty."""
    surveyed = common.cut(survey(docs), "nodes")
    nodes = surveyed.where("kind = 0").select("doc_id", "n_shingles", "node")
    total = nodes.agg(F.sum(F.ceil(F.col("n_shingles") * (100 - percent) / 100) + 1)).first()[0] or 1
    bits = min(62, max(16, int(total).bit_length() + 7))
    frequent = frequent_shingles(surveyed)
    dealt = common.cut(postings(docs, frequent, bits, percent), "postings")
    several = dealt.groupBy("block").agg(F.count("*").alias("_n")).where("_n > 1").select("block")
    # sizes of linked documents differ by at most 100 / percent, so they lie in one class of that ratio or in neighbours
    step = F.floor(F.log("n") / float(np.log(100 / percent) * (1 + 1e-9)))
    met = dealt.join(several, "block", "left_semi").withColumn("_class", F.explode(F.array(step, step + 1)))
    met = met.select(F.xxhash64("block", "_class").alias("region"), F.shiftright("block", bits - 16).cast("int").alias("code"), "node").distinct()
    regions = distinct_regions(common.cut(met, "met-postings"))
    regions = common.cut(regions.select("region", F.array("code").alias("codes"), "node"), "first-regions")
    classes = common.cut(nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "classes")
    bodies = common.cut(texts_of(docs, classes.join(regions.select("node").distinct(), "node", "left_semi"), frequent, percent), "bodies")
    comps = join_regions(regions, bodies, percent)
    if comps is not None:
        labels = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        least = labels.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        classes = labels.join(least, "comp").select("node", "component_id")
    else:
        classes = classes.select("node", F.col("doc_id").alias("component_id"))
    return nodes.join(classes, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return cluster(common.documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM w JOIN reach ON w.doc_id = reach.a LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
