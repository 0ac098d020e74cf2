"""Substring dedup by suffix sorting: every byte covered by a 100-byte string that starts earlier
goes.

Equal 100-byte strings choose equal anchors (the smallest hash among their 32-byte substrings),
so each text falls into segments, runs of windows with one anchor, and equal windows lie in
segments of equal anchor hash.  Segments whose anchor is unique are done.  Equal segments need no
sorting: all but the first go whole.  Different segments of one anchor (the ends of repeated
passages) are sorted by deep-shallow suffix sorting: a multikey sort on 8-byte characters to a
shallow depth, then blind tries, which branch only where suffixes differ, for the groups whose
common prefix is longer.  An anchor with very many segments is sorted in chunks, and the first
windows of the chunks meet by hash.
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

LENGTH, GRAM, SHALLOW = 100, 32, 24
#: Bytes hashed at a time, segments of one anchor sorted at a time, segments of one task at least.
PIECE, CHUNK, BUCKET = 1 << 19, 1024, 1024
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers() -> list[np.ndarray]:
    """Powers of the base of the rolling hash modulo 2**64, and of its inverse."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            _powers.append(np.append(np.ones(1, np.uint64), np.cumprod(np.full(PIECE + LENGTH, base, np.uint64))))
    return _powers


def segments(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts concatenated in ``data``: for each segment the text, its first window (in
    ``data``), the number of windows, the anchor's hash and the segment's hash."""
    n, empty = len(data), np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    power, inverse = powers()
    total = np.append(np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n]))
    grams = mix((total[GRAM:] - total[:-GRAM]) * inverse[: n - GRAM + 1])
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    wide, width = LENGTH - GRAM + 1, 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: width - wide], least[wide - width :])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) <= ends[owner] - LENGTH)
    if not len(at):
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    anchor = (least[at] & _LOW).astype(np.int64)
    first = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
    start, count, anchor = at[first], np.diff(np.append(np.flatnonzero(first), len(at))), anchor[first]
    raw, ends = data.tobytes(), (start + count + LENGTH - 1).tolist()
    whole = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], d) for a, b, d in zip(start.tolist(), ends, (anchor - start).tolist())), np.uint64, len(start))
    return owner[start], start, count, grams[anchor], whole


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, sizes, row of each text, where in its row it starts) of up to PIECE bytes; a longer
    text comes in parts that share LENGTH - 1 bytes, so each window is in one of them."""
    parts, held = [], 0

    def joined():
        rows, starts, chunks = zip(*parts)
        return np.concatenate(chunks), np.array([len(c) for c in chunks]), np.array(rows), np.array(starts)

    for row, value in enumerate(batch.column(2)):
        buffer = value.as_buffer()
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        step = PIECE - LENGTH + 1
        for a in range(0, max(0, len(data) - LENGTH + 1), step):
            chunk = data[a : a + PIECE]
            if held + len(chunk) > PIECE:
                yield joined()
                parts, held = [], 0
            parts.append((row, a, chunk))
            held += len(chunk)
    if parts:
        yield joined()


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, h and text: rows that repeat a doc_id with another text are told apart by its hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("h"), F.col("text"))


def anchors(docs: DataFrame, bits: int, whole: bool) -> DataFrame:
    """anchor (``bits`` bits of its hash) of every segment and, if ``whole``, doc_id, h, at (its first
    window in the text), n (windows) and seg (the hash of the segment's bytes and its anchor's place)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, sizes, rows, starts in _texts(batch):
                owner, at, count, hashes, seg = segments(data, sizes)
                key = pa.array((mix(hashes) >> np.uint64(64 - bits)).view(np.int64))
                if not whole:
                    yield pa.RecordBatch.from_arrays([key], names=["anchor"])
                    continue
                offset = np.cumsum(sizes) - sizes
                of = pa.array(rows[owner])
                yield pa.RecordBatch.from_arrays([key, batch.column(0).take(of), batch.column(1).take(of), pa.array(at - offset[owner] + starts[owner]), pa.array(count), pa.array(seg.view(np.int64))], names=["anchor", "doc_id", "h", "at", "n", "seg"])

    return identified(docs).mapInArrow(emit, "anchor long, doc_id long, h int, at long, n long, seg long" if whole else "anchor long")


def blind_tries(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order the rows within their groups; ``group`` holds for each row the place where its group
    starts.  Returns the order and the groups of equal rows, in the same form.

    All tries grow at once, a branching a round: a group's blind trie branches at the first byte
    in which any of its rows differs from its first, and bytes before it are never looked at
    again."""
    order, group, width = np.arange(len(rows)), group.copy(), rows.shape[1]
    live = np.arange(len(rows))
    skip = np.zeros(len(rows), np.int64)
    while len(live):
        starts = np.flatnonzero(np.append(True, group[live][1:] != group[live][:-1]))
        sizes = np.diff(np.append(starts, len(live)))
        several = np.repeat(sizes > 1, sizes)
        if not several.all():
            live = live[several]
            continue
        differ = rows[order[live]] != rows[order[np.repeat(live[starts], sizes)]]
        common_prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        branch = np.repeat(np.minimum.reduceat(common_prefix, starts), sizes)
        skip[live] = branch
        live, branch = live[branch < width], branch[branch < width]
        if not len(live):
            break
        byte = rows[order[live], branch]
        by = np.lexsort((byte, group[live]))
        order[live], byte = order[live[by]], byte[by]
        first = np.append(True, (group[live][1:] != group[live][:-1]) | (byte[1:] != byte[:-1]))
        group[live] = np.repeat(live[first], np.diff(np.append(np.flatnonzero(first), len(live))))
    return order, group


def deep_shallow(data: np.ndarray, at: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of ``data`` that start at ``at`` by their first ``depth`` bytes: the order,
    and for each place in it the first place with an equal prefix."""
    n = len(at)
    order, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(0, shallow, 8):
        key = data[at[order][:, None] + np.arange(d, d + 8)].view(">u8").ravel()
        by = np.lexsort((key, group))
        order, key, group = order[by], key[by], group[by]
        first = np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1]))[:n]
        group = np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), n)))
    deep = np.flatnonzero(np.bincount(group, minlength=n)[group] > 1) if n else order
    if len(deep):
        inner = np.searchsorted(deep, group[deep])
        by, within = blind_tries(data[at[order[deep]][:, None] + np.arange(shallow, depth)], inner)
        order[deep] = order[deep[by]]
        group[deep] = deep[within]
    return order, group


def _sorted_bucket(table: pa.Table) -> pa.Table:
    """Of the segments of a bucket: the runs of windows that have an earlier equal one here (digest
    null), and of anchors sorted in chunks the digest of each window that has none."""
    docs = table["doc_id"].fill_null(-(1 << 63)).to_numpy()
    at, count, chunks, hashes = (table[c].to_numpy() for c in ("at", "n", "chunks", "h"))
    body = table["body"].combine_chunks()
    body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
    sizes = np.array([len(x) for x in body.to_pylist()], np.int64)
    data = np.frombuffer(b"".join(body.to_pylist()), np.uint8)
    segment = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
    place = (np.cumsum(sizes) - sizes)[segment] + inner
    order, group = deep_shallow(data, place)
    cls = np.empty(len(order), np.int64)
    cls[order] = group
    doc, h, where = docs[segment], hashes[segment], at[segment] + inner
    by = np.lexsort((where, h, doc, cls))
    lead = by[np.append(True, cls[by][1:] != cls[by][:-1])[: len(by)]]
    first = np.empty(len(order), np.int64)
    first[by] = np.repeat(lead, np.diff(np.append(np.flatnonzero(np.append(True, cls[by][1:] != cls[by][:-1])[: len(by)]), len(by))))
    gone = (doc != doc[first]) | (h != h[first]) | (where != where[first])
    begin = gone & ~(np.append(False, gone[:-1]) & np.append(False, segment[1:] == segment[:-1]))[: len(gone)]
    runs = np.flatnonzero(begin)
    long = np.add.reduceat(gone, runs) if len(runs) else runs
    hot = np.flatnonzero(~gone & (chunks[segment] > 1))
    null = lambda d: pa.array([None if x == -(1 << 63) else x for x in d.tolist()], pa.int64())
    raw = data.tobytes()
    digest = [xxhash.xxh3_128_digest(raw[p : p + LENGTH]) for p in place[hot].tolist()]
    return pa.table({
        "doc_id": null(np.concatenate([doc[runs], doc[hot]])), "h": pa.array(np.concatenate([h[runs], h[hot]]), pa.int32()), "at": pa.array(np.concatenate([where[runs], where[hot]]), pa.int64()),
        "n": pa.array(np.concatenate([long, np.ones(len(hot), np.int64)]), pa.int64()), "digest": pa.array([None] * len(runs) + digest, pa.binary()),
    })


def _pressed(docs: DataFrame) -> DataFrame:
    """_id, _h and body: the text, compressed before it is dealt out by document."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            body = pa.array([tool.compress(t.as_buffer() if t.is_valid else b"") for t in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), body], names=["_id", "_h", "body"])

    return identified(docs).mapInArrow(press, "_id long, _h int, body binary")


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The segments of ``wanted`` (doc_id, h, list of anchor, seg, at, n, k) with their bytes."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        names = ("anchor", "seg", "at", "n", "k")
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, h, body, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = tool.decompress(body)
                for p in parts:
                    found = raw[p["at"] : p["at"] + p["n"] + LENGTH - 1]
                    for column, x in zip(out, (doc, h, *(p[c] for c in names), found)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out[:7])] + [pa.array(out[7], pa.binary())], names=["doc_id", "h", *names, "body"])

    joined = _pressed(docs).join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h"))).select("doc_id", "h", "body", "parts")
    return joined.mapInArrow(cut_out, "doc_id long, h int, anchor long, seg long, at long, n long, k long, body binary")


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), at and n: runs of n windows, the first at byte ``at``, that occur earlier too."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    bits = min(62, max(16, int(size * 2 // (LENGTH - GRAM + 2) + 1).bit_length() + 8))
    several = anchors(docs, bits, False).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    met = common.cut(anchors(docs, bits, True).join(several, "anchor", "left_semi"), "segments")
    firsts = met.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "h", "at")).alias("first"), F.first("n").alias("n"), F.count("*").alias("c"))
    firsts = common.cut(firsts, "first-segments")
    copies = met.join(firsts.where("c > 1").select("anchor", "seg", "first"), ["anchor", "seg"]).where(~F.struct("doc_id", "h", "at").eqNullSafe(F.col("first"))).select("doc_id", "h", "at", "n")
    mixed = firsts.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    wanted = firsts.join(mixed, "anchor").groupBy(F.col("first.doc_id").alias("doc_id"), F.col("first.h").alias("h")).agg(F.collect_list(F.struct("anchor", "seg", F.col("first.at").alias("at"), "n", "k")).alias("parts"))
    bodies = common.cut(_bodies(docs, wanted), "segment-bytes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bodies.count() // BUCKET)
    dealt = bodies.dropDuplicates(["doc_id", "h", "at", "n"]).withColumn("chunks", F.ceil(F.col("k") / CHUNK).cast("long"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("anchor", F.pmod("seg", "chunks")), F.lit(buckets)))
    found = dealt.select("bucket", "doc_id", "h", "at", "n", "chunks", "body").groupBy("bucket").applyInArrow(_sorted_bucket, "doc_id long, h int, at long, n long, digest binary")
    found = common.cut(found, "sorted")
    leads = found.where("digest IS NOT NULL")
    earliest = leads.groupBy("digest").agg(F.min(F.struct("doc_id", "h", "at")).alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    later = leads.join(earliest, "digest").where(~F.struct("doc_id", "h", "at").eqNullSafe(F.col("first"))).select("doc_id", "h", "at", "n")
    return copies.unionByName(found.where("digest IS NULL").select("doc_id", "h", "at", "n")).unionByName(later)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) and spans (start and end of
    each maximal removed run) of every row.

    Null and empty texts, and texts of less than 100 bytes, lose nothing; rows that repeat a
    doc_id with the same text count as one document, and of those with another text that with the
    smaller hash is the earlier; null ids come first; other columns are ignored; an empty table
    stays empty.  Equal segments are equal by 64 bits of hash beside those of their anchor."""
    gone = repeats(docs).groupBy("doc_id", "h").agg(F.collect_list(F.struct("at", "n")).alias("runs"))  # at most a document's own

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for body, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = np.frombuffer(tool.decompress(body), np.uint8)
                edge = np.zeros(len(raw) + 1, np.int64)
                if runs:
                    at, n = (np.array([r[c] for r in runs], np.int64) for c in ("at", "n"))
                    np.add.at(edge, np.minimum(at, len(raw)), 1)
                    np.add.at(edge, np.minimum(at + n + LENGTH - 1, len(raw)), -1)
                covered = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
                for column, x in zip(out, (len(raw), int(covered.sum()), len(turns) // 2, raw[~covered].tobytes(), turns.tolist())):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    joined = _pressed(docs).join(gone, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_h") == F.col("h")), "left").select(F.col("_id").alias("doc_id"), "body", "runs")
    return joined.mapInArrow(take_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
