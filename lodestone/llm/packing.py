"""Best-fit packing by minimum bin slack.

Token counts are at most ``width``, so the whole corpus is described by a histogram of ``width``
numbers however large it is.  The packing is planned on that histogram: per bin the largest
length left is placed, a bitset subset-sum dynamic program over the lengths still available finds
the fullest feasible combination for the rest, and the combination is removed as many times as
the histogram holds it.  The plan (a few thousand rows, bounded by ``width``) is then applied to
the pieces by their rank within their length, so no bin is ever formed in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text under the tokenizer file ``path`` without special tokens added.  A byte-level
    BPE whose ranks lie beside it (``.tiktoken``) is run by the faster library; texts that spell a
    special token go through ``tokenizers`` itself."""
    import base64
    import json

    import public_tokenizers
    import tiktoken
    from pathlib import Path
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    special = [t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]]
    slow = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return slow
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return lambda text: slow(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), dtype="<u4")


_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def pieces(docs: DataFrame, tokenizer_path: str, width: int = 1024, eos: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 (and the ids as
    little-endian 32-bit ``ids`` if asked).

    A document is its ids and then ``eos``; null or empty text is ``eos`` alone.  Documents longer
    than ``width`` are cut so that only their first piece may be shorter.  Repeated rows give
    repeated pieces; other columns are ignored."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, encoder(tokenizer_path))
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(eos)).astype("<u4")
                first = len(ids) % width or width
                starts = [0, *range(first, len(ids), width)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    data = ids[a:b].tobytes()
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(data), data)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(v, t) for v, t in zip(out, kinds)][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, PIECES + (", ids binary" if with_ids else ""))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum of at most ``room``."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan(histogram: dict[int, int], width: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces of it per bin, first bin, offset in the bin)."""
    counts = {n: c for n, c in histogram.items() if c}
    used, rows, bins = dict.fromkeys(counts, 0), [], 0
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        combination = fullest(counts, width - seed)
        counts[seed] += 1
        combination[seed] = combination.get(seed, 0) + 1
        times = min(counts[n] // m for n, m in combination.items())
        offset = 0
        for n, m in sorted(combination.items(), reverse=True):
            rows.append((n, used[n], m, bins, offset))
            offset += n * m
            used[n] += m * times
            counts[n] -= m * times
            if not counts[n]:
                del counts[n]
        bins += times
    return sorted(rows)


def pack(items: DataFrame, width: int = 1024) -> DataFrame:
    """Add sequence_id and offset to rows that have doc_id, piece and length (1 to ``width``).

    Every row is placed exactly once, repeated rows and null ids too; an empty table stays empty.
    ``items`` is read more than once: pass a table, not an expensive plan."""
    histogram = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most width rows
    total = sum(histogram.values())
    rows = np.array(plan(histogram, width) or [(0, 0, 1, 0, 0)], dtype=np.int64)
    shift = max(1, total).bit_length()
    keys = (rows[:, 0] << shift) + rows[:, 1]
    buckets = max(1, round(total**0.5))
    dealt = items.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    bases = dealt.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bases.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_in", F.row_number().over(within)).join(bases, ["_bucket", "length"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_in") - 1).drop("_bucket", "_base", "_in")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            inner = rank - rows[at, 1]
            columns = [c for c in batch.schema.names if c != "_rank"]
            more = [pa.array(rows[at, 3] + inner // rows[at, 2]), pa.array(rows[at, 4] + inner % rows[at, 2] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in columns] + more, names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, path: str, width: int = 1024, eos: int = 2) -> DataFrame:
    """Tokenize, cut and pack ``docs``; see ``pieces`` and ``pack`` for nulls, ties and empty tables."""
    return pack(common.cut(pieces(docs, path, width, eos), "pieces"), width).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir), tokenizer_path())
