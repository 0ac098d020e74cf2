"""Line dedup by a deletion-neighbourhood join.

A line is its words.  A line of ``MIN_WORDS`` words or more, that is any with a word, goes if an
earlier line (by doc_id, then place) has the same words or, where both have ``NEAR_WORDS`` words or more, lies within one
word inserted, deleted or replaced; what is earlier is judged on the input.  Copies fold into one
distinct line first.  Of the distinct lines only suspects go on: lines within one edit agree in
their first or their second half, so lines that share neither half with another are done.  For
the suspects all variants with one word deleted are emitted as hashed keys, equal variants meet,
the edit distance is verified, and the earliest line of each neighbourhood stays.
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

MIN_WORDS, NEAR_WORDS = 1, 10


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _halves(words: list[bytes]) -> list[int]:
    """Hashes of the first and second halves that a line within one edit shares at least one of:
    those for its own number of words and for one word less."""
    n = len(words)
    ends = {("p", n // 2), ("p", (n - 1) // 2), ("s", n - n // 2), ("s", (n - 1) - (n - 1) // 2)}
    return [xxhash.xxh3_64_intdigest(side.encode() + b" ".join(words[:k] if side == "p" else words[n - k :])) - (1 << 63) for side, k in sorted(ends)]


def lines_of(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """doc_id, line (from 0), key and, for lines long enough, halves."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, keys, halves = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    words = line.split()
                    if len(words) >= min_words:
                        ids.append(doc)
                        places.append(k)
                        keys.append(_key(words))
                        halves.append(_halves(words) if len(words) >= near_words else [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(keys, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], names=["doc_id", "line", "key", "halves"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, "doc_id long, line long, key binary, halves array<long>")


def _pressed(docs: DataFrame) -> DataFrame:
    """``docs`` with its text compressed (null stays null), before it is dealt out by document."""
    names = docs.columns

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [None if t is None else tool.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)

    return docs.mapInArrow(press, ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema))


def _words_of(wanted: DataFrame) -> DataFrame:
    """key, place and word hashes (8 bytes each) of the lines that ``wanted`` (doc_id, text pressed,
    lines: the places wanted) names."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text, places in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows = tool.decompress(text).split(b"\n") if text else []
                for k in places:
                    if k < len(rows) and (words := rows[k].split()):
                        for column, x in zip(out, (doc, k, _key(words), b"".join(xxhash.xxh3_64_digest(w) for w in words))):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "line", "key", "words"])

    return wanted.select("doc_id", "text", "lines").mapInArrow(pick, "doc_id long, line long, key binary, words binary")


def _variants(suspects: DataFrame) -> DataFrame:
    """Each suspect itself (cut -1) and with each of its words deleted (cut: the word's place), as
    a 64-bit hash of the words left: a polynomial, so that all of a line's take one pass."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero, one = np.zeros(1, np.uint64), np.ones(1, np.uint64)
        for batch in batches:
            hashes, cuts, sizes = [], [], []
            for value in batch.column(3).to_pylist():
                words = np.frombuffer(value, dtype="<u8")
                n = len(words)
                powers = np.append(one, np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64)))
                left = np.append(zero, np.cumsum(words * powers[:n]))
                right = np.append(np.cumsum((words[1:] * powers[: n - 1])[::-1])[::-1], zero)
                hashes.append(np.append(left[n], left[:n] + right).view(np.int64))
                cuts.append(np.arange(-1, n))
                sizes.append(n + 1)
            at = np.repeat(np.arange(batch.num_rows), sizes)
            rows = [batch.column(k).take(pa.array(at, pa.int64())) for k in (0, 1, 2)]
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.concatenate(hashes or [empty])), pa.array(np.concatenate(cuts or [empty]))], names=["doc_id", "line", "key", "variant", "cut"])

    return suspects.select("doc_id", "line", "key", "words").mapInArrow(emit, "doc_id long, line long, key binary, variant long, cut long")


def within_one(a: bytes, b: bytes) -> bool:
    """Whether two sequences of 8-byte words lie within one edit."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if len(x) > len(y):
        x, y = y, x
    n = len(x)
    if len(y) - n > 1:
        return False
    if len(y) == n:
        return int((x != y).sum()) <= 1
    differ = np.flatnonzero(x != y[:n])
    return not len(differ) or bool((x[differ[0] :] == y[differ[0] + 1 :]).all())


def _verify(pairs: DataFrame) -> DataFrame:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within_one(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near, pa.bool_())) for c in batch.columns[:3]], names=["doc_id", "line", "key"])

    return pairs.select("doc_id", "line", "key", "words", "other").mapInArrow(check, "doc_id long, line long, key binary")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """doc_id, line and key of the distinct lines that have an earlier line within one edit.
    ``distinct``: key, first (doc_id, line) and halves."""
    halves = distinct.select("key", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    suspects = halves.join(shared, "half", "left_semi").select("key").distinct()
    wanted = distinct.select("key", "first").join(suspects, "key", "left_semi").select(F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))  # at most a document's own lines
    texts = _pressed(docs.select(F.col("doc_id").cast("long").alias("_id"), "text"))
    suspects = common.cut(_words_of(texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")))).dropDuplicates(["doc_id", "line", "key"]), "suspects")
    emitted = _variants(suspects)
    several = emitted.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1").select("variant")
    variants = common.cut(emitted.join(several, "variant", "left_semi").select("variant", "cut", F.struct("doc_id", "line").alias("me")), "variants")
    # lines that agree after deleting a word at the same place differ in that word alone; a line that is a variant of others is one word shorter
    groups = variants.groupBy("variant", "cut").agg(F.min("me").alias("lead"), F.count("*").alias("n"))
    same = groups.where("cut >= 0 AND n > 1").select("variant", "cut", "lead")
    whole = groups.where("cut = -1").select("variant", F.col("lead").alias("whole"))
    shorter = groups.where("cut >= 0").groupBy("variant").agg(F.min("lead").alias("lead"))
    candidates = (
        variants.join(same, ["variant", "cut"]).select("me", "lead")
        .unionByName(variants.where("cut >= 0").join(whole, "variant").select("me", F.col("whole").alias("lead")))
        .unionByName(whole.join(shorter, "variant").select(F.col("whole").alias("me"), "lead"))
    ).where("lead < me").distinct()
    of = suspects.select(F.struct("doc_id", "line").alias("me"), "key", "words")
    pairs = candidates.join(of, "me").join(of.select(F.col("me").alias("lead"), F.col("words").alias("other")), "lead")
    return _verify(pairs.select("me.*", "key", "words", "other")).distinct()


def drops(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, line, key and near (false: an earlier line has the same words) of the lines to go."""
    lines = common.cut(lines_of(docs, min_words, near_words), "lines")
    distinct = common.cut(lines.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.first("halves").alias("halves"), F.count("*").alias("n")), "distinct-lines")
    repeated = distinct.where("n > 1").select("key", "first")
    exact = lines.select("doc_id", "line", "key").join(repeated, "key").where(~F.struct("doc_id", "line").eqNullSafe(F.col("first")))
    return exact.select("doc_id", "line", "key", F.lit(False).alias("near")).unionByName(near_lines(docs, distinct).withColumn("near", F.lit(True)))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """The columns of ``docs``, text without the lines that go, and n_lines, n_exact, n_near (lines
    before, and gone by either kind; columns of these names are replaced).

    Null text stays null with no line; lines without a word stay; rows that repeat a doc_id with
    the same text count as one document; an empty table stays empty."""
    docs = docs.drop("n_lines", "n_exact", "n_near")
    own_id, own_gone = common.fresh(docs, "_id"), common.fresh(docs, "_gone")
    gone = drops(docs.select("doc_id", "text"), min_words, near_words).groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_list(F.struct("line", "key", "near")).alias(own_gone))
    joined = _pressed(docs).join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)), "left").drop(own_id)
    names = docs.columns

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, counts = [], []
            at, last = batch.schema.get_field_index("text"), batch.schema.get_field_index(own_gone)
            for text, gone in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist()):
                if text is None:
                    texts.append(None)
                    counts.append((0, 0, 0))
                    continue
                rows, out, went = tool.decompress(text).decode("utf-8", "surrogatepass").split("\n"), [], [0, 0]
                named = {(g["line"], g["key"]): g["near"] for g in gone or ()}
                at_lines = {k for k, _ in named}
                for k, line in enumerate(rows):
                    near = named.get((k, _key(line.encode("utf-8", "surrogatepass").split()))) if k in at_lines else None
                    if near is None:
                        out.append(line)
                    else:
                        went[near] += 1
                texts.append("\n".join(out))
                counts.append((len(rows), *went))
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in names]
            more = [pa.array(c, pa.int64()) for c in (zip(*counts) if counts else ([], [], []))]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=[*names, "n_lines", "n_exact", "n_near"])

    return joined.mapInArrow(rebuild, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_exact long, n_near long")


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(common.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(common.whole().cast("binary"), 256).alias("kept_sha256"))
