"""Language identification by hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  A trigram is its letters' vectors, rotated
by their place and multiplied (binding); a text is the sum of its trigrams (bundling); a
language's prototype is the sum of its training texts, each of length one.  A text has the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS, SEED, SCALE = 1024, 20_000, 1 << 20
BATCH = 48  # texts whose counts are multiplied with the trigram vectors at once

_letter_table: list[np.ndarray] = []
_vectors: dict[int, np.ndarray] = {}


def _is_letter() -> np.ndarray:
    if not _letter_table:
        _letter_table.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letter_table[0]


def _vector(letter: int) -> np.ndarray:
    if letter not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        _vectors[letter] = np.random.default_rng([SEED, letter]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
    return _vectors[letter]


def trigrams(text: str | None) -> np.ndarray:
    """The trigrams of a text, three code points of 21 bits in a number: letters in lower case,
    words set off by single spaces.  Empty without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = _is_letter()[points]
    if not letters.any():
        return np.zeros(0, np.int64)
    points = np.where(letters, points, 32)
    points = points[letters | np.append(False, letters[:-1])]
    points = np.concatenate(([32], points, [32] if points[-1] != 32 else []))
    points = points.astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


def bundle(texts: list[str | None]) -> np.ndarray:
    """A row of DIMENSIONS for each text, of length one, or zeros without letters."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for a in range(0, len(texts), BATCH):
        grams = [trigrams(t) for t in texts[a : a + BATCH]]
        codes, at = np.unique(np.concatenate(grams), return_inverse=True)
        if not len(codes):
            continue
        rows = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        counts = np.bincount(rows * len(codes) + at, minlength=len(grams) * len(codes)).reshape(len(grams), len(codes)).astype(np.float32)
        for b in range(0, len(codes), 4096):  # bounds memory for scripts with many letters
            part = codes[b : b + 4096]
            bound = np.ones((len(part), DIMENSIONS), np.int8)
            for place, shift in ((2, 42), (1, 21), (0, 0)):
                letters, index = np.unique(part >> shift & 0x1FFFFF, return_inverse=True)
                bound *= np.stack([np.roll(_vector(int(x)), place) for x in letters])[index]
            out[a : a + BATCH] += counts[:, b : b + 4096] @ bound.astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length, length, 1)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of ``labelled`` (text, lang) and their prototypes, one row each.  Sums are of
    whole numbers, so any order of the rows gives the same prototypes.  What comes to the driver
    is DIMENSIONS numbers a language."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            vectors = np.rint(bundle(batch.column(0).to_pylist()) * SCALE).astype(np.int64)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0)
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([vector.tolist()], pa.list_(pa.int64()))], names=["lang", "vector"])

    parts = labelled.select("text", "lang").mapInArrow(sums, "lang string, vector array<long>")
    summed = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).collect()
    langs = sorted({r["lang"] for r in summed})
    matrix = np.zeros((len(langs), DIMENSIONS))
    for r in summed:
        matrix[langs.index(r["lang"]), r["pos"]] = r["x"]
    return langs, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1)


def identify(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, 0 to 1) of every row of ``docs``.

    Null text and text without letters are ``und`` with score 0, and so is everything if there
    was nothing to learn from.  Ties go to the first language by name."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = bundle(batch.column(2).to_pylist()).astype(np.float64)
            cosines = np.round(vectors @ matrix.T, 6) if langs else np.zeros((len(vectors), 1))
            best, some = cosines.argmax(axis=1), vectors.any(axis=1) & bool(langs)
            pred = [langs[b] if s else "und" for b, s in zip(best, some)]
            score = np.where(some, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return identify(docs, *prototypes(docs.where(~held_out() & F.col("lang").isNotNull())))
