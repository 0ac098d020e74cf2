"""Quality rules as a short-circuit cascade.

Every rule rejects or passes a document.  Cost (seconds) and rejection of each rule are measured
on a sample of ``SAMPLE`` documents, spread over the corpus by a hash of doc_id and text; the rules then
run in order of rejection per cost and a document leaves at its first rejection.  The order
changes only the work: a document is kept if and only if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents, at most about, on which costs and rejections are estimated.
SAMPLE = 600
WORDS, SYMBOLS = re.compile(common.WORD_REGEX), re.compile(r"[#*$%&|<>]")
UPPER, LOWER = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]")


class Document:
    """A text and what rules measure on it, each measured once and only when asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    def __getattr__(self, name: str):
        value = getattr(type(self), f"_{name}")(self)
        setattr(self, name, value)
        return value

    def _words(self) -> list[str]:
        return WORDS.findall(self.text)

    def _n_words(self) -> int:
        return len(self.words)

    def _word_chars(self) -> int:
        return sum(map(len, self.words))

    def _n_symbols(self) -> int:
        return len(SYMBOLS.findall(self.text))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORDS.search(x)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        if len(self.words) < 4:
            return 0
        known: dict[str, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, len(self.words))
        size = len(known)
        pairs = ids[:-2] * size + ids[1:-1]
        if size > 2_000_000:  # three numbers no longer fit into 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, at, counts = np.unique(pairs * size + ids[2:], return_inverse=True, return_counts=True)
        found = counts[at] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            covered[k : k + len(found)] |= found
        return int(covered.sum())


#: Name and rejection of each rule.  The first two are the base.
RULES: dict[str, Callable[[Document], bool]] = {
    "short": lambda d: d.n_words < 50,
    "repeats": lambda d: 100 * d.n_repeat_words > 50 * d.n_words,
    "symbols": lambda d: 10 * d.n_symbols > d.n_words,
    "duplicate_lines": lambda d: 2 * d.n_dup_lines > len(d.lines),
    "shouting": lambda d: 10 * d.text.count("!") > d.n_words,
    "capitals": lambda d: len(UPPER.findall(d.text)) > len(LOWER.findall(d.text)),
    "word_length": lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 25 * d.n_words,
}
BASE = ("short", "repeats")


def estimate(docs: DataFrame, names: list[str], sample: int = SAMPLE) -> dict[str, tuple[float, float]]:
    """(seconds a document, share rejected) of each rule, alone on the sample."""
    total = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / max(1, total))))).limit(4 * sample)  # equal rows fall together

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for name in names:
                    began = time.perf_counter()
                    rejected[name] += RULES[name](Document(text))
                    seconds[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([seconds[k] for k in names]), pa.array([rejected[k] for k in names], pa.int64()), pa.array([n] * len(names), pa.int64())], names=["rule", "seconds", "rejected", "n"])

    found = part.select("text").mapInArrow(measure, "rule string, seconds double, rejected long, n long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n")).collect()
    return {r["rule"]: (r["s"] / max(1, r["n"]), r["r"] / max(1, r["n"])) for r in found}


def order(costs: dict[str, tuple[float, float]], names: list[str]) -> list[str]:
    """The rules by rejection per cost, the best first; ties by name."""
    return sorted(names, key=lambda k: (-costs[k][1] / max(costs[k][0], 1e-9) if k in costs else 0.0, k))


def cascade(docs: DataFrame, names: list[str] | None = None, sample: int = SAMPLE, name: str = "rejected_by") -> DataFrame:
    """All columns of ``docs`` (one named alike is replaced) and ``name``, the rule that rejects, null if kept.

    Null and empty texts have no words and are short.  Repeated rows get equal verdicts; an empty
    table stays empty."""
    ordered = order(estimate(docs, names := names or [*RULES], sample), names)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                document = Document(text)
                out.append(next((k for k in ordered if RULES[k](document)), None))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    docs = docs.drop(name)
    return docs.mapInArrow(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` string")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of each document; see ``cascade``.  The
    base is measured for all, as its numbers are asked for; the other rules then short-circuit."""
    others = [k for k in RULES if k not in BASE]
    ordered = order(estimate(docs, others, sample), others)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                document = Document(text)
                failed = RULES["short"](document) or RULES["repeats"](document)
                rows.append((*(getattr(document, m) for m in MEASURES), failed, not failed and not any(RULES[k](document) for k in ordered)))
            columns = [*zip(*rows)] if rows else [[]] * 7
            arrays = [pa.array(c, pa.int64() if i < 5 else pa.bool_()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *MEASURES, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return measure(common.documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
t AS (SELECT r, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, c IS NOT NULL AND count(*) OVER (PARTITION BY r, word, b, c) > 1 AS found, length(word) AS n FROM t),
g AS (SELECT r, n, found OR coalesce(lag(found) OVER o, false) OR coalesce(lag(found, 2) OVER o, false) AS covered FROM f WINDOW o AS (PARTITION BY r ORDER BY i)),
per AS (SELECT r, count(*) AS n_words, sum(n)::BIGINT AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words FROM g GROUP BY r),
l AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT doc_id, text, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM d JOIN l USING (r) LEFT JOIN per USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR 10 * len(regexp_extract_all(text, '!')) > n_words
            OR len(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ]')) > len(regexp_extract_all(text, '[a-zß-öø-ÿ]'))
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""
