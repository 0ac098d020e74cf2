"""Pair similarities: set and length measures as columns, character measures as Arrow UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a whole row of the table in one integer.
    Common ends are counted as they are; steps go by the characters of the shorter text."""
    start = _common_prefix(a, b)
    a, b = a[start:], b[start:]
    end = _common_prefix(a[::-1], b[::-1])
    a, b = (x[: len(x) - end] for x in sorted((a, b), key=len))
    places: dict[str, list[int]] = {}
    for i, c in enumerate(b):
        places.setdefault(c, []).append(i)
    full = row = (1 << len(b)) - 1
    bits = {c: _bits(places[c], len(b)) for c in {*a} & places.keys()}
    for c in a:
        mask = bits.get(c)
        if mask is not None:
            match = row & mask
            row = (row + match | row ^ match) & full
    return start + end + len(b) - row.bit_count()


def _bits(places: list[int], size: int) -> int:
    """The integer with these bits set."""
    made = bytearray(size // 8 + 1)
    for i in places:
        made[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(made, "little")


#: Bits of an integer that has the rows of several texts, and steps until what they carry is cleared.
ROW, STEPS = 1 << 17, 32


def lcs_lengths(mine: list[str], other: list[str]) -> np.ndarray:
    """``lcs_length`` of each of ``mine`` with each of ``other``.  The rows of many of ``other`` lie
    one behind another in one integer; STEPS free bits take what each row carries."""
    out = np.zeros((len(mine), len(other)), np.int64)
    codes = [np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32) for b in other]
    sizes = np.array([len(c) for c in codes], np.int64)
    spans = (sizes + STEPS + 7) // 8 * 8
    low = 0
    while low < len(other):
        ends = np.cumsum(spans[low:])
        high = low + max(1, int(np.searchsorted(ends, ROW, side="right")))
        starts = np.concatenate([[0], ends[: high - low - 1]])
        free = np.uint32(0xFFFFFFFF)  # no character
        laid = np.full(int(ends[high - low - 1]), free, np.uint32)
        for start, found in zip(starts.tolist(), codes[low:high]):
            laid[start : start + len(found)] = found
        whole = lambda chosen: int.from_bytes(np.packbits(chosen, bitorder="little").tobytes(), "little")
        full, size = whole(laid != free), len(laid) // 8
        bits = {chr(c): whole(laid == c) for c in np.unique(laid).tolist() if c != free}
        for i, a in enumerate(mine):
            masks, row = [bits[c] for c in a if c in bits], full
            for k in range(0, len(masks), STEPS):
                for mask in masks[k : k + STEPS]:
                    match = row & mask
                    row = row + match | row ^ match
                row &= full
            left = np.bitwise_count(np.frombuffer(row.to_bytes(size, "little"), np.uint8))
            out[i, low:high] = sizes[low:high] - np.add.reduceat(left, starts // 8, dtype=np.int64)
        low = high
    return out


def indels(mine: list[str], other: list[str], both_empty: float) -> np.ndarray:
    """``indel`` of each of ``mine`` with each of ``other``; 0 where one is empty.  Equal texts are
    measured once."""
    kinds = [[*dict.fromkeys(x)] for x in (mine, other)]
    size = [np.array([len(t) for t in x], np.float64) for x in kinds]
    whole = size[0][:, None] + size[1][None, :]
    ratio = np.divide(2.0 * lcs_lengths(*kinds), whole, out=np.full(whole.shape, both_empty), where=whole > 0)
    order = [{t: i for i, t in enumerate(x)} for x in kinds]
    return ratio[np.ix_(*([o[t] for t in x] for o, x in zip(order, (mine, other))))]


def indel(a: str, b: str) -> float:
    """1 minus the insert-and-delete distance over both lengths."""
    if a == b:
        return 1.0
    return 2.0 * lcs_length(a, b) / (len(a) + len(b))


def _pairwise(measure):
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in known:
                known[pair] = measure(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return apply


def _together(both_empty: float):
    """Like ``_pairwise`` of ``indel``: texts that are met with one text go through one integer."""

    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = [*zip(a.fillna(""), b.fillna(""))]
        by = int(len({p[1] for p in pairs}) < len({p[0] for p in pairs}))
        met: dict[str, dict[str, float]] = {}
        for pair in pairs:
            met.setdefault(pair[by], {})[pair[1 - by]] = 0.0
        for one, others in met.items():
            met[one] = dict(zip(others, indels([one], [*others], both_empty)[0].tolist()))
        return pd.Series([met[p[by]][p[1 - by]] for p in pairs], dtype="float64")

    return apply


def _train(a: str, b: str) -> float:
    return float(a == b) if not a or not b else SequenceMatcher(None, a, b).ratio()


indel_ratio = F.pandas_udf(_together(0.0), DoubleType())  #: any empty: 0
indel_ratio_empty = F.pandas_udf(_together(1.0), DoubleType())  #: both empty: 1
difflib_ratio = F.pandas_udf(_pairwise(_train), DoubleType())  #: both empty: 1; one: 0


def unless_equal(measure, a: str, b: str, equal: Column | float) -> Column:
    """``measure`` of two texts; equal ones don't leave the JVM and get ``equal``."""
    same = F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.col(b), F.lit(""))
    return F.when(same, equal).otherwise(measure(F.when(~same, F.col(a)), F.when(~same, F.col(b))))


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(empty))


def shared(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column | str, b: Column | str, both_empty: float = 1.0) -> Column:
    return share(shared(a, b), F.size(F.array_union(a, b)), both_empty)


def overlap(a: Column | str, b: Column | str) -> Column:
    """Shared over the smaller size, as the lists stand (with repeats if they have them)."""
    return share(shared(a, b), F.least(F.size(a), F.size(b)))


def length_ratio(a: Column | str, b: Column | str) -> Column:
    return share(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)), 1.0)


def _end(a: str, b: str, cut, strict: bool) -> Column:
    some = (F.length(a) >= 4) & (F.length(b) >= 4) if strict else (F.col(a) != "") & (F.col(b) != "")
    return (some & (cut(a) == cut(b))).cast("double")


def prefix4(a: str, b: str, strict: bool = False) -> Column:
    """Equal first four characters; ``strict`` asks for four on both sides, else for one."""
    return _end(a, b, lambda c: F.substring(c, 1, 4), strict)


def suffix4(a: str, b: str, strict: bool = False) -> Column:
    return _end(a, b, lambda c: F.right(F.col(c), F.lit(4)), strict)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")
