from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import packing


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=6), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_fullest_is_fullest(counts, room):
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= room}
    chosen = packing.fullest(counts, room)
    assert sum(n * m for n, m in chosen.items()) == max(reach)
    assert all(m <= counts[n] for n, m in chosen.items())


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_places_all(histogram):
    placed, fill = defaultdict(int), defaultdict(int)
    rows = packing.plan(histogram, 64)
    for k, (n, first, per, bins, offset) in enumerate(rows):
        until = rows[k + 1][1] if k + 1 < len(rows) and rows[k + 1][0] == n else histogram[n]
        assert first == placed[n]
        placed[n] = until
        for rank in range(until - first):
            fill[bins + rank // per] += n
    assert dict(placed) == histogram and max(fill.values(), default=0) <= 64
    assert len(fill) <= 2 * -(-sum(n * c for n, c in histogram.items()) // 64) + 1


def check(rows, texts, path):
    own = Tokenizer.from_file(path)
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 1024
    for doc, text in texts.items():
        ids = np.array(own.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        got = {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[doc]}
        cut, k = len(ids) % 1024 or 1024, 0
        a, b, want = 0, cut, set()
        while a < len(ids):
            want.add((k, a, b - a, packing.zlib.crc32(ids[a:b].tobytes())))
            a, b, k = b, b + 1024, k + 1
        assert got == want
    return len(places)


def test_documents(small, spark):
    path = packing.tokenizer_path()
    rows = packing.pack_documents(small, path).collect()
    total = sum(r["length"] for r in rows)
    bins = check(rows, {r["doc_id"]: r["text"] for r in small.collect()}, path)
    assert bins <= total / 1024 * 1.1 + 1


def test_odd_rows(odd, empty):
    path = packing.tokenizer_path()
    rows = packing.pack_documents(odd, path).collect()
    check(rows, {r["doc_id"]: r["text"] for r in odd.collect()}, path)
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and {r["length"] for r in rows if r["doc_id"] in (0, 1)} == {1}
    assert packing.pack_documents(empty, path).count() == 0


def test_ids_come_along(odd):
    row = packing.pieces(odd, packing.tokenizer_path(), with_ids=True).where("doc_id = 3").first()
    assert packing.zlib.crc32(row["ids"]) == row["ids_crc32"] and row["length"] * 4 == len(row["ids"])


@pytest.mark.parametrize("width", [1, 7])
def test_equal_lengths(spark, width):
    rows = packing.pack(spark.range(25).selectExpr("id AS doc_id", "0 AS piece", "1L AS length"), width).collect()
    assert len({r["sequence_id"] for r in rows}) == -(-25 // width)
