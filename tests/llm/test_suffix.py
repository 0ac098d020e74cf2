import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffix


def brute(rows):
    seen, out = set(), []
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out.append((doc, len(raw), sum(covered), spans, hashlib.sha256(bytes(b for b, c in zip(raw, covered) if not c)).hexdigest()))
    return out


def result(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix.dedup(df).collect())


@pytest.mark.parametrize("shallow", [0, 8, 24])
def test_deep_shallow_sorts(shallow):
    rng = np.random.default_rng(shallow)
    data = np.concatenate([rng.integers(97, 99, 400, dtype=np.uint8), np.frombuffer(b"abcabcabd" * 40, np.uint8), rng.integers(0, 256, 300, dtype=np.uint8)] * 2)
    at = rng.permutation(len(data) - 100)
    order, group = suffix.deep_shallow(data, at, 100, shallow)
    raw = data.tobytes()
    got = [raw[at[i] : at[i] + 100] for i in order]
    assert got == sorted(got) and all((got[i] == got[i - 1]) == (group[i] == group[i - 1]) for i in range(1, len(got)))


@pytest.mark.parametrize("chunk", [1024, 2])
def test_documents(small, monkeypatch, chunk):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    assert result(small) == brute([(r["doc_id"], r["text"]) for r in small.collect()])


def test_hot_passage_overlaps_and_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(20)) + passage[: len(passage) - i % 7] + " ".join(word() for _ in range(20))) for i in range(30)]
    rows += [(100, "ab" * 400), (101, "b" + "ab" * 80), (102, passage[:100]), (103, passage[:99]), (104, "é" * 120), (105, "é" * 60), (106, None), (107, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, text + text[100:3000]), (2, text[4000:8000])]
    batch = suffix.pa.RecordBatch.from_arrays([suffix.pa.array([1, 2]), suffix.pa.array([0, 0]), suffix.pa.array([t for _, t in rows])], names=["doc_id", "h", "text"])
    monkeypatch.setattr(suffix, "PIECE", 2048)
    windows = [set() for _ in rows]
    for data, sizes, where, starts in suffix._texts(batch):
        assert len(data) == sizes.sum() <= 2048
        for row, start, size in zip(where, starts, sizes):
            new = set(range(start, start + size - 99))
            assert not windows[row] & new
            windows[row] |= new
    assert [len(w) for w in windows] == [len(t) - 99 for _, t in rows]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd, empty):
    known = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    assert result(known) == brute([(r["doc_id"], r["text"]) for r in known.collect()])
    assert suffix.dedup(odd).count() == odd.count() and suffix.dedup(empty).count() == 0


def test_repeated_ids_with_other_texts(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(300)
    rows = [(1, passage + word(50)), (2, word(600)), (2, word(40) + passage + word(200)), (2, word(200) + passage), (3, word(30) + passage)]
    assert result(spark.createDataFrame(rows + rows[1:2], "doc_id long, text string")) == sorted(brute(rows) + [next(r for r in brute(rows) if r[1] == 600)])


def test_text_of_megabytes(spark):
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefgh ", k=2_200_000))
    rows = [(1, text + text), (2, text[1_000_000:1_500_000] + "end")]
    got = {r[0]: r[1:4] for r in result(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {1: (4_400_000, 2_200_000, 1), 2: (500_003, 500_000, 1)}
