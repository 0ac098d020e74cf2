import hashlib
import io

import pytest

from lodestone.llm import warc

from .conftest import DATA, same

PAGES = [(3, "http://a/", "x" * 200), (1, None, "x" * 200), (2, "http://b/\r\nX: y", "x" * 200), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "é" * 200_000), (8, "u", "a\r\n\r\nb" * 40), (1, None, "x" * 200), (None, "u", "no id " * 30)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 0, "size") for p in PAGES], "page_id long, url string, html string, size int, digest string")


def test_equals_sql(spark, duck):
    same(warc.op10_warc(spark, DATA), duck.sql(warc.SQL))


def test_odd_rows(pages):
    rows = warc.read(warc.write(warc.plan_records(pages), 1000)).collect()
    want = []
    for page, _, html in PAGES:
        raw = (html or "").encode()
        revisit = page in (2, 3)
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert warc.read(warc.write(warc.plan_records(pages.limit(0)))).count() == 0


def test_chunks_are_bounded_and_carry_digests(pages):
    chunks = warc.write(warc.plan_records(pages.where("page_id = 7")), 1000).orderBy("chunk").collect()
    body = b"".join(c["data"] for c in chunks[1:-1])
    assert max(len(c["data"]) for c in chunks[1:]) <= 1000 and body == ("é" * 200_000).encode()
    assert [c["payload_digest"] for c in chunks[1:4]] == [hashlib.sha256(body[: 1000 * k]).hexdigest() for k in (1, 2, 3)]


def test_export_is_one_file(pages):
    warc.export(warc.write(warc.plan_records(pages)), out := io.BytesIO())
    data, records = out.getvalue(), []
    while data:
        reader = warc.Reader()
        rest = reader.feed(data)
        assert rest[:4] == b"\r\n\r\n"
        records.append(reader.row())
        data = rest[4:]
    assert len(records) == len(PAGES)


def test_damage_is_seen(spark, pages):
    chunks = warc.write(warc.plan_records(pages.where("page_id = 8"))).collect()
    bad = [(c["record"], c["chunk"], bytearray(c["data"]), c["payload_digest"]) for c in chunks]
    bad[1][2][5] ^= 1
    with pytest.raises(Exception, match="damaged"):
        warc.read(spark.createDataFrame(bad, warc.CHUNKS)).collect()


def test_damage_in_a_middle_chunk_is_found_there(spark):
    page = spark.createDataFrame([(1, "u", "abcdefghij" * 600)], "page_id long, url string, html string")
    chunks = sorted(warc.write(warc.plan_records(page), 1000).collect(), key=lambda c: c["chunk"])
    assert len(chunks) == 8
    bad = [(c["record"], c["chunk"], bytearray(c["data"]), "0" * 64 if c["chunk"] == 2 else c["payload_digest"]) for c in chunks]
    with pytest.raises(Exception, match="damaged chunk 2"):
        warc.read(spark.createDataFrame(bad, warc.CHUNKS)).collect()


def test_payload_of_a_hundred_megabytes(spark):
    from pyspark.sql import functions as F

    page = spark.range(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("0123456789abcdef"), 7_000_000).alias("html"))
    row = warc.read(warc.write(warc.plan_records(page))).collect()[0]
    assert (row["payload_bytes"], row["payload_digest"]) == (112_000_000, hashlib.sha256(b"0123456789abcdef" * 7_000_000).hexdigest())
