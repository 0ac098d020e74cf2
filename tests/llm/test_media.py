import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import media


@given(st.binary(max_size=9000))
@settings(max_examples=80, deadline=None)
def test_round_trip(payload):
    stored = media.store(payload, {"k": "ü"})
    back, found = media.fetch(stored)
    assert back == payload and found["tags"]["k"] == "ü" and found["skipped"] == 0
    assert found["right"] == found["checked"] == len(found["offsets"]) + 1 == found["vbr"]["frames"] + 1
    assert found["seconds"] * 32000 == found["samples"] == 1152 * len(found["offsets"])
    assert all(stored[a : a + 2] == b"\xff\xfa" for a in found["offsets"])


def test_resynchronises_and_sees_damage():
    stored = media.store(bytes(range(256)) * 20, {})
    whole = media.parse(stored)
    junk = b"\xff\xfbjunk" * 3
    at = whole["offsets"][1]
    broken = media.parse(stored[:at] + junk + stored[at:])
    assert broken["skipped"] == len(junk) and len(broken["offsets"]) == len(whole["offsets"])
    damaged = bytearray(stored)
    damaged[at + 10] ^= 1
    assert media.parse(bytes(damaged))["right"] == whole["right"] - 1
    assert media.parse(stored + b"TAG" + bytes(125))["offsets"] == whole["offsets"]
    assert media.parse(b"")["offsets"] == [] and media.parse(b"\xff" * 50)["skipped"] == 50


def test_headers():
    assert media.header(b"\xff\xfb\x90\x00")[:3] == (417, 1152, 44100)
    assert media.header(b"\xff\xf3\x40\xc0")[1:3] == (576, 22050) and media.header(b"\xff\xff\x44\x00")[:3] == (128 * 12 * 1000 // 48000 * 4, 384, 48000)
    assert media.header(b"\xff\xfb\xf0\x00") is None and media.header(b"\xff\xe9\x90\x00") is None and media.header(b"abc") is None
    assert media.crc16(b"123456789") == 0xAEE7


def test_rows(odd, empty):
    rows = media.digests(media.stored(odd)).collect()
    by = {}
    for r in odd.collect():
        raw = (r["text"] or "").encode()
        by[r["doc_id"]] = raw + bytes(-len(raw) % 64 if raw else 64), len(raw)
    assert len(rows) == odd.count()
    for r in rows:
        payload, n = by[r["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert media.digests(media.stored(empty)).count() == 0
    frames = media.frames(media.stored(odd).where("doc_id = 11")).orderBy("frame").collect()
    assert [r["start_sample"] for r in frames] == [1152 * i for i in range(len(frames))] and frames[1]["seek_offset"] == frames[0]["seek_offset"] + frames[0]["frame_bytes"]
