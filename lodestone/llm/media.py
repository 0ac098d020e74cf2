"""Media columns: MPEG audio.

``store`` carries any bytes losslessly as the ancillary data of silent MPEG-1 Layer III frames:
an ID3v2 tag, a variable-bitrate table in the first frame, then 320 kbit/s frames and a last one
just large enough.  ``parse`` walks any MPEG audio stream: it resynchronises on frame headers,
parses tags and the variable-bitrate table, verifies frame checksums, and yields the exact
duration and the seek offset of every frame.  It does not read other frames of ID3v2 than TXXX,
sizes over 127 of ID3v2.3 (all are taken for syncsafe), ID3v1 (skipped), VBRI tables (taken for a
frame of sound), or checksums of Layers I and II.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Fixed values of the format: kbit/s by header index, and Hz by header index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
RATE, STEREO_INFO, OVERHEAD = 32000, 32, 4 + 2 + 32


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """The checksum of MPEG audio frames: polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def header(head: bytes) -> tuple[int, int, int, int, int] | None:
    """(frame bytes, samples, Hz, bytes under the checksum or 0 if there is none or it isn't
    checked, side information bytes) of a 4-byte header, or None if it isn't one."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, guarded = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3), not head[1] & 1
    index, rate, padding, mono = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1, head[3] >> 6 == 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kind = 1 if version == 3 else 2
    bits, hz = KBITS[kind, layer][index] * 1000, RATES[version][rate]
    if layer == 1:
        return (12 * bits // hz + padding) * 4, 384, hz, 0, 0
    samples = 1152 if layer == 2 or kind == 1 else 576
    side = (17 if mono else 32) if kind == 1 else (9 if mono else 17)
    return samples // 8 * bits // hz + padding, samples, hz, (side if layer == 3 and guarded else 0), (side if layer == 3 else 0)


_heads: dict[bytes, tuple | None] = {}
_sums: dict[bytes, int] = {}


def _header(head: bytes) -> tuple | None:
    if head not in _heads:
        if len(_heads) > 4096:
            _heads.clear()
        _heads[head] = header(head)
    return _heads[head]


def _checksum(covered: bytes) -> int:
    if covered not in _sums:
        if len(_sums) > 4096:
            _sums.clear()
        _sums[covered] = crc16(covered)
    return _sums[covered]


def _head(kbits: int) -> bytes:
    return bytes([0xFF, 0xFA, KBITS[1, 3].index(kbits) << 4 | 2 << 2, 0])  # MPEG-1 Layer III, checksum, 32 kHz, stereo


def _frame(kbits: int, body: bytes) -> bytes:
    head, side = _head(kbits), bytes(STEREO_INFO)
    frame = head + _checksum(head[2:4] + side).to_bytes(2, "big") + side + body
    return frame + bytes(144 * kbits * 1000 // RATE - len(frame))


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def store(payload: bytes, tags: dict[str, str]) -> bytes:
    """An MPEG audio stream that carries ``payload``; ``tags`` go into its ID3v2 tag."""
    room = 144 * 320 * 1000 // RATE - OVERHEAD
    cuts = range(0, len(payload), room)
    frames = [_frame(320, payload[a : a + room]) for a in cuts[:-1]]
    last = payload[cuts[-1] :] if cuts else b""
    frames.append(_frame(next(k for k in KBITS[1, 3][1:] if 144 * k * 1000 // RATE - OVERHEAD >= len(last)), last))
    sizes = np.cumsum([0, *map(len, frames)])
    info_size = 144 * 64 * 1000 // RATE
    total = info_size + int(sizes[-1])
    at = (np.arange(100) * len(frames)) // 100
    toc = np.minimum(255, (info_size + sizes[at]) * 256 // total).astype(np.uint8).tobytes()
    info = _frame(64, b"Xing" + struct.pack(">III", 7, len(frames), total) + toc)
    fields = tags | {"payload_bytes": str(len(payload)), "payload_crc32": str(zlib.crc32(payload))}
    body = b""
    for key, value in fields.items():
        text = b"\x03" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"".join((b"ID3\x04\0\0", _syncsafe(len(body)), body, info, *frames))


def parse(data: bytes) -> dict:
    """tags, vbr (frames, bytes and table if there is one), offsets, sizes, starts (in samples),
    samples, seconds (an exact fraction), checksums (checked, right), skipped bytes and body (what
    the frames carry behind header, checksum and side information)."""
    out: dict = {"tags": {}, "vbr": None, "skipped": 0, "checked": 0, "right": 0}
    offsets, sizes, starts, bodies, clock, played, at, end = [], [], [], [], 0, {}, 0, len(data)
    if data[:3] == b"ID3" and end >= 10:
        size = sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
        p, at = 10, 10 + size
        while p + 10 <= at and data[p : p + 1] != b"\0":
            n = sum((b & 0x7F) << s for b, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0)))
            if data[p : p + 4] == b"TXXX":
                key, _, value = data[p + 11 : p + 10 + n].partition(b"\0")
                out["tags"][key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
            p += 10 + n
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    while at < end:
        found = _header(data[at : at + 4])
        after = at + found[0] if found else 0
        right = bool(found and found[3]) and _checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + found[3]]) == int.from_bytes(data[at + 4 : at + 6], "big")
        if not found or after > end or not right and after < end and not _header(data[after : after + 4]):
            nxt = data.find(b"\xff", at + 1, end)  # no frame unless its checksum is right or another follows
            out["skipped"] += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        size, samples, hz, covered, side = found
        body = at + 4 + 2 * (not data[at + 1] & 1) + side
        out["checked"] += covered > 0
        out["right"] += right
        if not offsets and out["vbr"] is None and data[body : body + 4] in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
            table = {"frames": None, "bytes": None, "toc": b""}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                table["toc"] = data[p : p + 100]
            out["vbr"] = table
        else:
            offsets.append(at)
            sizes.append(size)
            starts.append(clock)
            bodies.append(data[body : at + size])
            clock += samples
            played[hz] = played.get(hz, 0) + samples
        at += size
    return out | {"offsets": offsets, "sizes": sizes, "starts": starts, "samples": clock, "seconds": sum((Fraction(n, hz) for hz, n in played.items()), Fraction(0)), "body": b"".join(bodies)}


def fetch(data: bytes) -> tuple[bytes, dict]:
    """The payload that ``store`` put into ``data``, and what ``parse`` found."""
    found = parse(data)
    payload = found["body"]
    n = int(found["tags"]["payload_bytes"])
    # every frame but the last is full, so the payload is a prefix of what the frames carry
    payload = payload[:n]
    if len(payload) != n or zlib.crc32(payload) != int(found["tags"]["payload_crc32"]):
        raise ValueError("the stored payload is damaged")
    return payload, found


def feature(found: dict) -> str:
    """Exact duration, seek table and checks of a parsed stream, as text."""
    seek = zlib.crc32(np.array(found["offsets"], dtype="<u8").tobytes())
    vbr = found["vbr"] or {"frames": "-"}
    return f"frames={len(found['offsets'])};samples={found['samples']};seconds={found['seconds']};vbr_frames={vbr['frames']};crc={found['right']}/{found['checked']};skipped={found['skipped']};seek_crc32={seek}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the text as UTF-8 (null: empty), filled with bytes 0 up to a
    positive multiple of 64, as an MPEG audio stream.  Equal texts give equal media; repeated rows
    and null ids stay rows of their own; other columns are ignored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # media are as long as texts: small batches bound memory
                part = batch.slice(a, 256)
                sizes, media = [], []
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    sizes.append(len(raw))
                    media.append(store(raw + bytes(-len(raw) % 64 if raw else 64), {"content": "text/plain; charset=utf-8"}))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """Read every stream back: payload size, hash and tail checksum, the stored form's size and
    hash, and its feature."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for value in batch.column(2):
                data = value.as_py()
                payload, found = fetch(data)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(found))
                for column, x in zip(out, row):
                    column.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(out, kinds))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def frames(media: DataFrame) -> DataFrame:
    """One row per audio frame of each ``media`` stream: doc_id, frame, seek_offset, frame_bytes,
    start_sample."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = parse(value.as_py() or b"")
                n = len(found["offsets"])
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int64()), *(pa.array(found[k], pa.int64()) for k in ("offsets", "sizes", "starts"))], names=["doc_id", "frame", "seek_offset", "frame_bytes", "start_sample"])

    return media.select("doc_id", "media").mapInArrow(read, "doc_id long, frame long, seek_offset long, frame_bytes long, start_sample long")


def op3_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    return digests(common.cut(stored(common.documents(spark, sf_dir)), "media"))
