"""MPEG audio columns: a lossless carrier for bytes, and a reader of real MPEG audio streams.

Writing: bytes are padded with 255 to a positive multiple of 576, and each 576 bytes are the
ancillary data of one Layer III frame (MPEG-2, 16 kHz, mono, 144 kbit/s, CRC protected, no
coded audio), so the stream plays as silence of one granule of 576 samples for each 576
bytes. A first frame holds the variable-bitrate table (frame count, byte count, 100 seek
points); an ID3v2 tag in front holds the unpadded length, an ID3v1 tag closes the stream.

Reading: tags are parsed and skipped (ID3v2.2 to 2.4, with extended headers, footers and
unsynchronisation, and ID3v1), frame headers are found again after damage or foreign
bytes (a header counts if the frame it declares is followed by a fitting header or the end),
CRC-16s of Layers I and III are verified (those of Layer II, whose span hangs on allocation
tables, are counted as unchecked), and exact durations and frame offsets kept: samples over the
rate, over the least common multiple where rates differ, less the encoder's delay and padding
where a table names them.

Null and empty texts are one unit of 255; equal bytes give equal streams. Nothing but the row
at hand is kept; a text of any length is written whole. Repeated rows are worked on each for
itself, a null doc_id is carried through, an empty table gives no rows, further columns are
left out whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import of, spread

UNIT = 576
# Fixed values of the format: kbit/s by (is MPEG-1, layer), from index 1; Hz of MPEG-1.
BITRATES = {
    (True, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = [44100, 48000, 32000]
_HEAD = bytes([0xFF, 0xF2, 0xD8, 0xC0])  # MPEG-2, Layer III, CRC; 144 kbit/s, 16 kHz; mono
_FRAME, _SIDE = 648, 9


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ 0x8005, t << 1) & 0xFFFF
    return t


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """MPEG audio CRC-16 of each row of bytes."""
    c = np.full(len(rows), 0xFFFF, np.uint32)
    for b in rows.T:
        c = (c << 8 ^ _CRC[c >> 8 ^ b]) & 0xFFFF
    return c


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2, or 25 for MPEG-2.5
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int  # bytes of Layer III side information
    covered: int | None  # bytes after the CRC that it covers; None where tables would be needed


def header(word: bytes) -> Header | None:
    """The four header bytes' meaning; None if they are no header (or of free format)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 25, 2: 2, 3: 1}.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    index, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or index in (0, 15) or rate == 3:
        return None
    kbits = BITRATES[version == 1, layer][index - 1]
    hz = RATES[rate] // {1: 1, 2: 2, 25: 4}[version]
    pad, mono = word[2] >> 1 & 1, word[3] >> 6 == 3
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12_000 * kbits // hz + pad) * 4 if layer == 1 else samples * 125 * kbits // hz + pad
    side = (17 if mono else 32) if version == 1 else (9 if mono else 17)
    if layer == 1:  # four bits for each of 32 subbands and each channel, shared ones from the bound of joint stereo on
        covered = 16 if mono else 16 + (2 * ((word[3] >> 4 & 3) + 1) if word[3] >> 6 == 1 else 16)
    else:
        covered = side if layer == 3 else None
    return Header(version, layer, not word[1] & 1, kbits, hz, mono, length, samples, side, covered)


@dataclass
class Stream:
    """What a stream holds. offsets: bytes from the start to each audio frame."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    bad_crc: int = 0
    unchecked_crc: int = 0
    resyncs: int = 0
    skipped: int = 0  # bytes that belong to no frame or tag

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    def duration(self) -> tuple[int, int]:
        """Samples and samples a second; over the least common multiple of the rates if there are several."""
        if not self.headers:
            return 0, 1
        rate = math.lcm(*{h.rate for h in self.headers})
        cut = (self.vbr.get("delay", 0) + self.vbr.get("padding", 0)) * (rate // self.headers[0].rate)
        return max(0, sum(h.samples * (rate // h.rate) for h in self.headers) - cut), rate


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _id3v2(pairs: dict[str, str]) -> bytes:
    frames = b""
    for k, v in pairs.items():
        body = b"\x03" + k.encode() + b"\0" + v.encode()
        frames += b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _syncsafe(len(frames)) + frames


def _from_syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _parse_id3v2(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """(text frames, end) of the tag at a place, or None."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return None
    major, flags, n = data[at + 3], data[at + 5], _from_syncsafe(data[at + 6 : at + 10])
    body, end = data[at + 10 : at + 10 + n], min(len(data), at + 10 + n + 10 * (major >= 4 and flags >> 4 & 1))
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    i = 0
    if flags & 0x40 and major >= 3 and len(body) >= 4:  # an extended header
        i = _from_syncsafe(body[:4]) if major >= 4 else 4 + int.from_bytes(body[:4], "big")
    name_size, head = (3, 6) if major == 2 else (4, 10)
    tags: dict[str, str] = {}
    while i + head <= len(body) and body[i]:
        name, raw = body[i : i + name_size].decode("latin-1"), body[i + name_size : i + 2 * name_size]
        n = _from_syncsafe(raw) if major >= 4 else int.from_bytes(raw, "big")
        form = body[i + 9] if major >= 3 else 0
        text, i = body[i + head : i + head + n], i + head + n
        if form & (0x0C if major >= 4 else 0xC0):  # compressed or encrypted
            continue
        text = text[1:] if form & (0x40 if major >= 4 else 0x20) else text  # a group's number
        if major >= 4:
            text = text[4:] if form & 1 else text  # its length in full
            text = text.replace(b"\xff\0", b"\xff") if form & 2 or flags & 0x80 else text
        if name[0] == "T" and text:
            value = text[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(text[0], "utf-8"), "replace")
            key, _, value = value.partition("\0") if name in ("TXXX", "TXX") else (name, "", value)
            tags[key] = value.strip("\0\ufeff")
    return tags, end


def _parse_vbr(data: bytes, at: int, h: Header) -> dict:
    """The Xing, Info or VBRI table in a frame, or nothing. seek: byte offsets from the table's frame, evenly spaced in time."""
    i = at + 4 + 2 * h.protected + h.side
    if data[i : i + 4] in (b"Xing", b"Info") and i + 120 <= len(data):
        flags, out, i = int.from_bytes(data[i + 4 : i + 8], "big"), {"kind": data[i : i + 4].decode()}, i + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], i = int.from_bytes(data[i : i + 4], "big"), i + 4
        if flags & 4:
            out["toc"], i = list(data[i : i + 100]), i + 100
            out["seek"] = [t * out.get("bytes", 0) // 256 for t in out["toc"]]
        i += 4 * (flags >> 3 & 1)
        if data[i : i + 4] in (b"LAME", b"Lavf", b"Lavc") and i + 24 <= len(data):
            both = int.from_bytes(data[i + 21 : i + 24], "big")
            out |= {"delay": both >> 12, "padding": both & 0xFFF}
        return out
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= len(data):
        size, frames, n, scale, wide, _ = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        table = [int.from_bytes(data[i : i + wide], "big") * scale for i in range(at + 62, min(at + 62 + n * wide, len(data) - wide + 1), max(wide, 1))]
        return {"kind": "VBRI", "bytes": size, "frames": frames, "seek": np.cumsum([0, *table]).tolist()}
    return {}


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    """The MPEG audio stream of a payload, a positive multiple of UNIT bytes."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, _FRAME), np.uint8)
    head = np.frombuffer(_HEAD + b"\0" * (2 + _SIDE), np.uint8).copy()
    crc = int(crc16(np.concatenate([head[2:4], head[6:]])[None])[0])
    head[4:6] = crc >> 8, crc & 255
    frames[:, : len(head)] = head
    frames[1:, len(head) : len(head) + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    size = (n + 1) * _FRAME
    toc = bytes(min(255, 256 * (_FRAME + i * n // 100 * _FRAME) // size) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, size) + toc
    frames[0, len(head) : len(head) + len(table)] = np.frombuffer(table, np.uint8)
    last = b"TAG" + b"payload".ljust(30, b"\0") + b"\0" * 94 + b"\xff"
    return _id3v2({"n_bytes": str(n_bytes)}) + frames.tobytes() + last


def read_stream(data: bytes) -> Stream:
    out, at, end, lost = Stream(), 0, len(data), False
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        out.tags["title"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    seen: dict[bytes, Header | None] = {}

    def head_at(i: int) -> Header | None:
        word = data[i : i + 4]
        if word not in seen:
            seen[word] = header(word)
        return seen[word]

    first = True
    while at < end:
        if data[at : at + 3] == b"ID3" and (tag := _parse_id3v2(data, at)):
            out.tags |= tag[0]
            at, lost = tag[1], False
            continue
        h = head_at(at)
        if h:
            after = at + h.length
            nxt = head_at(after) if after + 4 <= end else None
            known = {(x.version, x.layer, x.rate) for x in (nxt, *out.headers[-1:]) if x}
            fits = after == end or data[after : after + 3] == b"ID3" or (nxt and (nxt.version, nxt.layer) == (h.version, h.layer))
            if fits or (not lost and out.headers and after < end and (h.version, h.layer, h.rate) in known):
                table = _parse_vbr(data, at, h) if first else {}
                if table:
                    out.vbr = table
                else:
                    out.offsets.append(at)
                    out.headers.append(h)
                first, lost, at = False, False, after
                continue
        if not lost:
            out.resyncs += 1
            lost = True
        step = data.find(b"\xff", at + 1, end)
        step = end if step < 0 else step
        out.skipped += step - at
        at = step
    raw = np.frombuffer(data, np.uint8)
    for h in set(out.headers):
        if h.protected and h.covered is None:
            out.unchecked_crc += sum(x == h for x in out.headers)
        elif h.protected:
            o = np.array([o for o, x in zip(out.offsets, out.headers) if x == h])
            o = o[o + 6 + h.covered <= len(raw)]
            covered = np.concatenate([raw[o[:, None] + np.arange(2, 4)], raw[o[:, None] + np.arange(6, 6 + h.covered)]], axis=1)
            stored = raw[o + 4].astype(np.uint32) << 8 | raw[o + 5]
            out.bad_crc += int((crc16(covered) != stored).sum())
    return out


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The carried bytes: each frame's ancillary data, padding at its end left out."""
    raw = np.frombuffer(data, np.uint8)
    starts = ((o, h, 4 + 2 * h.protected + h.side) for o, h in zip(stream.offsets, stream.headers))
    o = np.array([o + k for o, h, k in starts if h.length >= k + UNIT and o + k + UNIT <= len(data)], np.int64)
    return raw[o[:, None] + np.arange(UNIT)].tobytes() if len(o) else b""


def seek(stream: Stream, sample: int) -> int | None:
    """Byte offset of the frame that holds a sample."""
    ends = np.cumsum([h.samples for h in stream.headers])
    i = int(np.searchsorted(ends, sample, "right"))
    return stream.offsets[i] if i < len(stream.offsets) else None


def _write(batches):
    for b in batches:
        media = []
        for text in b.column(1):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
            media.append(write_stream(raw.ljust(size, b"\xff"), len(raw)))
            if sum(map(len, media[-64:])) > 1 << 24:  # long rows leave early
                yield pa.RecordBatch.from_arrays([b.column(0).slice(0, len(media)), pa.array(media, pa.binary())], ["doc_id", "media"])
                b, media = b.slice(len(media)), []
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])


_FEATURES = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "duration_samples": "long", "sample_rate": "int", "bad_crc": "int", "resyncs": "int", "frame_offsets": "array<long>"}


def _read(batches):
    for b in batches:
        rows = []
        for doc, cell in zip(b.column(0).to_pylist(), b.column(1)):
            media = cell.as_buffer().to_pybytes() if cell.is_valid else b""
            s = read_stream(media)
            payload = payload_of(media, s)
            n = s.tags.get("n_bytes", "")
            n_bytes = int(n) if n.isdigit() else len(payload)
            samples, rate = s.duration()
            o = np.array(s.offsets, "<i8")
            feature = f"frames={len(o)};samples={samples};rate={rate};vbr={s.vbr.get('frames', -1)};crc_errors={s.bad_crc};resyncs={s.resyncs};offsets={zlib.crc32(o.tobytes()):08x}"
            rows.append((doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, samples, rate, s.bad_crc, s.resyncs, o.tolist()))
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
        columns = zip(*rows) if rows else [[] for _ in _FEATURES]
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in zip(_FEATURES.values(), columns)], list(_FEATURES))


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes as an MPEG audio stream."""
    return spread(of(docs, doc_id="long", text="string")).mapInArrow(_write, "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Payload digests, exact duration, checksum errors and frame offsets of (doc_id, media)."""
    return media.select("doc_id", "media").mapInArrow(_read, ", ".join(f"{k} {v}" for k, v in _FEATURES.items()))
