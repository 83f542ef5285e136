"""MPEG audio as a media column: frame headers with resynchronisation, tags, variable-bitrate tables, checksums, durations and offsets.

parse() reads MPEG-1, 2 and 2.5 streams of Layers I to III, free-format frames among them, with ID3v1, ID3v2.2 to 2.4 and APEv2 tags. store_bytes() writes a lossless
carrier for arbitrary bytes: Layer III frames at 48 kHz whose side information says silence, with the bytes as ancillary data, a
checksum in every frame, an ID3v2 tag with the length, a Xing table and an ID3v1 tag.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shared import bounded
from corpusmill.llm.words import text_buffer

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bit rate index for (MPEG-1?, layer), and sampling rates by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Bits of the Layer II allocation of each subband, by table.
ALLOCATION = {"a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "low": [4] * 4 + [3] * 7 + [2] * 19}


@dataclass(frozen=True)
class Header:
    version: int  # the version bits: 3 is MPEG-1, 2 is MPEG-2, 0 is MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mode: int
    extension: int
    size: int
    samples: int

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.channels == 1 else 32) if self.version == 3 else (9 if self.channels == 1 else 17)


def header(four: bytes) -> Header | None:
    """The header of a frame whose size it tells."""
    h = any_header(four)
    return h if h and h.kbps else None


@lru_cache(4096)
def any_header(four: bytes) -> Header | None:
    """header(), or that of a free-format frame, of 0 kbit/s."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index == 15 or rate == 3 or four[3] & 3 == 2:
        return None
    kbps, hz, pad = BITRATES[version == 3, layer][index], RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 3 else 1152
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    # of a free-format frame the size is that of its padding: the next frame tells the rest
    return Header(version, layer, not four[1] & 1, kbps, hz, four[3] >> 6, four[3] >> 4 & 3, size, samples)


#: Longest frame of free format that is looked for.
FREE = 1 << 13


def alike(a: Header | None, b: Header | None) -> bool:
    """Frames of one stream: equal version, layer, rate, and both or neither of free format."""
    return a is not None and b is not None and (a.version, a.layer, a.rate, a.kbps == 0) == (b.version, b.layer, b.rate, b.kbps == 0)


def free_size(data: bytes, p: int, end: int, h: Header) -> int:
    """Bytes of free-format frames without their padding: the way to the next header that is alike, if the one after it is as far; else 0."""
    q = p + 4
    while 0 <= (q := data.find(data[p : p + 2], q, min(p + FREE, end))):
        size = q - p - h.size
        if alike(h, after := any_header(data[q : q + 4])) and size >= 32:
            r = q + size + after.size
            if r == end or alike(h, any_header(data[r : r + 4])):
                return size
        q += 1
    return 0


def _steps() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


_CRC = _steps()


@lru_cache(4096)
def checksum(data: bytes, bits: int | None = None) -> int:
    """CRC-16 with polynomial 0x8005, start 0xFFFF, over the first bits of data."""
    bits = 8 * len(data) if bits is None else bits
    c = 0xFFFF
    for byte in data[: bits // 8]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ byte]
    for k in range(bits % 8):
        bit = data[bits // 8] >> (7 - k) & 1
        c = (c << 1 ^ 0x8005 if (c >> 15) ^ bit else c << 1) & 0xFFFF
    return c


def protected_bits(h: Header, body: bytes) -> int:
    """Bits after the checksum that it covers."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        bound = 4 * (h.extension + 1) if h.mode == 1 else 32
        return 4 * (bound * h.channels + 32 - bound)
    each = h.kbps // h.channels
    name = "low" if h.version != 3 else ("c" if h.rate != 32000 else "d") if each <= 48 else "a" if h.rate == 48000 or each <= 80 else "b"
    widths = ALLOCATION[name]
    bound = min(4 * (h.extension + 1), len(widths)) if h.mode == 1 else len(widths)
    at, used, value = 0, 0, int.from_bytes(body[:40], "big")
    total = 8 * len(body[:40])
    for k, width in enumerate(widths):
        for _ in range(h.channels if k < bound else 1):
            allocated = value >> (total - at - width) & (1 << width) - 1
            at += width
            used += (1 if k < bound else h.channels) * (allocated > 0)
    return at + 2 * used


@dataclass
class Stream:
    """What parse() finds. Offsets are from the start of the data; duration() is exact.

    delay and padding: samples that the encoder put before and after the sound, from the table's extension; they do not count.
    """

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    table: dict | None = None
    table_frame: bool = False
    checked: int = 0
    bad: int = 0
    skipped: int = 0
    delay: int = 0
    padding: int = 0

    def samples(self) -> int:
        return max(0, sum(h.samples for h in self.headers) - self.delay - self.padding)

    def duration(self) -> Fraction:
        whole = sum((Fraction(sum(h.samples for h in self.headers if h.rate == rate), rate) for rate in {h.rate for h in self.headers}), Fraction(0))
        return max(Fraction(0), whole - Fraction(self.delay + self.padding, self.headers[0].rate)) if self.headers else whole

    def seek(self, seconds: Fraction | float) -> int:
        """Offset of the frame that plays at that time; of the last one beyond the end."""
        left = Fraction(seconds) + (Fraction(self.delay, self.headers[0].rate) if self.headers else 0)
        for at, h in zip(self.offsets, self.headers, strict=True):
            if left < (d := Fraction(h.samples, h.rate)):
                return at
            left -= d
        return self.offsets[-1] if self.offsets else 0


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Read the tag at `at`; return where it ends. A tag that runs beyond the data ends with it."""
    major, flags, size = data[at + 3], data[at + 5], _syncsafe(data[at + 6 : at + 10])
    end = min(at + 10 + size + (10 if flags & 0x10 else 0), len(data))
    body = data[at + 10 : min(at + 10 + size, len(data))]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")  # unsynchronisation, of the whole tag
    p, name_size = 0, 3 if major == 2 else 4
    if flags & 0x40 and major > 2 and len(body) >= 4:  # an extended header counts itself in version 4 alone
        p = _syncsafe(body[:4]) if major == 4 else 4 + int.from_bytes(body[:4], "big")
    head = 6 if major == 2 else 10
    while p + head <= len(body) and body[p]:
        name, raw = body[p : p + name_size].decode("latin-1"), body[p + name_size : p + 2 * name_size]
        n = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        if p + head + n > len(body):
            break
        value, more = body[p + head : p + head + n], body[p + 9] if major > 2 else 0
        if major == 4 and more & 1:
            value = value[4:]  # the length before compression and unsynchronisation
        if major == 4 and (more & 2 or flags & 0x80):
            value = value.replace(b"\xff\0", b"\xff")
        if name.startswith("T") and value:
            text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace").rstrip("\0")
            if name in ("TXXX", "TXX") and "\0" in text:
                what, text = text.split("\0", 1)
                name = f"TXXX:{what}"
            tags[name] = text
        p += head + n
    return end


def _table(frame: bytes, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in the first frame."""
    for at in {4 + h.side, 6 + h.side}:
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
                p += 100
            p += 4 if flags & 8 else 0
            if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= p + 24:
                gap = int.from_bytes(frame[p + 21 : p + 24], "big")
                out["delay"], out["padding"] = gap >> 12, gap & 0xFFF
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, _, n_bytes, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", frame[40:62])
        toc = [scale * int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": n_bytes, "toc": toc, "per": per}
    return None


def parse(data: bytes) -> Stream:
    """Read a stream. Bytes that belong to no frame or tag are skipped and counted; a cut last frame is skipped. Empty data: no frames."""
    out, p, end = Stream(), 0, len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                out.tags[f"id3v1:{name}"] = value
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size = int.from_bytes(data[end - 20 : end - 16], "little")
        head = 32 if data[end - 9] & 0x80 else 0
        end = max(0, end - size - head)
    known: Header | None = None
    free = 0
    while p < end:
        if data[p : p + 3] == b"ID3" and p + 10 <= end:
            p = _id3v2(data, p, out.tags)
            continue
        h = any_header(data[p : p + 4])
        if h is not None and not h.kbps:
            free = free if free and alike(h, known) else free_size(data, p, end, h)
            h = replace(h, size=free + h.size) if free else None
        fits = h is not None and p + h.size <= end
        if fits and not alike(h, known):
            # a first header counts only if another follows, or nothing does
            fits = p + h.size == end or alike(h, any_header(data[p + h.size : p + h.size + 4]))
        if not fits:
            q = data.find(b"\xff", p + 1, end)
            tag = data.find(b"ID3", p + 1, q if q >= 0 else end)
            q = min(x for x in (q, tag, end) if x >= 0)
            out.skipped += q - p
            p = q
            continue
        frame, known = data[p : p + h.size], h
        if h.protected:
            body = frame[6:]
            bits = protected_bits(h, body)
            out.checked += 1
            out.bad += checksum(frame[2:4] + body[: (bits + 7) // 8], 16 + bits) != int.from_bytes(frame[4:6], "big")
        if not out.offsets and out.table is None and h.layer == 3 and (table := _table(frame, h)):
            out.table, out.table_frame = table, True
            out.delay, out.padding = table.get("delay", 0), table.get("padding", 0)
        else:
            out.offsets.append(p)
            out.headers.append(h)
        p += h.size
    return out


_SIDE = 17
_LEVELS = BITRATES[True, 3][1:]


def _frame(body: bytes, kbps: int) -> bytes:
    """A silent MPEG-1 Layer III frame, 48 kHz mono, with a checksum and `body` as ancillary data."""
    head = bytes((0xFF, 0xFA, _LEVELS.index(kbps) + 1 << 4 | 1 << 2, 0xC0))
    side = bytes(_SIDE)
    return (head + checksum(head[2:] + side).to_bytes(2, "big") + side + body).ljust(3 * kbps, b"\0")


def _id3(fields: dict[str, str]) -> bytes:
    frames = b"".join(b"TXXX" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + b"\0\0" + body for k, v in fields.items() for body in [b"\3" + k.encode() + b"\0" + v.encode()] for n in [len(body)])
    n = len(frames)
    return b"ID3\4\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frames


def store_bytes(payload: bytes) -> bytes:
    """A stream that carries payload losslessly; equal payloads give equal streams."""
    room = 3 * _LEVELS[-1] - 6 - _SIDE
    frames = []
    for k in range(0, len(payload), room):
        part = payload[k : k + room]
        frames.append(_frame(part, next(b for b in _LEVELS if 3 * b - 6 - _SIDE >= len(part))))
    sizes = np.cumsum([0, *map(len, frames)])
    first = 3 * 64
    total = int(sizes[-1]) + first
    toc = bytes(min(255, 256 * (first + int(sizes[k * len(frames) // 100])) // total) for k in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    tail = (b"TAG" + b"payload".ljust(30, b"\0")).ljust(127, b"\0") + b"\xff"
    return b"".join([_id3({"payload_bytes": str(len(payload))}), _frame(xing, 64), *frames, tail])


def load_bytes(data: bytes) -> tuple[bytes, Stream]:
    """The payload of store_bytes() and the parsed stream; raises ValueError where a checksum or a count is wrong."""
    s = parse(data)
    n = int(s.tags.get("TXXX:payload_bytes", -1))
    payload = b"".join(data[at + 6 + _SIDE : at + h.size] if k + 1 < len(s.headers) else data[at + 6 + _SIDE : at + h.size] for k, (at, h) in enumerate(zip(s.offsets, s.headers, strict=True)))[: max(n, 0)]
    if len(payload) != n or s.bad or s.table is None or s.table["frames"] != len(s.offsets):
        raise ValueError("not an intact payload stream")
    return payload, s


def features(payload: bytes, s: Stream) -> str:
    """Stream and sample figures as text: samples are the payload's bytes as unsigned 8-bit values."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    kbps = sorted({h.kbps for h in s.headers})
    d = s.duration()
    return f"frames={len(s.offsets)};samples={s.samples()};duration={d.numerator}/{d.denominator};kbps={kbps[0]}-{kbps[-1]};checked={s.checked};bad={s.bad};skipped={s.skipped};mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};crossings={crossings}"


def pad(data: bytes, unit: int = 192) -> bytes:
    return data + b" " * (-len(data) % unit or (0 if data else unit))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_buffer(batch.column(1))
        low = 0
        while low < batch.num_rows:
            high = min(max(int(np.searchsorted(at, at[low] + (1 << 20), "right")) - 1, low + 1), batch.num_rows)
            media = [store_bytes(pad(data[at[k] : at[k + 1]].tobytes())) for k in range(low, high)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(at[low : high + 1])), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])
            low = high


_PARSED = "key long, n_bytes long, media binary, payload binary, feature string, n_frames long, duration_num long, duration_den long, offsets array<long>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            rows = []
            for value in part.column(2):
                payload, s = load_bytes(value.as_py())
                d = s.duration()
                rows.append((payload, features(payload, s), len(s.offsets), d.numerator, d.denominator, s.offsets))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=["key", "n_bytes", "media", "payload", "feature", "n_frames", "duration_num", "duration_den", "offsets"])


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: every text as UTF-8, padded with blanks to a positive multiple of 192 bytes, in an MPEG stream.

    A null text counts as empty and becomes 192 blanks. Null keys and repeated rows are kept; equal texts give equal streams. An
    empty table gives no rows. Other columns are not read.
    """
    rows = bounded(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    return rows.mapInArrow(_store, "key long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """The rows of text_media() with the payload read back from the stored bytes, features, exact duration and frame seek offsets."""
    return media.mapInArrow(_parse, _PARSED)


def _round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _parse(_store(batches))


def media_round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """read_media(text_media(docs)) with one worker for both, which halves what Python holds."""
    rows = bounded(docs).select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    return rows.mapInArrow(_round_trip, _PARSED)
