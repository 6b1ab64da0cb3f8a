"""MPEG audio media column: bytes carried losslessly in Layer III frames, and a reader for such streams.

Each frame is MPEG-2 Layer III, mono, 16 kHz: 576 samples, a checksum over header and side information, silent
main data, and 576 bytes of payload as ancillary data.  A frame with bytes above 127 is written at the next
higher bit rate, so streams are of variable bit rate; a leading frame holds the Xing table (frames, bytes,
100 seek points).  An ID3v2.3 tag precedes the frames and an ID3v1 tag ends the stream.

The reader takes MPEG-1, 2 and 2.5 audio of Layers I to III, mono or stereo, and relies on nothing but the bytes: it parses the
tags (ID3v2.2 to 2.4 and ID3v1), resynchronises on frame headers (a header counts if its checksum holds, or one of the same kind or the
end of the audio follows where it should), reads a Xing, Info or VBRI table, verifies the checksums of Layer III (those of the
other layers cover tables that it doesn't decode), and gives exact durations (each frame's samples over its rate) and the
byte offset of every frame.

Edge cases: null text is empty and becomes one frame of padding; bytes that belong to no frame are skipped and
counted; frames with a wrong checksum are counted and their payload kept; repeated rows each give a row; a null id stays null
and leaves the others as they are; an empty table gives an empty result; only id and text are read, so other columns may
have any name; texts of any length are stored whole, one document at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named_texts, parts, with_results

UNIT = 576  #: payload bytes, and samples, of a frame
PAD = b"\xff"

# Fixed values of the format: kilobits per second by index from 1, of MPEG-1 Layers I, II and III, of the others' Layer I, and of their Layers II and III.
KILOBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
# Fixed values of the format: version and layer by their bits, samples a second by version, bytes of Layer III's side information for one and two channels.
VERSIONS, LAYERS = (2.5, None, 2, 1), (None, 3, 2, 1)
SAMPLES_A_SECOND = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SIDE = {1: (17, 32), 2: (9, 17), 2.5: (9, 17)}
VBRI_AT = 36  # bytes from a frame's start
SIDE_BYTES = 9

SCHEMA = (
    "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, "
    "duration_ms double, seek_offsets array<int>"
)


@lru_cache(maxsize=4096)
def checksum(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF, highest bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def header(rate_index: int, protected: bool) -> bytes:
    """Frame header: sync, MPEG-2, Layer III, 16 kHz, mono."""
    return bytes((0xFF, 0xF2 | (not protected), rate_index << 4 | 2 << 2, 0xC0))


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kilobits: int
    rate: int
    padded: bool
    stereo: bool

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        """Bytes of the frame."""
        if self.layer == 1:
            return (12_000 * self.kilobits // self.rate + self.padded) * 4
        return self.samples // 8 * 1000 * self.kilobits // self.rate + self.padded

    @property
    def side(self) -> int:
        """Bytes of Layer III's side information, 0 for the others."""
        return SIDE[self.version][self.stereo] if self.layer == 3 else 0

    def like(self, other: Header | None) -> bool:
        """Whether both may be frames of one stream."""
        return other is not None and (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=4096)
def parsed(head: bytes) -> Header | None:
    """What four bytes say if they are a frame header with a bit rate of its own."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = VERSIONS[head[1] >> 3 & 3], LAYERS[head[1] >> 1 & 3], head[2] >> 4, head[2] >> 2 & 3
    if version is None or layer is None or index in (0, 15) or rate == 3:
        return None
    kilobits = KILOBITS[(1, layer) if version == 1 else (2, min(layer, 2))][index - 1]
    return Header(version, layer, not head[1] & 1, kilobits, SAMPLES_A_SECOND[version][rate], bool(head[2] & 2), head[3] >> 6 != 3)


def frame_size(head: bytes) -> int:
    """Bytes of the frame that a header announces; 0 if it isn't one."""
    h = parsed(head)
    return h.size if h else 0


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def text_frame(name: bytes, value: str) -> bytes:
    body = b"\x00" + value.encode("latin-1")
    return name + struct.pack(">IH", len(body), 0) + body


def write_stream(data: bytes) -> bytes:
    """A whole stream for some bytes, padded with 255 to a positive multiple of the unit."""
    payload = data + PAD * (-len(data) % UNIT or (0 if data else UNIT))
    frames = []
    for at in range(0, len(payload), UNIT):
        unit = payload[at : at + UNIT]
        head = header(13 if unit.isascii() else 14, protected=True)
        side = struct.pack(">BIHBB", 0, (sum(unit) & 0xFF) << 2, 0, 0, 0)  # a silent granule; its gain is the unit's sum
        body = head + struct.pack(">H", checksum(head[2:] + side)) + side + unit
        frames.append(body.ljust(frame_size(head), b"\x00"))
    lead = header(13, protected=False)
    sizes = [frame_size(lead), *map(len, frames)]
    total, points, at, reached = sum(sizes), [], 0, 0
    for percent in range(100):
        while reached < len(frames) * percent // 100:
            at += sizes[reached]
            reached += 1
        points.append(min(255, at * 256 // total))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(points)
    first = (lead + bytes(SIDE_BYTES) + table).ljust(sizes[0], b"\x00")
    tags = text_frame(b"TLEN", str(len(frames) * UNIT * 1000 // 16000)) + text_frame(b"TXXX", f"payload\x00{len(data)}:{zlib.crc32(payload):08x}")
    end = b"TAG" + b"payload".ljust(30, b"\x00") + bytes(94) + b"\xff"
    return b"".join((b"ID3\x03\x00\x00", syncsafe(len(tags)), tags, first, *frames, end))


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    table: tuple[int, int] | None = None
    seek_points: bytes = b""
    payload: bytes = b""
    offsets: list[int] = field(default_factory=list)
    wrong: int = 0
    skipped: int = 0
    rates: dict[int, int] = field(default_factory=dict)
    samples: int = 0
    sample_rate: int = 16000
    duration: float = 0.0  #: milliseconds


def unsyncsafe(b: bytes) -> int:
    return sum((x & 0x7F) << s for x, s in zip(b, (21, 14, 7, 0), strict=True))


def tag_text(b: bytes) -> str:
    """A text frame's value: the first byte names the encoding."""
    encoding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(b[0], "latin-1") if b else "latin-1"
    return b[1:].decode(encoding, "replace").rstrip("\x00")


def read_tags(media: bytes) -> tuple[dict[str, str], int, int]:
    """Text tags of ID3v2.2, 2.3 and 2.4 and ID3v1's title, and where the audio begins and ends."""
    tags, begin, end = {}, 0, len(media)
    if media[:3] == b"ID3" and len(media) >= 10 and 2 <= media[3] <= 4:
        version, flags, size = media[3], media[5], unsyncsafe(media[6:10])
        begin = min(len(media), 10 + size + 10 * (version == 4 and bool(flags & 0x10)))
        body = media[10 : 10 + size]
        if flags & 0x80:  # unsynchronised: a zero byte was put after each 255
            body = body.replace(b"\xff\x00", b"\xff")
        at = 0
        if flags & 0x40 and version > 2 and len(body) >= 4:
            at = unsyncsafe(body[:4]) if version == 4 else 4 + int.from_bytes(body[:4], "big")
        name, wide = (3, 6) if version == 2 else (4, 10)
        while at + wide <= len(body) and body[at]:
            length = int.from_bytes(body[at + 3 : at + 6], "big") if version == 2 else unsyncsafe(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
            tag = body[at : at + name].decode("latin-1")
            if tag[:1] == "T":
                tags[tag] = tag_text(body[at + wide : at + wide + length])
            at += wide + length
    if media[-128:-125] == b"TAG" and end - 128 >= begin:
        end -= 128
        tags["title"] = media[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    return tags, begin, end


def read_table(frame: bytes, h: Header) -> tuple[int, int, bytes] | None:
    """Frames, bytes and seek points of a variable-bitrate table, if the frame holds one."""
    at = 4 + 2 * h.protected + h.side
    if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, at, values = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, [0, 0]
        for k in (0, 1):
            if flags & 1 << k:
                values[k], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        return *values, frame[at : at + 100] if flags & 4 else b""
    if frame[VBRI_AT : VBRI_AT + 4] == b"VBRI" and len(frame) >= VBRI_AT + 26:
        total, frames, entries, _, width, _ = struct.unpack(">IIHHHH", frame[VBRI_AT + 10 : VBRI_AT + 26])
        return frames, total, frame[VBRI_AT + 26 : VBRI_AT + 26 + entries * width]
    return None


def read_stream(media: bytes) -> Stream:
    out = Stream()
    out.tags, at, end = read_tags(media)
    units, known = [], None
    while at + 4 <= end:
        h = parsed(media[at : at + 4])
        size = h.size if h else 0
        holds = checked = False
        if h and h.layer == 3 and h.protected:
            side, checked = at + 6, True
            holds = checksum(media[at + 2 : at + 4] + media[side : side + h.side]) == int.from_bytes(media[at + 4 : at + 6], "big")
        if not h or size < 4 or at + size > end or not (holds or at + size == end or h.like(parsed(media[at + size : at + size + 4]))) or (known and not holds and not h.like(known)):
            nearest = media.find(b"\xff", at + 1, end)
            step = (nearest if nearest >= 0 else end) - at
            out.skipped += step
            at += step
            continue
        table = read_table(media[at : at + size], h) if out.table is None and not out.offsets else None
        if table:
            out.table, out.seek_points = table[:2], table[2]
        else:
            known = h
            out.wrong += checked and not holds
            out.offsets.append(at)
            out.rates[h.kilobits] = out.rates.get(h.kilobits, 0) + 1
            out.samples += h.samples
            out.sample_rate = h.rate
            out.duration += h.samples * 1000 / h.rate
            begin = at + 4 + 2 * h.protected + h.side
            units.append(media[begin : min(begin + UNIT, at + size)])
        at += size
    out.payload = b"".join(units)
    return out


def feature(s: Stream) -> str:
    """What the stream holds, as one line; a function of its bytes."""
    n, total = s.table or (0, 0)
    _, _, said = s.tags.get("TXXX", "").partition(":")
    return (
        f"frames={len(s.offsets)};samples={s.samples};rate={s.sample_rate};kbps={','.join(f'{k}x{v}' for k, v in sorted(s.rates.items()))};table={n},{total};"
        f"points={zlib.crc32(s.seek_points):08x};offsets={zlib.crc32(struct.pack(f'<{len(s.offsets)}I', *s.offsets)):08x};"
        f"wrong={s.wrong};skipped={s.skipped};tag={int(said == f'{zlib.crc32(s.payload):08x}')}"
    )


def utf8(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8") for t in texts]


def encode_audio(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stored stream of each text."""

    def encoded(texts: list[str | None]) -> dict[str, Sequence]:
        data = utf8(texts)
        return {"n_bytes": list(map(len, data)), "media": list(map(write_stream, data))}

    return with_results(named_texts(docs, id_column, text_column), "n_bytes bigint, media binary", encoded)


def described(media: bytes) -> dict:
    s = read_stream(media)
    return {
        "payload_bytes": len(s.payload),
        "payload_sha256": hashlib.sha256(s.payload).hexdigest(),
        "tail_crc32": zlib.crc32(s.payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature(s),
        "duration_ms": s.duration,
        "seek_offsets": s.offsets,
    }


def _columns(streams: list[bytes]) -> dict[str, Sequence]:
    rows = [described(m) for m in streams]
    return {name: [r[name] for r in rows] for name, _ in parts(SCHEMA)}


def read_audio(media: DataFrame) -> DataFrame:
    """Features of stored streams (doc_id, n_bytes, media); a null stream is read as an empty one."""
    rows = media.select("doc_id", "n_bytes", F.col("media").alias("text"))  # the column that is read
    return with_results(rows, SCHEMA, lambda streams: _columns([m or b"" for m in streams]))


def describe_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Stores each text as a stream and reads the stored bytes back, a document at a time."""

    def stored(texts: list[str | None]) -> dict[str, Sequence]:
        data = utf8(texts)
        return {"n_bytes": list(map(len, data))} | _columns(list(map(write_stream, data)))

    return with_results(named_texts(docs, id_column, text_column), "n_bytes bigint, " + SCHEMA, stored)
