"""MPEG audio columns: write and read streams of audio frames.

The reader handles MPEG 1, 2 and 2.5, layers I to III: it skips and parses tags (ID3v2.2 to 2.4 at
the start, ID3v1 at the end), resynchronises after bytes that are no frame, reads the
variable-bitrate tables (Xing or Info, and VBRI), verifies the 16-bit checksum of protected
frames of every layer, and gives the exact duration and every frame's byte offset for seeking.
Frames of free format, whose header names no bitrate, count as junk.

The writer stores any bytes without loss as an MPEG 2 layer III stream of 576 samples a frame
(16 kHz, mono, checksums on): each frame has empty side information, so it decodes to silence, and
576 payload bytes in its ancillary data. Trailing bytes 255 of a frame's share are implied
and the frame takes the smallest bitrate that holds the rest, hence a variable bitrate with
a Xing table in front.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import computed

UNIT = 576
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: kbit/s by (MPEG 1?, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
BITRATES[(False, 3)] = BITRATES[(False, 2)]
VERSIONS = {3: "1", 2: "2", 0: "2.5"}


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    channels: int
    size: int
    samples: int
    side: int
    bound: int  # subbands that the channels do not share (layers I and II)

    @property
    def kind(self) -> tuple[int, int, int]:
        """What all frames of one stream share."""
        return self.version, self.layer, self.rate


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The header in four bytes; None if they are none, or if the bitrate is free or forbidden."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    k, r = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or k in (0, 15) or r == 3 or word[3] & 3 == 2:
        return None
    first = version == 3
    bitrate, rate, padding = BITRATES[(first, layer)][k], RATES[version][r], word[2] >> 1 & 1
    channels = 1 if word[3] >> 6 == 3 else 2
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * bitrate * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * bitrate * 1000 // rate + padding
    side = 0 if layer != 3 else (17 if channels == 1 else 32) if first else (9 if channels == 1 else 17)
    bound = 4 * (word[3] >> 4 & 3) + 4 if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, bitrate, rate, padding, channels, size, samples, side, bound)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


CRC = _crc_table()


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 ^ CRC[c >> 8 ^ b]) & 0xFFFF
    return c


def crc16_bits(data: bytes, n: int) -> int:
    """The checksum of the first ``n`` bits of ``data``."""
    c = crc16(data[: n // 8])
    for i in range(n % 8):
        bit = data[n // 8] >> (7 - i) & 1
        c = (c << 1 ^ 0x8005 if c >> 15 ^ bit else c << 1) & 0xFFFF
    return c


#: Fixed values of layer II: of each allocation table the (subbands, bits of an allocation) from the lowest subband upwards.
ALLOCATIONS = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}


def allocation_table(h: Header) -> str:
    """Which allocation table a layer II frame uses: by sampling rate and bitrate of a channel."""
    if h.version != 3:
        return "lsf"
    each = h.bitrate // h.channels
    if each <= 48:
        return "d" if h.rate == 32000 else "c"
    return "a" if h.rate == 48000 or each <= 80 else "b"


def protected_bits(body: bytes, h: Header) -> int:
    """How many bits after the checksum it covers: side information (III), or allocations (I) and scale factor selectors (II)."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (h.bound * h.channels + 32 - h.bound)
    widths = [w for n, w in ALLOCATIONS[allocation_table(h)] for _ in range(n)]
    bound, at, used = min(h.bound, len(widths)), 0, 0
    bits = int.from_bytes(body[:48].ljust(48, b"\0"), "big")  # 30 subbands of two channels take 30 bytes at most
    for band, w in enumerate(widths):
        shared = band >= bound
        for _ in range(1 if shared else h.channels):
            taken = bits >> (384 - at - w) & (1 << w) - 1
            used += (h.channels if shared else 1) * (taken > 0)
            at += w
    return at + 2 * used


def checksum_holds(frame: bytes, h: Header) -> bool:
    """Whether the checksum of a protected frame is that of its header's last two bytes and the bits that it covers."""
    n = 16 + protected_bits(frame[6:], h)
    covered = frame[2:4] + frame[6 : 6 + -(-n // 8)]
    return 8 * len(covered) >= n and crc16_bits(covered, n) == int.from_bytes(frame[4:6], "big")


def syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of the tag that starts ``data`` (0: none) and its text frames."""
    if len(data) < 10 or data[:3] != b"ID3" or data[3] == 255 or data[4] == 255 or any(x & 128 for x in data[6:10]):
        return 0, {}
    size, tags = syncsafe(data[6:10]), {}
    body, at = data[10 : 10 + size], 0
    named, head = (3, 6) if data[3] == 2 else (4, 10)  # bytes of a frame's name and of its whole head
    while at + head <= len(body) and body[at : at + named].isalnum():
        sized = body[at + named : at + 2 * named]
        n = syncsafe(sized) if data[3] >= 4 else int.from_bytes(sized, "big")
        name, value = body[at : at + named].decode("latin-1"), body[at + head : at + head + n]
        if name[0] == "T" and value:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(value[0], "latin-1")
            tags[name] = value[1:].decode(code, "replace").rstrip("\0").replace("\0", "=")
        at += head + n
    return min(len(data), 10 + size + (10 if data[5] & 16 else 0)), tags


@dataclass
class Stream:
    """What a stream holds. ``frames`` has (offset, header) of the audio frames, without the table's frame."""

    frames: list[tuple[int, Header]] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None
    checked: int = 0
    bad_checksums: int = 0
    junk_bytes: int = 0
    resyncs: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for _, h in self.frames)

    @property
    def duration(self) -> Fraction:
        """Exact seconds."""
        return Fraction(self.samples, self.frames[0][1].rate) if self.frames else Fraction(0)


def vbr_table(frame: bytes, h: Header) -> dict | None:
    """The Xing, Info or VBRI table in a frame: frames, bytes, and its seek table."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out["toc"], at = list(frame[at : at + 100]), at + 100
        if flags & 8:
            out["quality"] = int.from_bytes(frame[at : at + 4], "big")
        return out
    if frame[36:40] == b"VBRI":
        n, scale, width, per = (int.from_bytes(frame[a : a + 2], "big") for a in (54, 56, 58, 60))
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(n)]
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "toc": toc, "frames_per_entry": per}
    return None


def read(data: bytes) -> Stream:
    """Parse a stream. A frame counts if the next one starts where it ends, or the stream or its end tag does, or
    (among frames of its own kind) if only a whole frame's room is left after junk; all other bytes are junk. Never raises."""
    out = Stream()
    at, out.tags = id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    kind, lost = None, False
    while at < end:
        h = header(data[at : at + 4])
        ok = h is not None and (kind is None or h.kind == kind) and at + h.size <= end
        if ok and (kind is None or lost):  # out of step: the next header has to agree
            following = header(data[at + h.size : at + h.size + 4]) if at + h.size < end else h
            ok = following is not None and following.kind == h.kind
        if not ok:
            after = data.find(b"\xff", at + 1, end)
            after = end if after < 0 else after
            out.junk_bytes += after - at
            out.resyncs += not lost
            at, lost = after, True
            continue
        table = vbr_table(data[at : at + h.size], h) if kind is None and out.vbr is None and h.layer == 3 else None
        if h.protected:
            out.checked += 1
            out.bad_checksums += not checksum_holds(data[at : at + min(h.size, 96)], h)
        if table is None:
            out.frames.append((at, h))
        else:
            out.vbr = table
        at, kind, lost = at + h.size, h.kind, False
    return out


#: Written headers: bitrate index to (header, its frame's bytes, room for payload).
SIDE = bytes(9)


def _written(k: int) -> tuple[bytes, int, int]:
    word = bytes((0xFF, 0xF2, k << 4 | 2 << 2, 0xC0))
    h = header(word)
    return word + crc16(word[2:] + SIDE).to_bytes(2, "big") + SIDE, h.size, h.size - 15


FRAMES = {k: _written(k) for k in range(1, 15)}
SMALLEST = [next((k for k in FRAMES if FRAMES[k][2] >= n), 0) for n in range(UNIT + 1)]


def pad(payload: bytes) -> bytes:
    """``payload`` with bytes 255 up to a positive multiple of 576."""
    return payload + b"\xff" * (-len(payload) % UNIT or UNIT * (not payload))


def frame_of(share: bytes) -> bytes:
    head, size, _ = FRAMES[SMALLEST[len(share := share.rstrip(b"\xff"))]]
    return head + share + b"\xff" * (size - len(head) - len(share))


def write(payload: bytes) -> bytes:
    """A stream that stores ``payload``, whose length is a positive multiple of 576."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload's length must be a positive multiple of 576")
    frames = [frame_of(payload[i : i + UNIT]) for i in range(0, len(payload), UNIT)]
    total, sums = sum(map(len, frames)), [0]
    for f in frames:
        sums.append(sums[-1] + len(f))
    n = len(frames)
    toc = bytes(min(255, sums[i * n // 100] * 256 // total) for i in range(100))
    head, size, _ = FRAMES[8]
    table = head + b"Xing" + (15).to_bytes(4, "big") + n.to_bytes(4, "big") + (total + size).to_bytes(4, "big") + toc + (100).to_bytes(4, "big")
    length = b"\0" + str(n * UNIT * 1000 // 16000).encode()
    tag = b"TLEN" + len(length).to_bytes(4, "big") + b"\0\0" + length
    tag = b"ID3\x03\0\0" + bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0)) + tag
    return tag + table.ljust(size, b"\0") + b"".join(frames)


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The payload that ``write`` stored."""
    return b"".join(data[at + 15 : at + min(h.size, 15 + UNIT)].ljust(UNIT, b"\xff") for at, h in stream.frames)


SEEK_SCHEMA = "version string, layer int, sample_rate int, channels int, n_frames bigint, n_samples bigint, duration_s double, vbr_kind string, checked bigint, bad_checksums bigint, junk_bytes bigint, tags map<string,string>, seek_offsets array<bigint>"


def describe(s: Stream) -> tuple:
    h = s.frames[0][1] if s.frames else None
    return (VERSIONS[h.version] if h else None, h and h.layer, h and h.rate, h and h.channels, len(s.frames), s.samples, float(s.duration), s.vbr and s.vbr["kind"], s.checked, s.bad_checksums, s.junk_bytes, s.tags, [at for at, _ in s.frames])


def parse_media(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Add one struct column ``audio`` (fields of ``SEEK_SCHEMA``) to each row's stream.

    Null, empty or other bytes give no frames, duration 0 and null format fields; all
    bytes outside of tags are then junk. Other columns are kept; one named ``audio`` is replaced.
    """

    @F.pandas_udf(SEEK_SCHEMA)
    def parse(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(read(bytes(b or b""))) for b in column], columns=[x.split()[0] for x in SEEK_SCHEMA.split(", ")])

    return media.withColumn("audio", parse(F.col(f"`{media_col}`")))


DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, duration_s double, n_frames bigint, seek_offsets array<bigint>"


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text as a stream: id and ``media`` (binary). Null text is empty; equal texts give equal bytes; ids of any size and type stay exact."""
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("m_text"))
    return computed(rows, "media binary", lambda texts: [(write(pad(t.encode("utf-8", "surrogatepass"))),) for t in texts])


def feature(s: Stream) -> str:
    """What a stream is, in one line; equal streams have equal features."""
    h, of_rate = s.frames[0][1], Counter(x.bitrate for _, x in s.frames)
    told = {"frames": len(s.frames), "samples": s.samples, "duration": s.duration, "crc": f"{s.checked - s.bad_checksums}/{s.checked}", "junk": s.junk_bytes, "kbps": ",".join(f"{b}x{of_rate[b]}" for b in sorted(of_rate))}
    return f"mpeg{VERSIONS[h.version]} layer{h.layer} {h.rate}Hz {h.channels}ch {s.vbr['kind']}={s.vbr['frames']} " + " ".join(f"{k}={v}" for k, v in told.items())


def digest(text: str) -> tuple:
    """The values of ``DIGEST``: the text is stored, and read back from the stored bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    media = write(pad(raw))
    s = read(media)
    back = payload_of(media, s)
    return (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), float(s.duration), len(s.frames), [at for at, _ in s.frames])


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text (doc_id, text) as a stream, read the bytes back and return what they hold (``DIGEST``) beside doc_id.

    Null text is empty, other columns are ignored, repeated rows stay, no rows give no rows. The duration, offsets and feature
    come from the parsed stream alone.
    """
    return computed(docs.select(F.col("doc_id").cast("bigint"), F.col("text")), DIGEST, lambda texts: [digest(t) for t in texts])
