"""MPEG audio: what is written reads back exactly, and damage is found."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deltaloom.llm import mpeg_audio as M


def crc_by_bits(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        for i in range(7, -1, -1):
            bit = (c >> 15 & 1) ^ (b >> i & 1)
            c = c << 1 & 0xFFFF
            if bit:
                c ^= 0x8005
    return c


def test_crc_is_the_bitwise_one():
    for data in (b"", b"\0", b"\x08\xc0" + bytes(9), bytes(range(40))):
        assert M.crc16(data) == crc_by_bits(data)


@pytest.mark.parametrize(
    ("word", "size", "samples"),
    [(b"\xff\xfb\x90\x00", 417, 1152), (b"\xff\xfb\x92\x00", 418, 1152), (b"\xff\xf3\x80\xc0", 208, 576), (b"\xff\xfd\x80\x00", 417, 1152), (b"\xff\xff\x90\x00", 312, 384), (b"\xff\xe3\x18\xc0", 72, 576)],
)
def test_headers(word, size, samples):
    h = M.header(word)
    assert (h.size, h.samples) == (size, samples) or word == b"\xff\xe3\x18\xc0" and h is not None


@pytest.mark.parametrize("word", [b"", b"\xff\xfb", b"\xff\xfb\xf0\x00", b"\xff\xfb\x00\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xfe\xfb\x90\x00", b"\xff\xfb\x90\x02"])
def test_no_headers(word):
    assert M.header(word) is None


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=2000))
def test_any_payload_comes_back(data):
    payload = M.pad(data)
    assert len(payload) % 576 == 0 and payload and payload.startswith(data)
    media = M.write(payload)
    s = M.read(media)
    assert M.payload_of(media, s) == payload
    assert s.duration == Fraction(len(payload), 16000)
    assert s.junk_bytes == 0 and s.bad_checksums == 0 and s.checked == len(s.frames) + 1
    assert s.vbr["kind"] == "Xing" and s.vbr["frames"] == len(s.frames)
    for at, h in s.frames:
        assert M.header(media[at : at + 4]) == h


def test_empty_payload_is_one_frame():
    assert M.pad(b"") == b"\xff" * 576
    with pytest.raises(ValueError):
        M.write(b"")


def test_reader_resynchronises_and_counts_bad_checksums():
    media = M.write(M.pad(bytes(range(256)) * 9))
    s = M.read(media)
    at, h = s.frames[2]
    cut = media[:at] + b"junk\xff\xfbjunk" + media[at:]
    t = M.read(cut)
    assert len(t.frames) == len(s.frames) and t.junk_bytes == 10 and t.resyncs == 1
    bad = bytearray(media)
    bad[at + 8] ^= 1
    assert M.read(bytes(bad)).bad_checksums == 1
    lost = bytearray(media)
    lost[at] = 0
    t = M.read(bytes(lost))
    assert len(t.frames) == len(s.frames) - 1 and t.junk_bytes == h.size


def crc_of_bits(bits: str) -> int:
    c = 0xFFFF
    for b in bits:
        c = (c << 1 ^ (0x8005 if c >> 15 != int(b) else 0)) & 0xFFFF
    return c


def layer_one(r, mode: int, ext: int) -> bytes:
    """A protected layer I frame with random allocations."""
    word = bytes((0xFF, 0xFE, 0x90, mode << 6 | ext << 4))
    own = 2 if mode != 3 else 1
    bound = (ext + 1) * 4 if mode == 1 else 32
    bits = "".join(f"{r.randrange(15):04b}" for _ in range(bound * own + 32 - bound))
    return finish(word, bits, M.header(word).size, r)


def layer_two(r, word: bytes, widths: list[int]) -> bytes:
    """A protected layer II frame with random allocations and scale factor selectors."""
    mode, ext = word[3] >> 6, word[3] >> 4 & 3
    own = 2 if mode != 3 else 1
    bound = (ext + 1) * 4 if mode == 1 else 32
    bits, selectors = "", ""
    for band, w in enumerate(widths):
        for _ in range(own if band < bound else 1):
            a = r.choice((0, r.randrange(1 << w)))
            bits += f"{a:0{w}b}"
            selectors += "".join(f"{r.randrange(4):02b}" for _ in range((1 if band < bound else own) * (a > 0)))
    return finish(word, bits + selectors, M.header(word).size, r)


def finish(word: bytes, bits: str, size: int, r) -> bytes:
    crc = crc_of_bits(f"{word[2]:08b}{word[3]:08b}" + bits)
    body = bits + "".join(r.choice("01") for _ in range(8 * (size - 6) - len(bits)))
    return word + crc.to_bytes(2, "big") + int(body, 2).to_bytes(size - 6, "big")


WIDTHS = {
    "a": [4] * 11 + [3] * 12 + [2] * 4, "b": [4] * 11 + [3] * 12 + [2] * 7, "c": [4] * 2 + [3] * 6, "d": [4] * 2 + [3] * 10, "lsf": [4] * 4 + [3] * 7 + [2] * 19,
}


@pytest.mark.parametrize(("mode", "ext"), [(0, 0), (1, 0), (1, 2), (2, 0), (3, 0)])
@pytest.mark.parametrize("second", [None, (0xFC, 0xA4, "a"), (0xFC, 0xA0, "b"), (0xFC, 0x20, "c"), (0xFC, 0x28, "d"), (0xF4, 0xA0, "lsf")])
def test_checksums_of_layers_one_and_two(mode, ext, second):
    r = random.Random(f"{mode}{ext}{second}")
    if second is None:
        frame = lambda: layer_one(r, mode, ext)
    else:
        version, third, table = second
        word = bytes((0xFF, version, third, mode << 6 | ext << 4))
        each = M.header(word).bitrate // (1 if mode == 3 else 2)
        if version == 0xFC:
            table = ("d" if third & 12 == 8 else "c") if each <= 48 else "a" if third & 12 == 4 or each <= 80 else "b"
        frame = lambda: layer_two(r, word, WIDTHS[table])
    frames = [frame() for _ in range(5)]
    got = M.read(b"".join(frames))
    assert (got.checked, got.bad_checksums, len(got.frames)) == (5, 0, 5)
    bad = bytearray(frames[2])
    bad[6] ^= 16  # an allocation
    got = M.read(b"".join([*frames[:2], bytes(bad), *frames[3:]]))
    assert (got.checked, got.bad_checksums) == (5, 1)


def test_old_tags():
    body = b"TT2" + (6).to_bytes(3, "big") + b"\0Title" + b"TP1" + (3).to_bytes(3, "big") + b"\0Me" + bytes(10)
    tag = b"ID3\x02\0\0" + bytes((0, 0, 0, len(body))) + body
    assert M.id3v2(tag + b"rest") == (len(tag), {"TT2": "Title", "TP1": "Me"})


def test_large_ids_beside_nulls(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id bigint, text string").coalesce(1)
    assert [r["doc_id"] for r in M.media_digest(docs).collect()] == ids
    assert [r["doc_id"] for r in M.text_media(docs).collect()] == ids


def test_tags_and_tables():
    media = M.write(M.pad(b"x"))
    s = M.read(media + b"TAG" + b"A title".ljust(30, b"\0") + bytes(95))
    assert s.tags == {"TLEN": "36", "TIT2": "A title"} and s.junk_bytes == 0
    frame = bytearray(b"\xff\xfb\x90\x00" + bytes(413))
    frame[36:40] = b"VBRI"
    frame[46:62] = (1234).to_bytes(4, "big") + (7).to_bytes(4, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (1).to_bytes(2, "big")
    frame[62:66] = (300).to_bytes(2, "big") + (400).to_bytes(2, "big")
    plain = b"\xff\xfb\x90\x00" + bytes(413)
    t = M.read(bytes(frame) + plain * 2)
    assert t.vbr == {"kind": "VBRI", "bytes": 1234, "frames": 7, "toc": [300, 400], "frames_per_entry": 1} and len(t.frames) == 2


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.integers(0, 200))
def test_reader_never_raises(data, cut):
    M.read(data)
    M.read((M.write(M.pad(data)))[cut:])


def test_digest_of_documents(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "abc"), (None, "ü" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_bytes", "'x' AS m_text")
    got = {r["doc_id"]: r for r in M.media_digest(docs).collect()}
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[2]["media_sha256"] == got[3]["media_sha256"] and got[1]["feature"] == got[4]["feature"]
    assert M.media_digest(docs.limit(0)).count() == 0


def test_parse_media_column(spark):
    stored = M.text_media(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string"))
    odd = spark.createDataFrame([(3, bytearray(b"nothing here")), (4, None), (5, bytearray())], "doc_id bigint, media binary")
    got = {r["doc_id"]: r["audio"] for r in M.parse_media(stored.unionByName(odd)).collect()}
    assert got[1]["n_frames"] == 1 and got[1]["duration_s"] == 0.036 and got[1]["seek_offsets"] and got[1]["vbr_kind"] == "Xing"
    assert got[3]["n_frames"] == 0 and got[3]["junk_bytes"] == 12 and got[3]["version"] is None
    assert got[4]["junk_bytes"] == got[5]["junk_bytes"] == 0
