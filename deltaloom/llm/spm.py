"""SentencePiece encoding and decoding with the byte span of every piece in the original text.

The text is normalised here as the model's specification says: at each place the longest
prefix found in the compiled character map (a double-array trie) is replaced, and each
normalised byte records the source byte that it stems from. That normalised text is what gets
segmented, by the library with its own normalisation switched off, so its ids are those that the whole
model gives. Pieces partition the normalised bytes, so their bounds project to spans of the original UTF-8.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from deltaloom.llm.common import computed, slices, texts_of

SPACE = "▁".encode()
UNKNOWN_PIECE, USER_PIECE, BYTE_PIECE = 2, 4, 6


class CharMap:
    """A compiled character map: a double-array trie over source bytes, and the targets that it points to."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist() if n else []
        self.targets = blob[4 + n :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and target of the longest source that starts at ``at``."""
        if not self.units:
            return None
        units, found, size = self.units, None, 0
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for b in text[at:]:
            node ^= b
            if node >= len(units) or (unit := units[node]) & 0x800000FF != b:
                break
            size += 1
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = size, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        size, start = found
        return size, self.targets[start : self.targets.index(b"\0", start)]


class Normaliser:
    """Normalisation with alignment, as the specification in a model describes it."""

    def __init__(self, spec, user_symbols: tuple[bytes, ...] = (), space_after: bool = False):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.trim, self.space = spec.add_dummy_prefix, spec.remove_extra_whitespaces, SPACE if spec.escape_whitespaces else b" "
        self.users = sorted(user_symbols, key=len, reverse=True)
        self.after = space_after

    def prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Bytes taken at ``at`` and what they become."""
        for u in self.users:
            if text.startswith(u, at):
                return len(u), u
        if hit := self.map.longest(text, at):
            return hit
        b = text[at]
        n = 1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4
        return n, text[at : at + n]

    def align(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the source offset that it stems from."""
        if self.map.units or self.trim or self.users or self.after:
            return self._general(text)
        if not text:
            return b"", np.zeros(1, np.int64)
        source = np.frombuffer(text, np.uint8)
        width = np.where(source == 32, len(self.space), 1)
        origin = np.repeat(np.arange(source.size, dtype=np.int32 if source.size < 1 << 30 else np.int64), width)
        dummy = self.space if self.dummy else b""
        return dummy + text.replace(b" ", self.space), np.r_[np.zeros(len(dummy), origin.dtype), origin, np.array([source.size], origin.dtype)]

    def _general(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at, end, out, origin = 0, len(text), bytearray(), []
        if self.trim:
            while at < end:
                n, to = self.prefix(text, at)
                if to != b" ":
                    break
                at += n
        if at == end:
            return b"", np.array([at])
        if self.dummy and not self.after:
            out += self.space
            origin += [at] * len(self.space)
        was_space = self.trim
        while at < end:
            n, to = self.prefix(text, at)
            if was_space:
                to = to.lstrip(b" ")
            kept = to == text[at : at + n]  # then byte for byte
            for i, b in enumerate(to):
                piece = self.space if b == 32 else bytes((b,))
                out += piece
                origin += [at + i * kept] * len(piece)
            if to or not was_space:
                was_space = self.trim and to.endswith(b" ")
            at += n
        if self.trim:
            while out.endswith(self.space):
                end = origin[len(out) - len(self.space)]
                del out[-len(self.space) :], origin[-len(self.space) :]
        if self.dummy and self.after:
            out += self.space
            origin += [end] * len(self.space)
        return bytes(out), np.array([*origin, end])


class Codec:
    def __init__(self, model: bytes):
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)  # decodes; never sees a text to encode
        proto = model_pb2.ModelProto.FromString(model)
        users = tuple(p.piece.encode() for p in proto.pieces if p.type == USER_PIECE)
        self.normaliser = Normaliser(proto.normalizer_spec, users, proto.trainer_spec.treat_whitespace_as_suffix)
        self.lengths = np.array([1 if p.type == BYTE_PIECE else len(p.piece.encode()) for p in proto.pieces])
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN_PIECE)
        self.names = [str(i) for i in range(len(proto.pieces))]
        off = model_pb2.NormalizerSpec(name="identity", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
        proto.normalizer_spec.CopyFrom(off)
        proto.DiscardUnknownFields()  # among them checks of the model with its own normalisation
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray]]:
        """Of each text the ids, and start and end byte of every piece as an (n, 2) array. Bytes between two pieces' spans are those that normalisation dropped."""
        aligned = [self.normaliser.align(t.encode()) for t in texts]
        ids = self.segmenter.encode([n.decode() for n, _ in aligned], num_threads=1) if texts else []
        return [(own, self.spans(n, origin, own)) for (n, origin), own in zip(aligned, ids, strict=True)]

    def spans(self, normal: bytes, origin: np.ndarray, ids: list[int]) -> np.ndarray:
        """The source spans of the pieces ``ids`` of a normalised text."""
        if not ids:
            return np.zeros((0, 2), origin.dtype)
        if self.unknown in ids:  # its piece's name says nothing of the characters that it stands for
            found = self.segmenter.encode(normal.decode(), out_type="proto").pieces
            ends = np.cumsum([len(p.surface.encode()) for p in found])
        else:
            ends = np.cumsum(self.lengths[ids])
        if ends[-1] != len(normal):
            raise ValueError("pieces do not cover the normalised text")
        return origin[np.c_[np.r_[0, ends[:-1]], ends]]

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids) if ids else ""


@lru_cache(maxsize=4)
def codec(model: bytes) -> Codec:
    return Codec(model)


def load(path: str) -> bytes:
    """The model's bytes, read by the driver; executors get them with the task."""
    with open(path, "rb") as f:
        return f.read()


def clean(text: str) -> str:
    """``text`` with lone surrogates, which UTF-8 cannot hold, replaced."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


ENCODING = "array<struct<id:int,start:int,end:int>>"


def encode_documents(docs: DataFrame, model_path: str, *, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """Add ``out_col``: every piece's id and byte span in the text. Null or empty text has no pieces; a column of that name is replaced."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    @F.pandas_udf(ENCODING)
    def pieces(column: pd.Series) -> pd.Series:
        c, out = codec(model.value), []
        texts = [clean(t) for t in texts_of(column)]
        for part in slices(map(len, texts)):
            out += [[{"id": i, "start": a, "end": b} for i, (a, b) in zip(ids, spans.tolist(), strict=True)] for ids, spans in c.encode(texts[part])]
        return pd.Series(out)

    return docs.withColumn(out_col, pieces(F.col(f"`{text_col}`")))


def decode_documents(docs: DataFrame, model_path: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the text that an array of ids decodes to. Null or empty arrays give the empty text; ids outside of the vocabulary raise."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        c = codec(model.value)
        return pd.Series([c.decode([int(i) for i in ids]) if ids is not None else "" for ids in column], dtype=object)

    return docs.withColumn(out_col, text(F.col(f"`{ids_col}`")))


DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def encoding_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode every whole text of (doc_id, text); null is empty, other columns are ignored, repeated rows stay, no rows give no rows.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of what decode(ids)
    gives, spans_sha256 of the pieces' byte bounds (start, end as little-endian 32-bit integers).
    """
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def digests(texts: list[str]) -> list[tuple]:
        c = codec(model.value)
        coded = c.encode([clean(t) for t in texts])
        return [(len(ids), sha(",".join(map(c.names.__getitem__, ids)).encode()), sha(c.decode(ids).encode()), sha(spans.astype("<i4").tobytes())) for ids, spans in coded]

    return computed(docs.select(F.col("doc_id").cast("bigint"), F.col("text")), DIGEST, digests)
