"""SentencePiece: ids are the library's, and every piece's span is where its text stands."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from deltaloom.llm import spm
from deltaloom.llm.queries import MODEL

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = spm.codec(spm.load(MODEL))

texts = st.text(st.sampled_from(list("ab E\n\té▁中\U0001f600�1")) | st.characters(exclude_categories=("Cs",)), max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_spans_cover_the_text(text):
    raw = text.encode()
    [(ids, spans)] = CODEC.encode([text])
    assert ids == LIBRARY.encode(text)
    assert len(spans) == len(ids)
    if ids:
        assert spans[0][0] == 0 and spans[-1][1] == len(raw)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    for i, (a, b) in zip(ids, spans.tolist(), strict=True):
        piece = LIBRARY.id_to_piece(i)
        if not LIBRARY.is_byte(i):
            assert raw[a:b].decode().replace(" ", "▁") in (piece, piece.removeprefix("▁"))
        elif b > a:
            assert raw[a:b] == bytes([int(piece[3:5], 16)])


def test_general_normaliser_agrees_with_the_plain_one():
    for text in ("", " ", "a", "a b", "  two  spaces ", "é\n中"):
        raw = text.encode()
        plain, at = CODEC.normaliser.align(raw)
        general, origin = CODEC.normaliser._general(raw)
        if raw:
            assert (plain, at.tolist()) == (general, origin.tolist())


def trie(pairs: dict[bytes, bytes]) -> bytes:
    """A compiled character map of some replacements, laid out by hand as a double array."""
    targets, where = b"", {}
    for s, t in pairs.items():
        where[s] = len(targets)
        targets += t + b"\0"
    nodes, units, used = {b"": 0}, {}, {0}
    for prefix in sorted({s[:i] for s in pairs for i in range(len(s) + 1)}, key=len):
        labels = sorted({s[len(prefix)] for s in pairs if s.startswith(prefix) and len(s) > len(prefix)})
        node, leaf = nodes[prefix], prefix in pairs
        base = next(b for b in range(1, 100_000) if not any((node ^ b ^ x) in used for x in [*labels, *([0] if leaf else [])]) and b < 1 << 20)
        own = units.get(node, 0) | base << 10 | (256 if leaf else 0)
        units[node] = own
        for x in labels:
            at = node ^ base ^ x
            used.add(at)
            units[at] = x
            nodes[prefix + bytes([x])] = at
        if leaf:
            used.add(node ^ base)
            units[node ^ base] = 1 << 31 | where[prefix]
    size = -(-(max(units) + 1) // 256) * 256
    blob = b"".join((units.get(i, 0)).to_bytes(4, "little") for i in range(size))
    return len(blob).to_bytes(4, "little") + blob + targets


def test_longest_prefix_of_the_character_map():
    m = spm.CharMap(trie({b"a": b"x", b"ab": b"", b"abcd": b"yy", "ﬁ".encode(): b"fi"}))
    assert m.longest(b"a", 0) == (1, b"x") and m.longest(b"abc", 0) == (2, b"") and m.longest(b"zabcd", 1) == (4, b"yy")
    assert m.longest("ﬁx".encode(), 0) == (3, b"fi") and m.longest(b"b", 0) is None


def test_alignment_through_a_map_with_trimmed_spaces():
    spec = model_pb2.NormalizerSpec(precompiled_charsmap=trie({"ﬁ".encode(): b"fi", b"\t": b" ", "①".encode(): b"1"}), add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    n = spm.Normaliser(spec)
    text = "  ﬁ \t① ".encode()
    out, origin = n.align(text)
    assert out == "▁fi▁1".encode()
    assert origin.tolist() == [2, 2, 2, 2, 2, 5, 5, 5, 7, 10]
    assert n.align(b"   ")[0] == b"" and n.align(b"")[0] == b""


def test_columns_and_odd_rows(spark):
    rows = [(1, "Hello  world é"), (2, None), (3, ""), (4, "x" * 100_000), (None, "Hello  world é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS pieces", "1 AS n_tokens")
    got = {r["doc_id"]: r for r in spm.encode_documents(docs, MODEL).collect()}
    assert [p["id"] for p in got[1]["pieces"]] == LIBRARY.encode(rows[0][1]) and got[2]["pieces"] == got[3]["pieces"] == []
    back = spm.decode_documents(spark.createDataFrame([(1, LIBRARY.encode("Hello  world é")), (2, None), (3, [])], "doc_id bigint, ids array<int>"), MODEL).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == ["Hello  world é", "", ""]
    digests = {r["doc_id"]: r for r in spm.encoding_digest(docs, MODEL).collect()}
    for i, text in rows:
        ids = LIBRARY.encode(text or "")
        assert digests[i]["n_tokens"] == len(ids) and digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert spm.encoding_digest(docs.limit(0), MODEL).count() == 0


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in spm.encoding_digest(docs, MODEL).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode(r["text"] or "")
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_pieces_that_cannot_cover_raise():
    with pytest.raises(ValueError):
        CODEC.spans(*CODEC.normaliser.align(b"abc"), LIBRARY.encode("something else"))


def small_model(**spec) -> bytes:
    """A BPE model without byte fallback, written by hand; nothing is trained."""
    m = model_pb2.ModelProto()
    names = [("<unk>", 2), ("<s>", 3), ("</s>", 3), ("@user", 4), *[(p, 1) for p in ("▁a", "ab", "fi", "▁fi", "fix", "11")], *[(c, 1) for c in "▁abfix1é"]]
    for i, (piece, kind) in enumerate(names):
        m.pieces.add(piece=piece, score=-float(i), type=kind)
    m.trainer_spec.model_type = model_pb2.TrainerSpec.BPE
    m.trainer_spec.vocab_size = len(names)
    m.normalizer_spec.CopyFrom(model_pb2.NormalizerSpec(name="own", **spec))
    return m.SerializeToString()


MAP = {"ﬁ".encode(): b"fi", b"\t": b" ", "①".encode(): b"1", "①①".encode(): b"111", b"A": b"a", b"#": b""}


@pytest.mark.parametrize("trim", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
@settings(max_examples=150, deadline=None)
@given(text=st.lists(st.sampled_from([*"ab fix1é\tﬁ①A#Zß中@", "@user", "  "]), max_size=30).map("".join))
def test_a_model_with_a_map_and_unknown_pieces(trim, dummy, text):
    model = small_model(precompiled_charsmap=trie(MAP), add_dummy_prefix=dummy, remove_extra_whitespaces=trim, escape_whitespaces=True)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    [(ids, spans)] = spm.codec(model).encode([text])
    assert ids == library.encode(text)
    raw = text.encode()
    assert all(0 <= a <= b <= len(raw) for a, b in spans.tolist())
    assert all(a[1] == b[0] for a, b in zip(spans.tolist(), spans.tolist()[1:], strict=False))
    for i, (a, b) in zip(ids, spans.tolist(), strict=True):  # what stands in a span becomes the piece
        if i and "#" not in text and not trim and library.id_to_piece(i) == "é":
            assert raw[a:b].decode().strip() == "é"
    if text == "Zß":
        assert ids.count(0) == 1


def test_unknown_pieces_have_their_own_span():
    model = small_model(add_dummy_prefix=True, remove_extra_whitespaces=False, escape_whitespaces=True)
    [(ids, spans)] = spm.codec(model).encode(["a中文b"])
    assert ids[1] == 0 and spans.tolist()[1] == [1, 7] and spans.tolist()[-1] == [7, 8]


def test_large_ids_beside_nulls(spark):
    ids = [2**60 + 1, None, 2**60 + 3]
    docs = spark.createDataFrame([(i, "x") for i in ids], "doc_id bigint, text string").coalesce(1)
    assert [r["doc_id"] for r in spm.encoding_digest(docs, MODEL).collect()] == ids
