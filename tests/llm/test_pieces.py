"""SentencePiece: ids against the library's own encoder, round trips, odd texts, the rarer units' joins, both kinds of models."""

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from foliant.llm import pieces as P

ODD = [
    "", None, "  a  b   c\n\n\t x", "1234 5.67 ²².² Ünïcödé 😀 日本語", "a" * 200, "    ", "don't stop—“no”… नमस्ते दुनिया สวัสดี", "x=y+z; // foo(bar)[1] == {}",
    "ab" * 500 + "cdefgh" * 40 + " " * 70 + "é" * 99, "The same text.", "The same text.", "0123 4567 8901", "\x00\x01 control", "word " * 300,
    "ab" * 300, "a" * 62, "a" * 61 + " " + "a" * 63, "the" * 41 + "é" + "the" * 41, "zq" * 80 + "in" * 90, "iiiiiiiiii" * 13,
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("hot", [P.HOT, 400, 20])
def test_bpe_equals_library(spark, hot):
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rows = P.encode(frame(spark, ODD), P.Pieces(), hot).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert list(r.encoded.ids) == library.encode(r.text or ""), r.text
        assert r.encoded.n_tokens == len(r.encoded.ids) and r.encoded.round_trip


def test_bpe_equals_library_on_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in P.encode(docs.select("doc_id", "text"), P.Pieces()).collect():
        assert list(r.encoded.ids) == library.encode(r.text) and r.encoded.round_trip


def test_unigram_equals_library(spark, tmp_path):
    """The same lattice folded by Viterbi: a unigram model of the same pieces with scores that have no ties."""
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(P.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for i, p in enumerate(m.pieces):
        if p.type == 1:
            p.score = -(5.0 + 0.0003 * (i * 7919 % 32003)) / (1 + 0.03 * len(p.piece))
    path = tmp_path / "unigram.model"
    path.write_bytes(m.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    pieces = P.Pieces(str(path))
    assert pieces.unigram
    texts = ["the quick brown fox", "Anblewh sttible athawh", "é日本 x", "a" * 80, "über straße 12", ""]
    for r in P.encode(frame(spark, texts), pieces).collect():
        assert list(r.encoded.ids) == library.encode(r.text), r.text


def test_empty_table_and_clashing_names(spark):
    docs = frame(spark, ["a b"]).selectExpr("doc_id", "text", "1 as encoded", "2 as tail", "3 as text_key", "4 as ids")
    out = P.encode(docs, P.Pieces(), 0)
    assert out.columns[:6] == docs.columns and out.first()[6].n_tokens > 0
    assert P.pieces_query(frame(spark, ["x"]).limit(0)).count() == 0


def test_space_sign_is_no_round_trip(spark):
    assert not P.encode(frame(spark, ["a▁b"]), P.Pieces()).first().encoded.round_trip


def test_runs_of_pieces_of_one_score(spark):
    """Runs of spaces have pieces of one score, some of them merged from others."""
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    texts = [" " * n + x for n in range(80) for x in ("", "x", "é ")]
    for r in P.encode(frame(spark, texts), P.Pieces()).collect():
        assert list(r.encoded.ids) == library.encode(r.text), repr(r.text)
