"""Byte-level BPE against the tiktoken library: odd texts, all code points, rare words by join, names, empty tables."""

import hashlib
import random
import struct

import pytest
import tiktoken
from pyspark.sql import functions as F

from foliant.llm import bpe

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "a", "don't they'll I'm he'd we've you're it's 'S", "x" * 30_000, "ab" * 9000, " " * 5000 + "end", "tail   ", "\t\n a \n\n b\r\n", "\x1c!\x1c! a\x1cb \x85x\xa0y  z",
    "<|endoftext|> and <|endoftext|>", "naïve café 東京 𝔘𝔫𝔦 🙂🙂 ǅ ⅷ ² ١٢٣", "՘ new \U00011de0\U00011de1 a࢏b ⃁", "é ​‍ ﻿", "1234567 3.14 1,000", "\0\0 \0", "same words", "same words",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def held(rows, texts, library):
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids), texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_merges(vocabulary, library):
    random.seed(5)
    words = ["".join(random.choice(kind) for _ in range(n)) for kind in ("ab", "etaoin shr", "é東🙂x", "0", "aaab") for n in (*range(1, 40), 300, 4000)]
    for word in words:
        assert bpe.merged(word.encode(), vocabulary.ranks, vocabulary.longest) == library._encode_single_piece(word.encode())


def test_classes_of_all_code_points(vocabulary, library):
    """Every code point between letters, digits, signs and spaces falls into pre-tokens as the library has it."""
    find = bpe.pre_tokens(bpe.PATTERN, vocabulary.stand_ins)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(every), 8192):
        text = "".join(f"a{c}1{c}!{c} {c}\n" for c in every[at : at + 8192])
        ids = [i for segment in bpe.SEGMENTS.findall(text) for w in find(segment) for i in bpe.merged(w.encode(), vocabulary.ranks, vocabulary.longest)]
        assert ids == library.encode_ordinary(text)


@pytest.mark.parametrize("hot", [bpe.HOT, 20_000, 0])
def test_documents(spark, library, hot):
    given = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()} if hot else {}
    given |= {-i - 1: t for i, t in enumerate(ODD)}
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string").repartition(3)
    held(bpe.bpe_query(docs, hot=hot).collect(), given, library)


def test_names_nulls_and_decoding(spark, vocabulary, library):
    docs = spark.createDataFrame([(None, "one two", "x"), (7, None, None), (7, "one two", "y"), (7, "one two", "y")], "row long, text string, `a.b` string").withColumn("ids", F.lit(1)).withColumn("key", F.lit(2))
    for hot in (bpe.HOT, 0):
        out = bpe.encode(docs, vocabulary, hot=hot)
        assert out.columns == [*docs.columns, "ids1"] and out.count() == 4
        back = out.withColumn("back", bpe.decoder(vocabulary)(F.col("ids1"))).collect()
        assert all(bytes(r.back).decode() == (r.text or "") and r.ids1 == library.encode_ordinary(r.text or "") for r in back)
    assert bpe.bpe_query(docs.selectExpr("row doc_id", "text").limit(0)).count() == 0
    lists = spark.createDataFrame([([0, 1, 2],), ([],), (None,), ([5, None],), ([5, 50_256],), ([-1],)], "ids array<int>")
    decoded = [r.back for r in lists.select(bpe.decoder(vocabulary)(F.col("ids")).alias("back")).collect()]
    assert decoded == [bytearray(library.decode_bytes([0, 1, 2])), bytearray(), None, None, None, None]


def test_each_word_once(spark, vocabulary):
    docs = spark.createDataFrame([(i, "again and again" + " again" * i) for i in range(30)], "doc_id long, text string").repartition(8)
    words = {r.word: r.n for r in bpe.dictionary(docs, vocabulary).collect()}
    assert words == {"again": 30, " and": 30, " again": 30 + sum(range(30))}
    once = spark.createDataFrame([(0, "left out, as it occurs once once")], "doc_id long, text string")
    assert [(r.word, r.n) for r in bpe.dictionary(once, vocabulary).collect()] == [(" once", 2)]


def test_forgotten_segments(spark, library, monkeypatch):
    """Segments that are forgotten and learnt again, in slices of a few texts."""
    for name in ("HELD", "HELD_CHARS", "AT_A_TIME"):
        monkeypatch.setattr(bpe, name, 20)
    given = {i: t for i, t in enumerate(ODD * 3) if not t or len(t) < 1000}
    docs = spark.createDataFrame(list(given.items()), "doc_id long, text string").coalesce(1)
    for hot in (bpe.HOT, 200, 0):
        held(bpe.bpe_query(docs, hot=hot).collect(), given, library)
