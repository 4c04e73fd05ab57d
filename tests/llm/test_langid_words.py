"""Words of any length, letters with marks, and what is no letter."""

import numpy as np
import pytest

from foliant.llm import langid

from .test_operators import documents


def test_words_are_letters_with_their_marks():
    assert langid.words_of("² ½ ① _ 12") == []
    assert langid.words_of("हिन्दी Straße2x") == ["▁हिन्दी", "▁straße", "▁x"]


def test_long_words_are_summed_whole():
    """Against the sum in logs, over a word far beyond what fits a float without scaling."""
    ids, p = {"a": 0, "b": 1, "ab": 2}, np.array([[0.3, 1e-3], [0.2, 1e-4], [0.1, 0.5], [1e-7, 1e-7]])
    word = "ab" * 900
    logs = [np.zeros(2)]
    for e in range(1, len(word) + 1):
        options = [logs[s] + np.log(p[ids[word[s:e]]]) for s in range(max(0, e - 2), e) if word[s:e] in ids]
        logs.append(np.logaddexp.reduce(options, axis=0))
    found = langid.forward([word, "b"], langid.edges([word, "b"], ids, 2), p)
    assert found[1, 1] == pytest.approx(np.log(p[1])) and found[0, len(word)] == pytest.approx(logs[-1], rel=1e-9)
    counts = langid.expected(["ab" * 300], langid.edges(["ab" * 300], ids, 2), p, np.ones((1, 2)))
    both = p[2] / (p[2] + p[0] * p[1])  # each "ab" by itself
    assert counts[2] == pytest.approx(300 * both) and counts[0] == pytest.approx(300 * (1 - both))


def test_odd_texts_and_ids(spark):
    texts = ["the word"] * 30 + ["das wort"] * 30 + ["² ½ ①", "x" * 30_000, "the " * 50_000]
    docs = documents(spark, texts).selectExpr("if(doc_id = 5, null, doc_id) as doc_id", "text", "if(doc_id < 30, 'en', 'de') as lang", "source", "n_chars")
    got = {r.doc_id: r for r in langid.language_query(docs).collect()}
    assert got[60].lang_pred == "und" and got[60].score == 0 and got[62].lang_pred == "en" and not got[None].held_out
    assert got[0].lang_pred == "en" and got[40].lang_pred == "de" and len(got) == len(texts)
