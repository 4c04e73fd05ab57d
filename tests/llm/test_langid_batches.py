"""Many texts and words at once: the same words and lattices as one at a time, in a part of the time."""

import os
import random
import subprocess
import sys
from time import process_time
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from foliant.llm import langid
from foliant.llm.pieces import Pieces

ODD = [None, "", " \n\t", "12 34 !!", "one", "Ein Wort, ein Wort", "x" * 3000, "́́á́b ́ ć", "́", "हिन्दी Straße2x", "İI ΟΔΟΣ ΟΔΟΣΑ Σ", "𝒜𝓑 𐐀𐐁 日本語 日本\n語", "a\x00b\x85c", "one"]


def plain_edges(words, ids, longest):
    out = []
    for k, w in enumerate(words):
        for s in range(len(w)):
            for e in range(s + 1, min(len(w), s + longest) + 1):
                if w[s:e] in ids or e == s + 1:
                    out.append((e, e - s, k, ids.get(w[s:e], -1)))
    return sorted(out)


def test_words_of_many_texts_at_once():
    kinds = langid.kinds()
    for texts in (ODD, ODD[::-1], [None], ["́"], []):
        words, at, counts = langid.distinct_words(texts, kinds)
        one_by_one = [langid.words_of(t or "") for t in texts]
        assert counts.tolist() == [len(w) for w in one_by_one] and len(set(words)) == len(words)
        assert [words[i] for i in at] == [w for ws in one_by_one for w in ws]


def test_lattices_of_many_words_at_once():
    pieces = Pieces()
    words = [*dict.fromkeys(w for t in ODD for w in langid.words_of(t or "")), "", "the", "日本語𝒜"]
    for ids, longest in ((pieces.id, pieces.longest), ({"a": 0, "ab": 5, "abcd": 2, "bc": 1}, 4), ({"abc": 0}, 3)):
        for some in (words, ["abcd", "zabcab"], [""], []):
            word, start, end, piece = langid.edges(some, ids, longest)
            assert list(zip(end, end - start, word, piece, strict=True)) == plain_edges(some, ids, longest)


def test_prediction_takes_less_than_looking_up_each_substring(spark):
    r, pieces = random.Random(9), Pieces()
    parts = ["tion", "the", "er", "and", "ou", "in", "sch", "que", "ñ", "è", "st", "ung"]
    words = list(dict.fromkeys("".join(r.choices(parts, k=r.randint(3, 6))) for _ in range(40_000)))
    texts = pd.Series([" ".join(words[i : i + 400]) for i in range(0, len(words), 400)])
    p = np.random.default_rng(9).random((len(pieces.surface) + 1, 4))
    predict = langid.predictor(["a", "b", "c", "d"], SimpleNamespace(value=p), pieces).func
    began = process_time()
    out = pd.concat(predict(iter([texts])))
    took = process_time() - began
    began = process_time()
    found = 0
    for w in (langid.SPACE + w for w in words):
        for s in range(len(w)):
            for e in range(s + 1, min(len(w), s + pieces.longest) + 1):
                found += pieces.id.get(w[s:e]) is not None
    assert len(out) == len(texts) and found and took < 0.8 * (process_time() - began)


def test_prediction_needs_no_package_on_the_executors(spark, tmp_path):
    pieces = Pieces()
    p = np.full((len(pieces.surface) + 1, 2), 1e-4)
    (tmp_path / "f").write_bytes(cloudpickle.dumps(langid.predictor(["a", "b"], SimpleNamespace(value=p), pieces).func))
    code = "import pandas, pickle; print(next(pickle.load(open('f', 'rb'))(iter([pandas.Series(['the word', None])]))).values.tolist())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert found.stdout.strip() == "[['a', 0.5], ['und', 0.0]]", found.stderr
