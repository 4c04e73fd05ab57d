"""Collocations against brute force; bit sets that let everything through, many flushes, wide products, ties, odd rows."""

import collections
import random
import re
import string

import pytest

from foliant.llm import collocations

DOCS = "doc_id long, text string, lang string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, longest=3, least=10, share=50, best=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            f.update((lang, words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    kept = {}
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, w), a in found.items():
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        kept[lang, w] = (score, a, f[lang, w[:k]], f[lang, w[k:]])
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= share * found[lang, w[i : i + m]]:
                    kept.pop((lang, w[i : i + m]), None)
    out = []
    for lang in {x for x, _ in kept}:
        mine = sorted((-s, -a, " ".join(w).encode(), left, right) for (x, w), (s, a, left, right) in kept.items() if x == lang)
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(mine[:best])]
    return sorted(out)


def made(n=300, seed=2):
    random.seed(seed)
    words = ["The", "new", "York", "city", "of", "é", "ÉA", "\x1c", "\xa0", "a", "B", "東京", "0"]
    text = lambda: "".join(random.choice(words) + random.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!"]) for _ in range(random.randint(0, 60)))
    odd = [None, "", " ", "...", "new york " * 400, "same same same " * 30, "x" * 50_000, "\0 a\0 b " * 12]
    return [(i, t, random.choice(["en", "en", "de", None, "und", ""])) for i, t in enumerate([text() for _ in range(n)] + odd + odd)]


def held(spark, rows, parts=3, **settings):
    got = sorted(map(tuple, collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(parts), **settings).collect()))
    assert got == brute(rows, **settings)
    return got


def test_brute_force(spark):
    assert len({r[0] for r in held(spark, made())}) == 4


@pytest.mark.parametrize(("bits", "limit", "longest", "best"), [(1 << 15, 40, 4, 2000), (1 << 28, 1 << 30, 3, 5)])
def test_sizes(spark, monkeypatch, bits, limit, longest, best):
    """Longer phrases, few best, handed on after few words."""
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    monkeypatch.setattr(collocations, "HELD", limit)
    monkeypatch.setattr(collocations, "DEALT", 2)
    held(spark, made(150, 7), longest=longest, best=best, least=4, share=70)


def test_bits_that_let_all_through(spark, monkeypatch):
    """A set with every bit changes the work, not the result."""
    monkeypatch.setattr(collocations, "bits_of", lambda grams: (b"\xff" * 4096, 32_768))
    held(spark, made(120, 3))


def test_bits_are_those_of_the_frequent(spark):
    grams = spark.createDataFrame([("en", "new york"), ("de", "é 東京"), ("und", "a b")], "lang string, phrase string")
    bits, size = collocations.bits_of(grams)
    assert size == 32_768 and sum(bin(b).count("1") for b in bits) == 3


def test_products_beyond_64_bits(spark):
    a, many = 3_000_000_000, 9_000_000_000
    levels = spark.createDataFrame([("en", "x", many), ("en", "y", many), ("en", "x y", a), ("en", "y z", a), ("en", "z", a), ("en", "x y z", a)], "lang string, phrase string, n long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocations.scored(levels).collect()}
    assert got == {"x y": (a, many, many, 111_111), "y z": (a, many, a, 333_333), "x y z": (a, many, a, 333_333)}


def test_names_and_empty_tables(spark):
    rows = [(i, "one two three. one two", "en") for i in range(12)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", phrase int, n int")
    assert sorted(map(tuple, collocations.collocation_query(docs).collect())) == brute(rows)
    assert collocations.collocation_query(docs.limit(0)).count() == 0
