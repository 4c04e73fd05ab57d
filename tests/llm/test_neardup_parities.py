"""Pairs of a large bucket that are unlike by more than a link allows are excluded before they are verified."""

import random

import numpy as np

from foliant.llm import neardup

from .test_operators import brute_components, documents


def test_differing_bits_are_at_most_the_shingles_of_one_set():
    r = np.random.default_rng(3)
    pool = np.unique(r.integers(0, 2**63, 6000, dtype=np.uint64))
    for size in (0, 1, 5, 150, 4000):
        x, y = (np.unique(r.choice(pool, size)) if size else np.empty(0, np.uint64) for _ in range(2))
        p, q, empty = neardup.parities([x, y, np.empty(0, np.uint64)])
        differ = sum(int(a).bit_count() for a in (p ^ q).view(np.uint64))
        assert not empty.any() and differ <= np.setxor1d(x, y).size and (size or not differ)
    x = pool[:150]
    p, q = neardup.parities([x, np.concatenate([x[:120], pool[150:180]])])
    assert sum(int(a).bit_count() for a in (p ^ q).view(np.uint64)) > 50


def test_a_family_beyond_the_limit_gives_few_pairs(spark, monkeypatch):
    """500 texts, each with two words of one text changed: they meet in bands, but few of them are linked."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    common, texts = [word() for _ in range(130)], []
    for _ in range(500):
        a = common[:]
        for i in r.sample(range(130), 2):
            a[i] = word()
        texts.append(" ".join(a))
    counts, verified = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *rest: counts.append(pairs.distinct().count()) or verified(pairs, *rest))
    rows = neardup.neardup_query(documents(spark, texts)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == dict(enumerate(brute_components(texts)))
    assert len(counts) == 3 and max(counts[1:]) < 5 * len(texts), counts
