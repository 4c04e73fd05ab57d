"""Units cut and hashed many at a time: as by the pattern, and found again by their hashes."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import pieces as P

from .test_pieces import ODD, frame


def texts():
    r = random.Random(6)
    return [t or "" for t in ODD] + ["".join(r.choice(" ▁\n\t.,;ab1290éз日😀²«-") for _ in range(r.randrange(40))) for _ in range(3000)]


def test_cuts_are_the_patterns():
    pieces = P.Pieces()
    for signs, digits, cut in ((pieces.signs, pieces.digits, pieces.cut), (pieces.signs, "several", pieces.cut.replace("[0-9]|", "[0-9]+|")), (set(), "", f"{P.SPACE}*[^{P.SPACE}]+|{P.SPACE}+")):
        cutter, find, hashes = P.Cutter(signs, digits), re.compile(cut).findall, {}
        left = texts()
        for chunk in P.in_chunks(left, 500):
            row, starts, sizes, found, bounds = cutter.cut(chunk)
            units = [row[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
            assert [units[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)] == [find(P.prepared(t)) for t in chunk]
            assert all(hashes.setdefault(u, h) == h for u, h in zip(units, found.tolist(), strict=True) if len(u) < P.LONG)
            left = left[len(chunk) :]
        assert not left and len(set(hashes.values())) == len(hashes)
        assert cutter.hashes(list(hashes)).tolist() == list(hashes.values())


def test_places():
    r = np.random.default_rng(2)
    for n in (0, 1, 5000):
        known = np.unique(r.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(r.integers(0, 2)))
        wanted = np.concatenate([known, r.integers(0, 2**64, 999, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        assert P.Places(known).of(wanted).tolist() == [{h: i for i, h in enumerate(known.tolist())}.get(h, -1) for h in wanted.tolist()]


def test_counts(spark):
    pieces, want = P.Pieces(), {}
    find = P.units_of(pieces.cut, pieces.pairs)
    for t in texts():
        for u in find(P.prepared(t)):
            want[u] = want.get(u, 0) + 1
    assert {r.unit: r.n for r in P.unit_counts(frame(spark, texts()).repartition(3), pieces).collect()} == want
    found = spark.createDataFrame([(u,) for u in want], "unit string").select("unit", P.hashed_units(pieces)("unit").alias("h")).agg(F.countDistinct("h").alias("n")).first().n
    assert found == len(want)
