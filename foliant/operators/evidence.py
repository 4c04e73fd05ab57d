"""Evidence among texts: which texts hold which passages, white space aside."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passages that one automaton holds; more are sought in further passes over the texts.
BLOCK = 50_000


def holding(texts: DataFrame, ident: str, text: str, passages: DataFrame, item: str, passage: str) -> DataFrame:
    """(item, ident) of each passage and each text that holds it. Passages without a character but blanks are in none.

    The passages are a stated query set, dealt into blocks by a hash, of which the driver reads one at a time and broadcasts it.
    The texts are read once for each block and never shuffled or paired with passages that they don't hold: an Aho-Corasick
    automaton, built once in a task, finds all of a block's passages in one scan of a text.
    """
    bare = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "")
    part = F.pmod(F.xxhash64("i", "p"), F.lit(max(1, -(-passages.count() // BLOCK))))
    named = passages.select(F.col(item).alias("i"), bare(passage).alias("p")).where("p != ''").withColumn("part", part)
    kind = dict(passages.dtypes)[item]
    found = None
    for at in [r.part for r in named.select("part").distinct().collect()] or [0]:
        block = [(r.i, r.p) for r in named.where(F.col("part") == at).toLocalIterator()]
        held = _finder(texts.sparkSession.sparkContext.broadcast(block), kind)
        one = texts.select(F.col(ident), F.explode(held(bare(text))).alias(item)).select(item, ident)
        found = one if found is None else found.unionByName(one)
    return found


def _finder(part, kind: str):
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = ahocorasick.Automaton()
        for i, p in part.value:
            terms.add_word(p, [*terms.get(p, []), i])
        terms.make_automaton()
        for stripped in batches:
            yield pd.Series([sorted({i for _, ids in terms.iter(t) for i in ids}) if len(terms) else [] for t in stripped])

    held.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(held, f"array<{kind}>")
