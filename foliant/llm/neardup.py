"""MinHash near-dedup (4): fast similarity sketches, banding, exact verification, components.

A document's set are the distinct shingles of five words of its text, A-Z lower-cased. Documents with equal sets form a class.
Classes are linked if 100 * intersection >= percent * union: 85 in the query, 80 in the pipeline's stage (see At).

The sketch (Dahlgaard, Knudsen, Thorup: Fast similarity sketching, 2017) has T coordinates. In round i < T each element goes
to a coordinate chosen by a hash, with a value that begins with i; in round T + j all elements go to coordinate j. A
coordinate keeps its least value, and the rounds end once all are filled, after 2 T rounds at the latest. So each of them
agrees with the probability of the sets' similarity, concentrated as for independent ones. At similarity 0.85, 25 bands of 6
coordinates meet in at least one with probability 1 - (1 - 0.85^6)^25 > 0.99999, at 0.8 30 bands of 5 with 1 - (1 - 0.8^5)^30
> 0.99999; more above.

Near copies of near copies form groups whose members are mostly not linked with each other, so pairs are sought in rounds,
and each round only across the components that the links so far give:

1. FIRST_BANDS bands of FIRST_ROWS coordinates find the closest pairs: each class of a bucket with PIVOTS others of it.
2. The bands of At.rows coordinates, in buckets of more than PAIRED classes that span components: again with PIVOTS others.
3. In all buckets of these bands that still span components: all pairs across them. Here nothing is left out but pairs whose
   sketches disagree in more than At.most_apart of T coordinates (compared by four bits each), over five standard deviations
   from what the least similarity of a link gives, and pairs of two classes of large buckets that one of two exact bounds on
   such pairs excludes (used for no others): the number of shingles that others of these share at all, and the number of
   bits in which the sets' parities differ (see parities), which is at most that of the shingles in one set only.

Every pair is confirmed on the full sets. A pair that none of the rounds emits lies within one component already.

Defined results. Null, empty, or only white space: an empty set (n_shingles 0), linked with nothing, a component of its own.
Fewer than five words: the whole sequence is the one shingle. Equal rows get equal results. Null doc_id: part of its
component, whose id is its least doc_id that isn't null (or null). An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, kept_table, lookup, small_batches, typed
from .components import components

SHINGLE, PERCENT, T, MEMO = 5, 85, 150, 100_000
FIRST_BANDS, FIRST_ROWS, PAIRED, PIVOTS = 12, 12, 16, 3
ODD = 1024
_U = np.uint64


@dataclass(frozen=True)
class At:
    """The least similarity of a link, in percent, and the bands for it."""

    percent: int = PERCENT
    bands: int = 25
    rows: int = 6

    @property
    def most_apart(self) -> int:
        """5.25 standard deviations above the mean number of coordinates whose four bits differ."""
        differ = (1 - self.percent / 100) * 15 / 16
        return math.ceil(T * differ + 5.25 * math.sqrt(T * differ * (1 - differ)))


QUERY, STAGE = At(), At(80, 30, 5)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes(dict):
    """Words to 64-bit hashes, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: Hashes) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        total = mixed(total + h[j : j + n] + _U(0x9E3779B97F4A7C15))
    return np.unique(total)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of t coordinates for each set; sets must not be empty."""
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    element = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), np.array([len(s) for s in sets], np.int64))
    for i in range(2 * t):
        h = mixed(element + _U((i + 1) * 0xD1342543DE82EF95 % 2**64))
        at = owner * t + (((h >> _U(40)) % _U(t)).astype(np.int64) if i < t else i - t)
        # the round comes first in a value, so that earlier rounds win
        np.minimum.at(flat, at, (_U(i) << _U(55)) | (mixed(h) >> _U(9)))
        open_ = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not open_.any():
            break
        if i % 2 or i < 4:
            keep = open_[owner]
            element, owner = element[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.zeros((len(sketch), bands), np.uint64)
    for r in range(rows):
        keys = mixed(keys + sketch[:, r : bands * rows : rows] + _U(r + 1))
    return mixed(keys + np.arange(rows, rows + bands, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def nibbles(sketch: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, sixteen to a number."""
    n, t = sketch.shape
    four = np.zeros((n, -(-t // 16) * 16), np.uint64)
    four[:, :t] = mixed(sketch) & _U(15)
    return (four.reshape(n, four.shape[1] // 16, 16) << (np.arange(16, dtype=np.uint64) * _U(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set ODD bits, 64 to a number: whether an odd number of its shingles falls on the bit.

    A shingle of both of two sets changes nothing in the xor of theirs, and one of a single set flips one bit of it. So the bits
    in which they differ are never more than the shingles that are in one set only.
    """
    owner = np.repeat(np.arange(len(sets)), np.array([len(s) for s in sets], np.int64))
    at = (np.concatenate(sets) & _U(ODD - 1)).astype(np.int64) if len(owner) else np.empty(0, np.int64)
    odd = np.bincount(owner * ODD + at, minlength=len(sets) * ODD).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sets), ODD), axis=1).view(np.int64)


@F.pandas_udf(typed("array<long>"))
def parity(sets: pd.Series) -> pd.Series:
    return pd.Series(list(parities([x.view(np.uint64) for x in sets])), dtype=object)


def sketcher(at: At):
    """A UDF text -> struct<n, key, first_bands, bands, nibbles>."""

    @F.pandas_udf(typed("n long, key binary, first_bands array<long>, bands array<long>, nibbles array<long>"))
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for texts in batches:
            sets = [shingles(t, hashes) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            sketch = sketches([sets[i] for i in full])
            out = {"n": [len(s) for s in sets], "key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]}
            for name, found in (("first_bands", band_keys(sketch, FIRST_BANDS, FIRST_ROWS)), ("bands", band_keys(sketch, at.bands, at.rows)), ("nibbles", nibbles(sketch))):
                out[name] = [None] * len(sets)
                for i, x in zip(full, found, strict=True):
                    out[name][i] = x
            yield pd.DataFrame(out)

    return sketched


@F.pandas_udf(typed("array<long>"))
def full_set(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hashes = Hashes()
    for texts in batches:
        yield pd.Series([shingles(t, hashes).view(np.int64) for t in texts])


def linker(percent: int):
    """A UDF (set, set) -> whether they are linked."""

    def one(x: np.ndarray, y: np.ndarray) -> bool:
        both = np.intersect1d(x, y, assume_unique=True).size
        return 100 * both >= percent * (len(x) + len(y) - both)

    @F.pandas_udf(typed("boolean"))
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    return linked


def apart(a: str, b: str) -> Column:
    """In how many coordinates two sketches' four bits differ."""
    def one(i: int) -> Column:
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for shift in (1, 2):  # any bit of four
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return sum((one(i) for i in range(1, -(-T // 16))), one(0))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class keys whose full sets are similar enough. Sets are made anew, for the classes in pairs only."""
    fits = F.least("an", "bn") * 100 >= F.greatest("an", "bn") * percent
    pairs = kept_table(pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), classes, docs)
    # a class in very many pairs is dealt over parts of 128 of them
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 128).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    left = sets.join(parts.withColumnRenamed("a", "key"), "key").select(F.col("key").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("set").alias("a_set"))
    right = dealt.join(sets.select(F.col("key").alias("b"), F.col("set").alias("b_set")), "b")
    return kept_table(right.join(left, ["a", "part"]).where(linker(percent)("a_set", "b_set")).select("a", "b"), "verified")


def sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """key, set of these classes, from the texts of their representatives."""
    needed = kept_table(nodes.join(classes.select("key", "rep"), "key").select("key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.hash").alias("hash")), "needed")
    found = lookup(docs.select("doc_id", "text").withColumn("hash", F.xxhash64("text")), needed.groupBy("hash").agg(F.min(F.struct("key", "rep_id")).alias("rep")), "hash", "inner", spread=F.col("doc_id"))
    found = found.where(F.col("doc_id").eqNullSafe(F.col("rep.rep_id"))).select(F.col("rep.key").alias("key"), full_set("text").alias("set"))
    sets = kept_table(found, "sets")
    if sets.count() > needed.count():  # equal rows
        sets = kept_table(sets.dropDuplicates(["key"]), "sets")
    return sets


def members_of(classes: DataFrame, bands: str, *more: str) -> DataFrame:
    """band, size, key, n of the buckets with several classes. The rows are shuffled once: both sides of the join read that."""
    banded = classes.select("key", "n", *more, F.explode(bands).alias("band")).repartition("band")
    sizes = banded.groupBy("band").agg(F.count("*").alias("size"), *[F.max(c).alias(f"max_{c}") for c in ("key", "n", *more)]).where("size > 1 and max_n > 0 and max_key is not null")
    return banded.join(sizes.select("band", "size"), "band")


def with_pivots(members: DataFrame, *same: str) -> DataFrame:
    """Pairs of each member with up to PIVOTS of its bucket, picked by a hash; a and b are structs."""
    side = F.struct("key", "n", *same)
    pivots = members.groupBy("band").agg(*[F.min_by(side, F.xxhash64("key", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)])
    paired = members.join(pivots, "band").select(side.alias("a"), F.explode(F.array(*[f"p{j}" for j in range(PIVOTS)])).alias("b"))
    return paired.where("a.key != b.key")


def flat(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a.key").alias("a"), F.col("a.n").alias("an"), F.col("b.key").alias("b"), F.col("b.n").alias("bn"))


def spanning(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members, with their roots, of the buckets that span several components."""
    rooted = kept_table(members.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    spans = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("band")
    return kept_table(rooted.join(spans, "band"), "spanning")


def shared_at_most(many: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """key, most, odd: how many of a class' shingles any other class of large buckets has too, and its parities, for the
    classes in these.

    A shingle that no other of them has is in no intersection of two of them; so this bounds these, exactly. It says nothing
    on pairs with a class that is in small buckets only.
    """
    nodes = many.select("key").distinct()
    sets = sets_of(nodes, classes, docs)
    single = sets.select("key", F.explode("set").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("key").alias("key")).where("c = 1")
    alone = single.groupBy("key").agg(F.count("*").alias("alone"))
    named = sets.select("key", F.size("set").alias("n"), parity("set").alias("odd")).join(alone, "key", "left")
    return kept_table(named.select("key", (F.col("n") - F.coalesce("alone", F.lit(0))).cast("long").alias("most"), "odd"), "bounds")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two structs (n, most) can have an intersection that links them; most is null outside of large buckets."""
    both = F.col(f"{a}.most").isNotNull() & F.col(f"{b}.most").isNotNull()
    least = F.when(both, F.least(F.col(f"{a}.most"), F.col(f"{b}.most"))).otherwise(F.least(F.col(f"{a}.n"), F.col(f"{b}.n")))
    return (100 + percent) * least >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def few_differ(a: str, b: str, percent: int) -> Column:
    """Whether two structs (n, odd) can have as few shingles in one set only as a link allows; true if odd is null for one."""
    differ = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(1, ODD // 64)), F.bit_count(F.col(f"{a}.odd")[0].bitwiseXOR(F.col(f"{b}.odd")[0])))
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col(f"{a}.n") + F.col(f"{b}.n")), F.lit(True))


def all_across(members: DataFrame, at: At) -> DataFrame:
    """All pairs of a bucket across components that may link, each in the first band that it shares.

    What lies outside a bucket's largest component meets everything in others; the first is few, and dealt out to 16 parts of
    the second.
    """
    salts = 16
    sizes = members.groupBy("band", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("band").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    named = members.join(main, "band")
    side = F.struct("key", "n", "most", "odd", "root", "nibbles", "bands")
    x = named.where("root != main").select("band", side.alias("a"), F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"))
    y = named.select(F.col("band").alias("band_"), side.alias("b"), "main", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt_"))
    first_shared = F.coalesce(*[F.when(F.col("a.bands")[i] == F.col("b.bands")[i], F.col("a.bands")[i]) for i in range(at.bands)])
    across = (F.col("a.root") != F.col("b.root")) & ((F.col("b.root") == F.col("main")) | (F.col("a.key") < F.col("b.key")))
    near = may_link("a", "b", at.percent) & (apart("a.nibbles", "b.nibbles") <= at.most_apart) & few_differ("a", "b", at.percent) & (first_shared == F.col("band"))
    return flat(x.join(y, (F.col("band") == F.col("band_")) & (F.col("salt") == F.col("salt_")) & across & near))


def joined_by(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components after more links: only the links between their roots are gone through."""
    root = lambda side: found.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    rooted = kept_table(more.join(root("a"), "a", "left").join(root("b"), "b", "left").select("a", "b", F.coalesce("a_root", "a").alias("ra"), F.coalesce("b_root", "b").alias("rb")), "rooted")
    above = components(rooted.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    new = rooted.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("root")), F.struct(F.col("b").alias("node"), F.col("rb").alias("root")))).alias("x")).select("x.*")
    every = found.unionByName(new).distinct().join(above, "root", "left")
    return kept_table(every.select("node", F.coalesce("top", "root").alias("root")), "components")


def near_copies(docs: DataFrame, at: At = QUERY) -> tuple[DataFrame, DataFrame]:
    """(one row for each document: doc_id, hash of the text, n, key; one for each class in a group: key, component, component_id)."""
    small_batches(docs.sparkSession)
    rows = kept_table(docs.select("doc_id", F.xxhash64("text").alias("hash"), sketcher(at)("text").alias("s")).select("doc_id", "hash", "s.*"), "sketches")
    # a null doc_id comes after all others
    rep = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("hash"))).alias("rep")
    classes = kept_table(rows.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"), rep, *[F.first(c).alias(c) for c in ("n", "first_bands", "bands", "nibbles")]), "classes")
    found = kept_table(components(verified(flat(with_pivots(members_of(classes, "first_bands"))), classes, docs, at.percent)), "components")
    members = spanning(members_of(classes, "bands"), found)
    if members.limit(1).count():
        many = members.where(F.col("size") > PAIRED)
        bounded = members.join(classes.select("key", "nibbles", "bands"), "key")
        if many.limit(1).count():
            bounded = bounded.join(shared_at_most(many, classes, docs), "key", "left")
        else:
            bounded = bounded.withColumns({"most": F.lit(None).cast("long"), "odd": F.lit(None).cast("array<long>")})
        # all others of a large bucket are bounded too, so a class can be left out there; in small ones it meets other classes
        members = kept_table(bounded.where((F.col("size") <= PAIRED) | (100 * F.col("most") >= at.percent * F.col("n"))), "bounded")
        near = with_pivots(members.where(F.col("size") > PAIRED), "root", "nibbles", "most", "odd").where("a.root != b.root").where(may_link("a", "b", at.percent) & (apart("a.nibbles", "b.nibbles") <= at.most_apart) & few_differ("a", "b", at.percent))
        for pairs in (lambda: flat(near), lambda: all_across(spanning(members.drop("root"), found), at)):
            more = verified(pairs(), classes, docs, at.percent)
            if more.limit(1).count():
                found = joined_by(found, more)
    grouped = classes.where("copies > 1").select("key").unionByName(found.select(F.col("node").alias("key"))).distinct()
    named = classes.select("key", "least").join(grouped, "key").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("root", "key"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows, kept_table(named.select("key", "component").join(ids, "component"), "groups")


def neardup_query(docs: DataFrame) -> DataFrame:
    rows, groups = near_copies(docs)
    named = lookup(rows.select("doc_id", "n", "key", "hash"), groups.select("key", F.struct("component_id").alias("g")), "key", spread=F.col("hash"))
    component = F.when(F.col("g").isNull(), F.col("doc_id")).otherwise(F.col("g.component_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, at: At = STAGE) -> DataFrame:
    """The pipeline's stage: of each component one document, that with its id (of equal rows, one).

    Documents that go are few and found by doc_id and the text's hash; the texts themselves are not shuffled, but for rows
    that come up more than once under the kept id.
    """
    rows, groups = near_copies(docs, at)
    named = lookup(rows.select("doc_id", "n", "key", "hash"), groups.select("key", "component", "component_id", F.lit(True).alias("grouped")), "key", spread=F.col("hash"))
    stays = kept_table(named.where("grouped").groupBy("doc_id", "hash").agg(F.count("*").alias("n"), F.first("component").alias("component"), F.first(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")), "grouped")
    best = stays.where("stays").groupBy("component").agg(F.min("hash").alias("best"))
    verdicts = stays.join(best, "component", "left").select(
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.col("hash").cast("string")).alias(k := free_name(docs, "row_key")),
        F.when(F.col("stays") & (F.col("hash") == F.col("best")), F.col("n")).otherwise(0).alias(v := free_name(docs, "row_n")),
    )
    keyed = docs.withColumn(k, F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.xxhash64("text").cast("string")))
    whole = lookup(keyed, verdicts, k, spread=F.col("text"))
    once = whole.where(f"{v} is null or {v} = 1")
    if verdicts.where(F.col(v) > 1).limit(1).count():
        once = once.unionByName(whole.where(f"{v} > 1").dropDuplicates([k]))
    return once.drop(k, v)


SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), e AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' '))) END AS s FROM d
), c AS (SELECT min(r) AS c, list_sort(s) AS s, any_value(len(s)) AS n FROM e WHERE len(s) > 0 GROUP BY list_sort(s)),
x AS (SELECT c, n, unnest(s) AS sh FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.sh = b.sh AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(a, b) AS (SELECT c, c FROM c UNION SELECT reach.a, u.b FROM reach JOIN u ON u.a = reach.b),
root AS (SELECT a AS c, min(b) AS root FROM reach GROUP BY a),
f AS (SELECT e.r, e.doc_id, len(e.s) AS n, coalesce(root.root, -e.r) AS root FROM e LEFT JOIN c ON c.s = list_sort(e.s) LEFT JOIN root ON root.c = c.c)
SELECT doc_id, n::BIGINT AS n_shingles, min(doc_id) OVER (PARTITION BY root) AS component_id, doc_id = min(doc_id) OVER (PARTITION BY root) AS kept FROM f
"""
