"""Phrase collocation mining (11): Apriori passes by level, with the frequent (k-1)-grams broadcast, then cuts scored from the
level tables.

1. Level 1 counts words. Level k reads the texts again and emits a k-gram only where both (k-1)-grams that it holds are frequent;
   counts are summed in the task, then in a shuffle by language and phrase, and phrases below the least count go.
2. What is broadcast is a set of bits: each frequent (k-1)-gram sets the bit at its hash. There are BITS_EACH bits for each of them,
   up to MOST_BITS (32 MB); with more of them the set lets more k-grams through, which the least count then takes out. So counts
   are exact at every size, and the broadcast has a proven bound. Spark's bitmap aggregates build it.
3. A frequent phrase's parts are frequent, so every cut is scored by looking both parts up in the level tables, in decimals.
4. Candidates that a longer one contains often enough go, and each language keeps its best, first within parts of its phrases and
   then among what these have kept.

Phrases lie within pieces of a text. Defined results. Null and empty texts have no words. A null language is `und`. Equal rows count
each. An empty table gives an empty result. Further columns are of no concern. A text is held whole while its words are counted, with
about thirty times its size; a task holds HELD words of further texts beside it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_table, lookup, lookup_split

#: The contract's: words of a candidate, least count, share (in hundredths) of a longer candidate that takes a shorter one out, best kept.
LONGEST, LEAST, SHARE, BEST = 3, 10, 50, 2000
#: Bits of the broadcast set for each phrase, and at most; words, and distinct ones, that a task holds before it hands counts on.
BITS_EACH, MOST_BITS, HELD, DISTINCT = 32, 1 << 28, 1_000_000, 200_000
#: Bits in a row of Spark's bitmaps; parts into which a language's phrases are dealt for its best.
BITMAP, DEALT = 32_768, 64
#: A-Z lower-cased, tabs as spaces, and every sign that ends a piece as a dot.
PLAIN = bytes(ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
COUNTS = "lang string, phrase string, n long"


def words_of(text: str) -> list[bytes]:
    """A text's words, with a dot where a piece ends."""
    return text.encode().translate(PLAIN).replace(b".", b" . ").split()


def folded(parts: list[np.ndarray]) -> np.ndarray:
    """A hash of neighbouring words' hashes, as `folded_column` has it."""
    out = parts[0]
    for x in parts[1:]:
        out = (out << np.uint64(17) | out >> np.uint64(47)) ^ x
    return out


def folded_column(lang: Column, words: Column) -> Column:
    """The hash of an array of words."""
    one = lambda w: F.xxhash64(lang, w)
    turned = lambda x: F.shiftleft(x, 17).bitwiseOR(F.shiftrightunsigned(x, 47))
    return F.aggregate(F.slice(words, 2, F.size(words)), one(F.get(words, F.lit(0))), lambda acc, w: turned(acc).bitwiseXOR(one(w)))


def bits_of(grams: DataFrame) -> tuple[bytes, int]:
    """The bit set of grams (lang, phrase), and its number of bits (a power of 2)."""
    size = BITMAP
    while size < min(MOST_BITS, BITS_EACH * grams.count()):
        size *= 2
    at = folded_column(F.col("lang"), F.split("phrase", " ")).bitwiseAND(size - 1) + 1
    rows = grams.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()  # at most MOST_BITS
    out = np.zeros(size // 8, np.uint8).reshape(-1, BITMAP // 8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits"), strict=True):
        out[bucket - 1] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.tobytes(), size


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, n of all words; the null phrase has the number of all words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                words.pop(b".", None)
                names = pa.array([None, *words], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(names)), "phrase": names, "n": pa.array([sum(words.values()), *words.values()], pa.int64())})
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if value := text.as_py():
                    seen.setdefault(lang, Counter()).update(words_of(value))
                    if sum(map(len, seen.values())) > DISTINCT:
                        yield from out()
        yield from out()

    return docs.mapInArrow(counted, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


class Numbered(dict):
    """Words to numbers in order of their first occurrence; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def grams_of(numbers: np.ndarray, words: list[bytes], lang: str, k: int, bits: np.ndarray, size: int) -> pa.RecordBatch | None:
    """The k-grams of numbered words whose both (k-1)-grams are in the bit set, with counts."""
    first = xxhash.xxh64_intdigest(lang.encode(), 42)  # as Spark's xxhash64 of two columns
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, first) for w in words), np.uint64, len(words))
    n = len(numbers) - k + 1  # places where a k-gram may begin
    if n <= 0:
        return None
    code = folded([hashes[numbers[j : n + 1 + j]] for j in range(k - 1)]) & np.uint64(size - 1)
    frequent = (bits[code >> np.uint64(3)] >> (code & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    for j in range(k - 1):
        frequent &= numbers[j : n + 1 + j] != 0
    at = np.flatnonzero(frequent[:-1] & frequent[1:])
    if not len(at):
        return None
    code = numbers[at].astype(np.int64)
    for j in range(1, k):
        code = code * len(words) + numbers[at + j]
        if j < k - 1:
            code = np.unique(code, return_inverse=True)[1]
    _, where, counts = np.unique(code, return_index=True, return_counts=True)
    names, at = pa.array(words, pa.binary()), at[where]
    phrase = pc.binary_join_element_wise(*[names.take(pa.array(numbers[at + j])) for j in range(k)], b" ").cast(pa.string())
    return pa.RecordBatch.from_pydict({"lang": pa.array([lang]).take(pa.array(np.zeros(len(at), np.int32))), "phrase": phrase, "n": pa.array(counts.astype(np.int64))})


def gram_counts(docs: DataFrame, k: int, frequent: DataFrame) -> DataFrame:
    """lang, phrase, n of the k-grams whose both (k-1)-grams may be among the frequent ones."""
    bits, size = bits_of(frequent)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(sent.value, np.uint8)
        seen: dict[str, tuple[Numbered, list[np.ndarray]]] = {}
        held = distinct = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (words, lists) in seen.items():
                if (found := grams_of(np.concatenate(lists), list(words), lang, k, table, size)) is not None:
                    yield found
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (value := text.as_py()):
                    continue
                if lang not in seen:
                    seen[lang] = (Numbered({b".": 0}), [])
                number, lists = seen[lang]
                before, found = len(number), words_of(value)
                found.append(b".")
                lists.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                held, distinct = held + len(found), distinct + len(number) - before
                if held > HELD or distinct > DISTINCT:
                    yield from out()
                    held = distinct = 0
        yield from out()

    return docs.mapInArrow(counted, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def level_tables(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, n of all frequent phrases up to `longest` words, and lang, n of all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    level = kept_table(word_counts(texts).where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    totals, level = level.where("phrase is null").select("lang", "n"), level.where("phrase is not null")
    levels = level
    for k in range(2, longest + 1):
        level = kept_table(gram_counts(texts, k, level).where(F.col("n") >= least), f"grams{k}")
        levels = levels.unionByName(level)
    return levels, totals


def key_of(lang: Column, phrase: Column) -> Column:
    return F.struct(lang.alias("lang"), phrase.alias("phrase"))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(levels: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words and more, at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    size, k = F.size("words"), F.col("k")
    counts = levels.select(key_of(F.col("lang"), F.col("phrase")).alias("key"), "n")
    cuts = levels.withColumn("words", words).where(size > 1).withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", F.col("n").alias("a"), "k", key_of(F.col("lang"), joined(F.slice("words", F.lit(1), k))).alias("left"), key_of(F.col("lang"), joined(F.slice("words", k + 1, size - k))).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = kept_table(lookup_split(cuts, counts.select(F.col("key").alias(side), F.col("n").alias(name)), side).drop(side), f"cuts_{name}")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    whole = F.expr("cast(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) as decimal(38,0))")
    parts = (wide["l"] * wide["r"]).cast("decimal(38,0)")
    cuts = cuts.withColumn("whole", whole).withColumn("parts", parts).withColumn("score", F.expr("whole div parts"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def uncontained(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates but those that a longer one contains with at least `share` hundredths of their count."""
    size = F.size("words")
    longer = candidates.select("lang", F.split("phrase", " ").alias("words"), "a").where(size > 2)
    inside = longer.withColumn("m", F.explode(F.sequence(F.lit(2), size - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
    most = inside.groupBy("lang", joined(F.slice("words", F.col("at"), F.col("m"))).alias("phrase")).agg(F.max("a").alias("most"))
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share)).drop("most")


def ranked(candidates: DataFrame, best: int = BEST) -> DataFrame:
    """Each language's best, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    first = candidates.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best).drop("part", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    levels, totals = level_tables(docs, longest, least)
    found = ranked(uncontained(kept_table(scored(levels), "collocations"), share), best)
    return lookup(found, totals, "lang", "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocation_query(docs: DataFrame) -> DataFrame:
    return collocations(docs)


SQL = rf"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents where text is not null
), worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from worded),
grams as (select lang, w, i, unnest(range(1, least(len(w) - i + 1, {LONGEST}) + 1)) as k from starts),
phrases as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from grams group by all),
totals as (select lang, sum(f)::bigint as n from phrases where k = 1 group by lang),
candidates as (select lang, k, phrase, f, string_split(phrase, ' ') as w from phrases where k > 1 and f >= {LEAST}),
cuts as (select lang, k, phrase, f, w, unnest(range(1, k)) as c from candidates),
scores as (
    select cuts.lang, cuts.phrase, cuts.k, cuts.w, cuts.f as a, c, x.f as l, y.f as r, (1000000::hugeint * cuts.f * cuts.f) // (x.f::hugeint * y.f) as score
    from cuts join phrases x on x.lang = cuts.lang and x.phrase = array_to_string(w[1:c], ' ') join phrases y on y.lang = cuts.lang and y.phrase = array_to_string(w[c + 1:cuts.k], ' ')
), lowest as (select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inner_starts as (select lang, f, w, k, unnest(range(1, k + 1)) as i from candidates where k > 2),
inner_phrases as (select lang, f, w, k, i, unnest(range(2, k)) as m from inner_starts),
longer as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(f) as most from inner_phrases where i + m - 1 <= k group by all),
kept as (select lowest.* from lowest left join longer using (lang, phrase) where most is null or 100 * most < {SHARE} * a),
numbered as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from numbered join totals using (lang) where rank <= {BEST}
"""
