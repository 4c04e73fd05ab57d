"""Byte-level BPE encoding and decoding (12): a global shuffle of distinct pre-tokens, each encoded once, joined back by position.

1. A text falls into segments, cut before each run of white space: no pre-token crosses such a place, so a distinct segment is
   matched against the pattern once for a task. Pre-tokens are counted in the tasks and shuffled as distinct words with counts.
2. Each distinct word is encoded once: its bytes are merged by the lowest rank, leftmost first, over a heap. A word that occurs
   once in the whole corpus is encoded at that occurrence, as nobody else needs its ids; the others make up the dictionary.
3. The dictionary word -> ids is joined back. Its most frequent words, up to HOT bytes of them in a compact form, are broadcast and
   joined where the texts lie, in the texts' order. If there are more, unknown words are left as gaps; these are exploded with row
   and position, joined by word in a shuffle, gathered by row, and put into their positions. Texts are not shuffled.
4. Decoding joins each id to the table of token bytes, whose size is the vocabulary's, and concatenates in order of position.

Which characters are letters, digits or white space depends on the Unicode version of the library that tokenises; where the pattern
matcher here knows another one, such characters stand in for others of their class while a text is matched.

Defined results. Null or empty text: no ids, decoded to nothing. Equal rows get equal results, each its own. An empty table gives an
empty result. Ids are those of ordinary encoding, without special tokens; texts that look like them are text. Decoding gives null for
null and for lists with an unknown or null id. Further columns of any name stay. A text is held whole while it is encoded, with about
fifteen times its size in segments.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path
from typing import Any, NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, kept_table
from .pieces import compact, places_of

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: Bytes of the words that are broadcast; segments and their characters that a task holds before it hands on or forgets them.
HOT, HELD, HELD_CHARS = 64 << 20, 150_000, 4 << 20
#: Characters of the texts that are encoded at a time.
AT_A_TIME = 1 << 19
#: Bytes up to which a word is its own key in a join.
OWN_KEY = 64
#: The code points with the property White_Space.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_SET = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | frozenset(map(chr, range(0x2000, 0x200B)))
SEGMENTS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


@lru_cache(maxsize=4)
def other_classes(path: str) -> dict[int, str]:
    """Code points that the library puts into another class than the matcher, each with a character of the library's class."""
    ranks = read_ranks(path)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = {}
    for pattern, stand_in in ((r"\p{L}", "\xaa"), (r"\p{N}", "\xb2"), (r"\s", "\xa0")):
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        theirs = {c for at in range(0, len(every), 4096) for c in library.decode(library.encode_ordinary("".join(every[at : at + 4096])))}
        ours = set(regex.findall(pattern, "".join(every)))
        for c in theirs - ours:
            found[ord(c)] = stand_in
        for c in ours - theirs:
            found.setdefault(ord(c), "\xa7")
    return found


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class Vocabulary:
    """A file of ranks and the pattern of pre-tokens."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        self.ranks, self.pattern, self.stand_ins = read_ranks(path), pattern, other_classes(path)
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary has no token for every byte")
        self.longest = max(map(len, self.ranks))

    def surfaces(self) -> pa.BinaryArray:
        """The tokens' bytes by id; null for a free id."""
        table: list[bytes | None] = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            table[rank] = token
        return pa.array(table, pa.binary())


def pre_tokens(pattern: str, stand_ins: dict[int, str]) -> Callable[[str], list[str]]:
    """A text's pre-tokens, in order."""
    matcher, unlike = regex.compile(pattern), frozenset(map(chr, stand_ins))

    def found(text: str) -> list[str]:
        if text.isascii() or unlike.isdisjoint(text):
            return matcher.findall(text)
        return [text[m.start() : m.end()] for m in matcher.finditer(text.translate(stand_ins))]

    return found


def merged(word: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of one pre-token."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    ends, starts = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at, and that ends at, a place
    heap = [(rank, i, i + 1, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def seen(a: int, middle: int, b: int) -> None:
        if b - a <= longest and (rank := ranks.get(word[a:b])) is not None:
            heapq.heappush(heap, (rank, a, middle, b))

    while heap:
        _, a, middle, b = heapq.heappop(heap)
        if ends[a] != middle or ends[middle % n] != b or not middle:
            continue
        ends[a], ends[middle], starts[b] = b, 0, a
        if a:
            seen(starts[a], a, b)
        if b < n:
            seen(a, b, ends[b])
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


def cut(find: Callable[[str], list[str]], segments: list[str]) -> tuple[list[str], list[str], np.ndarray]:
    """The segments in a new order, their pre-tokens one after another, and the number of each one's.

    Those that begin with white space and end without are matched as one text, as no pre-token crosses their ends.
    """
    chained = [s for s in segments if s[0] in WHITE_SET and s[-1] not in WHITE_SET]
    single = [s for s in segments if s[0] not in WHITE_SET or s[-1] in WHITE_SET] if len(chained) < len(segments) else []
    tokens = find("".join(chained)) if chained else []
    places = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    ends = np.searchsorted(places, np.cumsum(np.fromiter(map(len, chained), np.int64, len(chained)))) + 1
    rest = [find(s) for s in single]
    return chained + single, tokens + [t for each in rest for t in each], np.concatenate([np.diff(ends, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))])


def word_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word, n: the distinct pre-tokens of all texts."""
    pattern, stand_ins = vocabulary.pattern, vocabulary.stand_ins

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen, chars = pre_tokens(pattern, stand_ins), Counter(), 0

        def out() -> pa.RecordBatch:
            segments, tokens, sizes = cut(find, list(seen))
            times = np.repeat(np.fromiter(map(seen.__getitem__, segments), np.int64, len(segments)), sizes)
            words = pa.table({"word": pa.array(tokens, pa.string()), "n": times}).group_by("word").aggregate([("n", "sum")])
            return words.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches()[0]

        for batch in batches:
            for text in batch.column(0):
                if value := text.as_py():
                    seen.update(SEGMENTS.findall(value))
                    chars += len(value) if len(value) > 1 << 16 else 0
                    if len(seen) > HELD or chars > HELD_CHARS:
                        yield out()
                        seen.clear()
                        chars = 0
        if seen:
            yield out()

    return docs.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """word, n, ids: every distinct word that occurs more than once, encoded once."""
    ranks, longest = vocabulary.ranks, vocabulary.longest

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [merged(word.encode(), ranks, longest) for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return kept_table(word_counts(docs, vocabulary).where("n > 1").mapInArrow(encoded, "word string, n long, ids array<int>"), "bpe_words")


class Segments:
    """A task's segments with their ids. Words that weren't broadcast are encoded here, or left as gaps if others may have them."""

    def __init__(self, find: Callable[[str], list[str]], known: dict[str, np.ndarray], own: Callable[[str], list[int]] | None):
        self.find, self.known, self.own = find, known, own
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.start, self.size, self.flat = array("q"), array("q"), array("i")
        self.rare: dict[int, list[tuple[int, str]]] = {}
        self.chars = 0

    def learn(self, new: list[str]) -> None:
        segments, tokens, sizes = cut(self.find, new)
        distinct = list(set(tokens))
        start, size, ids = (self.known[x] for x in ("start", "size", "ids"))
        place = places_of(distinct, self.known)
        missing = [w for w, p in zip(distinct, place, strict=True) if p < 0]
        # the ids of words that weren't broadcast, or one gap each, are numbered after those that were
        lists = [self.own(w) if self.own else [-1] for w in missing]
        extra, more = np.fromiter(map(len, lists), np.int64, len(lists)), np.array([i for x in lists for i in x], np.int32)
        at, n = np.array(place, np.int64), np.zeros(len(distinct), np.int64)
        first = np.zeros(len(distinct), np.int64)
        there = at >= 0
        n[there], first[there] = size[at[there]], start[at[there]]
        n[~there], first[~there] = extra, len(ids) + np.cumsum(extra) - extra
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        which = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        each = n[which]
        ends = np.cumsum(each)
        place_of = np.repeat(first[which] - ends + each, each) + np.arange(int(ends[-1]))
        sent = place_of < len(ids)
        flat = np.empty(len(place_of), np.int32)
        flat[sent], flat[~sent] = ids[place_of[sent]], more[place_of[~sent] - len(ids)]
        last = ends[np.cumsum(sizes) - 1]
        begin, count = len(self.flat), len(self.start)
        self.flat.frombytes(flat.tobytes())
        self.start.frombytes((begin + np.concatenate([[0], last[:-1]])).astype(np.int64).tobytes())
        self.size.frombytes(np.diff(last, prepend=0).astype(np.int64).tobytes())
        self.number.update(zip(segments, range(count, count + len(segments)), strict=True))
        self.chars += sum(map(len, segments))
        if missing and not self.own:
            of, before = np.repeat(np.arange(len(segments)), sizes), np.concatenate([[0], last[:-1]])
            for t in np.flatnonzero(~there[which]).tolist():
                self.rare.setdefault(count + int(of[t]), []).append((int(ends[t] - 1 - before[of[t]]), tokens[t]))

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
        """The texts' ids one after another, -1 in a gap; their numbers; each text's gaps: position and word."""
        if len(self.number) > HELD or self.chars > HELD_CHARS:
            self.clear()
        found = [SEGMENTS.findall(t) if t else [] for t in texts]
        every = [s for x in found for s in x]
        if new := list(set(every).difference(self.number)):
            self.learn(new)
        at = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        size = np.frombuffer(self.size, np.int64)[at] if len(at) else at
        ends = np.cumsum(size)
        flat = np.frombuffer(self.flat, np.int32)[np.repeat(np.frombuffer(self.start, np.int64)[at] - ends + size, size) + np.arange(int(ends[-1]))] if len(at) else np.empty(0, np.int32)
        sums, parts = np.concatenate([[0], ends]), np.cumsum([0, *map(len, found)])
        gaps: list[list[dict]] = [[] for _ in texts]
        if self.rare:
            for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
                gaps[i] = [{"at": int(sums[k] - sums[a]) + offset, "word": word} for k in range(a, b) for offset, word in self.rare.get(int(at[k]), ())]
        return flat, np.diff(sums[parts]), gaps


def slices(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of about AT_A_TIME characters."""
    out, chars = [], 0
    for text in texts:
        out.append(text.as_py())
        chars += len(out[-1] or "") + 100
        if chars > AT_A_TIME:
            yield out
            out, chars = [], 0
    if out:
        yield out


GAPPED = "struct<ids:array<int>,gaps:array<struct<at:int,word:string>>>"


class Finish(NamedTuple):
    """What becomes of lists of ids in the task that has them, and its type."""

    of: Callable[[pa.ListArray], pa.Array]
    kind: str


AS_IDS = Finish(lambda ids: ids, "array<int>")


def gapped(vocabulary: Vocabulary, hot: Any, gaps: bool, finish: Finish) -> Callable[[Column], Column]:
    """text -> struct<ids, gaps>. Without gaps, words that weren't broadcast are encoded in place: text -> finished ids."""
    pattern, stand_ins, ranks, longest = vocabulary.pattern, vocabulary.stand_ins, vocabulary.ranks, vocabulary.longest

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        segments = Segments(pre_tokens(pattern, stand_ins), hot.value, None if gaps else lambda w: merged(w.encode(), ranks, longest))
        for texts in batches:
            for some in slices(texts):
                flat, sizes, missing = segments.ids(some)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.StructArray.from_arrays([ids, pa.array(missing, pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())])))], ["ids", "gaps"]) if gaps else finish.of(ids)

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, GAPPED if gaps else finish.kind)


def filler(vocabulary: Vocabulary, finish: Finish) -> Callable[[Column, Column], Column]:
    """Lists of ids with the ids of their gaps in place of -1; of a word that the dictionary lacks, as it occurs once, its own."""
    ranks, longest = vocabulary.ranks, vocabulary.longest

    def fill(ids: pa.Array, fills: pa.Array) -> pa.Array:
        out = []
        for mine, found in zip(ids.to_pylist(), fills.to_pylist(), strict=True):
            within = {x["at"]: x["ids"] if x["ids"] is not None else merged(x["word"].encode(), ranks, longest) for x in found}
            out.append([i for at, one in enumerate(mine) for i in (within[at] if one < 0 else (one,))])
        return finish.of(pa.array(out, pa.list_(pa.int32())))

    fill.__annotations__ = {"ids": pa.Array, "fills": pa.Array, "return": pa.Array}
    return F.arrow_udf(fill, finish.kind)


def key_of_word(word: Column) -> Column:
    """The word, or a digest of a long one."""
    return F.when(F.octet_length(word) <= OWN_KEY, word).otherwise(F.concat(F.lit("\0"), F.sha2(word, 256)))


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: list[str] | None = None, hot: int = HOT, finish: Finish = AS_IDS) -> DataFrame:
    """The columns `keep` of docs (all, if None) with the array column `ids`, or what `finish` makes of it."""
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    out, row = free_name(docs, "ids"), free_name(docs, "row")
    words = dictionary(docs, vocabulary).withColumn("often", F.floor(F.log2("n") * 4).cast("int"))
    # the least class of counts (four to a doubling) down to which the words stay within `hot` bytes
    least, room = 0, hot
    classes = words.groupBy("often").agg(F.sum(F.size("ids") * 2 + 17).alias("bytes")).orderBy(F.desc("often")).collect()  # at most four a doubling
    for r in classes:
        if room < r.bytes:
            least = r.often + 1
            break
        room -= r.bytes
    known = spark.sparkContext.broadcast(compact(words.where(F.col("often") >= least).select(F.xxhash64("word").alias("hash"), F.crc32("word").alias("check"), "ids").toArrow()))
    part = docs.withColumn(out, gapped(vocabulary, known, bool(least), finish)(F.col("text")))
    columns = [F.col(f"`{c}`") for c in keep]
    if not least:
        return part.select(*columns, out)
    part = kept_table(part.select(F.monotonically_increasing_id().alias(row), *columns, out), "bpe_rows")
    gaps = part.select(row, F.explode(F.col(out)["gaps"]).alias("gap")).select(row, "gap.at", "gap.word", key_of_word(F.col("gap.word")).alias("key"))
    rare = words.where(F.col("often") < least).select(key_of_word(F.col("word")).alias("key"), F.col("ids").alias("found"))
    found = F.struct("at", F.when(F.col("found").isNull(), F.col("word")).alias("word"), F.col("found").alias("ids"))
    fills = gaps.join(rare, "key", "left").groupBy(row).agg(F.collect_list(found).alias("fills"))
    open_, whole = F.size(F.col(out)["gaps"]) > 0, part.where(F.size(F.col(out)["gaps"]) == 0)
    mended = part.where(open_).join(fills.withColumnRenamed("fills", f"{out}_fills"), row)
    done = F.arrow_udf(typed_function(finish.of), finish.kind)
    return whole.select(*columns, done(F.col(out)["ids"]).alias(out)).unionByName(mended.select(*columns, filler(vocabulary, finish)(F.col(out)["ids"], F.col(f"{out}_fills")).alias(out)))


def joined_bytes(ids: pa.ListArray, surfaces: pa.BinaryArray) -> pa.BinaryArray:
    """Each list's token bytes, one after another."""
    values = ids.flatten()
    known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(surfaces)))
    tokens = surfaces.take(pc.if_else(known, values, None))
    offsets = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens, mask=pc.is_null(ids)), b"")


def typed_function(f: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """f with the annotations that tell an Arrow function's kind."""

    def typed(ids: pa.Array) -> pa.Array:
        return f(ids)

    typed.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return typed


def decoder(vocabulary: Vocabulary) -> Callable[[Column], Column]:
    """ids -> the bytes of the text."""
    surfaces = vocabulary.surfaces()
    return F.arrow_udf(typed_function(lambda ids: joined_bytes(ids, surfaces)), "binary")


def digests(vocabulary: Vocabulary) -> Finish:
    """n_tokens, ids_sha256 and decoded_sha256 of each list, of ids as little-endian unsigned 32-bit integers."""
    surfaces = vocabulary.surfaces()

    def digest(ids: pa.ListArray) -> pa.Array:
        flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).tolist()
        own = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
        text = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined_bytes(ids, surfaces)]
        return pa.StructArray.from_arrays([pa.array(np.diff(ends), pa.int64()), pa.array(own), pa.array(text)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return Finish(digest, "struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")


def bpe_query(docs: DataFrame, path: str = RANKS, hot: int = HOT) -> DataFrame:
    vocabulary = Vocabulary(path)
    return encode(docs.select("doc_id", "text"), vocabulary, ["doc_id"], hot, digests(vocabulary)).select("doc_id", "ids.*")
