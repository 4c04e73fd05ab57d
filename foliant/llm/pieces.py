"""SentencePiece encoding and decoding (1): a relational lattice over the corpus' distinct words.

1. A text becomes "▁" + text with spaces as "▁", and is cut into units where no piece of the vocabulary can cross: before
   each "▁" and between classes of characters that no piece mixes (both found from the piece table). A unit is the word of
   the lattice. Units are counted in the tasks first and shuffled once, as distinct units with counts.
2. Each distinct unit is exploded into its substrings up to the longest piece, and these are equi-joined to the piece table
   (its size is that of the vocabulary file, so it is broadcast). The matches are the lattice's edges; they are grouped by
   unit. A character without a piece gives an edge that turns into its UTF-8 bytes' pieces.
3. Spark's higher-order `aggregate` folds each unit's edges: for a unigram model by Viterbi over positions; for a BPE model
   in the order of the merges over a bit mask of the boundaries (Viterbi over BPE scores, which are ranks, gives other ids
   than the model's own encoder; see the README). For a BPE model an edge is packed into one number.
4. The dictionary unit -> ids encodes the documents. Its most frequent units, up to HOT bytes of them, are broadcast in a
   compact form; the rest reaches the documents by joins on unit and then text. Every unit is encoded by the lattice.

BPE in one pass: merges happen in order of rank, leftmost first, and a piece (start, end) comes about when both its ends
are boundaries with exactly one between. Sorted by (rank, start, end), each edge need be looked at once: inside two
boundaries that no merge crosses, merging goes as for the piece alone, whose last step has the piece's own rank. (Pieces of
equal scores, as runs of spaces have, are put where their last step comes; see Packed.)

Units from LONG characters on are parted further between characters that no piece has side by side. What is still as long
is exploded window by window and has its mask in several numbers; it is folded all the same. (For a unigram model the fold
takes time by the square of such a unit's length.)

Defined results. Null or empty text: no ids. Equal rows get equal results. An empty table gives an empty result. Ids are
those of the model's own encoder. Decoding gives back every text without "▁" or null; `round_trip` tells.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import free_name, kept_table, lookup, small_batches
from .neardup import mixed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Boundaries that one number of the mask holds; bytes of the units that are broadcast; units a task counts before it hands them on.
LONG, HOT, COUNTED = 62, 128 << 20, 60_000
#: Units whose edges (about 0.5 KB) a task groups in memory before it sorts; characters of a longer unit's window; numbers in
#: a part of its mask; most parts into which the units are dealt.
GROUPED, WINDOW, PART, PARTS = 20_000, 256, 32, 50_000
#: Copies of a text that one task encodes from joined units; more are dealt over further ones.
COPIES = 1000
SPACE = "▁"


class Pieces:
    """A vocabulary file: pieces, scores, and where texts may be cut."""

    def __init__(self, path: str = MODEL, unigram: bool | None = None):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(Path(path).read_bytes())
        self.unigram = model.trainer_spec.model_type == 1 if unigram is None else unigram
        normal = {i: p for i, p in enumerate(model.pieces) if p.type == 1}
        self.id = {p.piece: i for i, p in normal.items()}
        self.score = {i: p.score for i, p in normal.items()}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.longest = max(map(len, self.id))
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" for p in model.pieces]
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no piece for every byte")
        if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix:
            raise ValueError("only the identity normaliser with a dummy prefix is known here")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space after another character")
        self.cut = self._cut()
        self.pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}

    def _cut(self) -> str:
        """The pattern of units. Digits, signs and all other characters part where no piece mixes them."""
        signs = {chr(c) for c in range(128) if not chr(c).isalnum()}
        kind = lambda c: "s" if c in signs else "d" if "0" <= c <= "9" else "o"
        for _ in range(8):
            mixing = [p.lstrip(SPACE) for p in self.id if len({kind(c) for c in p.lstrip(SPACE)}) > 1]
            if not mixing:
                break
            signs |= {c for p in mixing for c in p if kind(c) == "o" and not c.isalpha()}
            if any(kind(c) == "d" or c.isalpha() for p in mixing for c in p):
                self.signs, self.digits = set(), ""
                return f"{SPACE}*[^{SPACE}]+|{SPACE}+"  # pieces mix letters with signs: only spaces part units
        sign = "".join(re.escape(c) for c in sorted(signs))
        several = any(len(p.lstrip(SPACE)) > 1 and kind(p.lstrip(SPACE)[0]) == "d" for p in self.id if p.lstrip(SPACE))
        self.signs, self.digits = signs, "several" if several else "single"
        return f"{SPACE}*[^{sign}0-9{SPACE}]+|{SPACE}*[0-9]{'+' if several else ''}|{SPACE}*[{sign}]+|{SPACE}+"

    def table(self, spark: SparkSession, packed: Packed | None = None) -> DataFrame:
        """piece, id, and score or, for packed edges, the score's rank and the piece's shift."""
        ids = list(self.id.values())
        last = {"rank": [packed.rank[self.score[i]] for i in ids], "shift": [packed.shift.get(i, 0) for i in ids]} if packed else {"score": [self.score[i] for i in ids]}
        return spark.createDataFrame(pd.DataFrame({"piece": list(self.id), "id": ids, **last}), f"piece string, id int, {'rank int, shift int' if packed else 'score double'}")


def prepared(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def units_of(cut: str, pairs: set[str]) -> Callable[[str], list[str]]:
    """A prepared text's units, in order."""
    find = re.compile(cut).findall

    def parted(unit: str) -> list[str]:
        at = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in pairs), len(unit)]
        return [unit[a:b] for a, b in zip(at, at[1:], strict=False)]

    def units(text: str) -> list[str]:
        found = find(text)
        return [p for u in found for p in (parted(u) if len(u) >= LONG else (u,))] if max(map(len, found), default=0) >= LONG else found

    return units


class Cutter:
    """Units and their 64-bit hashes for many texts at once: the code points' classes give the cuts, sums of weighted code points
    the hashes. It cuts as the pattern does, but leaves units from LONG characters on whole; callers take `units_of` for these."""

    SINGLE, SPACES = 2, 3  # a digit that is always cut off, a space; others are letters (0), signs (1), joined digits (4)

    def __init__(self, signs: set[str], digits: str):
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[[ord(c) for c in signs]] = 1
        if digits:
            self.kind[ord("0") : ord("9") + 1] = self.SINGLE if digits == "single" else 4
        self.kind[ord(SPACE)] = self.SPACES
        self.value = mixed(np.arange(1, 0x110001, dtype=np.uint64))
        self.weight = np.ones(LONG, np.uint64)
        for i in range(1, LONG):
            self.weight[i] = int(self.weight[i - 1]) * 0x9E3779B97F4A7C15 % 2**64

    def _hashed(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.uint64)
        place = np.arange(len(points)) - np.repeat(starts, sizes)
        return mixed(np.add.reduceat(self.value[points] * self.weight[np.minimum(place, LONG - 1)], starts) + sizes.astype(np.uint64))

    def hashes(self, units: list[str]) -> np.ndarray:
        """Hashes of units, none of them empty. From LONG characters on another hash, of the bytes."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        out = self._hashed(np.frombuffer("".join(units).encode("utf-32-le"), np.uint32), np.cumsum(sizes) - sizes, sizes)
        for i in np.flatnonzero(sizes >= LONG):
            out[i] = xxhash.xxh64_intdigest(units[i].encode(), 42)
        return out

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The prepared texts in a row, each unit's start, size and hash in it, and the number of units before each text."""
        prepared_ = [prepared(t) for t in texts]
        row = "".join(prepared_)
        ends = np.cumsum(np.fromiter(map(len, prepared_), np.int64, len(prepared_)))
        points = np.frombuffer(row.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        first = np.empty(len(points), bool)
        # a unit begins where the class changes, but not after spaces, and with each digit that stands for itself
        first[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == self.SINGLE)) & (kind[:-1] != self.SPACES)
        first[np.concatenate([[0], ends])[:-1][np.diff(ends, prepend=0) > 0]] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(starts, append=len(points))
        return row, starts, sizes, self._hashed(points, starts, sizes), np.searchsorted(starts, np.concatenate([[0], ends]))


def in_chunks(texts: list[str], most: int = 1 << 18) -> Iterator[list[str]]:
    """Texts in order, in lists of about `most` characters, so that arrays over these stay small."""
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= most:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def unit_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, n: the distinct units of all texts."""
    cut, pairs, signs, digits = pieces.cut, pieces.pairs, pieces.signs, pieces.digits

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, cutter = units_of(cut, pairs), Cutter(signs, digits)
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"unit": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        for batch in batches:
            for texts in in_chunks([t for t in batch.column(0).to_pylist() if t]):
                row, starts, sizes, hashes, _ = cutter.cut(texts)
                whole = sizes < LONG
                _, at, n = np.unique(hashes[whole], return_index=True, return_counts=True)
                at = np.flatnonzero(whole)[at]
                for a, b, k in zip(starts[at].tolist(), (starts + sizes)[at].tolist(), n.tolist(), strict=True):
                    seen[row[a:b]] += k
                for i in np.flatnonzero(~whole):
                    seen.update(find(row[starts[i] : starts[i] + sizes[i]]))
            if len(seen) > COUNTED:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(counted, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def shifted(way: str, x: Column | int, n: Column | int) -> Column:
    """shiftleft, shiftright or shiftrightunsigned of a long."""
    return F.call_function(way, (x if isinstance(x, Column) else F.lit(x)).cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("int"))


class Packed:
    """An edge as one number, and numbers sort as merges come: rank of the score (equal scores, equal ranks), start, length, id.

    A merge of two pieces of its own rank comes right after that of its right part, so it is sorted by that part's place: the
    number holds start + shift and length - shift, and then the shift, which is the left part's length (else 0).
    """

    def __init__(self, pieces: Pieces):
        self.rank = {x: i for i, x in enumerate(sorted(set(pieces.score.values()), reverse=True))}
        self.none = len(pieces.surface)  # the id of a character without a piece
        self.shift = _shifts(pieces)
        wide = pieces.longest.bit_length()
        self.at_shift = self.none.bit_length()
        self.at_length, self.at_start, self.at_rank = self.at_shift + wide, self.at_shift + 2 * wide, 63 - len(self.rank).bit_length()
        if self.at_rank - self.at_start < 20:
            raise ValueError("too many pieces for edges of one number")

    def edge(self, rank: Column, s: Column, n: Column, shift: Column, id_: Column) -> Column:
        fields = ((rank, self.at_rank), (s + shift, self.at_start), (n - shift, self.at_length), (shift, self.at_shift))
        return reduce(lambda x, f: x.bitwiseOR(shifted("shiftleft", *f)), fields, id_.cast("long"))

    def _field(self, x: Column, at: int, end: int) -> Column:
        return shifted("shiftright", x, at).bitwiseAND((1 << end - at) - 1).cast("int")

    def start(self, x: Column) -> Column:
        return self._field(x, self.at_start, self.at_rank) - self._field(x, self.at_shift, self.at_length)

    def length(self, x: Column) -> Column:
        return self._field(x, self.at_length, self.at_start) + self._field(x, self.at_shift, self.at_length)

    def id(self, x: Column) -> Column:
        return x.bitwiseAND((1 << self.at_shift) - 1).cast("int")

    def placed(self, x: Column) -> Column:
        """start and id alone, so that numbers sort by start."""
        return shifted("shiftleft", self.start(x), self.at_shift).bitwiseOR(self.id(x).cast("long"))

    def place(self, x: Column) -> Column:
        """The start in such a number; its id is `id`."""
        return shifted("shiftright", x, self.at_shift).cast("int")


def _shifts(pieces: Pieces) -> dict[int, int]:
    """Of each piece the length of the left part of its last merge if the right part has the same score, else 0 (and left out)."""
    same = Counter(pieces.score.values())
    found = {}
    for piece, i in pieces.id.items():
        if same[pieces.score[i]] == 1 or len(piece) == 1:
            continue
        symbols, left, right = list(piece), 0, 1
        while len(symbols) > 1:
            pairs = [(-pieces.score[pieces.id[x]], k) for k in range(len(symbols) - 1) if (x := symbols[k] + symbols[k + 1]) in pieces.id]
            if not pairs:
                raise ValueError(f"the piece {piece!r} doesn't come about by merges")
            k = min(pairs)[1]
            left, right = len(symbols[k]), len(symbols[k + 1])
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        part = pieces.id.get(piece[left:])
        if right > 1 and pieces.score[part] == pieces.score[i]:
            found[i] = left
    if any(pieces.id[p[n:]] in found for p, i in pieces.id.items() if (n := found.get(i))):
        raise ValueError("pieces of one score that are merged from each other in several steps aren't known here")
    return found


class ShortMask:
    """The boundaries of a unit of less than LONG characters, as one long."""

    @staticmethod
    def full(length: Column) -> Column:
        return shifted("shiftleft", 1, length + 1) - 1

    @staticmethod
    def seen(m: Column, start: Column) -> Column:
        """The boundaries from a place on."""
        return shifted("shiftrightunsigned", m, start)

    @staticmethod
    def without(m: Column, start: Column, bits: Column) -> Column:
        """Bits, counted from a place on, taken out."""
        return m.bitwiseAND(F.bitwise_not(shifted("shiftleft", bits, start)))


class LongMask:
    """The boundaries of a unit of any length: LONG in each of arrays of PART longs, so that a merge copies little."""

    @staticmethod
    def full(length: Column) -> Column:
        word = lambda k: shifted("shiftleft", 1, F.greatest(F.lit(0), F.least(F.lit(LONG), length + 1 - k * LONG))) - 1
        return F.transform(F.sequence(F.lit(0), F.floor(length / (LONG * PART)).cast("int")), lambda j: F.transform(F.sequence(j * PART, j * PART + PART - 1), lambda k: word(k)))

    @staticmethod
    def seen(m: Column, start: Column) -> Column:
        word = lambda k: F.coalesce(F.get(F.get(m, F.floor(k / PART).cast("int")), k % PART), F.lit(0))
        k, within = F.floor(start / LONG).cast("int"), start % LONG
        return shifted("shiftrightunsigned", word(k), within).bitwiseOR(shifted("shiftleft", word(k + 1), LONG - within))

    @staticmethod
    def without(m: Column, start: Column, bits: Column) -> Column:
        first, within = F.floor(start / LONG).cast("int"), start % LONG
        here, further = shifted("shiftleft", bits, within).bitwiseAND((1 << LONG) - 1), shifted("shiftrightunsigned", bits, LONG - within)
        word = lambda w, k: F.when(k == first, w.bitwiseAND(F.bitwise_not(here))).when(k == first + 1, w.bitwiseAND(F.bitwise_not(further))).otherwise(w)
        touched = lambda j: (j == F.floor(first / PART)) | (j == F.floor((first + 1) / PART))
        return F.transform(m, lambda p, j: F.when(touched(j), F.transform(p, lambda w, i: word(w, j * PART + i))).otherwise(p))


def folded_merges(edges: Column, length: Column, packed: Packed, mask: type[ShortMask] | type[LongMask]) -> Column:
    """The edges of the BPE segmentation in order, as Packed.placed: a fold over the boundary mask, then the edges that span
    two neighbouring boundaries."""
    s, n = packed.start, packed.length
    bits = lambda x: shifted("shiftleft", 1, n(x))  # noqa: E731  of the edge's end; less 2, of the places inside
    merges = lambda seen, x: (seen.bitwiseAND(bits(x) + 1) == bits(x) + 1) & (F.bit_count(seen.bitwiseAND(bits(x) - 2)) == 1)
    ordered = F.sort_array(F.filter(edges, lambda x: n(x) > 1))
    left = F.aggregate(ordered, mask.full(length), lambda m, x: F.when(merges(mask.seen(m, s(x)), x), mask.without(m, s(x), bits(x) - 2)).otherwise(m))
    spans = lambda m, x: mask.seen(m, s(x)).bitwiseAND(2 * bits(x) - 1) == bits(x) + 1
    # the mask is bound once, as a lambda's variable
    chosen = F.get(F.transform(F.array(left), lambda m: F.filter(edges, lambda x: spans(m, x))), F.lit(0))
    return F.sort_array(F.transform(chosen, lambda x: packed.placed(x)))


def folded_viterbi(edges: Column, length: Column) -> Column:
    """The edges of the path with the highest sum of scores: a fold over edges by their ends, then back from the last."""
    ordered = F.array_sort(F.transform(edges, lambda x: F.struct(x["e"].alias("e"), x["s"].alias("s"), x["id"].alias("id"), x["score"].alias("score"))))
    state = "array<struct<total:double,s:int,e:int,id:int>>"
    start = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("s"), F.lit(0).alias("e"), F.lit(-1).alias("id"))).cast(state)

    def step(best: Column, x: Column) -> Column:
        new = F.struct((F.get(best, x["s"])["total"] + x["score"]).alias("total"), x["s"].alias("s"), x["e"].alias("e"), x["id"].alias("id"))
        known = F.size(best) > x["e"]
        better = new["total"] > F.get(best, x["e"])["total"]
        return F.when(~known, F.concat(best, F.array(new))).when(better, F.concat(F.slice(best, F.lit(1), x["e"]), F.array(new))).otherwise(best).cast(state)

    best = F.aggregate(ordered, start, step)
    back = lambda best: F.aggregate(F.sequence(length.cast("int"), F.lit(1), F.lit(-1)), F.struct(length.cast("int").alias("at"), F.array().cast("array<struct<s:int,e:int,id:int>>").alias("path")), lambda acc, i: F.when(acc["at"] == i, F.struct(F.get(best, i)["s"].alias("at"), F.concat(F.array(F.struct(F.get(best, i)["s"].alias("s"), i.alias("e"), F.get(best, i)["id"].alias("id"))), acc["path"]).alias("path"))).otherwise(acc), lambda acc: acc["path"])
    return F.flatten(F.transform(F.array(best), back))


def with_bytes(path: Column, unit: Column, pieces: Pieces, place: Callable[[Column], Column], piece: Callable[[Column], Column], missing: int) -> Column:
    """Ids of a path; an edge without a piece gives those of its character's bytes."""
    first = pieces.byte[0]
    if [pieces.byte[b] for b in range(256)] != list(range(first, first + 256)):
        raise ValueError("the bytes' pieces don't stand in a row")
    octets = lambda c: F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.substring(F.hex(F.encode(c, "utf-8")), i * 2 - 1, F.lit(2)), 16, 10).cast("int") + first)
    several = lambda p: F.flatten(F.transform(p, lambda x: F.when(piece(x) != missing, F.array(piece(x))).otherwise(octets(F.substring(unit, place(x) + 1, F.lit(1))))))
    ids = lambda p: F.when(F.exists(p, lambda x: piece(x) == missing), several(p)).otherwise(F.transform(p, lambda x: piece(x)))
    return F.get(F.transform(F.array(path), lambda p: ids(p)), F.lit(0))


def edges_of(spans: DataFrame, pieces: Pieces, packed: Packed | None) -> DataFrame:
    """spans (key, window, at, last and more) -> key and edge: the window's substrings up to the longest piece that begin before
    `last`, equi-joined to the pieces. `at` is the window's place in its unit."""
    table = pieces.table(spans.sparkSession, packed)
    starts = spans.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("last") - 1)))
    each = starts.withColumn("e", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + pieces.longest, F.length("window")))))
    named = each.withColumn("piece", F.substring("window", F.col("s") + 1, F.col("e") - F.col("s")))
    found = named.join(F.broadcast(table), "piece", "left").where("id is not null or e - s = 1")
    s, n = F.col("at") + F.col("s"), F.col("e") - F.col("s")
    if packed:
        edge = packed.edge(F.coalesce("rank", F.lit(len(packed.rank))), s, n, F.coalesce("shift", F.lit(0)), F.coalesce("id", F.lit(packed.none)))
    else:
        unknown = min(pieces.score.values()) - 10
        edge = F.struct((s + n).alias("e"), s.alias("s"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"))
    return found.withColumn("edge", edge)


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, n -> unit, n, ids.

    Short units are dealt by unit first, so that their edges are grouped where they come about. Longer ones are cut into
    windows that overlap by the longest piece, these are dealt out, and only the edges of one unit meet in a task.
    """
    packed = None if pieces.unigram else Packed(pieces)

    def ids(mask: type[ShortMask] | type[LongMask]) -> Column:
        edges, length, unit = F.col("edges"), F.col("length"), F.col("unit")
        if packed:
            return with_bytes(folded_merges(edges, length, packed, mask), unit, pieces, packed.place, packed.id, packed.none)
        return with_bytes(folded_viterbi(edges, length), unit, pieces, lambda x: x["s"], lambda x: x["id"], -1)

    length = F.length("unit")
    # as many parts as keep a task's units within what it groups in memory (up to a number of parts, beyond which it sorts)
    parts = min(words.count() * 5 // (4 * GROUPED) + 1, PARTS)
    short = words.where(length < LONG).repartition(parts, "unit").select("unit", "n", F.col("unit").alias("window"), F.lit(0).alias("at"), length.alias("last"))
    grouped = edges_of(short, pieces, packed).groupBy("unit").agg(F.first("n").alias("n"), F.first("last").alias("length"), F.collect_list("edge").alias("edges"))
    done = grouped.select("unit", "n", ids(ShortMask).alias("ids"))
    long = words.where(length >= LONG).select("unit", "n", F.sha2("unit", 256).alias("key"))
    if not long.limit(1).count():
        return done
    window = lambda at: F.struct(at.alias("at"), F.substring(F.col("unit"), at + 1, F.lit(WINDOW + pieces.longest)).alias("window"), F.least(F.lit(WINDOW), length - at).alias("last"))
    cut = long.select("key", F.transform(F.sequence(F.lit(0), length - 1, F.lit(WINDOW)), window).alias("w")).select("key", F.explode("w").alias("w")).select("key", "w.*").repartition("key", "at")
    grouped = edges_of(cut, pieces, packed).groupBy("key").agg(F.collect_list("edge").alias("edges"))
    return done.unionByName(long.join(grouped, "key").withColumn("length", length).select("unit", "n", ids(LongMask).alias("ids")))


HASHED = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def dictionary(docs: DataFrame, pieces: Pieces) -> DataFrame:
    spark = docs.sparkSession
    words = kept_table(unit_counts(docs, pieces), "words")
    before = spark.conf.get(HASHED)
    spark.conf.set(HASHED, str(GROUPED))
    try:
        return kept_table(lattice(words, pieces), "units")
    finally:
        spark.conf.set(HASHED, before)


def compact(table: pa.Table) -> dict[str, np.ndarray]:
    """hash, ids and perhaps check -> arrays sorted by hash."""
    hashes = table.column("hash").to_numpy().view(np.uint64)
    lists = table.column("ids").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    order = np.argsort(hashes, kind="stable")
    if len(order) and (hashes[order][1:] == hashes[order][:-1]).any():
        raise ValueError("two units share a hash")
    size = np.diff(offsets)[order]
    return {
        "hash": hashes[order], **({"check": table.column("check").to_numpy().astype(np.uint32)[order]} if "check" in table.column_names else {}), "start": offsets[:-1][order].astype(np.int32), "size": size.astype(np.uint8 if not len(size) or size.max() < 256 else np.int32),
        "ids": values.astype(np.uint16 if not len(values) or values.max() < 2**16 else np.int32),
    }


def places_of(units: list[str], known: dict[str, np.ndarray]) -> list[int]:
    """Each unit's place in the arrays of `compact`, or -1; all units in one search."""
    data = [u.encode() for u in units]
    hashes = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in data), np.uint64, len(data))  # as Spark's xxhash64
    if not len(known["hash"]):
        return [-1] * len(units)
    at = np.minimum(np.searchsorted(known["hash"], hashes), len(known["hash"]) - 1)
    found = (known["hash"][at] == hashes) & (known["check"][at] == np.fromiter(map(zlib.crc32, data), np.uint32, len(data)))
    return np.where(found, at, -1).tolist()


class Places:
    """Places of hashes in the sorted array of `compact`: its first entry with the same leading bits, and those behind it."""

    def __init__(self, hashes: np.ndarray):
        bits = min(max(len(hashes).bit_length(), 1), 22)
        self.shift, self.hashes = np.uint64(64 - bits), hashes
        count = np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        self.most = int(count.max(initial=0))
        self.first = (np.cumsum(count) - count).astype(np.int32)

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Each hash' place, or -1."""
        found = np.full(len(wanted), -1, np.int64)
        if not len(self.hashes):
            return found
        left, at = np.arange(len(wanted)), self.first[(wanted >> self.shift).astype(np.int64)].astype(np.int64)
        for _ in range(self.most):
            here = self.hashes[np.minimum(at, len(self.hashes) - 1)]
            same = here == wanted
            found[left[same]] = at[same]
            further = here < wanted
            left, at, wanted = left[further], at[further] + 1, wanted[further]
            inside = at < len(self.hashes)
            left, at, wanted = left[inside], at[inside], wanted[inside]
            if not len(left):
                break
        return found


def hashed_units(pieces: Pieces) -> F.udf:
    """A UDF unit -> its hash by Cutter."""
    signs, digits = pieces.signs, pieces.digits

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cutter = Cutter(signs, digits)
        for units in batches:
            yield pa.array(cutter.hashes(units.to_pylist()).view(np.int64))

    hashed.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(hashed, "long")


ENCODED = "ids array<int>, n_tokens int, round_trip boolean"


def encoder(pieces: Pieces, hot) -> F.udf:
    """A UDF (text, the rarer units' ids) -> struct<ids, n_tokens, round_trip>.

    Units are found by hash. Two of the broadcast with one hash were refused when it was made; a rarer one with the hash of one of
    these shows in the decoded text, and is then taken from the row's own.
    """
    cut, pairs, surface, signs, digits = pieces.cut, pieces.pairs, pieces.surface, pieces.signs, pieces.digits

    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        find, cutter = units_of(cut, pairs), Cutter(signs, digits)
        known, surfaces = hot.value, pa.array(surface, pa.binary())
        start, size, flat, places = known["start"], known["size"], known["ids"], Places(known["hash"])

        def ids_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sizes = size[at].astype(np.int64)
            total = int(sizes.sum())
            return flat[np.repeat(start[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(total)].astype(np.int32), sizes

        def by_unit(text: str, tail: list[dict] | None) -> np.ndarray:
            units, own = find(prepared(text)), {x["unit"]: x["ids"] for x in tail or ()}
            at = places.of(cutter.hashes(units)).tolist()
            return np.array([i for u, p in zip(units, at, strict=True) for i in (own[u] if u in own or p < 0 else flat[start[p] : start[p] + size[p]].tolist())], np.int32)

        for texts, tails in batches:
            docs, parts, done = [t or "" for t in texts.to_pylist()], [], 0
            for chunk in in_chunks(docs):
                _, _, sizes, hashes, bounds = cutter.cut(chunk)
                at = places.of(hashes)
                odd = (at < 0) | (sizes >= LONG)
                ids, n = ids_at(np.where(odd, 0, at)) if len(known["hash"]) else (np.empty(0, np.int32), np.zeros(len(at), np.int64))
                ends = np.concatenate([[0], np.cumsum(n)])[bounds].tolist()
                strange = np.concatenate([[0], np.cumsum(odd)])[bounds]
                for i, (text, a, b) in enumerate(zip(chunk, ends, ends[1:], strict=False)):
                    parts.append(ids[a:b] if strange[i] == strange[i + 1] else by_unit(text, tails[done + i].as_py()))
                done += len(chunk)
            lists = listed(parts)
            wanted = with_prefix(texts)
            same = pc.equal(decoded(lists, surfaces), wanted)
            if again := [i for i in np.flatnonzero(~same.to_numpy(zero_copy_only=False)).tolist() if tails[i].is_valid and SPACE not in docs[i]]:
                for i in again:
                    parts[i] = by_unit(docs[i], tails[i].as_py())
                lists = listed(parts)
                same = pc.equal(decoded(lists, surfaces), wanted)
            if any(SPACE not in docs[i] for i in np.flatnonzero(~same.to_numpy(zero_copy_only=False)).tolist()):
                raise ValueError("two units share a hash")
            yield pa.StructArray.from_arrays([lists, pa.array(np.diff(lists.offsets.to_numpy()), pa.int32()), same], ["ids", "n_tokens", "round_trip"])

    encode.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, ENCODED)


def listed(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))


def decoded(ids: pa.ListArray, surfaces: pa.BinaryArray) -> pa.BinaryArray:
    """The UTF-8 bytes of each list of ids, the dummy prefix's space in front; surfaces are the pieces' bytes by id."""
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, surfaces.take(ids.values)), b"")


def with_prefix(texts: pa.StringArray) -> pa.BinaryArray:
    """What decoding must give: a space and the text, or nothing for a null or empty one."""
    texts = pc.fill_null(texts, "")
    return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, "")).cast(pa.binary())


def encode(docs: DataFrame, pieces: Pieces, hot: int = HOT) -> DataFrame:
    """docs with the struct column `encoded`."""
    spark = docs.sparkSession
    small_batches(spark)
    units = dictionary(docs, pieces).withColumn("often", F.floor(F.log2("n") * 4).cast("int"))
    # the least class of counts (four to a doubling) down to which the units stay within `hot` bytes
    by_count = units.groupBy("often").agg(F.sum(F.size("ids") * 2 + 17).alias("bytes")).orderBy(F.desc("often")).collect()
    least, room, rest = 0, hot, False
    for r in by_count:
        if room < r.bytes:
            least, rest = r.often + 1, True
            break
        room -= r.bytes
    known = spark.sparkContext.broadcast(compact(units.where(F.col("often") >= least).select(hashed_units(pieces)("unit").alias("hash"), "ids").toArrow()))
    out, tail = free_name(docs, "encoded"), free_name(docs, "tail")
    udf = encoder(pieces, known)
    if not rest:
        return docs.withColumn(out, udf(F.col("text"), F.lit(None).cast("array<struct<unit:string,ids:array<int>>>")))
    return with_tail(docs, units.where(F.col("often") < least), pieces, tail).withColumn(out, udf(F.col("text"), F.col(tail))).drop(tail)


def with_tail(docs: DataFrame, rare: DataFrame, pieces: Pieces, tail: str) -> DataFrame:
    """docs with the ids of their rarer units. Rare units have few occurrences each, so no key of the first join is hot. The
    last one's key is the text's hash; a text with more than COPIES copies is dealt over several parts of COPIES each. Null texts have
    no units, and a key of their own each, so that they are dealt out too."""
    cut, pairs = pieces.cut, pieces.pairs
    key, part, parts = (free_name(docs, x) for x in ("text_key", "text_part", "text_parts"))

    @F.pandas_udf("array<string>")
    def distinct_units(texts: pd.Series) -> pd.Series:
        find = units_of(cut, pairs)
        return pd.Series([list(dict.fromkeys(find(prepared(t or "")))) for t in texts])

    keyed = docs.withColumn(key, F.coalesce(F.sha2("text", 256), F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))))
    many = kept_table(keyed.where("text is not null").groupBy(key).agg(F.ceil(F.count("*") / COPIES).cast("int").alias(parts)).where(f"{parts} > 1"), "copied")
    pairs_ = keyed.where("text is not null").select(key, "text").dropDuplicates([key]).select(key, F.explode(distinct_units("text")).alias("unit"))
    found = kept_table(pairs_.join(rare.select("unit", "ids"), "unit").groupBy(key).agg(F.collect_list(F.struct("unit", "ids")).alias(tail)), "tails")
    every = F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)
    dealt = lookup(found, many, key).select(key, tail, F.explode(every).alias(part))
    here = lookup(keyed, many, key, spread=F.monotonically_increasing_id()).withColumn(part, F.pmod(F.monotonically_increasing_id(), F.coalesce(parts, F.lit(1))).cast("int"))
    return here.join(dealt, [key, part], "left").drop(key, part, parts)


def pieces_query(docs: DataFrame, model: str = MODEL) -> DataFrame:
    return encode(docs.select("doc_id", "text"), Pieces(model)).select("doc_id", "encoded.*")


def encoded_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """The pipeline's last stage: doc_id, source, lang where present, ids and n_tokens of each document."""
    out = encode(docs, Pieces(model))
    return out.select(*[c for c in ("doc_id", "lang", "source") if c in docs.columns], f"{out.columns[-1]}.*")
