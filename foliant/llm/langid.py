"""Language ID (9): segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for each piece of the vocabulary. A word's probability is the sum over all its segmentations
into pieces, by the forward algorithm; a text's is the product over its words. The probabilities are learned by
expectation-maximisation (forward-backward counts), over the word counts of a sample of labelled documents: about TRAIN_DOCS
of them, chosen by hash (a documented limit). Expected counts are summed in Spark; the driver gets one row for each piece and
language.

In prediction, a batch's texts are cut into words at once, and each distinct word's lattice is summed once; a lattice is found by
going down the tree of the pieces' prefixes from all letters of many words at once.

A word is a run of letters (with their combining marks), lower-cased, with "▁" before it, however long. A character that no piece holds has the probability FLOOR in every language. A language is learned if its
share of the sample is at least one in LEAST_SHARE, which bounds the number of languages.

Defined results. Null text, or one without a letter: `und`, score 0. If there is nothing to learn from: `und`. Documents whose
id is null aren't learned from and aren't held out. Ties go to the least language. Equal rows get equal results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_table, small_batches
from .pieces import MODEL, SPACE, Pieces

TRAIN_DOCS, EM_ROUNDS, FLOOR, SMOOTH, MEMO, LEAST_SHARE = 6000, 3, 1e-7, 200.0, 400_000, 1000
#: Words, and letters of words, whose lattices are summed at once; letters up to which sums need no scaling.
WORDS, LETTERS, PLAIN = 8000, 100_000, 40
UNKNOWN = "und"
#: Bits of a code point in a key of the tree; what stands behind a word there, no code point.
CODE, END = 21, (1 << 21) - 1
_LETTERS = regex.compile(r"(?:\p{L}\p{M}*)+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    return [SPACE + w for w in _LETTERS.findall(text.lower())]


def kinds() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for a mark, else 0. Takes some tenths of a second."""
    every, kind = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for k, pattern in ((1, r"\p{L}"), (2, r"\p{M}")):
        kind[[ord(c) for c in regex.findall(pattern, every)]] = k
    return kind


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def distinct_words(texts: list[str | None], kinds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What words_of finds in many texts: the distinct words, each word's place among them, and how many words each text has."""
    low = [t.lower() if t else "" for t in texts]
    codes = code_points("\n".join(["", *low, ""]))
    kind = kinds[codes]
    inside = kind == 1
    if (marks := kind == 2).any():  # marks go with the letter that they follow, if they follow one
        inside = inside[np.maximum.accumulate(np.where(marks, 0, np.arange(len(codes), dtype=np.int32)))]
    bounds = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = bounds[::2], bounds[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]) * 4
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(codes[inside])]).dictionary_encode()
    counts = np.diff(np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in low)])))
    if not len(starts):
        return [], np.zeros(0, np.int64), counts
    _, at, letters = found.dictionary.buffers()
    at = (np.frombuffer(at, np.int64)[: len(found.dictionary) + 1] // 4).tolist()
    letters = letters.to_pybytes()[: 4 * at[-1]].decode("utf-32-le")
    return [SPACE + letters[a:b] for a, b in zip(at, at[1:], strict=False)], found.indices.to_numpy(), counts


def groups(words: list[str]) -> Iterator[list[int]]:
    """Places of words of like lengths, so that the arrays over them have few empty cells."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    now: list[int] = []
    for i in order:
        if now and (len(now) >= WORDS or (len(now) + 1) * len(words[i]) > LETTERS):
            yield now
            now = []
        now.append(i)
    if now:
        yield now


class Tree:
    """The pieces' prefixes as a tree. Nodes are numbered level by level from the root, 0. keys: of each other node its
    parent and last code point in one number, ascending, so that a node is its key's place and 1; piece: -1 for none."""

    def __init__(self, ids: dict[str, int]):
        node, keys = {"": 0}, []
        for n in range(1, max(map(len, ids), default=0) + 1):
            for parent, code, prefix in sorted({(node[x[: n - 1]], ord(x[n - 1]), x[:n]) for x in ids if len(x) >= n}):
                keys.append(parent << CODE | code)
                node[prefix] = len(keys)
        self.keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.piece = np.array([ids.get(x, -1) for x in node], np.int64)


def edges(words: list[str], ids: dict[str, int], longest: int, tree: Tree | None = None) -> tuple[np.ndarray, ...]:
    """The lattices of many words: word, start, end, piece (-1: a character without one), sorted by end and length.

    tree: that of ids, for callers that have it.
    """
    tree = tree or Tree(ids)
    sizes = np.array([len(w) for w in words], np.int64)
    codes = code_points("\n".join([*words, ""])).astype(np.int64)
    codes[np.cumsum(sizes + 1) - 1] = END
    at, node, found = np.flatnonzero(codes != END), np.int64(0), []
    for n in range(1, longest + 1):
        key = node << CODE | codes[at + (n - 1)]
        node = np.searchsorted(tree.keys, key)
        known = tree.keys[node] == key
        if n == 1:
            found.append((at, np.where(known, tree.piece[np.where(known, node + 1, 0)], -1)))
        at, node = at[known], node[known] + 1
        if n > 1:
            piece = tree.piece[node]
            found.append((at[piece >= 0], piece[piece >= 0]))
        if not len(at):
            break
    size = np.repeat(np.arange(1, len(found) + 1), [len(f[0]) for f in found])
    first, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    word = np.repeat(np.arange(len(words)), sizes + 1)[first]
    start = first - (np.cumsum(sizes + 1) - sizes - 1)[word]
    end = start + size
    order = np.argsort(end.astype(np.min_scalar_type(end.max(initial=0))), kind="stable")
    return word[order], start[order], end[order], piece[order]


def steps(start: np.ndarray, end: np.ndarray) -> list[slice]:
    """Runs of edges of one end and length: no word comes twice in a run."""
    cuts = np.flatnonzero(np.diff(end).astype(bool) | np.diff(end - start).astype(bool)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(end)], strict=True)] if len(end) else []


def forward(words: list[str], lattice: tuple, p: np.ndarray) -> np.ndarray:
    """For each word, position and language the log of the sum over all segmentations up to there.

    p: pieces x languages, the last row for -1. Each position's sum is made relative to the one before, so that it neither
    under- nor overflows; words of up to PLAIN letters can't, and are summed as they are.
    """
    word, start, end, piece = lattice
    n = max(map(len, words), default=0) + 1
    if n <= PLAIN:
        alpha = np.zeros((len(words), n, p.shape[1]))
        alpha[:, 0] = 1.0
        for s in steps(start, end):
            alpha[word[s], end[s]] += alpha[word[s], start[s]] * p[piece[s]]
        return np.log(np.maximum(alpha, 1e-300))
    logs, now, at = np.zeros((len(words), n, p.shape[1])), np.zeros((len(words), p.shape[1])), 1
    for s in steps(start, end):
        if end[s.start] != at:
            logs[:, at] = logs[:, at - 1] + np.log(np.where(now > 0, now, 1.0))  # 0: behind the word's end
            now, at = np.zeros_like(now), int(end[s.start])
        w = word[s]
        now[w] += np.exp(logs[w, start[s]] - logs[w, at - 1]) * p[piece[s]]
    logs[:, at] = logs[:, at - 1] + np.log(np.where(now > 0, now, 1.0))
    return logs


def expected(words: list[str], lattice: tuple, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words that come counts (words x languages) times."""
    word, start, end, piece = lattice
    logs = forward(words, lattice, p)
    # beta is that of the rest of the word, times the forward sum up to there, over the word's: all are at most 1
    beta = np.zeros_like(logs)
    beta[np.arange(len(words)), [len(w) for w in words]] = 1.0
    out = np.zeros_like(p)
    for s in reversed(steps(start, end)):
        w, a, b = word[s], start[s], end[s]
        share = np.exp(logs[w, a] - logs[w, b]) * p[piece[s]] * beta[w, b]
        beta[w, a] += share
        np.add.at(out, piece[s], share * counts[w])
    return out


def probabilities(counts: np.ndarray) -> np.ndarray:
    """Smoothed towards all languages together; the last row is that of unknown characters."""
    all_ = counts.sum(axis=1, keepdims=True) + 1e-3
    p = (counts + SMOOTH * all_ / all_.sum()) / (counts.sum(axis=0, keepdims=True) + SMOOTH)
    return np.concatenate([p, np.full((1, counts.shape[1]), FLOOR)])


def train(docs: DataFrame, pieces: Pieces, most: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """The languages, and the pieces' probabilities (pieces x languages)."""
    known = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    share = min(1.0, most / max(known.count(), 1))
    sample = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(9)), 32) < int(share * 2**32)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen.update((lang, w) for w in words_of(text))
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in seen], pa.string()), "word": pa.array([k[1] for k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = kept_table(sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    # a sample of some thousand documents has few languages, whatever is in the column: rarer values aren't learned
    of = sample.groupBy("lang").agg(F.count("*").alias("n"))
    every = max(sample.count(), 1)
    languages = sorted(r.lang for r in of.where(F.col("n") * LEAST_SHARE >= every).collect())
    counts = counts.where(F.col("lang").isin(languages))
    ids, longest, v, tree = pieces.id, pieces.longest, len(pieces.surface), Tree(pieces.id)
    p = np.concatenate([np.full((v, len(languages)), 1.0 / v), np.full((1, len(languages)), FLOOR)])
    for _ in range(EM_ROUNDS if languages else 0):
        shared = docs.sparkSession.sparkContext.broadcast(p)

        def e_step(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            p, total = shared.value, None
            for b in batches:
                every = b["word"].tolist()
                for places in groups(every):
                    part = b.iloc[places]
                    words = part["word"].tolist()
                    n = np.zeros((len(words), len(languages)))
                    n[np.arange(len(words)), [languages.index(x) for x in part["lang"]]] = part["n"]
                    found = expected(words, edges(words, ids, longest, tree), p, n)
                    total = found if total is None else total + found
            if total is not None:
                i, j = np.nonzero(total[:-1] > 1e-9)
                yield pd.DataFrame({"piece": i, "lang": j, "n": total[i, j]})

        sums = counts.repartition("word").mapInPandas(e_step, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        c = np.zeros((v, len(languages)))
        c[sums["piece"], sums["lang"]] = sums["n"]
        p = probabilities(c)
    return languages, p


def predictor(languages: list[str], shared, pieces: Pieces):
    ids, longest, tree, kind = pieces.id, pieces.longest, Tree(pieces.id), kinds()

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = shared.value
        place: dict[str, int] = {}
        logs = np.zeros((0, len(languages)))
        for texts in batches:
            found, at, counts = distinct_words(texts.tolist() if languages else [None] * len(texts), kind)
            if len(place) > MEMO:
                place, logs = {}, logs[:0]
            new = [w for w in found if w not in place]
            parts = [logs]
            for places in groups(new):
                words = [new[i] for i in places]
                logs_of = forward(words, edges(words, ids, longest, tree), p)
                parts.append(logs_of[np.arange(len(words)), [len(w) for w in words]])
                place.update(zip(words, range(len(place), len(place) + len(words)), strict=True))
            logs = np.concatenate(parts)
            rows = [(UNKNOWN, 0.0)] * len(texts)
            lettered = np.flatnonzero(counts)
            if len(lettered):
                of = logs[[place[w] for w in found]]
                begins = (np.cumsum(counts) - counts)[lettered]
                # one language at a time, as a batch may have a million words
                total = np.stack([np.add.reduceat(np.ascontiguousarray(of[:, j])[at], begins) for j in range(len(languages))], axis=1)
                best = total.argmax(axis=1)
                scores = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for i, b, x in zip(lettered.tolist(), best.tolist(), scores.tolist(), strict=True):
                    rows[i] = (languages[b], round(x, 6))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predict


def language_query(docs: DataFrame, model: str = MODEL) -> DataFrame:
    small_batches(docs.sparkSession)
    pieces = Pieces(model)
    languages, p = train(docs, pieces)
    shared = docs.sparkSession.sparkContext.broadcast(p)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(languages, shared, pieces)("text").alias("x"))
    return out.select("doc_id", "held_out", "x.*")
