"""PII (8): patterns, and a skip-chain conditional random field that adds what agrees with them elsewhere in the document.

Patterns give the base spans; no span of theirs is ever dropped. The field has a node for each *carrier*: a word with a digit,
"@" or "+" (in other words no personal data of these kinds can be, and they take the label `none` with certainty, so leaving
them out changes no marginal). Its labels are none and the four kinds. Potentials:

- node: a log-linear model of the word's form (a naive Bayes log-odds for each feature, smoothed),
- chain: neighbouring carriers with nothing but white space between,
- skip: carriers of one document that are equal, or similar (the same digits, the same last nine digits, or the same text
  without its punctuation); the first carrier of a base span stands for the digits of the whole span.

Nodes inside base spans are observed. Loopy belief propagation (sum-product) passes messages forward and backward along the
whole text, so that every repeat of a carrier is reached however far it is; these sweeps are exact where edges form no loop,
and are repeated, damped, until the messages settle. Then
carriers whose marginal for a kind is above 0.5 become spans, each from the word's first to last letter or digit (runs of
neighbours of one kind become one span, but a carrier that is a whole address or number by itself isn't joined to others),
unless they overlap a base span.

Training is piecewise: every potential is fitted by itself from counts over documents labelled by the patterns. The labels
count over about TRAIN_DOCS documents, those whose hash is under a bound set from the number of rows: a documented limit. Only counts reach the driver.
Few documents repeat an address in a form that the patterns miss, or repeat plain numbers; so each training document is followed by
such a form of each of its spans, which counts for the skip potential only, and by a plain number, date or code that comes twice.

Defined results. Null text: as empty, no spans. Equal rows get equal results. An empty table gives an empty result, and the
field then knows only its priors. Whole texts are read; time is n log n in the number of carriers and spans.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, small_batches, typed

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, ROUNDS, DAMPING, SMOOTH = 4000, 30, 0.3, 0.5
#: What a feature of a carrier's form counts for: the features overlap, so each counts half.
FORM_WEIGHT = 0.5

# The four patterns. Lookbehinds keep a failed run of digits from being tried again at each of its digits;
# they exclude no match, as a match from within a run could start at the run's start.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARRIER = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = re.compile(r"[^0-9A-Za-z]+")
_QUAD = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[::-2])
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), leftmost and non-overlapping within a kind, by start and kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), 0))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and (len(p) < 4 or not p[:-3].strip("0")) for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def carriers(text: str) -> list[tuple[int, int, str]]:
    """Words with a digit, "@" or "+", as (start, end, word)."""
    if not any(c in text for c in "0123456789@+"):
        return []
    return [(m.start(), m.end(), w) for m in _CARRIER.finditer(text) if not (w := m.group()).isalpha() and any(c in "0123456789@+" for c in w)]


def features(word: str) -> tuple[str, ...]:
    """The form of a carrier; few values each, so that the counts stay small."""
    digits = sum("0" <= c <= "9" for c in word)
    letters = sum(c.isalpha() for c in word)
    card = luhn("".join(c for c in word if "0" <= c <= "9")) if 14 <= digits <= 19 else None
    quad = [int(x[:9]) for x in word.strip(".,;:!?()").split(".") if x.isascii() and x.isdigit()]
    address = max(quad) <= 255 if len(quad) == 4 else None
    return (f"d{min(digits, 20)}", f"l{min(letters, 6)}", f"at{min(word.count('@'), 2)}", f"dot{min(word.count('.'), 4)}", f"plus{word.startswith('+')}", f"par{word[0] == '('}", f"dash{min(word.count('-'), 3)}", f"luhn{card}", f"quad{address}")


def labels_of(nodes: list, spans: list) -> list[int]:
    """Of each carrier the kind + 1 of the base span that it overlaps, else 0. Both are in order."""
    out, first = [], 0
    for start, end, _ in nodes:
        while first < len(spans) and spans[first][1] <= start:
            first += 1
        # the first span that ends after the carrier's start overlaps it, or begins behind it, as do all that follow
        out.append(spans[first][2] + 1 if first < len(spans) and spans[first][0] < end else 0)
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def first_carriers(nodes: list, spans: list) -> dict[int, str]:
    """The digits of each base span by the first carrier that it overlaps."""
    ends, found = [n[1] for n in nodes], {}
    for start, end, digits in spans:
        i = bisect_right(ends, start)
        if i < len(nodes) and nodes[i][0] < end:
            found.setdefault(i, digits)
    return found


def edges_of(text: str, nodes: list, base: list = ()) -> tuple[list, list]:
    """Chain edges and skip edges. Equal or similar carriers are linked in a row, each to the one before it: linear in number."""
    of_span = first_carriers(nodes, [(s, e, digits_of(text[s:e])) for s, e, _ in base])
    chain = [(i - 1, i) for i in range(1, len(nodes)) if not text[nodes[i - 1][1] : nodes[i][0]].strip(SPACES)]
    before: dict[str, int] = {}
    skip = []
    for i, (_, _, word) in enumerate(nodes):
        keys = {"w" + _PLAIN.sub("", word).lower()}
        for digits in {digits_of(word), of_span.get(i, "")}:
            keys |= {"d" + digits} if len(digits) >= 6 else set()
            keys |= {"e" + digits[-9:]} if len(digits) >= 9 else set()
        for key in keys:
            if len(key) < 5:
                continue
            if key in before:
                skip.append((before[key], i))
            before[key] = i
    return chain, sorted(set(skip))


def broken(found: str, kind: int) -> str:
    """A base span's text in a form that its pattern misses."""
    if kind == 0:
        name, _, domain = found.partition("@")
        return f"{name}@{domain.replace('.', ',')}"
    digits = digits_of(found)
    return found.replace(".", "-") if kind == 1 else ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if kind == 2 else digits


def plain_number(seed: int) -> str:
    """A number, date, time, code or amount that is no personal data, chosen by the seed."""
    draw, digits = random.Random(seed), str(seed * 7919 + 10**18)
    kind = draw.randrange(9)
    if kind == 0:
        return f"{draw.randint(1990, 2030)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}"
    if kind == 1:
        return f"{draw.randint(10, 23)}:{draw.randint(10, 59)}:{draw.randint(10, 59)}"
    if kind == 2:
        return f"AB-{draw.randint(1000, 99999)}"
    if kind == 3:
        return f"{draw.randint(1, 999)},{draw.randint(100, 999)}.{draw.randint(10, 99)}"
    if kind == 4:
        return f"{draw.getrandbits(160):040x}"
    number = digits[-draw.randint(4, 19) :]
    return number if not luhn(number) else number[:-1] + str((int(number[-1]) + 1) % 10)


def with_samples(text: str, base: list) -> tuple[str, list]:
    """The text followed by a broken form of each of its spans and a plain number that comes twice; the spans of all but that."""
    parts, spans, at = [text], list(base), len(text)
    for start, end, kind in base:
        sample = broken(text[start:end], kind)
        parts.append(f" ; {sample}")
        spans.append((at + 3, at + 3 + len(sample), kind))
        at += 3 + len(sample)
    number = plain_number(zlib.crc32(text.encode("utf-8", "replace")))
    return "".join([*parts, f" ; {number} ; {number}"]), spans


@F.pandas_udf(typed("array<string>"))
def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What a document counts for in training: "f|feature|label", "c|label|label", "s|label|label", "l|label"."""
    for texts in batches:
        rows = []
        for text in texts:
            base = base_spans(text or "")
            long, spans = with_samples(text or "", base)
            nodes = carriers(long)
            labels = labels_of(nodes, spans)
            chain, skip = edges_of(long, nodes, base)
            # a broken form tells nothing of the forms of its kind
            formed = [(w, y) for (at, _, w), y in zip(nodes, labels, strict=True) if not y or at < len(text)]
            rows.append([f"l|{y}" for _, y in formed] + [f"f|{f}|{y}" for w, y in formed for f in features(w)] + [f"c|{labels[a]}|{labels[b]}" for a, b in chain] + [f"s|{labels[a]}|{labels[b]}" for a, b in skip])
        yield pd.Series(rows)


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> dict:
    """The potentials, from counts over about `most` documents."""
    texts = docs.where("text is not null").select("doc_id", "text")
    share = min(1.0, most / max(texts.count(), 1))
    sample = texts.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 32) < int(share * 2**32))
    counts = {r.e: r.n for r in sample.select(F.explode(evidence("text")).alias("e")).groupBy("e").agg(F.count("*").alias("n")).collect()}
    n = len(KINDS) + 1
    label = np.full(n, 1.0)
    edge = {"c": np.full((n, n), SMOOTH), "s": np.full((n, n), SMOOTH)}
    by: dict[str, np.ndarray] = defaultdict(lambda: np.full(n, SMOOTH))
    for key, count in counts.items():
        kind, *rest = key.split("|")
        if kind == "l":
            label[int(rest[0])] += count
        elif kind == "f":
            by[rest[0]][int(rest[1])] += count
        else:
            edge[kind][int(rest[0]), int(rest[1])] += count
    prior = label / label.sum()

    def agreement(x: np.ndarray) -> np.ndarray:
        joint = (x + x.T) / (x + x.T).sum()
        side = joint.sum(axis=1)
        return joint / np.outer(side, side)

    return {"prior": np.log(prior), "features": {f: np.log(v / (label + 2 * SMOOTH)) for f, v in by.items()}, "c": agreement(edge["c"]), "s": agreement(edge["s"])}


def schedule(pairs: np.ndarray, n_nodes: int) -> list[np.ndarray]:
    """The order of a sweep, as groups of messages that need only those of groups before them.

    Message e < len(pairs) goes along pairs[e], which leads to the later carrier, and e + len(pairs) goes back.
    """
    level = [0] * n_nodes
    for a, b in sorted(pairs.tolist(), key=lambda x: x[1]):
        level[b] = max(level[b], level[a] + 1)
    groups, of = [], np.asarray(level)
    for side, first in ((0, 0), (1, len(pairs))):
        at = of[pairs[:, side]]
        order = np.argsort(at, kind="stable")
        parts = np.split(order + first, np.flatnonzero(np.diff(at[order])) + 1)
        groups += parts[::-1] if side else parts
    return groups


def marginals(nodes: list, labels: list[int], chain: list, skip: list, model: dict) -> np.ndarray:
    """Loopy belief propagation: for each carrier the probability of each label."""
    n = len(KINDS) + 1
    unary = np.zeros((len(nodes), n))
    for i, (_, _, word) in enumerate(nodes):
        unary[i] = model["prior"] + FORM_WEIGHT * sum(model["features"].get(f, 0.0) for f in features(word))  # what training never saw says nothing
    unary = np.exp(unary - unary.max(axis=1, keepdims=True))
    observed = np.flatnonzero(labels)
    unary[observed] = np.eye(n)[np.asarray(labels)[observed]]
    pairs = np.array(chain + skip, np.int64).reshape(-1, 2)
    if not len(pairs):
        return unary / unary.sum(axis=1, keepdims=True)
    psi = np.concatenate([np.broadcast_to(model["c"], (len(chain), n, n)), np.broadcast_to(model["s"], (len(skip), n, n))])
    source, to = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    psi = np.concatenate([psi, psi.transpose(0, 2, 1)])
    m = len(pairs)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    messages = np.full((2 * m, n), 1.0 / n)
    groups = schedule(pairs, len(nodes))
    for sweep in range(ROUNDS):
        logs, moved = np.log(messages), 0.0
        belief = np.log(unary + 1e-300)
        np.add.at(belief, to, logs)
        for g in groups:
            out = belief[source[g]] - logs[back[g]]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.einsum("ea,eab->eb", out, psi[g])
            new = np.maximum(new / new.sum(axis=1, keepdims=True), 1e-12)
            if sweep:
                new = DAMPING * messages[g] + (1 - DAMPING) * new
            moved = max(moved, np.abs(new - messages[g]).max())
            new_logs = np.log(new)
            np.add.at(belief, to[g], new_logs - logs[g])
            messages[g], logs[g] = new, new_logs
        if moved < 1e-4:
            break
    belief = np.log(unary + 1e-300)
    np.add.at(belief, to, np.log(messages))
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def is_whole(found: str, kind: int) -> bool:
    """Whether a text has all that a kind asks for by itself, so that nothing is to be joined to it."""
    digits = digits_of(found)
    return ("@" in found, len(_QUAD.findall(found)) >= 4, 14 <= len(digits) <= 19 and luhn(digits), len(digits) >= 10)[kind]


def added_spans(text: str, base: list, model: dict) -> list[tuple[int, int, int]]:
    """Spans that the field adds."""
    nodes = carriers(text)
    if not nodes:
        return []
    labels = labels_of(nodes, base)
    chain, skip = edges_of(text, nodes, base)
    p = marginals(nodes, labels, chain, skip, model)
    joined, out, last = set(chain), [], None
    for i, (start, end, word) in enumerate(nodes):
        best = int(p[i].argmax())
        if labels[i] or not best or p[i, best] <= 0.5:
            continue
        a = start + next((j for j, c in enumerate(word) if c.isalnum()), 0)
        b = end - next((j for j, c in enumerate(reversed(word)) if c.isalnum()), 0)
        alone = lambda s, e, k=best - 1: is_whole(text[s:e], k)
        if last == (i - 1, best) and (i - 1, i) in joined and not alone(out[-1][0], out[-1][1]) and not alone(a, b):
            out[-1] = (out[-1][0], b, best - 1)
        else:
            out.append((a, b, best - 1))
        last = (i, best)
    # of the base spans that begin before an added one ends, the furthest end tells
    starts, furthest = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    return [s for s in out if not (k := bisect_left(starts, s[1])) or furthest[k - 1] <= s[0]]


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, redacted string"


def finder(model: dict, redact: bool):
    @F.pandas_udf(typed(FOUND))
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            text = text or ""
            base = base_spans(text)
            spans = base + added_spans(text, base, model)
            n = Counter(k for _, _, k in base)
            rows.append((n[0], n[1], n[2], n[3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), redacted(text, spans) if redact and spans else None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])

    return found


def redacted(text: str, spans: list) -> str:
    """Each span gives way to its kind in brackets; of overlapping ones the first, extended."""
    merged: list[list] = []
    for s, e, k in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, k])
    out, last = [], 0
    for s, e, k in merged:
        out += [text[last:s], f"[{KINDS[k].upper()}]"]
        last = e
    return "".join([*out, text[last:]])


def find(docs: DataFrame, redact: bool = False) -> DataFrame:
    """docs with the struct column `pii` (see FOUND); `redacted` is null where nothing was found."""
    small_batches(docs.sparkSession)
    return docs.withColumn(free_name(docs, "pii"), finder(train(docs), redact)("text"))


def pii_query(docs: DataFrame) -> DataFrame:
    return find(docs.select("doc_id", "text")).select("doc_id", "pii.*").drop("redacted")


def without_pii(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: all documents, personal data replaced by its kind. n_chars, where present, follows the text."""
    pii = free_name(docs, "pii")
    new = find(docs, redact=True).withColumn("text", F.coalesce(f"{pii}.redacted", "text"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(f"{pii}.redacted").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return new.drop(pii)
