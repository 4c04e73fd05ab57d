"""All five stages of the pipeline against brute force, over odd texts, null ids, copies, and columns with clashing names."""

import collections
import hashlib
import math
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import common, mixing, pieces, pii, quality

from .test_operators import ODD_TEXTS, WORD, measured

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, quality int, Mix string, encoded int, pii int, row_key string, `odd.name` string"


def fixture() -> list[tuple]:
    random.seed(5)
    words = [f"w{random.choice('abcdefgh')}{i}ord" for i in range(300)]
    prose = lambda n: " ".join(random.sample(words, n))
    texts = list(ODD_TEXTS)
    base = prose(120)
    texts += [base, base, base.replace(base.split()[60], "changed"), base + " " + prose(9), prose(40), prose(41), prose(60)]
    texts += [f"{prose(25)} mail ann.lee@example.org or 10.0.0.{i} or +44 20 7946 0{i:03d} card 4111 1111 1111 1111 {prose(25)}" for i in range(6)]
    texts += [prose(30) + " #### $$$$ ||||" for _ in range(4)] + [prose(n) for n in (22, 35, 35, 80, 300)]
    rows = [(i, t, "en", (None, "a", "b", "c")[i % 4], len(t or ""), 1, "m", 2, 3, "k", "o") for i, t in enumerate(texts)]
    # null ids, a repeated row, a host whose documents mostly fail
    return rows + [(None, prose(33), None, "a", 0, None, None, None, None, None, None), rows[16], rows[16]] + [(500 + i, prose(30) + " ####" if i % 4 else prose(30), "en", "poor", 0, 1, "m", 2, 3, "k", "o") for i in range(16)]


@pytest.fixture(scope="module")
def stages(spark):
    """{stage: (its input, its output)}, rows as tuples of the columns' values."""
    docs, found = common.kept_table(spark.createDataFrame(fixture(), COLUMNS), "fixture"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.kept_table(stage(spark, docs, None), name)
        if name != "encoding":
            assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        found[name] = (docs.collect(), out.collect())
        docs = out
    return found


def bag(rows):
    return collections.Counter(map(tuple, rows))


def test_quality_rules(stages):
    given, out = stages["quality_rules"]
    verdicts = []
    for r in given:
        n, chars, symbols, lines, repeats = measured(r.text)
        bad = n < 20 or 100 * repeats > 30 * n
        verdicts.append((r, bad, 100 * symbols > 10 * n or lines > 20 or chars < 2 * n or chars > 14 * n))
    hosts = collections.defaultdict(list)
    for r, bad, soft in verdicts:
        hosts[r.source].append(bad or soft)
    n, k = sum(map(len, hosts.values())), sum(map(sum, hosts.values()))
    variance = sum(sum(x) ** 2 / len(x) for x in hosts.values()) / n - (k / n) ** 2
    strength = min(max(k / n * (1 - k / n) / variance - 1, 1.0), 1e6)
    rate = {h: (sum(x) + k / n * strength) / (len(x) + strength) for h, x in hosts.items()}
    assert rate["poor"] > quality.MAX_HOST_RATE > rate["a"]  # both verdicts occur
    assert bag(out) == bag(r for r, bad, soft in verdicts if not bad and not (soft and rate[r.source] > quality.MAX_HOST_RATE))


def test_near_dedup(stages):
    given, out = stages["near_dedup"]
    sets = []
    for r in given:
        w = WORD.findall((r.text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(given)))
    for i in range(len(given)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = collections.defaultdict(list)
    for i, g in enumerate(root):
        groups[g].append(given[i])
    assert sorted(map(len, groups.values()))[-2:] == [3, 4]  # a row that comes three times; a text, its copy and two near copies
    left = bag(out)
    for rows in groups.values():
        kept = [r for r in rows if left[tuple(r)]]
        assert sum(left[t] for t in {tuple(r) for r in rows}) == 1 and kept[0].doc_id == min((r.doc_id for r in rows if r.doc_id is not None), default=None)
    assert sum(left.values()) == len(groups)


def test_personal_data(stages):
    given, out = stages["personal_data"]
    rest = lambda r: tuple(v for c, v in r.asDict().items() if c not in ("text", "n_chars"))
    assert collections.Counter(map(rest, given)) == collections.Counter(map(rest, out))
    new, changed = {r.doc_id: r for r in out}, 0
    for r in given:
        spans, o = pii.base_spans(r.text or ""), new[r.doc_id]
        assert not pii.base_spans(o.text)
        if spans:
            changed += 1
            assert o.n_chars == len(o.text) and all(o.text.count(f"[{kind}]") >= sum(s[2] == i for s in spans) for i, kind in enumerate(("EMAIL", "IP", "CARD", "PHONE")))
            assert o.text.startswith(r.text[: spans[0][0]]) and o.text.endswith(r.text[max(s[1] for s in spans) :])
    assert changed >= 6


def test_mixing(stages):
    given, out = stages["mixing"]
    size = {id(r): len(WORD.findall(r.text or "")) for r in given}
    names = sorted({r.source for r in given}, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total = {s: sum(size[id(r)] for r in given if r.source == s) for s in names}
    open_, rest, target = set(names), sum(total.values()), {}
    while stopped := {s for s in open_ if rest * weight[s] > 3 * total[s] * sum(weight[x] for x in open_)}:  # all at once, then again
        target |= {s: 3 * total[s] for s in stopped}
        open_, rest = open_ - stopped, rest - sum(3 * total[s] for s in stopped)
    target |= {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
    part = lambda i: (((((i or 0) % 2**31) * 1103515245) % 2**31) >> 15) % mixing.PARTS
    expected = collections.Counter()
    for s in names:
        offset = int(hashlib.md5(f"{mixing.SEED}|{chr(0) + 'null' if s is None else s}".encode()).hexdigest()[:6], 16) / 2**24
        rate = target[s] / total[s]
        rows = sorted((r for r in given if r.source == s), key=lambda r: (size[id(r)], part(r.doc_id), r.doc_id is not None, r.doc_id or 0))
        for i, r in enumerate(rows):
            expected[tuple(r)] += math.floor(offset + rate * (i + 1)) - math.floor(offset + rate * i)
    assert bag(out) == +expected and max(expected.values()) <= 3


def test_encoding(stages):
    given, out = stages["encoding"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert collections.Counter((r.doc_id, r.lang, r.source, tuple(library.encode(r.text or ""))) for r in given) == collections.Counter((r.doc_id, r.lang, r.source, tuple(r.ids)) for r in out)
    assert all(r.n_tokens == len(r.ids) and r.round_trip for r in out)


def test_encoding_of_odd_rows(spark):
    docs = spark.createDataFrame([r for r in fixture() if r[1] in ODD_TEXTS], COLUMNS)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = {r.doc_id: r.ids for r in STAGES["encoding"](spark, docs, None).collect()}
    assert ids == {i: library.encode(t or "") for i, t in enumerate(ODD_TEXTS)}


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, name):
    empty = spark.createDataFrame([], COLUMNS)
    out = STAGES[name](spark, empty, None)
    assert out.count() == 0 and (out.columns == empty.columns or name == "encoding")


def test_run_is_the_stages_in_turn(spark, tmp_path, stages):
    spark.createDataFrame(fixture(), COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda found: collections.Counter((r.doc_id, r.source, tuple(r.ids)) for r in found)
    assert rows(corpus_pipeline.run(spark, str(tmp_path)).select("*", F.lit(1)).collect()) == rows(stages["encoding"][1])
