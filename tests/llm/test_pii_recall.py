"""What the field adds: forms of an address that the patterns miss, beside ones that they find, and nothing of plain numbers."""

import random
import re

import pytest

from foliant.llm import pii

SF = "/root/testdata/sf0.01"


def card(draw):
    body = "4" + "".join(str(draw.randrange(10)) for _ in range(14))
    return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))


def planted(draw, kind):
    """(form that the patterns find, form that they miss) of one address or number."""
    n = lambda a, b: draw.randint(a, b)
    if kind == 0:
        name, site = f"{draw.choice(['ana', 'li', 'omar'])}.{n(10, 99)}", draw.choice(["mail", "site", "post"])
        return f"{name}@{site}.org", draw.choice([f"{name}@{site},org", f"{name}@@{site}.org"])
    if kind == 1:
        parts = [str(n(10, 255)) for _ in range(4)]
        return ".".join(parts), draw.choice(["-", "_", ":"]).join(parts)
    if kind == 2:
        c = card(draw)
        return c, draw.choice([".", "/", "_"]).join(c[i : i + 4] for i in range(0, 16, 4))
    a, b, c = n(200, 999), n(200, 999), n(1000, 9999)
    return f"+1-{a}-{b}-{c}", draw.choice([f"1-{a}-{b}-{c}", f"1{a}{b}{c}", f"1.{a}.{b}.{c}", f"{a}-{b}-{c}"])


def plain(draw):
    """A number that comes twice and is no personal data."""
    return draw.choice([str(draw.randint(10**5, 10**13)), f"20{draw.randint(10, 29)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}", f"v{draw.randint(1, 9)}.{draw.randint(10, 99)}.{draw.randint(0, 9)}", f"{draw.getrandbits(64):016x}"])


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_planted_forms_are_found_and_plain_numbers_left(spark, model):
    draw = random.Random(5)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r.text]
    wanted = found = right = added = 0
    for text in texts:
        kind, number = draw.randrange(4), plain(draw)
        good, bad = planted(draw, kind)
        half = len(text) // 2
        whole = f"{text[:half]} id {good} {text[half:]} or {bad} ; {number} so {number} end"
        spans = pii.added_spans(whole, pii.base_spans(whole), model)
        at = whole.rindex(f"or {bad} ;") + 3
        hit = any(s <= at and e >= at + len(bad) and k == kind for s, e, k in spans) or any(s <= at and e >= at + len(bad) for s, e, _ in pii.base_spans(whole))
        wanted, found, added = wanted + 1, found + hit, added + len(spans)
        right += sum(e > at and s < at + len(bad) and k == kind for s, e, k in spans) + sum(bool(re.fullmatch(r"[0-9]{14,19}", whole[s:e])) and pii.luhn(whole[s:e]) for s, e, k in spans if k == 2 and e <= at)
    assert found / wanted >= 0.9 and right / added >= 0.95


def test_numbers_that_are_whole_by_themselves_are_spans_of_their_own(model):
    text = "4465758382889437 4465758382889437"
    assert pii.base_spans(text) == [] and pii.added_spans(text, [], model) == [(0, 16, 2), (17, 33, 2)]


def test_the_first_carrier_of_a_span_stands_for_its_digits():
    text = "+1 555 010 9999 then 15550109999"
    nodes, base = pii.carriers(text), pii.base_spans(text)
    assert (0, 4) in pii.edges_of(text, nodes, base)[1] and (0, 4) not in pii.edges_of(text, nodes)[1]


def test_training_samples():
    text = "a@b.org, 10.2.3.4, 4111111111111111, +1-555-010-9999"
    long, spans = pii.with_samples(text, pii.base_spans(text))
    shown = [(pii.KINDS[k], long[s:e]) for s, e, k in spans[4:]]
    assert long.startswith(text) and shown == [("email", "a@b,org"), ("ip", "10-2-3-4"), ("card", "4111.1111.1111.1111"), ("phone", "15550109999")]
    assert pii.base_spans(pii.with_samples("", [])[0]) == [] and not any(pii.base_spans(pii.plain_number(i)) for i in range(2000))
