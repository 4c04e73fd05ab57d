"""Links of a class in a large bucket to one that is in small buckets only."""

import random

from foliant.llm import neardup

from .test_operators import brute_components, documents


def test_links_beside_a_half_alike_family(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    common, texts = [word() for _ in range(160)], []
    for _ in range(300):
        a = common + [word() for _ in range(80)]
        b = a[:]
        for i in (r.randrange(10), 50 + r.randrange(10), 100 + r.randrange(10)):
            b[i] = word()
        texts += [" ".join(a), " ".join(b)]
    want = brute_components(texts)
    assert len({root for _, root in want}) == 300
    rows = neardup.neardup_query(documents(spark, texts)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in rows} == dict(enumerate(want))
