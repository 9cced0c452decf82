"""The set-similarity join of the pipeline's near-dedup against brute force."""

import random

import pytest
from test_operators import docs, prose

from tideline.llm import shingles, simhash


def alike(a, b, width=5):
    x, y = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if (w := t.split()) else set() for t in (a, b))
    return bool(x) and 5 * len(x & y) >= 4 * len(x | y)


@pytest.mark.parametrize("few", [shingles.FEW, 2])
def test_keep_one_links_similar_sets(spark, monkeypatch, few):
    monkeypatch.setattr(shingles, "FEW", few)
    monkeypatch.setattr(shingles, "SAMPLE", 2)
    draw = random.Random(8)
    texts = []
    for k in range(30):
        words = prose(draw, draw.choice((6, 40, 120, 300)), 5000).split()
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for at in draw.sample(range(len(copy)), draw.randint(0, 1 + len(copy) // 35)):
                copy[at] = "changed%d" % draw.randrange(9)
            texts.append(" ".join(copy[draw.randint(0, 2) :]))
    shared = prose(draw, 40, 5000)
    texts += [shared + " " + prose(draw, 60, 5000) for _ in range(10)] + ["", "one", "one"]
    prints = [simhash.fingerprint(t.encode(), 5) for t in texts]
    component, changed = list(range(len(texts))), True
    close = [[j for j in range(len(texts)) if alike(texts[i], texts[j]) or (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(len(texts))]
    far = sum(j > i and (prints[i] ^ prints[j]).bit_count() > 3 for i in range(len(texts)) for j in close[i])
    assert far > 20
    while changed:
        least = [min(component[j] for j in near) for near in close]
        changed, component = least != component, least
    got = sorted(r.doc_id for r in simhash.keep_one(docs(spark, list(enumerate(texts))), similar=True).collect())
    assert got == sorted(set(component))
