import random

import pytest

from vigilspark.llm import jaccard_join

from .test_operators import classes_of, shingles, table


@pytest.mark.parametrize("part", [512, 3])
def test_shared_passages_and_border_copies(spark, monkeypatch, part):
    """Stars of several components, whole and in parts: unlike texts with one passage, copies of copies about the threshold, one frequent text."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "TILE", 400)
    rnd = random.Random(11)
    word = lambda: rnd.choice("bcdfg") + rnd.choice("aeiou") + rnd.choice("klmnp") + rnd.choice("aeiou")
    passage, texts = [word() for _ in range(30)], ["same words here for all of them"] * 20
    for k in range(24):
        texts.append(" ".join([*(word() for _ in range(10 + 2 * k)), *passage, *(word() for _ in range(rnd.randrange(8)))]))
    for _ in range(3):
        w = [word() for _ in range(70)] + passage
        for _ in range(14):
            w = list(w)
            w[rnd.randrange(len(w))] = word()
            if rnd.random() < 0.4:
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
    rnd.shuffle(texts)
    sets = {k: shingles(t, 5) for k, t in enumerate(texts)}
    want = classes_of(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(table(spark, texts), percent=80, size=5).collect()}
    assert got == want and 1 < len(set(want.values())) < len(texts) - 20
