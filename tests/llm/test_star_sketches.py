import random

import numpy as np
import pytest

from vigilspark.llm import jaccard_join

from .test_operators import table


@pytest.mark.parametrize("percent", [80, 85])
def test_no_similar_pair_is_left_out(percent):
    """Sketches of any two lengths: all similar pairs may be similar, unlike sets of 100 shingles and more may not."""
    rnd = np.random.default_rng(7)
    new = lambda n: np.unique(rnd.integers(0, 1 << 64, n, dtype=np.uint64))
    sets = []
    for n in (1, 2, 7, 60, 64, 65, 70, 128, 130, 500, 511, 513, 1100):
        s = new(n)
        sets += [s, s, np.unique(np.concatenate([s[n // 10 :], new(n // 10)])), np.unique(np.concatenate([s, new(n // 7)])), s[n // 8 :], new(n)]
    n, sketches = np.array([len(s) for s in sets]), [jaccard_join.sketch(s) for s in sets]
    may = jaccard_join.may_be_similar(sketches, n, sketches, n, percent)
    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            differ = jaccard_join.bits_that_differ(sketches[i], sketches[j])
            assert differ <= len(a) + len(b) - 2 * both
            assert may[i, j] == (200 * percent * (len(a) + len(b)) <= 100 * (100 + percent) * (len(a) + len(b) - max(differ, abs(len(a) - len(b)))))
            if jaccard_join.similar(both, len(a), len(b), percent):
                assert may[i, j]
                links += i != j
            elif not both and min(len(a), len(b)) >= 100:
                assert not may[i, j]
    assert links > 50


@pytest.mark.parametrize("part", [512, 3])
def test_unlike_sets_leave_their_stars(spark, monkeypatch, part):
    """A star keeps sets like its centre (near), and sets like each other; those like none go, so that their texts don't move."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    rnd = np.random.default_rng(3)
    new = lambda n: rnd.integers(0, 1 << 64, n, dtype=np.uint64)
    centre, other = new(200), new(200)
    sets = [centre, np.append(centre[5:], new(5)), other, np.append(other[4:], new(3)), *[new(150 + 10 * k) for k in range(12)]]
    rows = [(k, len(s), bytearray(jaccard_join.sketch(np.sort(s)))) for k, s in enumerate(sets)]
    links = spark.createDataFrame([(k, 0) for k in range(1, len(sets))], "a long, b long")
    got = jaccard_join.pruned(links, spark.createDataFrame(rows, "sid long, n long, sketch binary"), 85)
    assert sorted(map(tuple, got.collect())) == [(1, 0, True), (2, 0, False), (3, 0, False)]


def test_ranges_follow_the_documents(spark, monkeypatch):
    """A set and a centre are one row of a range: ranges don't grow with the shuffle partitions."""
    asked = []
    plain = jaccard_join.candidate_links
    monkeypatch.setattr(jaccard_join, "candidate_links", lambda docs, percent, size, ranges, hot: asked.append(ranges) or plain(docs, percent, size, ranges, hot))
    rnd = random.Random(5)
    text = [rnd.choice("abcdefgh") + str(rnd.randrange(50)) for _ in range(80)]
    texts = [" ".join([*text[:k], "other", *text[k + 1 :]]) for k in range(0, 80, 5)]
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        got = [r["component_id"] for r in jaccard_join.join(table(spark, texts)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert asked == [1] and set(got) == {0}
