import random

import numpy as np

from vigilspark.llm import jaccard_join

from .test_operators import table


class Hot:
    value = np.zeros(0, dtype=np.uint64)


def copies(rnd, n, words):
    text = [rnd.choice("abcdefgh") + str(rnd.randrange(5000)) for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(text)
        own[rnd.randrange(words)] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_rows_of_copies_do_not_grow_with_the_ranges(spark):
    """Copies meet in almost every range of keys, but a range makes no row of a pair that shares a label."""
    rnd = random.Random(4)
    docs = table(spark, [t for _ in range(30) for t in copies(rnd, 4, 300)])
    few, many = (jaccard_join.star_rows(docs, 80, 5, ranges, Hot).count() for ranges in (2, 40))
    assert 120 * jaccard_join.OWN <= few and many <= 1.5 * few


def test_sets_with_an_equal_key_share_a_star():
    """Whatever the labels: none, some or all of a key's sets own a star together; one set has several places in none."""
    rnd = np.random.default_rng(5)
    for own in (0, 3, 40):
        sets = [rnd.integers(0, 1 << 40, 12, dtype=np.uint64) for _ in range(60)]
        common = rnd.integers(0, 1 << 40, 40, dtype=np.uint64)
        sets = [np.unique(np.append(s, rnd.choice(common, max(1, own // 4)))) if k % 2 else s for k, s in enumerate(sets)]
        labels = np.array([jaccard_join.own_labels(s) for s in sets])
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        key = np.concatenate(sets)
        twice = rnd.permutation(np.tile(np.arange(len(key)), 2))
        set_, label, owns = jaccard_join.stars(key[twice], at[twice], labels)
        found = [set(label[set_ == k].tolist()) for k in range(len(sets))]
        assert {(a, b) for a, b in zip(set_[owns].tolist(), label[owns].tolist(), strict=True)} == {(k, int(x)) for k, row in enumerate(labels) for x in row}
        assert set(label.tolist()) == set(label[owns].tolist())
        assert all(found[i] & found[j] for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])))


def test_labels_of_few_keys():
    assert jaccard_join.own_labels(np.array([5 + (9 << 32), 3], dtype=np.uint64)).tolist() == [3, 5, 5]
