import random

import numpy as np
import pytest

from footgrid.llm import near_dup as N
from tests.llm.helpers import awkward, empty


def roots_by_hand(rows, k, percent=80):
    sets = [N.shingles(N.words_of(t), k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, groups=12, most=9):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(900)]
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 12, 40, 150]))
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 20, len(base) // 12])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words).replace("w1", "W1" if rng.random() < 0.3 else "w1"))
    passage = " ".join(rng.choices(vocabulary, k=14))
    rows += [f"{passage} {' '.join(rng.choices(vocabulary, k=rng.randint(2, 9)))}" for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("shingle, seed, crowd", [(2, 1, 16), (5, 2, 16), (2, 3, 0)])
def test_equals_brute_force(spark, shingle, seed, crowd):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.apply(spark.createDataFrame(rows, "doc_id long, text string"), N.NearDup(shingle=shingle, crowd=crowd)).collect()}
    assert got == roots_by_hand(rows, shingle)


def test_recall_of_tables_at_the_threshold():
    config, rng, found, n = N.NearDup(), np.random.default_rng(4), 0, 400
    for _ in range(n):
        common, own = rng.integers(0, 1 << 62, 160, np.uint64), rng.integers(0, 1 << 62, 40, np.uint64)
        a, b = N.bands([np.unique(np.concatenate([common, own[:20]])), np.unique(np.concatenate([common, own[20:]]))], config)[0]
        same = a == b
        found += same[: config.tables].any() and same[config.tables :].any()
    assert found / n > 0.98


def test_heavily_edited_copies_are_all_found(spark):
    """Copies of one text at similarities about 0.6 to 0.9 of each other: a crowd that only some links hold together."""
    rng, rows = random.Random(8), []
    base = [f"b{i}" for i in range(90)]
    for d in range(160):
        words = list(base)
        for _ in range(rng.choice([2, 6, 9, 10, 11])):
            words[rng.randrange(90)] = f"x{rng.randrange(400)}"
        rows.append((d + 1, " ".join(words)))
    for config in (N.NearDup(shingle=2), N.NearDup(shingle=2, crowd=0), N.NearDup(shingle=2, crowd=10_000)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.apply(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()}
        want = roots_by_hand(rows, 2)
        assert got == want and 5 < len({c for _, c in want.values()}) < 160


def test_pairs_of_just_the_similarity_are_found(spark):
    """Planted pairs of 0.80 to 0.85 from end to end: at least 99 in 100 are found."""
    rng, rows, n = random.Random(9), [], 600
    for d in range(n):
        words = [f"p{d}_{i}" for i in range(rng.randint(60, 200))]
        total = len(words) - 1
        cut = max(k for k in range(1, total) if total - k >= 0.8 * total and (total - k) / total <= 0.86)
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(words[: len(words) - cut]))]
    got = {r.doc_id: r.component_id for r in N.apply(spark.createDataFrame(rows, "doc_id long, text string"), N.NearDup(shingle=2)).collect()}
    assert sum(got[2 * d + 1] == 2 * d for d in range(n)) >= 0.99 * n


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in N.components(links).collect()}
    assert got == {**{i: 0 for i in range(31) if i}, 101: 100, 102: 100}


def test_awkward_rows(spark):
    docs = awkward(spark, [(7, "One"), (8, "one two"), (9, "a null id here")])
    got = {}
    for r in N.apply(docs, N.NearDup(shingle=2)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[6] == [(0, 6, True)]
    assert got[3] == [(1, 3, True)] and got[7] == [(1, 3, False)] and got[8] == [(1, 8, True)]
    assert got[4] == [(1, 4, True)] * 2 and len(got[5]) == 2 and got[None] == [(3, None, True)]
    assert N.apply(empty(spark)).count() == 0
