import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footgrid.llm import quality_classifier as C
from footgrid.llm import quality_rules as R
from footgrid.tables import table
from tests.llm.helpers import awkward, empty


def counts_by_hand(text):
    text = text or ""
    words, inside = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [inside] if inside else []
            inside = ""
        else:
            inside += c
    lines = text.split("\n")
    duplicates = sum(any(c not in " \t\n\x0b\x0c\r" for c in x) and x in lines[:i] for i, x in enumerate(lines))
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(hit), failed


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c ", " ", "\n", "é#", "|", " ", "\x0b", "d e f g h ", "\t"]), max_size=80).map("".join))
def test_base_counts(text):
    ratios = np.zeros(2 * R.QualityRules().buckets)
    assert R.judged(text, ratios, R.QualityRules())[:6] == counts_by_hand(text)


def test_windows_with_many_distinct_words():
    words = [str(i).encode() for i in range(30_000)] * 2 + [b"x"]
    ids, seen = R.word_ids(words)
    assert R.repeated_words(ids, len(seen)) == 60_000


def test_llr_by_hand(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words there"), (3, "good words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    config = R.QualityRules(buckets=64)
    counts = R.bucket_counts(docs, R.target_ids(labels, config), config)
    feats = {d: R.features(*R.word_ids(t.encode().split()), 64) for d, t in docs.collect()}
    assert (counts[0] == sum(np.bincount(f, minlength=128) for f in feats.values())).all()
    assert (counts[1] == np.bincount(feats[1], minlength=128)).all()
    ratios = R.log_ratios(counts, config)
    got = {r.doc_id: r.llr for r in R.apply(docs, labels, config).collect()}
    assert got == pytest.approx({d: ratios[f].mean() for d, f in feats.items()})
    assert got[1] > got[2]


def grams_by_hand(words, buckets):
    """Bucket names of a text's unigrams and bigrams, in plain integers."""
    mask, out = (1 << 64) - 1, []
    hashes = [zlib.crc32(w.encode()) for w in words]
    for h in hashes:
        out.append(("one", h % buckets))
    for a, b in zip(hashes, hashes[1:]):
        x = (a * 0x9E3779B97F4A7C15 & mask) ^ (b * 0xC2B2AE3D27D4EB4F & mask)
        out.append(("two", (((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & mask) >> 40) % buckets))
    return out


def test_verdict_equals_multinomials_by_hand(spark, tiny):
    config, docs, labels = R.QualityRules(buckets=512), table(spark, tiny, "documents"), table(spark, tiny, "labels")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    grams = {d: grams_by_hand([w for w in rows[d].translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w], 512) for d in rows}
    raw, target = Counter(g for x in grams.values() for g in x), Counter(g for d in trusted for g in grams[d])
    total = {(k, name): sum(n for (kind, _), n in c.items() if kind == k) + 512 for k in ("one", "two") for name, c in (("raw", raw), ("target", target))}
    found = {r.doc_id: r for r in R.apply(docs, labels, config).collect()}
    assert len(found) == len(rows) and {r.kept for r in found.values()} == {True, False}
    for d, own in grams.items():
        logs = [np.log((target[g] + 1) / total[g[0], "target"]) - np.log((raw[g] + 1) / total[g[0], "raw"]) for g in own]
        score = float(np.mean(logs)) if logs else 0.0
        assert found[d].llr == pytest.approx(score, abs=1e-9)
        assert found[d].base_failed == counts_by_hand(rows[d])[5] if len(rows[d]) < 20_000 else True
        assert found[d].kept == (not found[d].base_failed and score >= config.threshold)


def test_every_trusted_row_counts(spark):
    config, n = R.QualityRules(buckets=64), 20_500
    docs = spark.range(n).selectExpr("id AS doc_id", "'alpha' AS text").unionByName(spark.createDataFrame([(None, "alpha")] * 3, "doc_id long, text string"))
    trusted = R.target_ids(spark.range(n).selectExpr("id AS doc_id", "1 AS quality"), config)
    broadcast = R.bucket_counts(docs, trusted, config)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = R.bucket_counts(docs, trusted, config)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert broadcast.sum(axis=1).tolist() == shuffled.sum(axis=1).tolist() == [n + 3, n]


def test_labelled_documents_are_told_apart(spark, tiny):
    sf = tiny.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    judged = {r.doc_id: r for r in R.apply(docs, labels).collect()}
    by_quality = {0: [], 1: []}
    for r in labels.collect():
        by_quality[r.quality].append(judged[r.doc_id])
    good = [r for r in by_quality[1] if not r.base_failed]
    assert sum(r.kept for r in good) == len(good)
    assert sum(not r.kept for r in by_quality[0]) > 0.7 * len(by_quality[0])


def test_classifier_held_out_accuracy(spark, tiny):
    sf = tiny.replace("0.001", "0.01")
    labels = table(spark, sf, "labels")
    scored = {r.doc_id: r for r in C.apply(table(spark, sf, "documents"), labels).collect()}
    held = [(r.quality, scored[r.doc_id]) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(s.held_out for _, s in held)
    assert np.mean([q == s.predicted for q, s in held]) > 0.95
    assert all(0 <= s.score <= 1 and s.predicted == int(s.score >= 0.3) for s in scored.values())


def test_statistics_by_hand():
    text = "The cat sat! sat\nON THE MAT #\nON THE MAT #"
    got = dict(zip(C.NAMES, C.statistics(text)))
    n, words = len(text), text.split()
    assert got["share_upper"] == pytest.approx(sum(c.isupper() for c in text) / n) and got["share_blank"] == pytest.approx(text.count(" ") / n)
    assert got["share_line"] == pytest.approx(2 / n) and got["share_hash"] == pytest.approx(2 / n) and got["share_shout"] == pytest.approx(1 / n)
    assert got["log_words"] == pytest.approx(np.log(1 + len(words))) and got["distinct_words"] == len(set(words)) / len(words)
    assert got["word_bytes"] == n / len(words) and got["top_word"] == 2 / len(words) and got["repeats_previous"] == 0
    assert got["upper_words"] == sum(w.isupper() for w in words) / len(words) and got["lines_per_word"] == 3 / len(words) and got["distinct_lines"] == 2 / 3
    assert got["marked_words"] == 3 / len(words)
    assert all(v == 0 for v in C.statistics(None)) and all(v == 0 for v in C.statistics(""))


def test_first_tree_is_the_best_of_all_splits():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, len(C.NAMES)))
    y = ((x[:, 7] > 0.2) ^ (rng.random(60) < 0.1)).astype(float)
    config = C.QualityClassifier(trees=1, depth=1, bins=8, min_rows=5)
    model = C.fit(x, y, config)
    p = y.mean()
    best = None
    for j in range(x.shape[1]):
        edges = np.quantile(x[:, j], [k / 8 for k in range(1, 8)])
        for cut, edge in enumerate(edges):
            left = [i for i in range(60) if x[i, j] <= edge]
            right = [i for i in range(60) if x[i, j] > edge]
            if min(len(left), len(right)) < 5:
                continue
            gain = sum(sum(p - y[i] for i in side) ** 2 / (len(side) * p * (1 - p) + 1) for side in (left, right))
            if best is None or gain > best[0] + 1e-12:
                best = (gain, j, cut, [-sum(p - y[i] for i in side) / (len(side) * p * (1 - p) + 1) * config.rate for side in (left, right)])
    assert (model.feature[0, 0], model.cut[0, 0]) == best[1:3] and model.leaf[0].tolist() == pytest.approx(best[3])


def test_flat_trees_equal_recursion():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(C.NAMES)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0).astype(float)
    config = C.QualityClassifier(trees=12, depth=3, bins=16)
    model = C.fit(x, y, config)
    bins = model.binned(x)

    def down(t, row, node=0):
        inner = model.feature.shape[1]
        return model.leaf[t, node - inner] if node >= inner else down(t, row, 2 * node + 1 + (bins[row, model.feature[t, node]] > model.cut[t, node]))

    want = [1 / (1 + np.exp(-(model.base + sum(down(t, i) for t in range(12))))) for i in range(50)]
    assert model.score(x[:50]) == pytest.approx(np.array(want))
    assert ((model.score(x) > 0.5) == y).mean() > 0.8


@pytest.mark.parametrize("rows", [[], [(3, 1, 0)], [(3, None, None), (None, 1, 0)]])
def test_awkward_rows(spark, rows):
    docs, labels = awkward(spark), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for operator in (R, C):
        assert operator.apply(docs, labels).count() == docs.count()
        assert operator.apply(empty(spark), labels).count() == 0
    judged = {(r.doc_id, r.n_words): r for r in R.apply(docs, labels).collect()}
    assert judged[(1, 0)].base_failed and judged[(4, 30_000)].n_repeat_words == 30_000
    assert {r.score for r in C.apply(docs, labels).collect() if r.doc_id in (1, 2)} == {C.apply(docs, labels).where("doc_id = 1").first().score}
    assert C.accepted(docs, C.train(docs, labels)).columns == docs.columns
