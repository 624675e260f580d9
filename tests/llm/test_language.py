import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from footgrid.llm import language as L
from footgrid.tables import table
from tests.llm.helpers import awkward, empty


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=6), st.integers(0, 10_000))
def test_viterbi_equals_enumeration(lengths, seed):
    scores = np.random.default_rng(seed).normal(size=(sum(lengths), 3)) * 3
    label, start = L.viterbi(scores, np.array(lengths), 2.0), 0

    def value(path, part):
        return sum(part[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

    for n in lengths:
        part = scores[start : start + n]
        if n:
            best = max(value(p, part) for p in itertools.product(range(3), repeat=n))
            assert value(label[start : start + n].tolist(), part) == pytest.approx(best)
        start += n


def test_two_hundred_languages():
    scores = np.zeros((6, 200))
    scores[[0, 1, 2, 3, 4, 5], [150, 150, 150, 199, 199, 199]] = 50.0
    assert L.viterbi(scores, np.array([6]), 2.0).tolist() == [150] * 3 + [199] * 3
    names = [f"l{i:03}" for i in range(200)]
    model = L.Model(names, np.log(np.random.default_rng(1).dirichlet(np.ones(64), 200).T), np.ones((len(L.NAMES), 200), bool))
    memory = L.WordScores(model, L.Language(buckets=64))
    _, letters, lengths, label = L._labelled(["some words of one text"], memory, L.Language(buckets=64))
    assert label.dtype.kind == "u" and label.max() < 200 and len(set(label.tolist())) == 1


def test_held_out_accuracy_and_spans(spark, tiny):
    docs = table(spark, tiny.replace("0.001", "0.01"), "documents")
    found = {r.doc_id: r for r in L.apply(docs).collect()}
    rows = docs.collect()
    held = [r for r in rows if found[r.doc_id].held_out]
    assert held and np.mean([found[r.doc_id].lang_pred == r.lang for r in held if r.lang]) > 0.98
    texts = {lang: next(r.text for r in rows if r.lang == lang and len(r.text) > 600 and found[r.doc_id].score > 0.99) for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, texts["en"][:400] + " " + texts["de"][:400])], "doc_id long, text string")
    spans = L.spans(mixed, L.train(docs)).orderBy("start").collect()
    assert [s.lang for s in spans] == ["en", "de"] and spans[0].end == spans[1].start and spans[0].start == 0


def test_query_equals_brute_force(spark, tiny):
    """Counts, scores, spans and shares again, in dictionaries and a loop over all states."""
    import zlib
    from collections import Counter
    from math import log

    config, rows = L.Language(buckets=256), table(spark, tiny, "documents").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, (r.text or "")[:700], r.lang) for r in rows][:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = {d: zlib.crc32(str(d).encode()) % 4 for d, _, _ in rows}

    def words(text):
        return L.regex.findall(r"\p{L}[\p{L}\p{M}]*", text)

    def buckets(word):
        data = b"\x02" + word.lower().encode() + b"\x03"
        return [((int.from_bytes(data[i : i + 3], "big") * 0x9E3779B97F4A7C15 % 2**64) >> 40) % 256 for i in range(len(data) - 2)]

    def script(word):
        return [name for start, name in L.SCRIPTS if start <= ord(word[0])][-1]

    names = sorted({g for d, _, g in rows if g is not None and fold[d] != 2})
    grams = {g: Counter(b for d, t, x in rows if x == g and fold[d] != 2 for w in words(t) for b in buckets(w)) for g in names}
    scripts = {g: Counter(script(w) for d, t, x in rows if x == g and fold[d] != 2 for w in words(t)) for g in names}
    total = {g: sum(grams[g].values()) + 0.5 * 256 for g in names}

    def score(word, g):
        writers = [h for h in names if scripts[h][script(word)] >= 0.01 * max(1, sum(scripts[h].values()))]
        return 0.0 if not writers else -1e4 if g not in writers else sum(log((grams[g][b] + 0.5) / total[g]) for b in buckets(word))

    found = {r.doc_id: r for r in L.apply(docs, config).collect()}
    for d, t, _ in rows:
        own, value, back = words(t), None, []
        for w in own:
            scores = {g: score(w, g) for g in names}
            if value is None:
                value = scores
            else:
                best = max(names, key=lambda g: value[g])
                step = {g: g if value[g] >= value[best] - 12.0 else best for g in names}
                back.append(step)
                value = {g: max(value[g], value[best] - 12.0) + scores[g] for g in names}
        held = Counter()
        if own:
            at = max(names, key=lambda g: value[g])
            for i in range(len(own) - 1, -1, -1):
                held[at] += len(own[i])
                at = back[i - 1][at] if i else at
        assert found[d].held_out == (fold[d] == 2)
        if not own:
            assert (found[d].lang_pred, found[d].score) == ("und", 0.0)
        else:
            assert found[d].lang_pred == max(names, key=lambda g: held[g])
            assert found[d].score == pytest.approx(max(held.values()) / sum(held.values()))


def test_scripts_narrow(spark):
    docs = spark.createDataFrame([(d, t, g) for d in range(40) for t, g in (("привет мир как дела", "ru"), ("γειά σου κόσμε", "el"), ("hello world again", "en"))], "doc_id long, text string, lang string")
    model = L.train(docs)
    asked = spark.createDataFrame([(1, "мир"), (2, "κόσμε"), (3, "world"), (4, "12 34 !?"), (5, "漢字")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(asked, model).collect()}
    assert got[1] == ("ru", 1.0) and got[2] == ("el", 1.0) and got[3] == ("en", 1.0) and got[4] == ("und", 0.0) and got[5][0] in model.languages


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = L.apply(docs).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 6)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert L.apply(empty(spark)).count() == 0
    assert {r.lang_pred for r in L.apply(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
