import re

import pytest

from footgrid.llm import license_scan as L
from tests.llm.helpers import awkward, empty

NOTICES = [(f, t) for f, t in L.notices() if f != L.UNKNOWN]


def judged(unit, config=L.LicenseScan()):
    """(family, probability, agreement, confirmed) by plain loops."""
    model = L.train(config)
    p = model.probabilities(unit)
    best, held = model.families[p.argmax()], L.bigrams_of(L.words_of(unit))
    agreement = max([len(held & set(t)) / len(t) for f, t in L.templates() if f == best], default=0.0)
    family = best if p.max() >= config.probability else L.UNKNOWN
    return family, p.max(), agreement, family != L.UNKNOWN and agreement >= config.agreement - 1e-6


def by_hand(text):
    """(n_notices, families) of a text, every unit judged."""
    found = set()
    for i, block in enumerate(re.split(r"\n[ \t\r]*\n", (text or "").lower())):
        joined = re.sub(r"[ \t\n\x0b\x0c\r]+", " ", block).strip(" ")
        for unit in {joined, *block.split("\n"), *re.split(r"(?<=[.!?;]) ", joined)}:
            family, _, _, sure = judged(unit)
            if sure:
                found.add((i, family))
    return len(found), ",".join(sorted({f for _, f in found}))


def test_scores_equal_the_model(spark):
    lines = sorted({t.lower() for _, t in L.notices()})[::7] + ["license", "licensed under the eupl 1.2", "license " * 50, "warranty license é ü"]
    got = {r.id: r for r in L.scored(spark.createDataFrame(list(enumerate(lines)), "id long, unit string")).collect()}
    for i, t in enumerate(lines):
        family, p, agreement, sure = judged(t)
        assert got[i].probability == pytest.approx(p, abs=2e-6) and got[i].family == family and got[i].confirmed == sure
        if family != L.UNKNOWN:
            assert got[i].agreement == pytest.approx(agreement, abs=1e-6)


def test_notices_that_the_fit_has_not_seen():
    unseen = [(f, t) for f, t in NOTICES if L.part_of(t) == "test"]
    other = [t for f, t in L.notices() if f == L.UNKNOWN and L.part_of(t) == "test"]
    assert len(unseen) > 60 and len(other) > 10
    assert sum(judged(t)[0] == f and judged(t)[3] for f, t in unseen) >= 0.95 * len(unseen)
    assert sum(judged(t)[3] for t in other) == 0
    assert not any(judged(t)[3] for t in L.OTHERS)


def test_the_screen_leaves_out_nothing_that_is_confirmed():
    anchors, config = L.anchors(), L.LicenseScan()
    assert len(anchors) < 80
    for _, grams in L.templates():
        without = [g for g in grams if not any(w in anchors for w in g.split())]
        assert len(without) < L.needed(len(grams), config)


def test_equals_brute_force(spark):
    words = [w for _, t in NOTICES for w in t.split()]
    texts = ["\n".join(" ".join(words[i + 9 * k : i + 9 * k + n]) for k in range(2)) for n in (1, 2, 5, 9, 30) for i in range(0, len(words), 97)]
    texts += ["river\n\n".join([*L.OTHERS[k : k + 3], t]) for k, (_, t) in enumerate(NOTICES[::11])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_notices, r.families) for r in L.apply(docs).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def test_wrapped_headers_and_notices_in_long_lines(spark):
    def wrapped(text):
        lines = [""]
        for w in text.split():
            lines = [*lines, w] if len(lines[-1]) + len(w) > 40 else [*lines[:-1], f"{lines[-1]} {w}".strip()]
        return "\n".join(lines)

    texts = [(f, f"some words here.\n\n{wrapped(t)}\n\nmore words") for f, ts in L.HEADERS.items() for t in ts if len(t) > 70]
    texts += [("proprietary", "the river of the town was high " * n + "All rights reserved.") for n in (1, 3, 50)]
    texts += [("proprietary", f"Copyright {x}. All rights reserved.") for x in ("(c) 2021 Example Corp", "2019 Acme Inc")]
    texts += [("CC-BY-SA", "Text is available under CC BY-SA 4.0."), ("GPL", "Distributed under the GPL version 2 or later."), ("public domain", "This is free and unencumbered software released into the public domain")]
    texts += [("", t) for t in ("The house is free of charge.", "This is free.", "Recipes in the book", "All rights of the crown were reserved.", "of the", "the license", "Copyright 2019 is the year of the report.")]
    got = {r.doc_id: r.families for r in L.apply(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")).collect()}
    wrong = [(texts[i], f) for i, f in got.items() if f != texts[i][0]]
    assert len(wrong) <= 1, wrong


def test_awkward_rows(spark):
    notice = "Released under the MIT License."
    docs = awkward(spark, [(7, f"{notice}\n{notice}\nLicensed under CC BY-NC 4.0."), (7, notice), (None, notice), (8, notice + " word" * 50_000)])
    got = sorted((r.doc_id or 0, r.n_notices, r.families) for r in L.apply(docs).collect())
    assert [x for x in got if x[1]] == [(0, 1, "MIT"), (7, 1, "MIT"), (7, 2, "CC-BY-NC,MIT"), (8, 1, "MIT")]
    assert len(got) == docs.count() and L.apply(empty(spark)).count() == 0
