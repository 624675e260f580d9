import hashlib
import random
import re

import pytest

from footgrid.llm import decontaminate as D
from tests.llm.helpers import awkward, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(len(w), span)
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((doc or 0, len(w), len(hit), len([x for x in found if x is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def corpus(seed, short):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "Übung", "7"]
    items = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.choice([10, 11, 25] + ([1, 3, 9] if short else []))))) for i in range(12)]
    items += [(12, items[0][1].upper()), (13, None), (14, "..."), (15, items[1][1])]
    docs = []
    for d in range(60):
        text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 4, 9, 10, 60])))
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, len(w))
            text += " " + " ".join(w[a : a + rng.choice([8, 9, 10, 15])]) + rng.choice(["!", " w1 ", "\x00"])
        docs.append((d, text))
    return docs + [docs[-1], (59, docs[3][1])], items


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("config", [D.Decontaminate(), D.Decontaminate(broadcast_rows=0), D.Decontaminate(k=8, literal_rows=0, bitmap_prints=0)])
def test_equals_brute_force(spark, short, config):
    docs, items = corpus(6, short)
    got = D.apply(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), config)
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == by_hand(docs, items)


def test_spans_hold_the_words_hit(spark):
    docs = spark.createDataFrame([(1, "x y a b c d e f g h i j k z")], "doc_id long, text string")
    got = D.apply(docs, spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")).first()
    assert [tuple(s) for s in got.spans] == [(2, 12), (3, 13)] and got.n_hit == 11


@pytest.mark.parametrize("items", [[], [(1, None)], [(None, "word word word word word word word word word word word")], [(1, "one")]])
def test_awkward_rows(spark, items):
    docs, benchmark = awkward(spark), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.apply(docs, benchmark).collect())
    assert got == by_hand([(r.doc_id, r.text) for r in docs.collect()], items)
    assert D.apply(empty(spark), benchmark).count() == 0
