"""Stages against plain versions of what each decides on its own input, and the whole over awkward rows."""

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from footgrid.llm import bpe, quality_classifier, quality_rules
from footgrid.tables import table
from tests.llm.helpers import awkward, empty
from tests.llm.test_decontaminate import by_hand
from tests.llm.test_near_dup import roots_by_hand

RANKS = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_stages(spark, tiny):
    docs, labels = table(spark, tiny, "documents"), table(spark, tiny, "labels")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = corpus_pipeline.classify_quality(spark, docs, tiny).cache()
    assert one.columns == list(corpus_pipeline.COLUMNS)
    assert ids(one) == ids(quality_classifier.apply(docs, labels).where("predicted = 1"))
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(bad & set(ids(one))) <= 0.2 * len(bad)
    two = corpus_pipeline.apply_quality_rules(spark, one, tiny).cache()
    assert ids(two) == ids(quality_rules.apply(one, labels).where("kept"))
    three = corpus_pipeline.drop_near_duplicates(spark, two, tiny).cache()
    roots = roots_by_hand([(r.doc_id, r.text) for r in two.collect()], 5)
    assert ids(three) == sorted(d for d, (_, root) in roots.items() if d == root)
    four = corpus_pipeline.drop_contaminated(spark, three, tiny).cache()
    found = by_hand([(r.doc_id, r.text) for r in three.collect()], [tuple(r) for r in table(spark, tiny, "benchmark").select("item_id", "text").collect()])
    assert ids(four) == sorted(x[0] for x in found if not x[5])
    five = {r.doc_id: r for r in corpus_pipeline.encode(spark, four, tiny).collect()}
    assert {d: r.n_tokens for d, r in five.items()} == {r.doc_id: len(LIBRARY.encode_ordinary(r.text)) for r in four.collect()}
    assert ids(corpus_pipeline.run(spark, tiny)) == sorted(five)


def test_awkward_rows(spark, tiny):
    docs = awkward(spark)
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, empty(spark), tiny).count() == 0
    rows = lambda df: sorted(((r.doc_id or 0, r.text or "") for r in df.collect()))
    every = rows(docs)
    judged = stages["quality classifier"](spark, docs, tiny)
    assert judged.columns == list(corpus_pipeline.COLUMNS)
    kept = rows(judged)
    assert all(kept.count(r) in (0, every.count(r)) for r in every)  # equal rows alike
    assert stages["quality rules"](spark, docs, tiny).count() == 0  # too few words, or the same word over and over
    once = stages["near duplicates"](spark, docs, tiny)
    assert once.columns == list(corpus_pipeline.COLUMNS) and rows(once) == sorted(set(every))
    assert rows(stages["benchmark decontamination"](spark, docs, tiny)) == every
    found = stages["byte-level bpe"](spark, docs, tiny).collect()
    want = sorted((d, len(LIBRARY.encode_ordinary(t))) for d, t in every)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == want


def test_a_document_with_a_benchmark_passage_goes(spark, tiny):
    item = next(r.text for r in table(spark, tiny, "benchmark").collect() if len((r.text or "").split()) > 12)
    docs = spark.createDataFrame([(1, f"Before it {item} and after"), (2, "nothing of the kind")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1 AS n_chars")
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, tiny).collect()] == [2]
