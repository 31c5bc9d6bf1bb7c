"""The pipeline against a plain version of its stages."""

import corpus_pipeline
import __spark_entry__
from lodeframe.llm import quality
from lodeframe.session import table
from tests.llm.test_near_complete import plain_groups
from tests.llm.test_text_ops import plain_hits


def test_stages_follow_each_other(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]

    one = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    kept = {d for d, x in rows.items() if not any(eval(r.fails, {}, dict(zip(quality.MEASURES, quality.measure(x)))) for r in quality.RULES)}
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == kept and len(kept) < len(rows)

    two = corpus_pipeline.toxicity_filter(spark, one, sf_dir).cache()
    ids = {r["doc_id"] for r in two.collect()}
    assert two.columns == docs.columns and ids <= kept and len(ids) > 0.8 * len(kept)

    three = corpus_pipeline.near_dedup(spark, two, sf_dir).cache()
    groups = plain_groups([(d, rows[d]) for d in ids])
    got = {r["doc_id"] for r in three.collect()}
    assert three.columns == docs.columns and got == set(groups.values())

    four = corpus_pipeline.decontamination(spark, three, sf_dir)
    clean = {d for d in got if not plain_hits(rows[d], items)[1]}
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} == clean

    last = corpus_pipeline.encoding(spark, four, sf_dir).collect()
    assert {r["doc_id"] for r in last} == clean and all(r["lossless"] for r in last)


def test_run(spark, sf_dir):
    rows = __spark_entry__.queries()["pipeline"](spark, sf_dir).collect()
    assert rows and all(r["lossless"] for r in rows)


def test_stages_without_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
