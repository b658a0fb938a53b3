"""The pipeline against its stages applied by plain code."""

import corpus_pipeline
import __spark_entry__
from geoaudit.llm import bpe
from tests.llm.test_near import brute

SF = "/root/testdata/sf0.001"


def test_registered():
    assert "pipeline" in __spark_entry__.queries()
    assert sorted(int(k[2:].split("_")[0]) for k in __spark_entry__.queries() if k.startswith("op")) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())


def odd_documents(spark):
    """Null ids, null and empty texts, repeated rows, a very long text, and columns that clash with working names."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()
    rows = [tuple(r) for r in base] + [tuple(base[0])]
    rows += [(None, base[1].text, "en", "s", 5), (90001, None, "en", None, None), (90002, "", None, "s", 0), (90003, " ".join(r.text for r in base if r.text) * 12, "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema).selectExpr("*", "1 AS token", "2 AS score", "'x' AS `a.b`", "3 AS row", "4 AS place", "5 AS region", "6 AS component")


def test_stages_on_odd_documents(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == corpus_pipeline.COLUMNS, name
        rows = kept.collect()
        ids = [r.doc_id for r in rows]
        if name == "language_id":
            assert 90001 not in ids and 90002 not in ids and 90003 in ids
        elif name == "ngram_jaccard":
            assert ids.count(None) == 2 and 90001 in ids and 90002 in ids  # empty texts are no copies, null ids stay
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and {r.n_tokens for r in last if r.doc_id in (90001, 90002)} == {0}


def test_decontamination_stage_is_brute_force(spark):
    from tests.llm.test_corpus import plain_overlap

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    some = docs.orderBy("doc_id").collect()
    kept = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, SF).collect()}
    words = {i: set(t.lower().split()) for i, t in items}
    near = lambda t: [(i, u) for i, u in items if len(words[i] & set(t.lower().split())) >= 3]  # noqa: E731 - fewer common words cannot overlap
    want = {r.doc_id for r in some if not any(plain_overlap(r.text, u) for _, u in near(r.text or ""))}
    assert kept == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        ids = {r.doc_id for r in kept.collect()}
        if name == "ngram_jaccard":
            assert ids == {i for i, c in brute(rows).items() if i == c}
        assert len(ids) > 0.8 * len(rows)
        docs = spark.createDataFrame(kept.toPandas(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(last) == sorted(whole)
    v = bpe.Vocabulary(bpe.public_spec())
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(v.encode(text[r.doc_id])) for r in whole[:50])
