"""The stages together, and the registered queries."""

import corpus_pipeline
from seqlake.llm import registry
from seqlake.llm.common import Scratch, documents


def test_names_and_columns(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs, scratch, before = documents(spark, sf_dir), Scratch(spark, "test"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and docs.count() == len(ids)
        assert before is None or ids <= before
        before = ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before


def test_empty_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def rows(spark, given):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "u") for i, t in given], "doc_id long, text string, lang string, source string, n_chars long, uid string")


def test_rows_that_share_an_id(spark, sf_dir):
    """Rows are told apart by id and text: none is lost for another's sake."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    docs = rows(spark, [(1, a), (1, b), (3, c), (3, d), (2, c), (None, a + " z"), (None, d + " y z"), (4, None), (5, ""), (4, None)])
    got = corpus_pipeline.near_deduplication(spark, docs, sf_dir).collect()
    texts = sorted(r.text[0] for r in got if r.text)
    assert texts == ["a", "b", "c", "d"] and sorted(r.doc_id for r in got if not r.text) == [4, 5]
    assert all(r.uid == "u" for r in got)
    assert corpus_pipeline.benchmark_decontamination(spark, docs, sf_dir).count() == 10
    unknown = docs.withColumn("doc_id", docs.doc_id + 10**9)  # ids without labels
    assert corpus_pipeline.quality_classifier(spark, unknown, sf_dir).count() == 10


def test_one_copy_of_a_passage_stays(spark, sf_dir):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = rows(spark, [(2, "begin two " + passage + " end two"), (1, "begin one " + passage + " end one"), (3, "nothing"), (4, None)])
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.suffix_deduplication(spark, docs, sf_dir).collect()}
    assert got[1][0] == "begin one " + passage + " end one" and got[3][0] == "nothing" and got[4][0] is None
    assert passage not in got[2][0] and got[2][0].startswith("begin two") and got[2][0].endswith("two") and got[2][1] == len(got[2][0])


def test_stages_follow_their_operators(spark, sf_dir):
    """The stages in turn against what each operator says of the stage's own input."""
    from seqlake.llm import decontamination, near_dedup, quality

    docs = documents(spark, sf_dir)
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    kept = Scratch(spark, "t").keep(corpus_pipeline.quality_classifier(spark, docs, sf_dir), "one")
    assert ids(kept) == ids(quality.op7_kneser_ney_quality(spark, sf_dir).filter("kept"))
    once = Scratch(spark, "t").keep(corpus_pipeline.near_deduplication(spark, kept, sf_dir), "two")
    assert ids(once) == ids(near_dedup.near_duplicates(kept).filter("kept"))
    clean = corpus_pipeline.benchmark_decontamination(spark, once, sf_dir)
    found = decontamination.contaminated(once, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert ids(clean) == ids(once) - ids(found)


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert registry.oracle_sql() == {}
