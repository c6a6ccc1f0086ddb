"""The pipeline over a small table: each stage against its operator, and what the stages bear."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
import __spark_entry__ as entry
from reviewlens.llm import minmax, spaced_seeds, subwords
from reviewlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
NATIVE = ("op2", "op5", "op8")


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    def kept(name, docs):
        out = steps[name](spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    clean = kept("toxicity", docs)
    assert ids(clean) == ids(subwords.toxicity(docs, labels).filter("score < 0.5"))
    single = kept("near_duplicates", clean)
    assert ids(single) == ids(minmax.near_duplicates(clean).filter("kept"))
    apart = kept("decontamination", single)
    assert set(ids(single)) - set(ids(apart)) == set(ids(spaced_seeds.contamination(single, bench)))
    mixed = kept("mixing", apart)
    assert ids(mixed) == ids(apart)
    final = steps["token_ids"](spark, mixed, SF).orderBy("start").collect()
    laid = mixed.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    assert [r.doc_id for r in final] == [r.doc_id for r in laid]
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, final))


def test_stages_bear_odd_rows(spark):
    rows = [(1, "same words again and again here", "en", "s", 3)] * 2 + [(2, None, None, None, None), (None, "x", "en", "s", 1), (3, "", "en", "t", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        assert len(out) == (4 if name == "near_duplicates" else 5)
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_columns_that_clash_with_working_names(spark):
    """Every stage returns the columns as they came, whatever they are called."""
    names = ("row_key", "own_key", "own_id", "own_hash", "n_blocks", "slots", "block_", "slot_", "hash_", "key", "first", "rows", "text_hash")
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1), (3, "q r s t u v w", "en", "t", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for name, stage in pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        assert stage(spark, docs, SF).columns == docs.columns
        assert len(rows) == (2 if name == "near_duplicates" else 3) and all(tuple(r)[5:] == tuple(range(len(names))) for r in rows)


def test_texts_that_share_an_id(spark):
    """Equal rows become one, near copies too; other texts with the id stay."""
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long), (5, long), (5, long + " more"), (5, "something else altogether in here"), (9, long), (5, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.one_of_each(spark, docs.repartition(3), SF).collect()
    assert sorted((r.doc_id, r.text or "") for r in got)[:2] == [(5, ""), (5, "something else altogether in here")] and len(got) == 4
    assert sum((r.text or "").startswith("w0") for r in got) == 1


def test_near_copies_of_named_documents(spark):
    """Ids need not be numbers."""
    long = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([("b", long), ("a", long + " x"), ("c", "apart from the others"), (None, long)], "doc_id string, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in minmax.near_duplicates(docs).collect()}
    assert got == {"a": ("a", True), "b": ("a", False), "c": ("c", True), None: ("a", False)}


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_native_operators_run_no_python(spark):
    for name, run in QUERIES.items():
        if name.startswith(NATIVE):
            assert not re.search("Python|Pandas|Arrow", run(spark, SF)._jdf.queryExecution().executedPlan().toString())


def test_rows_that_occur_again_do_not_move_the_documents_twice(spark):
    """The few rows that are equal in id and text are broadcast to the documents; one of them stays."""
    import corpus_pipeline
    rows = [(i, f"text number {i} of this corpus has words {i * 7} and {i * 13}", "s", "en") for i in range(30)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string, lang string")
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan
    assert sorted(map(tuple, kept.collect())) == rows
