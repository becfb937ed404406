import os

import duckdb
import pytest

import corpus_pipeline
from ledgerflow.llm import queries
from ledgerflow.llm.store import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "ngram_join", "substring_dedup", "packing"]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4]
    left = {r.doc_id for r in docs.collect()}
    assert not [i for i in left if quality.get(i) == 0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in packed} == left


def test_run_equals_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"sequence_id", "offset", "length"} <= set(out.columns)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, sf_dir).collect()]
    assert sorted(got) == sorted(cursor.fetchall())


def test_near_duplicates_of_repeated_and_null_ids(spark):
    words = lambda a: " ".join(f"w{a}x{k}" for k in range(60))
    near = lambda a: words(a) + " end"
    rows = [(1, words(1)), (1, words(2)), (1, words(2)), (2, near(1)), (None, words(3)), (None, near(3)), (None, near(2)), (None, words(4)), (3, words(4)), (4, ""), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs, "").collect()
    ids = sorted(((r.doc_id, r.text) for r in got if r.doc_id is not None), key=repr)
    assert ids == sorted([(1, words(1)), (1, words(2)), (3, words(4)), (4, ""), (5, None)], key=repr)
    assert [r.text for r in got if r.doc_id is None] in ([words(3)], [near(3)])
    assert dict(corpus_pipeline.STAGES)["ngram_join"](spark, docs.where("doc_id = 99"), "").count() == 0


def test_quality_stage_drops_failing_lines(spark):
    body = "\n".join(" ".join(f"word{k}a{i}" for i in range(12)) + "." for k in range(8))
    docs = spark.createDataFrame([(1, "Home | News | About | Login\n" + body, 0), (2, body, 0), (3, "too short.", 0), (4, None, 0)], "doc_id long, text string, n_chars int")
    got = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, "")
    assert got.dtypes == docs.dtypes
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect()) == [(1, body, len(body)), (2, body, len(body))]
