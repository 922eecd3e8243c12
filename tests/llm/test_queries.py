"""Queries against their SQL, and the pipeline's stages."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = con.sql(queries.SQL[name])
    at = [sql.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=repr)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5), (10**6 + 2, "write to me@x.org please", "en", "s", 24)], docs.schema)
    docs = docs.unionByName(extra).withColumn("score", F.lit("clash"))
    first = p.language_id(spark, docs, SF)
    assert first.columns == docs.columns and not first.where("doc_id in (1000000, 1000001)").count()
    twice = first.unionByName(first.where("doc_id = 1000002"))
    second = p.near_dedup(spark, twice, SF)
    assert second.columns == docs.columns and second.groupBy("doc_id").count().where("count > 1").isEmpty()
    third = p.personal_data(spark, second, SF)
    row = third.where("doc_id = 1000002").first()
    assert row.text == "write to [EMAIL] please" and row.n_chars == len(row.text) and third.count() == second.count()
    fourth = p.mix_sources(spark, third, SF)
    assert fourth.columns == docs.columns and fourth.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    last = p.packing(spark, fourth, SF)
    assert last.where("start = 0").count() == fourth.count() and last.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 4096


def test_pipeline_run(spark):
    import corpus_pipeline as p

    assert len(p.STAGES) == 5 and p.run(spark, SF).count() > 0


def test_near_dedup_of_null_and_repeated_ids(spark):
    import corpus_pipeline as p

    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near = text("a") + " more"
    rows = [(1, text("a")), (None, near), (None, text("b")), (None, text("c")), (None, text("c")), (2, near), (2, text("d")), (3, text("e")), (3, text("f")), (4, text("g")), (4, text("g") + " more"), (4, text("g")), (5, text("h")), (5, text("h")), (6, ""), (6, None), (None, "")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, source string, kept long")
    out = p.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    (g,) = (t for i, t in left if i == 4)
    assert g in (text("g"), text("g") + " more")
    wanted = [(1, text("a")), (None, text("b")), (None, text("c")), (2, text("d")), (3, text("e")), (3, text("f")), (4, g), (5, text("h")), (6, ""), (6, None), (None, "")]
    assert sorted(left, key=repr) == sorted(wanted, key=repr)
    unique = docs.where("doc_id in (1, 6) or text like 'b%'")
    assert sorted(p.near_dedup(spark, unique, SF).collect(), key=repr) == sorted(unique.collect(), key=repr)


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0, name
    assert p.packing(spark, docs, SF).count() == 0
