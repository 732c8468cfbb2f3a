import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from tabulara.llm import queries as Q

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    compare(spark, connect(MIDDLE), MIDDLE, Q.queries()[name], Q.oracle_sql()[name])


def test_ids_of_every_row(spark, sf):
    got = Q.p6_ids(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and got.where("ids IS NULL OR exists(ids, i -> i IS NULL OR i < 0 OR i > 50255)").count() == 0


def test_search_fills_the_containers(spark):
    for r in Q.p7_fill(spark, MIDDLE).collect():
        assert r.n_containers <= 1.02 * r.at_least + 1 and r.n_containers <= r.n_at_start and r.n_containers * r.max_tokens * r.fill == pytest.approx(r.n_tokens)
    assert Q.p7_containers(spark, MIDDLE).groupBy("capacity_id").agg(F.count_distinct("doc_id").alias("n")).select("n").distinct().count() == 1


def test_composition_and_topics(spark):
    rows = Q.p8_composition(spark, MIDDLE).collect()
    assert len(rows) == 8 and all(r.n_documents > 20 and 0.25 * r.n_documents <= r.sum_share <= r.n_documents for r in rows)
    top = Q.p8_topics(spark, MIDDLE)
    assert top.groupBy("topic").agg(F.max("rank").alias("m")).where("m <> 20").count() == 0
