from pyspark.sql import functions as F

from tabulara.operators import rowparse
from tabulara.plans.dealt import CONTEST_ROWS, table
from tabulara.streaming import deliveries as S


def test_stream_equals_batch(spark, sf, tmp_path, rows):
    raw = table(spark, sf, "rekaman_mentah").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    raw.limit(20).write.mode("append").parquet(str(tmp_path / "in"))  # delivered twice
    parsed = S.parsed_once(S.read_deliveries(spark, str(tmp_path / "in"), 2), CONTEST_ROWS, "400 days")
    S.run_available(rowparse.failures(parsed, "raw_no"), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = rowparse.failures(rowparse.parse_rows(raw, "raw_line", CONTEST_ROWS), "raw_no")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)


def test_windows_close(spark, sf, tmp_path):
    raw = table(spark, sf, "rekaman_mentah").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    raw.write.parquet(str(tmp_path / "in"))
    late = raw.limit(1).withColumn("raw_no", F.lit(-1).cast("bigint")).withColumn("loaded_at", F.expr("timestamp'2030-01-01'"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    counted = S.failures_by_window(S.parsed_once(S.read_deliveries(spark, str(tmp_path / "in"), 10), CONTEST_ROWS, "1 day"))
    S.run_available(counted, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = rowparse.parse_rows(raw, "raw_line", CONTEST_ROWS).where("parsed.status = 'failed'").count()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == batch
