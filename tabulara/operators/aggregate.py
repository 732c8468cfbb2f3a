"""Exact aggregates of judged rows, from village to nation, and their audits. Absent stays a missing row, never 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulara.operators.hierarchy import CODES
from tabulara.operators.validate import LIMIT, q
from tabulara.schemas import COUNTS, PARTIES

STATS = [*COUNTS, "tps", "validated-tps", "blank-tps", "outlier-vote-tps"]


def included(judged: DataFrame) -> DataFrame:
    return judged.where("reject_reason IS NULL")


def measured(judged: DataFrame, options: Sequence[str] = PARTIES) -> DataFrame:
    """Included rows as summands: the options as they are, the five counts where they are valid and else 0, and the four counters."""
    ok = F.col("stats_valid")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    counters = [F.lit(1).cast("bigint"), flag(ok), flag(F.col("blank_result")), flag(F.col("vote_outlier"))]
    stats = [F.when(ok, q(c)).otherwise(0) for c in COUNTS]
    return included(judged).select("contest", *CODES, *(q(c) for c in options), *(c.alias(n) for c, n in zip([*stats, *counters], STATS, strict=True)))


def sums(columns: Sequence[str]) -> list[Column]:
    return [F.sum(q(c)).cast("bigint").alias(c) for c in columns]


def village_totals(judged: DataFrame, options: Sequence[str] = PARTIES) -> DataFrame:
    """One row per village and contest that has rows."""
    return measured(judged, options).groupBy(*CODES, "contest").agg(*sums([*options, *STATS]))


def district_totals(villages: DataFrame, options: Sequence[str] = PARTIES) -> DataFrame:
    return villages.groupBy(*CODES[:3], "contest").agg(*sums([*options, *STATS]))


def national_rollup(districts: DataFrame, all_districts: DataFrame, contests: Sequence[str], options: Sequence[str] = PARTIES) -> DataFrame:
    """Districts rolled up to regencies, provinces and the nation in one pass. covered counts districts with rows, total_units those of the dimension; sums of a node without any are null."""
    kinds = F.explode(F.array(*map(F.lit, contests))).alias("contest")
    every = all_districts.select(*CODES[:3]).distinct().select("*", kinds)
    met = every.join(districts.withColumn("present", F.lit(1)), [*CODES[:3], "contest"], "left")
    keys = [F.struct(F.lit(level).alias("level"), F.concat(F.lit("P"), F.concat_ws(".", *(F.col(c) for c in CODES[:level]))).alias("key")) for level in range(4)]
    grown = met.select("*", F.explode(F.array(*keys)).alias("node"))
    columns = [*options, *STATS]
    return grown.groupBy("node.level", "node.key", "contest").agg(*sums(columns), F.count("present").alias("covered"), F.count("*").alias("total_units"))


def source_totals(judged: DataFrame, options: Sequence[str] = PARTIES) -> DataFrame:
    """Per contest the raw sums of included rows and the validated ones (v_…)."""
    raw = included(judged).groupBy("contest").agg(*sums([*options, *COUNTS]))
    valid = measured(judged, options).groupBy("contest").agg(*(F.sum(q(c)).cast("bigint").alias("v_" + c) for c in STATS))
    return raw.join(valid, "contest")


def reconciliation(judged: DataFrame, options: Sequence[str] = PARTIES) -> DataFrame:
    """Per contest and column: total over rows, over villages and over districts, which must be equal."""
    columns = [*options, *STATS]
    long = lambda df, name: df.unpivot("contest", [q(c) for c in columns], "column_name", name)
    villages = village_totals(judged, options)
    rows = long(measured(judged, options).groupBy("contest").agg(*sums(columns)), "over_rows")
    leaves = long(villages.groupBy("contest").agg(*sums(columns)), "over_villages")
    upper = long(district_totals(villages, options).groupBy("contest").agg(*sums(columns)), "over_districts")
    return rows.join(leaves, ["contest", "column_name"], "full").join(upper, ["contest", "column_name"], "full")


def anomaly_counters(judged: DataFrame) -> DataFrame:
    """(contest, anomaly, n): reject reasons, flags of rows that got so far, and counts that disagree among included rows."""
    inc = F.col("reject_reason").isNull()
    reached = ~F.col("reject_reason").isin("invalid_record", "unmatched_district", "unresolved_leaf_id", "id_district_mismatch") | inc
    pemilih, pengguna, total, sah, tidak_sah = (q(c) for c in COUNTS)
    options = sum((q(c) for c in PARTIES), F.lit(0))
    tests = {
        **{r: F.col("reject_reason") == r for r in ("invalid_record", "unmatched_district", "unresolved_leaf_id", "id_district_mismatch", "duplicate_id")},
        "ambiguous_leaf_id": F.col("was_ambiguous") & ~F.coalesce(F.col("reject_reason").isin("invalid_record", "unmatched_district"), F.lit(False)),
        "blank_result_row": F.col("blank_result") & reached,
        "conflicting_duplicate_id": F.col("is_conflict"),
        "outlier_vote_row": inc & F.col("vote_outlier"),
        "invalid_stats_row": inc & ~F.col("stats_valid"),
        "option_sum_ne_suara_sah": inc & (options != sah),
        "suara_total_ne_sah_plus_tidak_sah": inc & (total != sah + tidak_sah),
        "pengguna_ne_suara_total": inc & (pengguna != total),
    }
    counted = {n: F.count_if(F.coalesce(t, F.lit(False))) for n, t in tests.items()} | {"malformed_numeric": F.sum(F.when(reached, F.col("n_malformed")).otherwise(0)).cast("bigint")}
    wide = judged.groupBy("contest").agg(*(c.alias(n) for n, c in counted.items()))
    return wide.unpivot("contest", list(counted), "anomaly", "n")


def column_extremes(judged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(contest, column_name, n_over, n_negative, max_value, file_path, row_no) over all rows with a village: counts beyond LIMIT and below 0, the maximum and the first row that has it."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), q(c).alias("value")) for c in columns))
    reached = judged.where(~F.col("reject_reason").isin("invalid_record", "unmatched_district", "unresolved_leaf_id", "id_district_mismatch") | F.col("reject_reason").isNull())
    long = reached.select("contest", "file_path", "row_no", F.explode(cells).alias("c")).select("contest", "c.*", (-F.col("c.value")).alias("down"), "file_path", "row_no")
    best = long.groupBy("contest", "column_name").agg(
        F.count_if(F.col("value") > LIMIT).alias("n_over"), F.count_if(F.col("value") < 0).alias("n_negative"), F.min(F.struct("down", "file_path", "row_no")).alias("m")
    )
    return best.select("contest", "column_name", "n_over", "n_negative", (-F.col("m.down")).alias("max_value"), "m.file_path", "m.row_no")


def capped_examples(judged: DataFrame, per_contest: int = 30, of_reason: dict[str, int] | None = None) -> DataFrame:
    """The first examples of rejected and blank rows per contest, by (file_path, row_no): at most of_reason[reason] of a reason, then per_contest in all. The cap is the report's."""
    of_reason = {"blank_result_row": 3} if of_reason is None else of_reason
    reason = F.coalesce("reject_reason", F.when(F.col("blank_result"), "blank_result_row"))
    rows = judged.select("contest", "file_path", "row_no", reason.alias("reason")).where("reason IS NOT NULL")
    order = ["file_path", "row_no"]
    # a ranking filter lets every task keep only its first rows before the shuffle
    for r, n in of_reason.items():
        some = rows.where(F.col("reason") == r).withColumn("rn", F.row_number().over(Window.partitionBy("contest").orderBy(*order))).where(F.col("rn") <= n).drop("rn")
        rows = rows.where(F.col("reason") != r).unionByName(some)
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("contest").orderBy(*order))).where(F.col("rn") <= per_contest)


def coverage(judged: DataFrame) -> DataFrame:
    """Per contest how many provinces, regencies, districts and villages the included rows have."""
    keys = [F.concat_ws(".", *(F.col(c) for c in CODES[: i + 1])) for i in range(4)]
    return included(judged).groupBy("contest").agg(*(F.count_distinct(k).alias("n_" + n) for k, n in zip(keys, ("provinces", "regencies", "districts", "villages"), strict=True)))


def coverage_gap(all_nodes: DataFrame, judged: DataFrame) -> DataFrame:
    """Villages of the hierarchy without an included row in any contest."""
    seen = included(judged).select(F.concat(F.lit("P"), F.concat_ws(".", *CODES)).alias("key"))
    return all_nodes.where("level = 4").join(seen, "key", "left_anti").select("key", "name", "parent_key")


def file_counts(judged: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per file of the inventory (file_path): rows read, included and rejected; files without rows are kept."""
    rows = judged.groupBy("file_path").agg(F.count("*").alias("n_read"), F.count_if(F.col("reject_reason").isNull()).alias("n_included"))
    out = inventory.select("file_path").distinct().join(rows, "file_path", "left")
    n, i = F.coalesce("n_read", F.lit(0)), F.coalesce("n_included", F.lit(0))
    return out.select("file_path", n.alias("n_read"), i.alias("n_included"), (n - i).alias("n_rejected"))


def contest_totals(judged: DataFrame) -> DataFrame:
    """Files, rows, included and rejected rows per contest and over all (contest null)."""
    return judged.rollup("contest").agg(
        F.count_distinct("file_path").alias("n_files"), F.count("*").alias("n_rows"), F.count_if(F.col("reject_reason").isNull()).alias("n_included"), F.count_if(F.col("reject_reason").isNotNull()).alias("n_rejected")
    )
