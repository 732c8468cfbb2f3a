"""A second source that lends columns: an index without conflicting keys, and a left join that marks what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["village_code", "tps_no"]


def donor_index(rows: DataFrame) -> DataFrame:
    """rows: village_code, tps_no, registered, users. One row per key whose rows all agree; a key with differing rows is dropped, as no row of it can be trusted."""
    pair = F.struct("registered", "users")
    return rows.groupBy(*KEY).agg(F.min(pair).alias("lo"), F.max(pair).alias("hi")).where("lo = hi").select(*KEY, "lo.registered", "lo.users")


def donor_conflicts(rows: DataFrame, *order: str) -> DataFrame:
    """Counts of repeats in order: `duplicate` while all rows of the key so far agree, `conflicting` from the first that differs. Running minimum and maximum of the values tell both apart."""
    upto = Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    pair = F.struct("registered", "users")
    seen = rows.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).withColumn("same", F.min(pair).over(upto) == F.max(pair).over(upto)).where("n > 1")
    return seen.agg(F.count_if("same").alias("duplicate"), F.count_if(~F.col("same")).alias("conflicting_duplicate"))


def lend(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows with registered, users (0 where nothing was found) and has_donor. Several rows of a key each find the same donor."""
    met = rows.join(index.withColumn("has_donor", F.lit(True)), KEY, "left")
    return met.withColumns({"has_donor": F.coalesce("has_donor", F.lit(False)), "registered": F.coalesce("registered", F.lit(0)), "users": F.coalesce("users", F.lit(0))})


def matched_by(lent: DataFrame, *group: str) -> DataFrame:
    return lent.groupBy(*group).agg(F.count_if("has_donor").alias("matched"), F.count_if(~F.col("has_donor")).alias("unmatched"))
