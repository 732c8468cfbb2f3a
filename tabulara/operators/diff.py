"""Differences between two copies of a dataset, by a merge of range-partitioned, sorted copies.

Each copy is reduced to one row per key first (its lowest row number; partial aggregation takes the copies of a hot key together before the shuffle). Both reduced copies go through one
range partitioning by the key, so the split points are shared, are sorted by (key, side) within their partitions, and one pass looks at each row and the next: the same key on both sides
meets there, a key that stands alone is missing on the other side. The window that does so needs no further exchange, as a range partitioning keeps equal keys together.

Nulls and edge cases: rows with a null or blank key name nothing and are left out; keys are compared without surrounding white space; missing equals only missing, unreadable texts are
compared by their trimmed text and never equal a number; of rows repeated inside a copy the first delivered (lowest row_no, null last) stands for the copy; an empty copy makes every key of
the other missing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulara.functions.numbers import number_key
from tabulara.functions.text import blank, trimmed
from tabulara.session import cut, shuffle_parts


def _reduced(df: DataFrame, key: str, order: str, fields: Sequence[str], side: int) -> DataFrame:
    """One row (id, side, fields as struct v) per key."""
    read = df.where(~blank(F.col(f"`{key}`"))).select(
        trimmed(F.col(f"`{key}`")).alias("id"),
        F.coalesce(F.col(f"`{order}`"), F.lit((1 << 63) - 1)).alias("o"),
        *(F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)),
    )
    first = read.groupBy("id").agg(F.min(F.struct("o", *(f"f{i}" for i in range(len(fields))))).alias("r"))
    return first.select("id", F.lit(side).alias("side"), F.struct(*(number_key(F.col(f"r.f{i}")).alias(f"f{i}") for i in range(len(fields)))).alias("v"))


def copy_differences(left: DataFrame, right: DataFrame, names: tuple[str, str], key: str, order: str, fields: Sequence[str]) -> DataFrame:
    """(id, field, kind): kind is missing_in_<name> with field *, or differs with the field."""
    both = cut(_reduced(left, key, order, fields, 0).unionByName(_reduced(right, key, order, fields, 1)))  # the split points are sampled from it before it is shuffled
    ranged = both.repartitionByRange(shuffle_parts(left.sparkSession), "id").sortWithinPartitions("id", "side")
    w = Window.partitionBy("id").orderBy("side")
    merged = ranged.withColumn("next", F.lead(F.struct("v")).over(w)).withColumn("before", F.lag("side").over(w))
    alone = F.col("next").isNull() & F.col("before").isNull()
    findings = F.when(
        alone, F.array(F.struct(F.lit("*").alias("field"), F.when(F.col("side") == 0, f"missing_in_{names[1]}").otherwise(f"missing_in_{names[0]}").alias("kind")))
    ).when(
        F.col("next").isNotNull(),
        F.array_compact(
            F.array(*(F.when(~F.col(f"v.f{i}").eqNullSafe(F.col(f"next.v.f{i}")), F.struct(F.lit(f).alias("field"), F.lit("differs").alias("kind"))) for i, f in enumerate(fields)))
        ),
    )
    return merged.select("id", F.explode(findings).alias("x")).select("id", "x.field", "x.kind")
