"""Column-level quality profile per load, and changes between a load and the one before.

The columns are unpivoted to (column, load, value) and counted before the first shuffle (map-side partial aggregation), so hot values and big loads shrink to one row per value. The value counts are
sorted by a range partitioning over (column, load, value); the sums of each partition and the running totals of the partitions before it turn counts within a partition into exact ranks over all rows,
without any group being gathered in one task: from these come exact quantiles and distinct counts. For the change between loads the counts of a load and its predecessor are merged by value and
run through the same prefix sums: the largest gap between both cumulative curves is the exact Kolmogorov-Smirnov distance.

Nulls and edge cases: null and blank values are missing; unreadable ones are counted but have no value; numbers beyond BIGINT count as its ends; a load without readable numbers has null range,
quantiles and distance, and 0 distinct values; rows with a null load are left out; a load without rows has no profile row; a load whose predecessor is null or has no rows has no findings, and shares
of nothing (no non-missing or no readable values on either side) are not compared; repeated rows count each; ties share one value; empty tables give empty results.

Columns of texts (`text_counts`) go the same way: every non-missing text, trimmed, is a value, in the order of code points; one that its column's pattern refuses counts as unreadable too, but keeps its value.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulara.functions.numbers import number_key, number_value, unreadable
from tabulara.functions.text import trimmed
from tabulara.session import cut, ship_code, shuffle_parts

#: Changes beyond these are findings; as whole thousandths, to be compared exactly.
NULL_RATE, PATTERN, VALUE_RANGE, DISTRIBUTION = 50, 20, 20, 250


def value_counts(df: DataFrame, columns: Sequence[str], load: str = "load_id") -> DataFrame:
    """(column_name, load_id, kind, value, n): kind is missing, unreadable or number; unreadable values aren't told apart."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("text")) for c in columns))
    long = df.where(F.col(f"`{load}`").isNotNull()).select(F.col(f"`{load}`").alias("load_id"), F.explode(cells).alias("c"))
    read = long.select("c.column_name", "load_id", number_key(F.col("c.text")).alias("k"))
    kind = F.when(F.col("k").isNull(), "missing").when(unreadable(F.col("k")), "unreadable").otherwise("number")
    return read.select("column_name", "load_id", kind.alias("kind"), number_value(F.col("k")).alias("value")).groupBy("column_name", "load_id", "kind", "value").agg(F.count("*").alias("n"))


def text_counts(df: DataFrame, patterns: Mapping[str, str], load: str = "load_id") -> DataFrame:
    """As value_counts, for columns of texts with the pattern of each: kind is missing, text or unreadable (refused by the pattern), value the trimmed text."""
    texts = {c: trimmed(F.col(f"`{c}`")) for c in patterns}
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), t.alias("text"), t.rlike(f"\\A(?:{patterns[c]})\\z").alias("fits")) for c, t in texts.items()))
    long = df.where(F.col(f"`{load}`").isNotNull()).select(F.col(f"`{load}`").alias("load_id"), F.explode(cells).alias("c")).select("c.column_name", "load_id", F.when(F.col("c.text") != "", F.col("c.text")).alias("value"), "c.fits")
    kind = F.when(F.col("value").isNull(), "missing").when(F.col("fits"), "text").otherwise("unreadable")
    return long.select("column_name", "load_id", kind.alias("kind"), "value").groupBy("column_name", "load_id", "kind", "value").agg(F.count("*").alias("n"))


def named_as_text(df: DataFrame) -> DataFrame:
    """A profile or changes of text_counts, with names that don't clash with those of numbers: n_texts, min_text, max_text, q<percent>_text."""
    names = {c: c.replace("n_numbers", "n_texts").replace("_value", "_text") for c in df.columns if c.endswith(("n_numbers", "_value"))}
    return df.withColumnsRenamed(names | {c: c + "_text" for c in df.columns if c[0] == "q" and c[1:].isdigit()})


def _running(batches: Iterator[pa.RecordBatch], group: list[str], value: str, sums: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches with in_<s>, the sum of s over the rows of the group so far, and `last`, true for the last row of each value. The last row of a batch waits for the next one."""
    key, total, waiting = None, np.zeros(len(sums), np.int64), None

    def done(rows: pa.RecordBatch, n: int) -> pa.RecordBatch:
        nonlocal key, total
        equal = lambda c: pc.equal(rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        same = np.logical_and.reduce([equal(c) for c in group])
        last = np.append(~(same & equal(value)), True)[:n]
        begins = np.concatenate([[key != [rows.column(c)[0] for c in group]], ~same])[:n]
        start = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
        out = []
        for i, name in enumerate(sums):
            each = rows.column(name).to_numpy(zero_copy_only=False)[:n].astype(np.int64)
            so_far = np.cumsum(each)
            out.append(so_far - np.where(start >= 0, (so_far - each)[start], -total[i]))
            total[i] = out[-1][-1]
        key = [rows.column(c)[n - 1] for c in group]
        names = [*rows.schema.names, *(f"in_{s}" for s in sums), "last"]
        return pa.RecordBatch.from_arrays([*rows.slice(0, n).columns, *map(pa.array, out), pa.array(last)], names=names)

    for batch in batches:
        if batch.num_rows:
            rows = batch if waiting is None else pa.concat_batches([waiting, batch])
            if rows.num_rows > 1:
                yield done(rows, rows.num_rows - 1)
            waiting = rows.slice(rows.num_rows - 1)
    if waiting is not None:
        yield done(waiting, 1)


def prefix_sums(counts: DataFrame, group: list[str], value: str, sums: list[str]) -> DataFrame:
    """counts with cum_<s>: the sum of s over all rows of its group up to its value, and `last`, true for the last row of each value (before that, rows of the same value may follow). group and value are not null.

    One exchange, by range: equal values meet in one sorted partition, and no task holds more than one partition.
    """
    ship_code(counts.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema) + "".join(f", in_{s} bigint" for s in sums) + ", last boolean"
    ranged = counts.repartitionByRange(shuffle_parts(counts.sparkSession), *group, value).sortWithinPartitions(*group, value)
    ranged = cut(ranged.mapInArrow(lambda batches: _running(batches, group, value, sums), schema).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy(*group, "part").agg(*(F.sum(s).alias(f"sum_{s}") for s in sums))  # at most partitions + groups rows
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*group, "part", *(F.coalesce(F.sum(f"sum_{s}").over(earlier), F.lit(0)).alias(f"off_{s}") for s in sums))
    return ranged.join(offsets, [*group, "part"]).select(*counts.columns, *((F.col(f"in_{s}") + F.col(f"off_{s}")).alias(f"cum_{s}") for s in sums), "last")


def load_stats(counts: DataFrame) -> DataFrame:
    """Per column and load: n_rows, n_missing, n_unreadable, n_numbers (rows with a value), n_distinct, min_value, max_value."""
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return counts.groupBy("column_name", "load_id").agg(
        F.sum("n").alias("n_rows"),
        n("missing").alias("n_missing"),
        n("unreadable").alias("n_unreadable"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_numbers"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def profile(counts: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """load_stats with shares, and exact quantiles q<percent>: the smallest value whose cumulative share is at least the quantile."""
    counts = cut(counts)
    stats = load_stats(counts)
    ranked = prefix_sums(counts.where("value is not null").select("column_name", "load_id", "value", "n"), ["column_name", "load_id"], "value", ["n"])
    wanted = ranked.join(stats.select("column_name", "load_id", "n_numbers"), ["column_name", "load_id"])
    at = [F.min(F.when(F.col("cum_n") >= F.ceil(F.lit(q) * F.col("n_numbers")), F.col("value"))).alias(f"q{round(q * 100)}") for q in quantiles]
    rate = lambda a, b: F.try_divide(F.col(a), b).alias(a.replace("n_", "") + "_rate")
    shares = stats.select("*", rate("n_missing", F.col("n_rows")), rate("n_unreadable", F.col("n_rows") - F.col("n_missing")))
    return shares.join(wanted.groupBy("column_name", "load_id").agg(*at), ["column_name", "load_id"], "left")


def _gap(a: Column, na: Column, b: Column, nb: Column, most: int) -> Column:
    """|a/na - b/nb| > most/1000 in whole numbers; null if a total is 0."""
    wide = lambda c: c.cast("decimal(19,0)")
    far = F.abs(wide(a) * wide(nb) - wide(b) * wide(na)) * F.lit(1000) > wide(na) * wide(nb) * F.lit(most)
    return F.when((na > 0) & (nb > 0), far)


def load_changes(counts: DataFrame, loads: DataFrame) -> DataFrame:
    """(column_name, load_id, prev_load_id, the stats of both as n_… and p_…, n_outside, ks, and the findings as an array). loads: load_id, prev_load_id."""
    counts = cut(counts)
    key = ["column_name", "load_id"]
    stats = load_stats(counts)
    before = stats.select("column_name", F.col("load_id").alias("prev_load_id"), *(F.col(c).alias("p_" + c) for c in stats.columns[2:]))
    pairs = stats.join(loads.select("load_id", "prev_load_id").where("prev_load_id is not null").distinct(), "load_id").join(before, ["column_name", "prev_load_id"])
    numbers = counts.where("value is not null")
    own = numbers.join(pairs.select(*key, "prev_load_id"), key)
    own = own.select(*key, "prev_load_id", "value", F.col("n").alias("a"), F.lit(0).cast("bigint").alias("b"))
    prev = numbers.withColumnRenamed("load_id", "prev_load_id").join(pairs.select(*key, "prev_load_id"), ["column_name", "prev_load_id"])
    prev = prev.select(*key, "prev_load_id", "value", F.lit(0).cast("bigint").alias("a"), F.col("n").alias("b"))
    key = [*key, "prev_load_id"]
    curves = prefix_sums(own.unionByName(prev), key, "value", ["a", "b"]).join(pairs.select(*key, "n_numbers", "p_n_numbers", "p_min_value", "p_max_value"), key)
    outside = (F.col("value") < F.col("p_min_value")) | (F.col("value") > F.col("p_max_value"))
    na, nb = F.col("n_numbers"), F.col("p_n_numbers")
    met = curves.groupBy(*key).agg(
        F.sum(F.when(outside, F.col("a")).otherwise(0)).alias("n_outside"),
        F.max(F.when(F.col("last"), F.abs(F.try_divide("cum_a", na) - F.try_divide("cum_b", nb)))).alias("ks"),
        F.coalesce(F.max(F.when(F.col("last"), _gap(F.col("cum_a"), na, F.col("cum_b"), nb, DISTRIBUTION))), F.lit(False)).alias("far"),
    )
    c, p = (lambda name: F.col("n_" + name)), (lambda name: F.col("p_n_" + name))
    tests = {
        "null_rate": _gap(c("missing"), c("rows"), p("missing"), p("rows"), NULL_RATE),
        "pattern": _gap(c("unreadable"), c("rows") - c("missing"), p("unreadable"), p("rows") - p("missing"), PATTERN),
        "value_range": (na > 0) & (nb > 0) & (F.col("n_outside") * 1000 > na * VALUE_RANGE),
        "distinct_count": (c("distinct") * 2 < p("distinct")) | (c("distinct") > p("distinct") * 2),
        "distribution": F.col("far"),
    }
    findings = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests.items())))
    return pairs.join(met, key, "left").withColumn("findings", findings).drop("far")


def load_findings(changes: DataFrame) -> DataFrame:
    """(load_id, column_name, finding)."""
    return changes.select("load_id", "column_name", F.explode("findings").alias("finding"))
