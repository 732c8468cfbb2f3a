"""References to records that do not exist, by a skew-aware split of the keys.

1. References are pre-aggregated per (table, field, key, period): their number, first and last time. The partial aggregation shrinks hot keys before any shuffle.
2. Groups with at least 1/HEAVY_GROUPS of all references are heavy: at most HEAVY_GROUPS of them, whatever the input, so their verdicts can be broadcast. All others are light.
3. Each group meets the life spans of its key, heavy ones through a broadcast of the heavy keys, light ones through a shuffled join, and gets a verdict: every reference of the period
   is covered by one span, or none matches at all, or the references have to be looked at one by one.
4. The references that belong to a group without full cover are taken from the facts (heavy: broadcast join, light: a broadcast filter by hash slot, then a shuffled join), checked against the few spans that touch the
   period, and both parts are united.

Nulls and edge cases: a reference with a null key or time is none; a null `begins` counts as always begun, a null `ends` as still live; an empty dimension makes every reference
`missing`; empty facts give an empty result; repeated rows and repeated dimension entries change nothing but the counts; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulara.session import cut

#: The largest number of groups treated as heavy: each has at least this fraction of all references.
HEAVY_GROUPS = 1024
#: Hash slots of the groups without full cover, a filter of at most so many numbers: most references of other groups meet none and are never shuffled.
SLOTS = 1 << 18
GROUP = ["field", "key", "period"]
_FAR_PAST, _FAR_FUTURE = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"


def life_spans(dimension: DataFrame) -> DataFrame:
    """(field, key, begins, ends) with repeated and overlapping entries of a key merged; entries that never live (ends <= begins) keep their begin.

    Also `entry_begins`, the earliest begin of the key, which decides between `deleted` and `later`.
    """
    entries = dimension.select(
        "field",
        "key",
        F.coalesce("begins", F.lit(_FAR_PAST).cast("timestamp_ntz")).alias("begins"),
        F.coalesce("ends", F.lit(_FAR_FUTURE).cast("timestamp_ntz")).alias("ends"),
    ).where(F.col("key").isNotNull())
    entries = entries.distinct()
    by_key = Window.partitionBy("field", "key")
    before = by_key.orderBy("begins", "ends").rowsBetween(Window.unboundedPreceding, -1)
    upto = by_key.orderBy("begins", "ends").rowsBetween(Window.unboundedPreceding, 0)
    islands = entries.withColumn("new", F.when(F.col("begins") <= F.max("ends").over(before), 0).otherwise(1)).withColumn("island", F.sum("new").over(upto))
    return islands.groupBy("field", "key", "island").agg(F.min("begins").alias("begins"), F.max("ends").alias("ends")).drop("island")


def table_groups(refs: DataFrame) -> DataFrame:
    """refs: table_name, row_no, field, key, at, period. One row per table and group with its number of references n, and first and last time."""
    return cut(refs.groupBy("table_name", *GROUP).agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")))


def reference_groups(counted: DataFrame) -> DataFrame:
    """The groups of references, or of table_groups, with n, first_at and last_at: these added up, and whether a group is heavy."""
    groups = cut(counted.groupBy(*GROUP).agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    return groups.withColumn("heavy", F.col("n") * HEAVY_GROUPS >= F.lit(total))


def _verdicts(groups: DataFrame, spans: DataFrame, few: bool) -> DataFrame:
    """Per group: verdict `covered`, `missing` or `rows`, the spans that touch its times, and the first begin of its key. few: at most HEAVY_GROUPS groups."""
    if few:
        spans = spans.join(F.broadcast(groups.select("field", "key").distinct()), ["field", "key"], "left_semi")
    met = groups.join(spans, ["field", "key"], "left")
    touches = (F.col("begins") <= F.col("last_at")) & (F.col("ends") > F.col("first_at"))
    covers = F.coalesce((F.col("begins") <= F.col("first_at")) & (F.col("ends") > F.col("last_at")), F.lit(False))
    per_group = met.groupBy(*GROUP).agg(
        F.max(covers).alias("covered"),
        F.min("begins").alias("first_begin"),
        F.collect_list(F.when(touches & ~covers, F.struct("begins", "ends"))).alias("spans"),
    )
    verdict = F.when(F.col("covered"), "covered").when(F.col("first_begin").isNull(), "missing").otherwise("rows")
    return per_group.select(*GROUP, verdict.alias("verdict"), "first_begin", "spans")


def _reasons(rows: DataFrame) -> DataFrame:
    live = F.exists("spans", lambda s: (s["begins"] <= F.col("at")) & (s["ends"] > F.col("at")))
    reason = F.when(F.col("verdict") == "missing", "missing").when(F.col("first_begin") <= F.col("at"), "deleted").otherwise("later")
    return rows.where((F.col("verdict") != "covered") & ~live).select("table_name", "row_no", "field", reason.alias("reason"), "period")


def _uncovered(counted: DataFrame, dimension: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keys of heavy groups, verdicts of heavy groups, verdicts of light groups), the verdicts of groups without full cover."""
    groups, spans = reference_groups(counted), life_spans(dimension)
    heavy = cut(_verdicts(groups.where("heavy"), spans, few=True))
    light = cut(_verdicts(groups.where("not heavy"), spans, few=False).where("verdict <> 'covered'"))
    return heavy.select(*GROUP), heavy.where("verdict <> 'covered'"), light


def _rows_of(refs: DataFrame, hot: DataFrame, heavy: DataFrame, light: DataFrame) -> DataFrame:
    """The references of the groups, with their reasons."""
    slot = F.pmod(F.xxhash64(*GROUP), F.lit(SLOTS)).cast("int").alias("slot")
    slots = F.broadcast(light.select(slot).distinct())  # at most SLOTS numbers
    hot_rows = refs.join(F.broadcast(heavy), GROUP)  # at most HEAVY_GROUPS rows
    other_rows = refs.join(F.broadcast(hot), GROUP, "left_anti").join(slots, slot == slots["slot"], "left_semi").join(light, GROUP)
    return _reasons(hot_rows).unionByName(_reasons(other_rows))


def _references(refs: DataFrame) -> DataFrame:
    return refs.select("table_name", "row_no", "field", "key", "at", "period").where(F.col("key").isNotNull() & F.col("at").isNotNull())


def orphan_references(refs: DataFrame, dimension: DataFrame) -> DataFrame:
    """One row per orphan reference: table_name, row_no, field, reason (missing, deleted, later), period.

    refs: table_name, row_no, field, key, at (timestamp_ntz), period. dimension: field, key, begins, ends (timestamp_ntz).
    """
    refs = _references(refs)
    each = refs.select(*GROUP, F.lit(1).alias("n"), F.col("at").alias("first_at"), F.col("at").alias("last_at"))
    return _rows_of(refs, *_uncovered(each, dimension))


def orphan_counts(refs: DataFrame, dimension: DataFrame) -> DataFrame:
    """orphan_report without the rows: groups that nothing matches count as they were pre-aggregated, only the references of groups covered in part are looked at, and both counts are united."""
    refs = _references(refs)
    per_table = table_groups(refs)
    hot, heavy, light = _uncovered(per_table, dimension)
    none = heavy.unionByName(light).where("verdict = 'missing'").select(*GROUP)
    missing = per_table.join(none, GROUP, "left_semi").select("table_name", "period", "field", F.lit("missing").alias("reason"), "n")
    looked = _rows_of(refs, hot, heavy.where("verdict = 'rows'"), light.where("verdict = 'rows'")).select("table_name", "period", "field", "reason", F.lit(1).cast("bigint").alias("n"))
    return missing.unionByName(looked).groupBy("table_name", "period", "field", "reason").agg(F.sum("n").alias("n_orphans"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per table, period, field and reason."""
    return orphans.groupBy("table_name", "period", "field", "reason").agg(F.count("*").alias("n_orphans"))
