"""Set-based record linkage between catalogues of areas: unique names within a scope, chained parents, source priority, staged village matching, code bridges.

rows of a source: source, fid (both name the row), province, regency, district, village. Names are compared in canonical form, then without spaces. A name that several targets of a scope bear never resolves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulara.functions.text import canonical, compact
from tabulara.session import cut

ROW = ["source", "fid"]


def unique_names(regions: DataFrame, scope: str, name: str) -> DataFrame:
    """(scope, norm, target) of the names that exactly one region of the scope bears. regions: key, scope, canonical name."""
    one = regions.groupBy(F.col(scope).alias("scope"), F.col(name).alias("norm")).agg(F.count("*").alias("n"), F.min("key").alias("target"))
    return one.where("n = 1").drop("n")


def resolve(rows: DataFrame, scope: str, name: str, regions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """rows with target and method (exact, alias, compact) of `name` (canonical) among the regions (key, parent_key, canon) of `scope`. aliases: canon, alias, and optionally scope (null: any)."""
    wanted = rows.withColumn("_raw", F.col(name)).withColumn("_want", F.col(name))
    if aliases is not None:
        own = F.broadcast(aliases.where("scope IS NOT NULL").select(F.col("scope").alias("_s"), F.col("canon").alias("_c"), F.col("alias").alias("_own"))) if "scope" in aliases.columns else None
        anyone = (aliases.where("scope IS NULL") if "scope" in aliases.columns else aliases).select(F.col("canon").alias("_c2"), F.col("alias").alias("_any"))
        if own is not None:
            wanted = wanted.join(own, (F.col(scope) == F.col("_s")) & (F.col(name) == F.col("_c")), "left").drop("_s", "_c")
        else:
            wanted = wanted.withColumn("_own", F.lit(None).cast("string"))
        wanted = wanted.join(F.broadcast(anyone), F.col(name) == F.col("_c2"), "left").drop("_c2")
        wanted = wanted.withColumn("_want", F.coalesce("_own", "_any", F.col(name))).drop("_own", "_any")
    exact = unique_names(regions, "parent_key", "canon").select(F.col("scope").alias("_es"), F.col("norm").alias("_en"), F.col("target").alias("_exact"))
    tight = unique_names(regions.withColumn("canon", compact(F.col("canon"))), "parent_key", "canon").select(F.col("scope").alias("_ts"), F.col("norm").alias("_tn"), F.col("target").alias("_tight"))
    out = wanted.join(exact, (F.col(scope) == F.col("_es")) & (F.col("_want") == F.col("_en")), "left").join(tight, (F.col(scope) == F.col("_ts")) & (compact(F.col("_want")) == F.col("_tn")), "left")
    method = F.when(F.col("_exact").isNotNull(), F.when(F.col("_want") != F.col("_raw"), "alias").otherwise("exact")).when(F.col("_tight").isNotNull(), "compact")
    return out.withColumn("target", F.coalesce("_exact", "_tight")).withColumn("method", method).drop("_raw", "_want", "_es", "_en", "_exact", "_ts", "_tn", "_tight")


def resolve_parents(rows: DataFrame, nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """rows (canonical province, regency, district) with p_key, k_key, c_key and methods: each level is looked for among the children of the one above."""
    out = rows.withColumn("root", F.lit("")).withColumn("methods", F.array().cast("array<string>"))
    scope = "root"
    for level, (name, key) in enumerate((("province", "p_key"), ("regency", "k_key"), ("district", "c_key")), 1):
        regions = nodes.where(F.col("level") == level)
        out = resolve(out, scope, name, regions, aliases).withColumnRenamed("target", key)
        out = out.withColumn("methods", F.array_compact(F.array_append("methods", F.col("method")))).drop("method")
        scope = key
    return out.drop("root")


def priority_match(rows: DataFrame, sources: Sequence[str], target: str) -> DataFrame:
    """(target, source, fid, method): for each target all rows of the first source that has any. rows: source, fid, target, methods."""
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    found = rows.where(F.col(target).isNotNull()).withColumn("rank", rank)
    best = found.groupBy(target).agg(F.min("rank").alias("best"))
    kept = found.join(best, target).where("rank = best")
    any_of = lambda m: F.max(F.array_contains("methods", m))
    how = kept.groupBy(target).agg(F.when(any_of("alias"), "alias").when(any_of("compact"), "compact").otherwise("exact").alias("method"))
    return kept.select(F.col(target).alias("target"), *ROW).join(how.withColumnRenamed(target, "target"), "target")


def match_villages(rows: DataFrame, villages: DataFrame, sources: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(matches, blocked). rows: source, fid, k_key, c_key, canonical village; villages: key, k_key, c_key, canonical village.

    Per source, in order, four stages: unique within the district by name, then without spaces; unique on both sides within the regency, by name, then without spaces. A row that names a target already
    matched, and all rows that compete for one, are blocked for the stages after. Uniqueness in the last two counts all rows and targets of the regency, matched or not. Stages are joins of sets; the
    state between them is cut, so the plan of a stage doesn't hold those before it.
    """
    rows = cut(rows.where(F.col("k_key").isNotNull() & (F.col("village") != "")).select(*ROW, "k_key", "c_key", "village", compact(F.col("village")).alias("tight")))
    villages = cut(villages.select("key", "k_key", "c_key", "village", compact(F.col("village")).alias("tight")))
    matches = villages.select(F.col("key").alias("target")).limit(0).withColumns({"source": F.lit(""), "fid": F.lit(0).cast("bigint"), "method": F.lit("")})
    blocked = matches.select(*ROW)
    for source in sources:
        own = rows.where(F.col("source") == source)
        for method, name in (("full_exact", "village"), ("full_compact", "tight")):
            free = own.join(matches.select(*ROW), ROW, "left_anti").join(blocked, ROW, "left_anti").where("c_key IS NOT NULL")
            only = unique_names(villages.select("key", "c_key", name), "c_key", name)
            named = free.join(only, (F.col("c_key") == F.col("scope")) & (F.col(name) == F.col("norm")))
            late = named.join(matches.select("target"), "target", "left_semi").select(*ROW)
            rest = named.join(matches.select("target"), "target", "left_anti")
            groups = rest.groupBy("target").agg(F.count("*").alias("n"))
            rest = rest.join(groups, "target")
            new = rest.where("n = 1").select("target", *ROW, F.lit(method).alias("method"))
            blocked = cut(blocked.unionByName(late).unionByName(rest.where("n > 1").select(*ROW)))
            matches = cut(matches.unionByName(new))
        for method, name in (("regency_unique_exact", "village"), ("regency_unique_compact", "tight")):
            sides = own.groupBy("k_key", name).agg(F.count("*").alias("n_rows")).join(villages.groupBy("k_key", name).agg(F.count("*").alias("n_targets"), F.min("key").alias("target")), ["k_key", name])
            named = own.join(sides, ["k_key", name])
            free = named.where("n_rows = 1 AND n_targets = 1").join(matches.select("target"), "target", "left_anti").join(matches.select(*ROW), ROW, "left_anti").join(blocked, ROW, "left_anti")
            new = free.select("target", *ROW, F.lit(method).alias("method"))
            blocked = cut(blocked.unionByName(named.where("n_rows > 1 OR n_targets > 1").select(*ROW)).distinct())
            matches = cut(matches.unionByName(new))
    return matches, blocked.distinct()


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("source", "method").agg(F.count("*").alias("n"))


BRIDGE_REASONS = ["invalid_modern_code", "nonunique_selected_modern_code", "nonunique_global_modern_code", "missing_or_nonunique_historic_code", "historic_feature_already_used", "modern_parent_regency_mismatch", "historic_parent_regency_mismatch"]


def code_bridge(selected: DataFrame, modern: DataFrame, historic: DataFrame, sources: Sequence[str] = (), used: DataFrame | None = None) -> DataFrame:
    """selected (target, target_regency, source, fid, code, k_key) with `historic_fid` where its code leads to exactly one historic row of the same regency, else the first reason why not.

    A code counts by its digits: unique among the selected rows and among all modern rows (source, code) of its source with a valid code, and borne by exactly one historic row (fid, code, k_key).
    A historic row is used once: not if `used` (fid) has it already, else by the first row that passes everything, in the order of sources (those not named last, by name).
    """
    digits = F.regexp_replace(F.coalesce("code", F.lit("")), "[^0-9]", "")
    valid = F.coalesce(F.col("code").rlike(r"^\d{2}\.\d{2}\.\d{2}\.\d{4}$"), F.lit(False))
    s = selected.withColumn("digits", digits).withColumn("valid", valid)
    count = lambda df, name: df.groupBy("source", "digits").agg(F.count("*").alias(name))
    old = historic.withColumn("digits", digits).where(F.length("digits") == 10).groupBy("digits").agg(F.count("*").alias("n_old"), F.min("fid").alias("historic_fid"), F.min("k_key").alias("historic_k"))
    met = s.join(count(s.where("valid"), "n_sel"), ["source", "digits"], "left").join(count(modern.where(valid).withColumn("digits", digits), "n_all"), ["source", "digits"], "left").join(old, "digits", "left")
    taken = F.lit(False)
    if used is not None:
        met = met.join(used.select(F.col("fid").alias("historic_fid"), F.lit(True).alias("taken")).distinct(), "historic_fid", "left")
        taken = F.coalesce("taken", F.lit(False))
    early = [
        ~F.col("valid"), F.col("n_sel") != 1, F.coalesce("n_all", F.lit(0)) != 1, F.coalesce("n_old", F.lit(0)) != 1,
    ]
    late = [
        ~F.col("k_key").eqNullSafe(F.col("target_regency")), ~F.col("historic_k").eqNullSafe(F.col("target_regency")),
    ]
    passes = ~F.coalesce(F.greatest(*early, taken, *late), F.lit(True))
    place = F.struct(F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, sources)), F.col("source")), F.lit(0)), F.lit(len(sources) + 1)) if sources else F.lit(0), "source", "target")
    rivals = Window.partitionBy("historic_fid", F.when(F.greatest(*early), F.col("target")))  # of rows that get so far, a historic row has at most one per source
    met = met.withColumn("place", place).withColumn("first", F.min(F.when(passes, F.col("place"))).over(rivals))
    tests = [*early, taken | F.coalesce(F.col("place") > F.col("first"), F.lit(False)), *late]
    reason = F.coalesce(*(F.when(t, F.lit(r)) for t, r in zip(tests, BRIDGE_REASONS, strict=True)))
    return met.select("target", "source", "fid", F.when(reason.isNull(), F.col("historic_fid")).alias("historic_fid"), reason.alias("block_reason"))


def canonical_columns(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: canonical(F.col(c)) for c in columns})


def eligible(rows: DataFrame, year: str, last: int) -> DataFrame:
    """Rows whose latest year of law is not after `last`; rows without a year stay."""
    return rows.where(F.coalesce(F.col(year) <= last, F.lit(True)))


def vintage_counts(rows: DataFrame, source: str, year: str, last: int) -> DataFrame:
    """(source, vintage, n): upto, unknown or after."""
    vintage = F.when(F.col(year).isNull(), "unknown").when(F.col(year) <= last, "upto").otherwise("after")
    return rows.groupBy(F.col(source).alias("source"), vintage.alias("vintage")).agg(F.count("*").alias("n"))


def unresolved_counts(resolved: DataFrame) -> DataFrame:
    """Per source: rows, and rows without a province, regency or district of the hierarchy."""
    return resolved.groupBy("source").agg(F.count("*").alias("n_rows"), *(F.count_if(F.col(k).isNull()).alias(f"no_{k}") for k in ("p_key", "k_key", "c_key")))
