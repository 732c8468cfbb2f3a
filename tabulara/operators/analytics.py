"""What a reader of results asks: leaders, margins, shares, turnout, scales, children, search, export.

results: one row per node and contest with key, contest, one column per option and the nine stats; a node without rows has null sums. Ratios are doubles of exact integers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulara.functions.text import column_key, csv_cell
from tabulara.operators.aggregate import STATS
from tabulara.operators.validate import q


def votes_array(options: Sequence[str]) -> Column:
    return F.array(*(q(c) for c in options))


def total_of(options: Sequence[str]) -> Column:
    return F.aggregate(votes_array(options), F.lit(0).cast("bigint"), lambda a, x: a + x)


def present() -> Column:
    return F.col("tps").isNotNull()


def leaders(options: Sequence[str]) -> Column:
    """Names of all options at the maximum, if there are votes at all; an empty array otherwise."""
    best = F.array_max(votes_array(options))
    at = F.array_compact(F.array(*(F.when(q(c) == best, F.lit(c)) for c in options)))
    return F.when(present() & (total_of(options) > 0), at).otherwise(F.array().cast("array<string>"))


def with_winner(results: DataFrame, options: Sequence[str]) -> DataFrame:
    """results with total, winner (null for a tie or no votes), is_tie and margin ((first - second) / total, null without votes)."""
    ranked = F.sort_array(votes_array(options), asc=False)
    out = results.withColumn("total", F.when(present(), total_of(options))).withColumn("_l", leaders(options))
    margin = F.when(F.col("total") > 0, (F.get(ranked, F.lit(0)) - F.coalesce(F.get(ranked, F.lit(1)), F.lit(0))) / F.col("total"))
    return out.withColumn("winner", F.when(F.size("_l") == 1, F.get("_l", F.lit(0)))).withColumn("is_tie", F.size("_l") > 1).withColumn("margin", margin).drop("_l")


def option_ranks(results: DataFrame, options: Sequence[str], top: int | None = None) -> DataFrame:
    """(key, contest, option, votes, rank, share) of nodes with rows: options by votes, then by their order; top keeps the first ones."""
    ranked = F.sort_array(F.array(*(F.struct(q(c).alias("votes"), F.lit(-i).alias("o"), F.lit(c).alias("option")) for i, c in enumerate(options))), asc=False)
    long = results.where(present()).select("key", "contest", total_of(options).alias("total"), F.posexplode(ranked).alias("i", "x"))
    long = long if top is None else long.where(F.col("i") < top)
    return long.select("key", "contest", "x.option", "x.votes", (F.col("i") + 1).alias("rank"), F.try_divide("x.votes", "total").alias("share"))


def turnout() -> Column:
    return F.when(present() & (q("validated-tps") > 0) & (q("total-pemilih") > 0), q("total-pengguna") / q("total-pemilih"))


def invalid_rate() -> Column:
    return F.when(q("suara-total") > 0, q("suara-tidak-sah") / q("suara-total"))


def coverage_notes(results: DataFrame, options: Sequence[str]) -> DataFrame:
    """Per node: rows that report figures, rows whose counts were set aside, and the difference between options and valid votes."""
    n = lambda c: F.coalesce(q(c), F.lit(0))
    return results.select(
        "key",
        "contest",
        present().alias("present"),
        F.greatest(F.lit(0), n("tps") - n("blank-tps")).alias("reported"),
        F.greatest(F.lit(0), n("tps") - n("validated-tps") - n("blank-tps")).alias("rejected"),
        F.when(present(), total_of(options) - q("suara-sah")).alias("difference"),
    )


def turnout_domain(results: DataFrame, *group: str) -> DataFrame:
    """Exact 2nd and 98th percentile (linear interpolation) of turnout per group; .55 to .9 where there is none; at least .02 wide."""
    p = results.withColumn("t", turnout()).groupBy(*group).agg(F.percentile("t", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    lo, hi = F.coalesce(F.get("p", F.lit(0)), F.lit(0.55)), F.coalesce(F.get("p", F.lit(1)), F.lit(0.9))
    narrow = (hi - lo) < 0.02
    return p.select(*group, F.when(narrow, F.greatest(F.lit(0.0), lo - 0.01)).otherwise(lo).alias("low"), F.when(narrow, hi + 0.01).otherwise(hi).alias("high"))


def share_domain(results: DataFrame, options: Sequence[str], option: str, *group: str) -> DataFrame:
    """The upper end of the share scale of an option: the greatest share, .5 if that is 0 or absent, .08 at least."""
    share = F.when(total_of(options) > 0, q(option) / total_of(options))
    top = results.groupBy(*group).agg(F.max(share).alias("m"))
    return top.select(*group, F.greatest(F.lit(0.08), F.coalesce(F.nullif("m", F.lit(0.0)), F.lit(0.5))).alias("high"))


def colour_class(with_winners: DataFrame) -> DataFrame:
    """(key, contest, class, intensity): winner, tie or no-data, and how strong the margin colours (full from one half)."""
    kind = F.when(F.coalesce(F.col("total"), F.lit(0)) <= 0, "no-data").when(F.col("is_tie"), "tie").when(F.col("winner").isNull(), "no-data").otherwise("winner")
    return with_winners.select("key", "contest", kind.alias("class"), F.when(F.col("winner").isNotNull(), F.least(F.lit(1.0), F.col("margin") / 0.5)).alias("intensity"))


def children_summary(results: DataFrame, options: Sequence[str]) -> DataFrame:
    """One row per node and contest with its parent: total, winner, margin, turnout, invalid rate, coverage, and its place among its siblings by total (then key)."""
    w = with_winner(results, options)
    place = F.row_number().over(Window.partitionBy("parent_key", "contest").orderBy(F.desc_nulls_last("total"), "key"))
    return w.select("parent_key", "key", "contest", "total", "winner", "is_tie", "margin", turnout().alias("turnout"), invalid_rate().alias("invalid_rate"), "covered", "total_units", place.alias("place"))


def sorted_children(results: DataFrame, options: Sequence[str], by: str, descending: bool = True) -> DataFrame:
    """Siblings numbered by total or by an option's share (absent counts as -1), ties by key."""
    value = F.coalesce(total_of(options).cast("double"), F.lit(-1.0)) if by == "total" else F.coalesce(F.when(total_of(options) > 0, q(by) / total_of(options)), F.lit(-1.0))
    out = results.withColumn("value", value)
    order = F.desc("value") if descending else F.asc("value")
    return out.select("parent_key", "key", "contest", "value", F.row_number().over(Window.partitionBy("parent_key", "contest").orderBy(order, "key")).alias("place"))


def search(nodes: DataFrame, text: str, first: int = 40, enough: int = 25, shown: int = 30) -> DataFrame:
    """Nodes found by name: those beginning with the text, and, if fewer than `enough`, those containing it; the first ones in key order, shown by level, name and key. Texts under two characters find nothing."""
    wanted = text.strip().upper()
    if len(wanted) < 2:
        return nodes.limit(0)
    upper = F.upper("name")
    starts = nodes.where(upper.startswith(wanted)).orderBy("path_key").limit(first)
    within = nodes.where(upper.contains(wanted) & ~upper.startswith(wanted)).orderBy("path_key").limit(first)
    n = starts.agg(F.count("*").alias("n_start"))  # one row
    rest = within.withColumn("i", F.row_number().over(Window.orderBy("path_key"))).join(F.broadcast(n), (F.col("n_start") < enough) & (F.col("i") + F.col("n_start") <= first)).drop("i", "n_start")
    return starts.unionByName(rest).orderBy("level", "name", "key").limit(shown)


def export_lines(results: DataFrame, options: Sequence[str]) -> DataFrame:
    """(parent_key, contest, line): a CSV line per child, absent figures empty."""
    cells = [F.col("key"), F.col("name"), F.col("level"), present().cast("int"), F.when(present(), total_of(options)), *(q(c) for c in STATS), *(q(c) for c in options)]
    return results.select("parent_key", "key", "contest", F.concat_ws(",", *(csv_cell(c) for c in cells)).alias("line"))


def option_dimension(columns: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """columns (contest, column, ordinal as delivered) with their place (1 …) and label: those of labels in its order, matched by column_key, then the unknown ones as delivered, labelled by their own words."""
    known = F.create_map(*(x for i, (c, label) in enumerate(labels.items()) for x in (F.lit(c), F.struct(F.lit(i).alias("i"), F.lit(label).alias("label")))))
    met = columns.withColumn("k", F.try_element_at(known, column_key(F.col("column"))))
    met = met.withColumn("k", F.coalesce("k", F.try_element_at(known, F.col("column"))))
    place = F.row_number().over(Window.partitionBy("contest").orderBy(F.coalesce("k.i", F.lit(1 << 20)), "ordinal"))
    own = F.initcap(F.regexp_replace("column", "[-_]+", " "))
    return met.select("contest", "column", place.alias("place"), F.coalesce("k.label", own).alias("label"), F.col("k").isNotNull().alias("known"))
