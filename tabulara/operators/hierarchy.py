"""The region hierarchy: spine, levels, keys, ancestors, roll-up dimensions, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulara.functions.text import clean_name, path_key

CODES, NAMES = ["kodeprov", "kodekab", "kodekec", "kodekel"], ["namaprov", "namakab", "namakec", "namakel"]
LEVELS = ["province", "regency", "district", "village"]


def spine(catalogue: DataFrame) -> DataFrame:
    """One row per village code of a catalogue with repeated entries: that of the latest created_at (then of the greatest names), with key and concat."""
    best = catalogue.groupBy(*CODES).agg(F.max(F.struct("created_at", *NAMES)).alias("e"))
    return best.select(*CODES, *(F.col(f"e.{n}").alias(n) for n in NAMES), path_key(*map(F.col, CODES)).alias("key"), F.concat(*CODES).alias("concat"))


def districts(villages: DataFrame) -> DataFrame:
    """(g1, g2, g3, d_prov, d_kab, d_kec): cleaned name triples and the codes they stand for; of equal triples the least codes."""
    names = [clean_name(F.col(n)).alias(f"g{i + 1}") for i, n in enumerate(NAMES[:3])]
    best = villages.select(*names, F.struct(*CODES[:3]).alias("c")).groupBy("g1", "g2", "g3").agg(F.min("c").alias("c"))
    return best.select("g1", "g2", "g3", *(F.col(f"c.{c}").alias(a) for c, a in zip(CODES, ("d_prov", "d_kab", "d_kec"), strict=False)))


def nodes(villages: DataFrame) -> DataFrame:
    """(level, key, name, code, parent_key) of all four levels, from one pass over the villages; of several names of a code the least."""
    rows = [
        F.struct(
            F.lit(i + 1).alias("level"),
            path_key(*map(F.col, CODES[: i + 1])).alias("key"),
            F.col(NAMES[i]).alias("name"),
            F.col(CODES[i]).alias("code"),
            (path_key(*map(F.col, CODES[:i])) if i else F.lit("")).alias("parent_key"),
        )
        for i in range(4)
    ]
    return villages.select(F.explode(F.array(*rows)).alias("n")).select("n.*").groupBy("level", "key", "code", "parent_key").agg(F.min("name").alias("name"))


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that are not unique, with their number: an assertion holds when this is empty."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def with_ancestors(all_nodes: DataFrame) -> DataFrame:
    """nodes with `path` (keys from the top) and `breadcrumb` (names joined by ' / '); three joins for four levels, no recursion."""
    names = all_nodes.select(F.col("key").alias("k"), F.col("name").alias("n"))
    out = all_nodes.withColumn("parts", F.split("key", r"\."))
    out = out.withColumn("path", F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", F.lit(1), i), ".")))
    for i in range(1, 5):
        level = names.select(F.col("k").alias(f"k{i}"), F.col("n").alias(f"n{i}"))
        out = out.withColumn(f"k{i}", F.get("path", F.lit(i - 1))).join(level, f"k{i}", "left")
    return out.select(*all_nodes.columns, "path", F.concat_ws(" / ", "n1", "n2", "n3", "n4").alias("breadcrumb"))


def children_of(all_nodes: DataFrame, key: str) -> DataFrame:
    """The children of a node; a leaf stands for itself."""
    kids = all_nodes.where(F.col("parent_key") == key)
    return kids if kids.take(1) else all_nodes.where(F.col("key") == key)


def is_related(key: Column, other: str) -> Column:
    """Whether key is other, below it or above it."""
    return (key == other) | key.startswith(other + ".") | F.lit(other).startswith(F.concat(key, F.lit(".")))


def reconcile(left: DataFrame, right: DataFrame, sample: int | None = None) -> DataFrame:
    """Rows of either side that the other lacks, with `side`; equal rows count by number (EXCEPT ALL)."""
    a, b = left.exceptAll(right), right.exceptAll(left)
    if sample is not None:
        a, b = a.limit(sample), b.limit(sample)
    return a.withColumn("side", F.lit("left")).unionByName(b.withColumn("side", F.lit("right")))


def nested_hierarchy(villages: DataFrame) -> DataFrame:
    """One row (json) per province: its regencies, districts and villages nested as k, n and children, each level sorted by clean name and code."""
    order = lambda name, code: F.struct(clean_name(F.col(name)).alias("o"), F.col(code).alias("k"), F.col(name).alias("n"))
    strip = lambda c, *more: F.transform(F.array_sort(c), lambda x: F.struct(x["v"]["k"].alias("k"), x["v"]["n"].alias("n"), *(x[m].alias(m) for m in more)))
    kel = villages.groupBy(*CODES[:3], *NAMES[:3]).agg(F.collect_list(F.struct(order("namakel", "kodekel").alias("v"))).alias("kel"))
    kec = kel.groupBy(*CODES[:2], *NAMES[:2]).agg(F.collect_list(F.struct(order("namakec", "kodekec").alias("v"), strip(F.col("kel")).alias("kel"))).alias("kec"))
    kab = kec.groupBy(CODES[0], NAMES[0]).agg(F.collect_list(F.struct(order("namakab", "kodekab").alias("v"), strip(F.col("kec"), "kel").alias("kec"))).alias("kab"))
    return kab.select(F.col("kodeprov").alias("k"), F.to_json(F.struct(F.col("kodeprov").alias("k"), F.col("namaprov").alias("n"), strip(F.col("kab"), "kec").alias("kab"))).alias("json"))
