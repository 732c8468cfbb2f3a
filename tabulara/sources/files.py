"""Readers with enforced schemas, inventories and digests."""

from __future__ import annotations

import re
import shutil
import zipfile
from collections.abc import Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulara.functions.text import trimmed
from tabulara.operators.validate import q


class HeaderError(ValueError):
    """A file whose header is not exactly the schema's."""


def read_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str], strict: bool = True) -> DataFrame:
    """All fields as strings with file_path and record_no, the place of a record among the non-blank records of its file (2 is the first after the header).

    The header must equal `columns` in order: the first line of every file is looked at before (a count prunes the columns, so the reader itself would not notice). Records whose fields are all empty are left out; those of
    white space are not. Files are read whole, one task per file: the ordinals need the order of a file, quoted line breaks included.
    """
    head = spark.read.text(paths, wholetext=True).select("_metadata.file_path", F.regexp_extract("value", "\\A\ufeff?([^\r\n]*)", 1).alias("head"))
    if strict:
        bad = head.where(F.col("head") != ",".join(columns)).limit(1).collect()  # one row at most
        if bad:
            raise HeaderError(f"{bad[0][0]}: {bad[0][1][:200]}")
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.regexp_replace("value", "\\A\ufeff", "").alias("value"))
    record = r'((?:[^"\r\n]|"(?:[^"]|"")*+")++)(?:\r\n|\n|\r|\z)'
    lines = whole.select("file_path", F.posexplode(F.filter(F.regexp_extract_all("value", F.lit(record), 1), lambda x: x.rlike("[^,\"]"))).alias("i", "line")).where("i > 0")
    quote = r'"(?:[^"]|"")*+"'
    raw = F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(f",({quote}|[^,]*+)"), 1)
    fields = F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return lines.withColumn("f", fields).select("file_path", (F.col("i") + 1).alias("record_no"), *(F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)))


def inventory(spark: SparkSession, glob: str) -> DataFrame:
    """(file_path, n_bytes, sha256) of the files."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def non_blank_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one cell that is not white space."""
    return df.where(F.greatest(*(F.coalesce(trimmed(q(c)), F.lit("")) != "" for c in df.columns)))


def set_digest(names_and_hashes: DataFrame) -> DataFrame:
    """One row: the SHA-256 of the sorted `name:hash` lines joined by line feeds. names_and_hashes: name, sha256; one per file of a published set."""
    line = F.concat_ws(":", "name", "sha256")
    return names_and_hashes.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))


def read_tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """(parent, code, name) of a folder of node files <id>.json whose children are lists that begin with code and name; the walk from node 0 goes four levels down, so village files need not exist."""
    nodes = spark.read.schema("children ARRAY<ARRAY<STRING>>").json(f"{folder}/*.json", multiLine=True).select(F.regexp_extract("_metadata.file_path", "([^/]+)\\.json$", 1).alias("parent"), F.explode("children").alias("c"))
    return nodes.select("parent", F.col("c")[0].alias("code"), F.col("c")[1].alias("name"))


def walk_tree(edges: DataFrame) -> DataFrame:
    """Villages (kodeprov, namaprov, … kodekel, namakel) of the (parent, code, name) edges below node 0: four joins, no recursion."""
    at = edges.where("parent = '0'").select(F.col("code").alias("kodeprov"), F.col("name").alias("namaprov"))
    for above, level in (("prov", "kab"), ("kab", "kec"), ("kec", "kel")):
        below = edges.select(F.col("parent").alias(f"kode{above}"), F.col("code").alias(f"kode{level}"), F.col("name").alias(f"nama{level}"))
        at = at.join(below, f"kode{above}")
    return at


def read_nested_hierarchy(spark: SparkSession, path: str, foreign: bool = True) -> DataFrame:
    """Nodes (level, key, name, parent_key) of a nested hierarchy file {prov:[{k,n,kab:[{k,n,kec:[{k,n,kel}]}]}]}; foreign=False leaves out provinces abroad."""
    leaf = "ARRAY<STRUCT<k:STRING,n:STRING>>"
    schema = f"prov ARRAY<STRUCT<k:STRING,n:STRING,kab:ARRAY<STRUCT<k:STRING,n:STRING,kec:ARRAY<STRUCT<k:STRING,n:STRING,kel:{leaf}>>>>>>"
    at = spark.read.schema(schema).json(path, multiLine=True).select(F.lit("P").alias("parent_key"), F.explode_outer("prov").alias("x"))
    out, parts = None, ["kab", "kec", "kel", None]
    for level, child in enumerate(parts, 1):
        at = at.where("x IS NOT NULL").withColumn("key", F.concat(F.when(F.col("parent_key") == "P", "P").otherwise(F.concat("parent_key", F.lit("."))), "x.k"))
        if level == 1 and not foreign:
            at = at.where(~(F.col("x.n").startswith("+") | F.upper("x.n").contains("LUAR NEGERI")))
        rows = at.select(F.lit(level).alias("level"), "key", F.col("x.n").alias("name"), F.when(F.col("parent_key") == "P", "").otherwise(F.col("parent_key")).alias("parent_key"))
        out = rows if out is None else out.unionByName(rows)
        if child:
            at = at.select(F.col("key").alias("parent_key"), F.explode_outer(f"x.{child}").alias("x"))
    return out


def read_partition(spark: SparkSession, base: str, column: str, value: str, schema: str) -> DataFrame:
    """One partition of a table written with partitionBy; a missing one is an empty table, not an error."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{column}={value}")
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).option("basePath", base).parquet(f"{base}/{column}={value}") if there else spark.createDataFrame([], schema)


def read_stems(spark: SparkSession, folder: str, stem: str, suffix: str = ".json") -> DataFrame:
    """(path, content) of the files of a folder whose whole stem matches a pattern, such as four digits."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{suffix}").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.where(F.regexp_replace(F.substring_index("path", "/", -1), re.escape(suffix) + "$", "").rlike(f"\\A(?:{stem})\\z"))


def describe(df: DataFrame, n: int = 5) -> tuple[list[str], int, DataFrame]:
    """(field names, number of rows, first n rows): a look into a source."""
    return df.columns, df.count(), df.limit(n)


def unzip_parts(parts: Sequence[str], folder: str, wanted: str) -> str:
    """Joins split archive parts, unpacks them (and archives inside) into folder, and returns the one path that matches `wanted`. Paths that leave the folder are refused."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    joined = base / "joined.zip"
    with joined.open("wb") as out:
        for part in sorted(parts):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out)
    queue = [joined]
    while queue:
        with zipfile.ZipFile(queue.pop()) as z:
            for name in z.namelist():
                parts_ = PurePosixPath(name.replace("\\", "/")).parts
                if name.startswith("/") or ".." in parts_:
                    raise ValueError(f"{name} leaves its folder")
            z.extractall(base)
            queue += [base / n for n in z.namelist() if n.lower().endswith(".zip")]
    found = [p for p in base.rglob(wanted) if p != joined]
    if len(found) != 1:
        raise ValueError(f"{len(found)} files match {wanted}")
    return str(found[0])
