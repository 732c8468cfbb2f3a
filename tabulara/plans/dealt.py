"""The queries p1 to p5 over the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulara.functions.text import blank, clean_name, trimmed
from tabulara.operators import archive, diff, orphans, profile, rowparse
from tabulara.schemas import CONTEST_COLUMNS, COPY_FIELDS, COUNTS, GEO, PARTIES
from tabulara.session import spread

PROFILED = ["pkb", "suara-tidak-sah", "total-pemilih"]
CONTEST_ROWS = rowparse.RowSchema(CONTEST_COLUMNS, {"id": rowparse.DIGITS, "tps": rowparse.TPS, "total-pemilih": rowparse.COUNT}, frozenset({"total-pemilih"}))

_NAME, _SCAN = r"(?s).*\p{L}.*", r"\S+\.[A-Za-z0-9]+"
_TIME = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]|[0-9]{2}/[0-9]{2}/[0-9]{4} )[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?Z?"
#: The contest columns that aren't numbers, with the pattern of a usual text.
TEXTS = {"id": rowparse.DIGITS, **dict.fromkeys(GEO, _NAME), "tps": rowparse.TPS, "timestamp": _TIME, **{c: _SCAN for c in CONTEST_COLUMNS if c.startswith("c1-")}}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of rows on which much is computed."""
    return spread(table(spark, d, name))


def _names(columns: list[str]) -> Column:
    return F.concat_ws("\x1f", *(clean_name(F.col(c)) for c in columns))


def _village_refs(facts: DataFrame, name: str) -> DataFrame:
    code = trimmed(F.col("id"))
    code = F.when(~blank(F.col("id")), F.substring(code, F.lit(1), F.greatest(F.length(code) - 9, F.lit(0))))
    named = F.when(~F.greatest(*(blank(F.col(c)) for c in GEO)), _names(GEO))
    refs = F.array(F.struct(F.lit("id").alias("field"), code.alias("key")), F.struct(F.lit("kelurahan").alias("field"), named.alias("key")))
    rows = facts.select("row_no", F.col("loaded_at").alias("at"), F.explode(refs).alias("r"))
    return rows.select(F.lit(name).alias("table_name"), "row_no", "r.field", "r.key", "at", F.date_format("at", "yyyy-MM").alias("period")).where("key is not null")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = table(spark, d, "wilayah")
    refs = _village_refs(rows_of(spark, d, "hasil_tps"), "hasil_tps").unionByName(_village_refs(rows_of(spark, d, "pilpres_situs"), "pilpres_situs"))
    codes = F.struct(F.lit("id").alias("field"), F.concat("kodeprov", "kodekab", "kodekec", "kodekel").alias("key"))
    names = F.struct(F.lit("kelurahan").alias("field"), _names(["namaprov", "namakab", "namakec", "namakel"]).alias("key"))
    dim = w.select(F.explode(F.array(codes, names)).alias("r"), F.col("created_at").alias("begins"), F.col("deleted_at").alias("ends")).select("r.*", "begins", "ends")
    return refs, dim


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*_references(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*_references(spark, d))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return rowparse.parse_rows(rows_of(spark, d, "rekaman_mentah"), "raw_line", CONTEST_ROWS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rowparse.failures(_parsed(spark, d), "raw_no")


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rowparse.loaded(_parsed(spark, d), CONTEST_ROWS, "raw_no", "contest", "loaded_at")


def p2_status(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).groupBy("contest", "file_path", F.col("parsed.status").alias("status"), F.col("parsed.reason").alias("reason"), F.col("parsed.first_broken").alias("first_broken")).agg(F.count("*").alias("n"))


def _archive(spark: SparkSession, d: str) -> DataFrame:
    return archive.read_archive(spark, archive.write_archive(rows_of(spark, d, "desa_file")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return archive.shared_records(_archive(spark, d))


def p3_index(spark: SparkSession, d: str) -> DataFrame:
    return archive.archive_index(_archive(spark, d)).select("file_id", "run_id", "path", "length", "sha256")


def p3_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every file cut out of its block by offset and length, checked against its checksum, with the hash of what came out."""
    return archive.unpack(_archive(spark, d)).select("file_id", "path", F.sha2("content", 256).alias("sha256"))


def p3_store(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """The consolidated features in blocks, a partition per container file: written out, they are the few files asked for. With a path they are kept there and read from it."""
    files = _archive(spark, d)
    if path is None:
        return archive.pack_features(archive.kept_features(files))
    return archive.read_consolidated(spark, archive.write_consolidated(files, path))


def p3_consolidated(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """The index of p3_store; its columns are fixed."""
    return archive.feature_index(p3_store(spark, d, path)).select("run_id", "key", "file_id", "ordinal", "n_copies")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.value_counts(rows_of(spark, d, "hasil_tps"), PROFILED)
    return profile.load_findings(profile.load_changes(counts, table(spark, d, "muatan")))


def p4_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(profile.value_counts(rows_of(spark, d, "hasil_tps"), [*PARTIES, *COUNTS]))


def p4_changes(spark: SparkSession, d: str) -> DataFrame:
    counts = profile.value_counts(rows_of(spark, d, "hasil_tps"), [*PARTIES, *COUNTS])
    return profile.load_changes(counts, table(spark, d, "muatan")).withColumn("findings", F.array_join("findings", ","))


def p4_profile_all(spark: SparkSession, d: str) -> DataFrame:
    """p4_profile for all 38 columns; texts have n_texts, min_text, max_text and q…_text."""
    texts = profile.profile(profile.text_counts(rows_of(spark, d, "hasil_tps"), TEXTS))
    return p4_profile(spark, d).unionByName(profile.named_as_text(texts), allowMissingColumns=True)


def p4_changes_all(spark: SparkSession, d: str) -> DataFrame:
    """p4_changes for all 38 columns."""
    texts = profile.load_changes(profile.text_counts(rows_of(spark, d, "hasil_tps"), TEXTS), table(spark, d, "muatan")).withColumn("findings", F.array_join("findings", ","))
    return p4_changes(spark, d).unionByName(profile.named_as_text(texts), allowMissingColumns=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return diff.copy_differences(rows_of(spark, d, "pilpres_situs"), rows_of(spark, d, "pilpres_arsip"), ("situs", "arsip"), "id", "row_no", COPY_FIELDS)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_loaded, p2_status, p3_found, p3_index, p3_lookup, p3_store, p3_consolidated, p4_found, p4_profile, p4_changes, p4_profile_all, p4_changes_all, p5_found)}
