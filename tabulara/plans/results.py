"""Queries of the results engine: hierarchy, judging, joins, aggregates, analytics, linkage, geometry, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulara.functions import text as T
from tabulara.functions.numbers import number_key, number_value, parse_int
from tabulara.operators import aggregate as A
from tabulara.operators import analytics as V
from tabulara.operators import donor as D
from tabulara.operators import geometry as G
from tabulara.operators import hierarchy as H
from tabulara.operators import match as M
from tabulara.operators import validate as X
from tabulara.operators.validate import q
from tabulara.plans.dealt import rows_of, table
from tabulara.schemas import CONTEST_OPTIONS, COPY_FIELDS, COUNTS, GEO, PARTIES, PARTY_OPTIONS
from tabulara.sources.files import set_digest
from tabulara.sources.publish import audit

PILPRES_OPTIONS = ["pemilih-1", "pemilih-2"]
CONTESTS = ["dpr", "dprdprov", "dprdkab"]
#: Provinces whose polling places may count more than 1000, as cleaned names.
EXEMPT = ["+MANCANEGARA"]
SOURCES = ["situs", "arsip", "hasil"]


def spine(spark: SparkSession, d: str) -> DataFrame:
    return H.spine(table(spark, d, "wilayah"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return H.nodes(spine(spark, d))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return X.contest_rows(rows_of(spark, d, "hasil_tps"), spine(spark, d), EXEMPT)


def rolled(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of all levels above the village with their results, parent and name."""
    s = spine(spark, d)
    districts = A.district_totals(A.village_totals(X.contest_rows(rows_of(spark, d, "hasil_tps"), s, EXEMPT)))
    up = A.national_rollup(districts, s, CONTESTS)
    named = H.nodes(s).select("key", "name")
    parent = F.when(F.col("level") == 0, F.lit(None).cast("string")).when(F.col("level") == 1, "P").otherwise(T.parent_key(F.col("key")))
    return up.withColumn("parent_key", parent).join(named, "key", "left")


def hierarchy_flat(spark, d):
    return nodes(spark, d)


def hierarchy_paths(spark, d):
    return H.with_ancestors(nodes(spark, d)).select("level", "key", F.array_join("path", ">").alias("path"), "breadcrumb")


def hierarchy_recursive(spark, d):
    """The same walk as a recursive query, for hierarchies of unknown depth."""
    return spark.sql(
        """WITH RECURSIVE walk(key, depth, trail) AS (
             SELECT key, 1, key FROM {n} WHERE parent_key = '' UNION ALL SELECT n.key, w.depth + 1, w.trail || '>' || n.key FROM walk w JOIN {n} n ON n.parent_key = w.key)
           SELECT key, depth, trail FROM walk""",
        n=nodes(spark, d),
    )


def hierarchy_repeated(spark, d):
    return H.repeated(table(spark, d, "wilayah"), *H.CODES)


def hierarchy_reconcile(spark, d):
    code = lambda name: table(spark, d, name).select(F.substring(T.trimmed(F.col("id")), F.lit(1), F.length(T.trimmed(F.col("id"))) - 9).alias("code")).distinct()
    return H.reconcile(code("pilpres_situs"), code("pilpres_arsip"))


def hierarchy_nested(spark, d):
    """The nested form, read back: per province its regencies, districts and villages."""
    kab = F.from_json("json", "kab ARRAY<STRUCT<k:STRING,kec:ARRAY<STRUCT<k:STRING,kel:ARRAY<STRUCT<k:STRING,n:STRING>>>>>>")["kab"]
    kec = F.flatten(F.transform(kab, lambda x: x["kec"]))
    kel = F.flatten(F.transform(kec, lambda x: x["kel"]))
    return H.nested_hierarchy(spine(spark, d)).select("k", F.size(kab).alias("n_regencies"), F.size(kec).alias("n_districts"), F.size(kel).alias("n_villages"), F.array_max(F.transform(kel, lambda x: x["n"])).alias("last_name"))


def hierarchy_with_results(spark, d):
    """As hierarchy_nested, of the villages that have results in some contest only."""
    have = A.included(judged(spark, d)).select(*H.CODES).distinct()
    some = H.nested_hierarchy(spine(spark, d).join(have, list(H.CODES), "left_semi"))
    kec = F.flatten(F.transform(F.from_json("json", "kab ARRAY<STRUCT<kec:ARRAY<STRUCT<kel:ARRAY<STRUCT<k:STRING>>>>>>")["kab"], lambda x: x["kec"]))
    return some.select("k", F.size(kec).alias("n_districts"), F.size(F.flatten(F.transform(kec, lambda x: x["kel"]))).alias("n_villages"))


def clean_names(spark, d):
    names = table(spark, d, "hasil_tps").select(F.explode(F.array(*(q(c) for c in GEO))).alias("raw")).distinct()
    return names.select("raw", T.clean_name(F.col("raw")).alias("name"))


def canonical_names(spark, d):
    names = table(spark, d, "wilayah").select(F.explode(F.array(*H.NAMES)).alias("raw")).distinct()
    return M.canonical_columns(names.withColumn("canon", F.col("raw")), "canon").withColumn("tight", T.compact(F.col("canon")))


def parse_int_edges(spark, d):
    cells = table(spark, d, "hasil_tps").select(F.explode(F.array(*(q(c) for c in [*PARTIES, *COUNTS]))).alias("text")).distinct()
    return cells.select("text", parse_int(F.col("text")).alias("p")).select("text", "p.value", "p.malformed")


def tps_numbers(spark, d):
    labels = table(spark, d, "hasil_tps").select("tps").distinct()
    return labels.select("tps", T.tps_digits(F.col("tps")).alias("by_digits"), T.tps_plain(F.col("tps")).alias("plain"))


def year_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", T.latest_year(F.col("text")).alias("year"))


def text_formats(spark, d):
    n = nodes(spark, d).select("key", "name")
    return n.select("key", T.csv_cell(F.col("name")).alias("cell"), T.html_escape(F.col("name")).alias("html"), T.slug(F.col("name")).alias("slug"), T.column_key(F.col("name")).alias("column_key"), T.parent_key(F.col("key"), 2).alias("grandparent"))


def judged_rows(spark, d):
    return judged(spark, d).select("contest", "file_path", "row_no", "reject_reason", "was_ambiguous", "blank_result", "n_malformed", "stats_valid", "vote_outlier", "is_conflict")


def concat_prefix_resolve(spark, d):
    return judged(spark, d).where("kodekel IS NOT NULL").select("row_no", "rid", T.path_key(*map(F.col, H.CODES)).alias("village_key"), "was_ambiguous")


def reject_waterfall(spark, d):
    return judged(spark, d).groupBy("contest", "reject_reason").agg(F.count("*").alias("n"))


def blank_rows(spark, d):
    return judged(spark, d).where("blank_result").select("contest", "row_no", "reject_reason")


def outlier_flags(spark, d):
    return judged(spark, d).where("vote_outlier").select("contest", "row_no", F.greatest(*(q(c) for c in PARTIES)).alias("most"))


def conflict_classify(spark, d):
    return judged(spark, d).where("reject_reason = 'duplicate_id'").groupBy("contest").agg(F.count("*").alias("n_repeats"), F.count_if("is_conflict").alias("n_conflicting"))


def _situs(spark, d):
    t = rows_of(spark, d, "pilpres_situs")
    code = T.trimmed(F.col("id"))
    return t.select(F.lit("situs").alias("file_path"), "row_no", F.substring(code, F.lit(1), F.length(code) - 9).alias("village_code"), "tps", "provinsi", *(q(c) for c in COPY_FIELDS))


def export_waterfall(spark, d):
    return X.export_rows(_situs(spark, d), spine(spark, d), COPY_FIELDS).select("row_no", "tps_no", "reject_reason")


def _donors(spark, d):
    t = rows_of(spark, d, "pilpres_arsip")
    code = T.trimmed(F.col("id"))
    rows = t.select("row_no", F.substring(code, F.lit(1), F.length(code) - 9).alias("village_code"), T.tps_digits(F.col("tps")).alias("tps_no"), *(number_key(q(c)).alias(a) for c, a in (("total-pemilih", "registered"), ("total-pengguna", "users"))))
    rows = rows.withColumns({c: number_value(F.col(c)) for c in ("registered", "users")})
    return rows.where("tps_no IS NOT NULL AND registered >= 0 AND users >= 0")


def donor_index(spark, d):
    return D.donor_index(_donors(spark, d))


def donor_conflicts(spark, d):
    return D.donor_conflicts(_donors(spark, d), "row_no")


def _lent(spark, d):
    rows = _situs(spark, d).select("row_no", "village_code", T.tps_plain(F.col("tps")).alias("tps_no"), T.clean_name(F.col("provinsi")).alias("province"))
    return D.lend(rows, donor_index(spark, d))


def donor_join(spark, d):
    return _lent(spark, d).select("row_no", "registered", "users", "has_donor")


def donor_by_province(spark, d):
    return D.matched_by(_lent(spark, d), "province")


def village_agg(spark, d):
    return A.village_totals(judged(spark, d))


def district_agg(spark, d):
    return A.district_totals(A.village_totals(judged(spark, d)))


def rollup_national(spark, d):
    return rolled(spark, d).drop("name")


def source_totals(spark, d):
    return A.source_totals(judged(spark, d))


def totals_reconcile(spark, d):
    return A.reconciliation(judged(spark, d))


def anomaly_counters(spark, d):
    return A.anomaly_counters(judged(spark, d))


def column_maxima(spark, d):
    return A.column_extremes(judged(spark, d), [*PARTIES, *COUNTS])


def capped_examples(spark, d):
    return A.capped_examples(judged(spark, d)).select("contest", "row_no", "reason", "rn")


def coverage_distinct(spark, d):
    return A.coverage(judged(spark, d))


def coverage_gap(spark, d):
    return A.coverage_gap(nodes(spark, d), judged(spark, d))


def file_counts(spark, d):
    t = table(spark, d, "hasil_tps")
    inventory = t.select("file_path").unionByName(table(spark, d, "rekaman_mentah").select("file_path"))
    return A.file_counts(judged(spark, d), inventory)


def contest_totals(spark, d):
    return A.contest_totals(judged(spark, d))


def union_contests(spark, d):
    """Valid votes of the four contests as delivered: legacy rows judged, of the presidential ones all that have a village, repeats included (its SQL is fixed). The judged union is union_totals."""
    long = A.village_totals(judged(spark, d)).select(T.path_key(*map(F.col, H.CODES)).alias("village_key"), "contest", q("suara-sah").alias("valid_votes"), "tps")
    s = _situs(spark, d).select("village_code", number_value(number_key(q("suara-sah"))).alias("v"))
    pilpres = s.join(spine(spark, d).select(F.col("concat").alias("village_code"), "key"), "village_code").groupBy("key").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("valid_votes"))
    return long.unionByName(pilpres.select(F.col("key").alias("village_key"), F.lit("pilpres").alias("contest"), "valid_votes"), allowMissingColumns=True)


def pilpres_totals(spark, d):
    """Village totals of the presidential contest: included rows of the export waterfall, participation lent by the other copy."""
    s = spine(spark, d)
    rows = X.export_rows(_situs(spark, d), s, [*PILPRES_OPTIONS, *COUNTS[2:]])
    return A.village_totals(X.lent_rows(D.lend(rows, donor_index(spark, d)), s, "pilpres", PILPRES_OPTIONS, EXEMPT), PILPRES_OPTIONS)


def union_totals(spark, d):
    """Village totals of the four contests in one result space: legacy rows with 20 options, presidential ones with two, all with the nine stats; what one side lacks is null."""
    both = A.village_totals(judged(spark, d)).unionByName(pilpres_totals(spark, d), allowMissingColumns=True)
    return both.withColumn("village_key", T.path_key(*map(F.col, H.CODES))).drop(*H.CODES)


def contest_options(spark, d):
    """Ballot order and labels of the options as the tables' columns have them, an unknown one last."""
    columns = lambda t: [c for c in table(spark, d, t).columns if c in CONTEST_OPTIONS or c in PARTIES]
    rows = [("pilpres", c, i) for i, c in enumerate(columns("pilpres_situs"))] + [("dpr", c, i) for i, c in enumerate(["calon-lain", *columns("hasil_tps")])]
    return V.option_dimension(spark.createDataFrame(rows, "contest string, column string, ordinal int"), CONTEST_OPTIONS | PARTY_OPTIONS)


def audit_sections(spark, d):
    """The audit of a build, assembled as one JSON document and read back: how many entries each section has."""
    j = judged(spark, d)
    whole = audit({"rejects": j.groupBy("contest", "reject_reason").agg(F.count("*").alias("n")), "totals": A.contest_totals(j), "coverage": A.coverage(j)})
    names = ["rejects", "totals", "coverage"]
    sections = F.explode(F.array(*(F.struct(F.lit(n).alias("section"), F.json_array_length(F.get_json_object("json", f"$.{n}")).alias("n")) for n in names))).alias("s")
    stamped = F.get_json_object("json", "$.generated_at").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z")
    return whole.select(sections, stamped.alias("stamped")).select("s.*", "stamped")


def alias_spellings(spark, d):
    """Spellings of a village's name in the rows that are not the hierarchy's."""
    rows = A.included(judged(spark, d)).select(F.concat(*H.CODES).alias("concat"), "g4").distinct()
    met = rows.join(spine(spark, d).select("concat", "key", T.clean_name(F.col("namakel")).alias("official")), "concat").where("g4 <> official")
    return met.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("g4")), "|").alias("spellings"))


def display_names(spark, d):
    """The name a village is shown by: the first legacy spelling, else the first presidential one, else the hierarchy's."""
    order = F.struct(F.array_position(F.array(*map(F.lit, CONTESTS)), F.col("contest")).alias("o"), "file_path", "row_no", "name")
    t = table(spark, d, "hasil_tps").select("row_no", T.trimmed(F.col("kelurahan")).alias("name"))
    legacy = A.included(judged(spark, d)).join(t, "row_no").groupBy(F.concat(*H.CODES).alias("concat")).agg(F.min(order).alias("m")).select("concat", F.col("m.name").alias("legacy"))
    code = T.trimmed(F.col("id"))
    p = table(spark, d, "pilpres_situs").select("row_no", F.substring(code, F.lit(1), F.length(code) - 9).alias("concat"), T.trimmed(F.col("kelurahan")).alias("name")).where("name <> ''")
    second = p.groupBy("concat").agg(F.min(F.struct("row_no", "name")).alias("m")).select("concat", F.col("m.name").alias("other"))
    every = spine(spark, d).select("concat", "key", "namakel").join(legacy, "concat", "left").join(second, "concat", "left")
    return every.select("key", F.coalesce("legacy", "other", "namakel").alias("name"))


def winner_by_region(spark, d):
    return V.with_winner(rolled(spark, d), PARTIES).select("level", "key", "contest", "total", "winner", "is_tie", "margin")


def tie_villages(spark, d):
    v = A.village_totals(judged(spark, d)).withColumn("key", T.path_key(*map(F.col, H.CODES)))
    return V.with_winner(v, PARTIES).where("is_tie").select("key", "contest", "total", F.array_join(V.leaders(PARTIES), ",").alias("leaders"))


def option_rank(spark, d):
    return V.option_ranks(rolled(spark, d), PARTIES, 6)


def option_share(spark, d):
    return V.option_ranks(rolled(spark, d).where("level <= 1"), PARTIES).select("key", "contest", "option", "share")


def tooltip_top3(spark, d):
    return V.option_ranks(rolled(spark, d), PARTIES, 3).select("key", "contest", "option", "share")


def bar_slices(spark, d):
    """Shares wide enough to be drawn."""
    return V.option_ranks(rolled(spark, d), PARTIES).where("share > 0.008").select("key", "contest", "option", "share")


def source_note(spark, d):
    """What stands behind the figures: nodes, covered districts of all, files and rows per contest."""
    top = rolled(spark, d).where("level = 0").select("contest", "covered", "total_units")
    n = nodes(spark, d).agg(F.count("*").alias("n_nodes")).first()[0]  # one number
    files = table(spark, d, "hasil_tps").groupBy("contest").agg(F.count_distinct("file_path").alias("n_files"), F.count("*").alias("n_rows"))
    return top.join(files, "contest").withColumn("n_nodes", F.lit(n))


def turnout(spark, d):
    return rolled(spark, d).select("key", "contest", V.turnout().alias("turnout"), V.invalid_rate().alias("invalid_rate"))


def coverage_note(spark, d):
    return V.coverage_notes(rolled(spark, d), PARTIES)


def turnout_domain(spark, d):
    return V.turnout_domain(rolled(spark, d).where("level > 0"), "parent_key", "contest")


def share_domain(spark, d):
    return V.share_domain(rolled(spark, d).where("level > 0"), PARTIES, "pdip", "parent_key", "contest")


def colour_class(spark, d):
    return V.colour_class(V.with_winner(rolled(spark, d), PARTIES))


def children_summary(spark, d):
    return V.children_summary(rolled(spark, d).where("level > 0"), PARTIES)


def table_sort_share(spark, d):
    return V.sorted_children(rolled(spark, d).where("level > 0"), PARTIES, "golkar")


def search_topk(spark, d):
    n = nodes(spark, d).withColumn("path_key", F.col("key"))
    return V.search(n, "ra").select("level", "key", "name")


def export_csv_lines(spark, d):
    return V.export_lines(rolled(spark, d).where("level > 0"), PARTIES)


def _catalogue(spark, d):
    """Distinct villages named in the three files of rows, as sources for linkage: source, fid, province, regency, district, village in canonical form."""
    parts = []
    for source, name in zip(SOURCES, ("pilpres_situs", "pilpres_arsip", "hasil_tps"), strict=True):
        raw = table(spark, d, name).select(*(T.clean_name(F.col(c)).alias(c) for c in GEO), "row_no")
        one = raw.groupBy(*GEO).agg(F.min("row_no").alias("fid"))
        parts.append(one.select(F.lit(source).alias("source"), "fid", F.col("provinsi").alias("province"), F.col("kabupaten").alias("regency"), F.col("kecamatan").alias("district"), F.col("kelurahan").alias("village")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return M.canonical_columns(every, "province", "regency", "district", "village")


def _canonical_nodes(spark, d):
    return M.canonical_columns(nodes(spark, d).withColumn("canon", F.col("name")), "canon")


def _resolved(spark, d):
    return M.resolve_parents(_catalogue(spark, d), _canonical_nodes(spark, d))


def unique_scope_index(spark, d):
    return M.unique_names(_canonical_nodes(spark, d).where("level = 4"), "parent_key", "canon")


def chained_resolve(spark, d):
    return _resolved(spark, d).select("source", "fid", "p_key", "k_key", "c_key", F.array_join("methods", ",").alias("methods"))


def source_priority_match(spark, d):
    return M.priority_match(_resolved(spark, d), SOURCES, "c_key")


def _village_targets(spark, d):
    n = _canonical_nodes(spark, d).where("level = 4")
    return n.select("key", T.parent_key(F.col("key"), 2).alias("k_key"), F.col("parent_key").alias("c_key"), F.col("canon").alias("village"))


def village_match_stages(spark, d):
    return M.match_villages(_resolved(spark, d), _village_targets(spark, d), SOURCES)[0]


def match_counts(spark, d):
    return M.match_counts(village_match_stages(spark, d))


def unresolved_parents(spark, d):
    return M.unresolved_counts(_resolved(spark, d))


def vintage_breakdown(spark, d):
    """Documents by source and the latest year they name."""
    docs = table(spark, d, "documents").select("source", T.latest_year(F.col("text")).alias("year"))
    return M.vintage_counts(docs, "source", "year", 2018)


def alias_join(spark, d):
    """District names through an alias table: here each village's old spelling leads to the district it lies in."""
    n = _canonical_nodes(spark, d)
    kec = n.where("level = 3").select(F.col("parent_key").alias("scope"), F.col("canon").alias("alias"))
    aliases = kec.groupBy("scope", "alias").agg(F.count("*").alias("n")).where("n = 1").select("scope", F.concat(F.lit("OLD "), F.col("alias")).alias("canon"), "alias")
    rows = aliases.select(F.col("scope").alias("k_key"), F.col("canon").alias("district"))
    return M.resolve(rows, "k_key", "district", n.where("level = 3"), aliases).select("k_key", "district", "target", "method")


def code_bridge(spark, d):
    """Suppliers as selected modern rows, customers as historic ones: dotted codes made of keys, equal nations as regencies."""
    code = lambda key, n: F.concat_ws(".", F.lpad((n % 100).cast("string"), 2, "0"), F.lit("01"), F.lit("02"), F.lpad((key % 500).cast("string"), 4, "0"))
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    rows = s.select(F.col("s_name").alias("target"), F.lit("modern").alias("source"), F.col("s_suppkey").alias("fid"), F.when(F.col("s_suppkey") % 7 != 0, code(F.col("s_suppkey"), F.col("s_nationkey"))).alias("code"), F.col("s_nationkey").cast("string").alias("k_key"))
    selected = rows.withColumn("target_regency", F.when(F.col("fid") % 11 != 0, F.col("k_key")).otherwise("x"))
    historic = c.select(F.col("c_custkey").alias("fid"), code(F.col("c_custkey"), F.col("c_nationkey")).alias("code"), F.col("c_nationkey").cast("string").alias("k_key"))
    return M.code_bridge(selected, rows, historic)


def best_overlap(spark, d):
    """For each archive district the site district of its province that shares most village names (two at least): most of its own names, then most names, then the first."""
    names = lambda t: table(spark, d, t).select(*(T.clean_name(F.col(c)).alias(c) for c in GEO)).distinct()
    a, b = names("pilpres_arsip"), names("pilpres_situs").withColumnsRenamed({"kabupaten": "b_kab", "kecamatan": "b_kec"})
    size = a.groupBy("provinsi", "kabupaten", "kecamatan").agg(F.count("*").alias("n_own"))
    shared = a.join(b, ["provinsi", "kelurahan"]).groupBy("provinsi", "kabupaten", "kecamatan", "b_kab", "b_kec").agg(F.count("*").alias("n_shared")).where("n_shared >= 2")
    place = F.row_number().over(Window.partitionBy("provinsi", "kabupaten", "kecamatan").orderBy(F.desc(F.col("n_shared") / F.col("n_own")), F.desc("n_shared"), "b_kab", "b_kec"))
    return shared.join(size, ["provinsi", "kabupaten", "kecamatan"]).withColumn("r", place).where("r = 1").drop("r")


def doc_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def tree_digest(spark, d):
    files = table(spark, d, "desa_file").select(F.col("path").alias("name"), F.sha2("content", 256).alias("sha256"))
    return set_digest(files)


def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


def _features(spark, d):
    f = rows_of(spark, d, "desa_file").select("file_id", F.explode(F.from_json(F.get_json_object("content", "$.features"), "ARRAY<STRUCT<properties:STRUCT<key:STRING,name:STRING,level:STRING,source:STRING,match:STRING>,geometry:STRING>>")).alias("f"))
    return f.select("file_id", "f.properties.*", G.from_geojson(F.col("f.geometry")).alias("g"))


def geojson_bounds(spark, d):
    return _features(spark, d).select("file_id", G.bounds(F.col("g")).alias("b")).groupBy("file_id").agg(F.count("*").alias("n"), F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


def geojson_area(spark, d):
    f = _features(spark, d)
    return f.groupBy("file_id").agg(F.round(F.sum(G.area(F.col("g"))), 9).alias("area"), F.sum(F.size("g")).alias("n_parts"), F.count_if(G.is_sound(F.col("g"))).alias("n_sound"))


def geojson_dissolve(spark, d):
    """Each district's outline from its villages (the first record of a key), simplified and snapped."""
    whole = G.simplify(G.dissolve(_first_features(spark, d), ["parent_key"], "g"), "g", G.TOLERANCE["district"])
    return whole.select("parent_key", F.size("g").alias("n_parts"), F.round(G.area(G.snapped(F.col("g"))), 6).alias("area"))


def _first_features(spark, d):
    """The record of each key that comes first."""
    f = _features(spark, d).where("key IS NOT NULL AND g IS NOT NULL").withColumn("ordinal", F.monotonically_increasing_id())
    return f.groupBy("key").agg(F.min_by(F.struct("name", "level", "source", "match", "g"), F.struct("file_id", "ordinal")).alias("x")).select("key", "x.*", T.parent_key(F.col("key")).alias("parent_key"))


def geojson_parents(spark, d):
    """Districts whose villages all have an outline, derived from them."""
    every = nodes(spark, d).where("level = 4").select("parent_key", "key")
    return G.derived_parents(_first_features(spark, d).select("parent_key", "key", "g"), every, "g", "derived-complete-villages").select("parent_key", "source", "match")


def geojson_provenance(spark, d):
    """Districts outlined by the villages that came as direct outlines: joined sources, and parts_union where there are several."""
    parts = _first_features(spark, d).select(F.col("parent_key").alias("key"), "source", "match", "g")
    direct = G.joined_parts(parts, "key", "source", "match", "g")
    derived = G.derived_parents(_first_features(spark, d).select("parent_key", "key", "g"), nodes(spark, d).where("level = 4").select("parent_key", "key"), "g", "derived-complete-villages").withColumnRenamed("parent_key", "key")
    return G.direct_first(direct.where(F.contains("source", F.lit("+"))), derived, "key").select("key", "source", "match")


def geojson_clean(spark, d):
    """What cleaning did to the village outlines, by layer."""
    g = G.clean(_features(spark, d), "g", G.TOLERANCE["village"])
    return g.groupBy("source", "cleaned").agg(F.count("*").alias("n"))


def geojson_collections(spark, d):
    """The layout for readers: one collection per district of the hierarchy, empty ones included."""
    one = _first_features(spark, d)
    feature = G.feature_json(*(F.col(c) for c in ("key", "name", "level", "source", "match", "g")))
    content = G.collections(nodes(spark, d).where("level = 3").select(F.col("key").alias("parent_key")), one.select(T.parent_key(F.col("key")).alias("parent_key"), "key", feature.alias("feature")))
    return content.select("parent_key", F.coalesce(F.json_array_length(F.get_json_object("content", "$.features")), F.lit(0)).alias("n_features"))


def winner_by_region_star(spark, d):
    """Leading return flag per region by whole units, over the star schema: the small dimensions meet first, the facts once."""
    dims = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(dims, F.col("o_custkey") == F.col("c_custkey"))
    sums = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("r_name", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("units"))
    ranked = F.rank().over(Window.partitionBy("r_name").orderBy(F.desc("units")))
    share = F.col("units") / F.sum("units").over(Window.partitionBy("r_name"))
    return sums.select("r_name", "l_returnflag", "units", ranked.alias("rank"), share.alias("share"))


def first_wins_lineitem(spark, d):
    """Line items by (order, line): the first in a total order stands, repeats are the same or conflict."""
    order = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    rows = table(spark, d, "lineitem")
    out = X.first_wins(rows, ["l_orderkey", "l_linenumber"], order, F.col("l_quantity"), F.lit(True))
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if("is_first").alias("n_first"), F.count_if("is_repeat").alias("n_repeats"), F.count_if("is_conflict").alias("n_conflicts"))


def rollup_star(spark, d):
    """Region, nation and all, with customers covered by orders out of all customers."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    met = c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.rollup("n_regionkey", "n_nationkey").agg(F.grouping_id().alias("gid"), F.sum("cents").alias("cents"), F.count("cents").alias("covered"), F.count("*").alias("total"))


QUERIES = [
    hierarchy_flat, hierarchy_paths, hierarchy_recursive, hierarchy_repeated, hierarchy_reconcile, hierarchy_nested, hierarchy_with_results, clean_names, canonical_names, parse_int_edges, tps_numbers, year_extract, text_formats,
    judged_rows, concat_prefix_resolve, reject_waterfall, blank_rows, outlier_flags, conflict_classify, export_waterfall, donor_index, donor_conflicts, donor_join, donor_by_province, village_agg, district_agg,
    rollup_national, source_totals, totals_reconcile, anomaly_counters, column_maxima, capped_examples, coverage_distinct, coverage_gap, file_counts, contest_totals, union_contests, union_totals, pilpres_totals, contest_options, audit_sections, alias_spellings, display_names,
    winner_by_region, tie_villages, option_rank, option_share, tooltip_top3, bar_slices, source_note, turnout, coverage_note, turnout_domain, share_domain, colour_class, children_summary, table_sort_share, search_topk, export_csv_lines,
    unique_scope_index, chained_resolve, source_priority_match, village_match_stages, match_counts, unresolved_parents, vintage_breakdown, alias_join, code_bridge, best_overlap, doc_digest, tree_digest, props_json, geojson_bounds, geojson_area,
    geojson_dissolve, geojson_parents, geojson_provenance, geojson_clean, geojson_collections, winner_by_region_star, first_wins_lineitem, rollup_star,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
