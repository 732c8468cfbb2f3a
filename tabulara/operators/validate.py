"""From delivered rows to judged rows: every row is kept, with one reject reason or none, and its flags.

Order of the rows, where the first of several counts, is (contest, file_path, row_no).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulara.functions.numbers import number_key, number_value, unreadable
from tabulara.functions.text import blank, clean_name, tps_plain, trimmed
from tabulara.operators.hierarchy import districts
from tabulara.schemas import COUNTS, EXPORT_NAMES, GEO, PARTIES

MEASURES = [*PARTIES, *COUNTS]
#: Fixed value: counts beyond it are doubted, except in provinces that the caller names.
LIMIT = 1000
NUL = "\x00"


def q(c: str) -> Column:
    return F.col(f"`{c}`")


def read_numbers(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with the columns read as BIGINT (0 where blank or unreadable; numbers beyond BIGINT are its ends), n_malformed (unreadable ones) and blank_result (all of them blank).

    A cell in plain digits, as nearly all are, is read by compiled code, column by column; only rows with another one take the full rule, cell by cell.
    """
    n = range(len(columns))
    others = [q(c) for c in rows.columns if c not in columns]
    rows = rows.select(*others, *(q(c).alias(f"_t{i}") for i, c in enumerate(columns)))
    rows = rows.select("*", *(F.expr(f"IF(CAST(TRY_CAST(_t{i} AS BIGINT) AS STRING) = _t{i}, TRY_CAST(_t{i} AS BIGINT), NULL) AS _p{i}") for i in n))
    odd = F.expr(" OR ".join(f"(_p{i} IS NULL AND _t{i} <> '')" for i in n))
    rows = rows.withColumn("_keys", F.when(odd, F.transform(F.array(*(f"_t{i}" for i in n)), number_key)))
    rows = rows.withColumn("_read", F.when(F.col("_keys").isNotNull(), F.transform("_keys", number_value)))
    values = [F.expr(f"coalesce(_p{i}, get(_read, {i}), 0L) AS `{c}`") for i, c in enumerate(columns)]
    bad = F.when(F.col("_keys").isNotNull(), F.size(F.filter("_keys", unreadable))).otherwise(0)
    empty = F.when(F.col("_keys").isNotNull(), F.forall("_keys", lambda k: k.isNull())).otherwise(F.coalesce(*(f"_p{i}" for i in n)).isNull())
    return rows.select(*others, *values, bad.alias("n_malformed"), empty.alias("blank_result"))


def resolve_codes(rows: DataFrame, villages: DataFrame) -> DataFrame:
    """rows (rid, d_prov, d_kab, d_kec, g4) with the village that a prefix of rid names: kodeprov … kodekel, or nulls, and was_ambiguous.

    A theta join by prefix, rewritten as an equi-join: the distinct beginnings of ids (as long as the longest code, so few) give their prefixes of 4 characters and more, which meet the concatenated codes. One hit
    is taken; of several the one in the row's district, else the only one with the row's village name (among those of its district, if any). Rows meet the found beginnings only, whatever their number.
    """
    longest = villages.agg(F.coalesce(F.max(F.length("concat")), F.lit(0))).scalar()
    rows = rows.withColumn("_head", F.substring("rid", F.lit(1), F.greatest(F.least(F.length("rid") - 1, longest), F.lit(0))))
    heads = rows.select("_head").where(F.length("_head") >= 4).distinct()
    prefixes = heads.select("_head", F.explode(F.transform(F.sequence(F.lit(4), F.length("_head")), lambda n: F.substring("_head", F.lit(1), n))).alias("concat"))
    known = villages.select("concat", F.struct("kodeprov", "kodekab", "kodekec", "kodekel", clean_name(F.col("namakel")).alias("name")).alias("v"))
    found = prefixes.join(known, "concat").groupBy("_head").agg(F.collect_list("v").alias("_hits"))  # a few per beginning, however many rows have it
    joined = rows.join(found, "_head", "left")
    hits = F.col("_hits")
    same = F.filter(hits, lambda v: (v["kodeprov"] == F.col("d_prov")) & (v["kodekab"] == F.col("d_kab")) & (v["kodekec"] == F.col("d_kec")))
    rest = F.when(F.size("_same") > 0, F.col("_same")).otherwise(hits)
    named = F.filter(rest, lambda v: v["name"] == F.col("g4"))
    chosen = F.when(F.size(hits) == 1, F.get(hits, F.lit(0))).when(F.size("_same") == 1, F.get("_same", F.lit(0))).when(F.size("_named") == 1, F.get("_named", F.lit(0)))
    several = F.size(hits) > 1
    joined = joined.withColumn("_same", F.when(several, same)).withColumn("_named", F.when(several, named)).withColumn("_v", chosen)
    codes = [F.col(f"_v.{c}").alias(c) for c in ("kodeprov", "kodekab", "kodekec", "kodekel")]
    return joined.select(*(c for c in rows.columns if c != "_head"), *codes, F.coalesce(several, F.lit(False)).alias("was_ambiguous"))


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str], signature: Column, among: Column, again: DataFrame | None = None) -> DataFrame:
    """rows with is_first, is_repeat and is_conflict (a repeat whose signature differs from the first's), counted among the rows where `among` holds.

    The first row of a key is a minimum, so repeats of a hot key are combined before the shuffle and no group is gathered. again: the rows whose key is there several times, if the caller can tell them before
    all the others are worked out; only they are searched then, and all other rows meet the few firsts found.
    """
    place = F.struct(*order)
    marked = lambda df: df.withColumn("_sig", signature).withColumn("_among", among)
    rows = marked(rows)
    first = (rows if again is None else marked(again)).where("_among").groupBy(*key).agg(F.min(F.struct(place.alias("at"), F.col("_sig").alias("sig"))).alias("_first"))
    joined = rows.join(first, list(key), "left")
    repeat = F.coalesce(F.col("_among") & (place != F.col("_first.at")), F.lit(False))
    out = joined.withColumn("is_first", F.col("_among") & ~repeat).withColumn("is_repeat", repeat)
    return out.withColumn("is_conflict", F.coalesce(repeat & (F.col("_sig") != F.col("_first.sig")), F.lit(False))).drop("_sig", "_among", "_first")


def several(rows: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is there more than once."""
    return rows.join(rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(*key), list(key), "left_semi")


def contest_rows(delivered: DataFrame, villages: DataFrame, exempt: Sequence[str] = (), measures: Sequence[str] = MEASURES) -> DataFrame:
    """Rows of the contest files judged.

    reject_reason: invalid_record, unmatched_district, unresolved_leaf_id, id_district_mismatch, malformed_numeric, duplicate_id or null, the first that holds; a repeat is looked for among the rows that pass
    everything else. Flags of every row: blank_result, n_malformed, stats_valid, vote_outlier, was_ambiguous, is_conflict. exempt: cleaned names of provinces whose counts may exceed LIMIT.
    """
    named = delivered.select("contest", trimmed(q("id")).alias("rid"), "file_path", "row_no", *map(q, GEO), "tps", *map(q, measures))
    g = [F.col(f"g{i}") for i in range(1, 5)]
    bad_text = F.contains(F.concat_ws("", "rid", *g), F.lit(NUL))
    invalid = (F.coalesce("rid", F.lit("")) == "") | (F.least(*(F.length(x) for x in g)) == 0) | bad_text
    early = (
        F.when(invalid, "invalid_record")
        .when(F.col("d_prov").isNull(), "unmatched_district")
        .when(F.col("kodekel").isNull(), "unresolved_leaf_id")
        .when((F.col("kodeprov") != F.col("d_prov")) | (F.col("kodekab") != F.col("d_kab")) | (F.col("kodekec") != F.col("d_kec")), "id_district_mismatch")
        .when(F.col("n_malformed") > 0, "malformed_numeric")
    )

    def judged(rows: DataFrame) -> DataFrame:
        rows = rows.select("contest", "rid", "file_path", "row_no", *(clean_name(q(c)).alias(f"g{i + 1}") for i, c in enumerate(GEO)), "tps", *map(q, measures))
        rows = read_numbers(rows, measures).join(districts(villages), ["g1", "g2", "g3"], "left")
        return resolve_codes(rows, villages).withColumn("early", early)

    cells = [*g, clean_name(F.col("tps")), *(q(c) for c in measures)]
    signature = F.struct(F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells))  # 128 bits stand for the cells
    rows = first_wins(judged(named), ["contest", "rid"], ["file_path", "row_no"], signature, F.col("early").isNull(), judged(several(named, "contest", "rid")))
    large = F.col("g1").isin(*exempt) if exempt else F.lit(False)
    pemilih, pengguna, total, sah, tidak_sah = (q(c) for c in COUNTS)
    stats = [pemilih, pengguna, total, sah, tidak_sah]
    valid = ~F.col("blank_result") & (F.least(*stats) >= 0) & (large | (F.greatest(*stats) <= LIMIT)) & (total == sah + tidak_sah) & (pengguna == total) & (pengguna <= pemilih)
    outlier = ~large & (F.greatest(*(q(c) for c in measures if c not in COUNTS)) > LIMIT)
    reason = F.coalesce("early", F.when(F.col("is_repeat"), "duplicate_id"))
    return rows.withColumn("reject_reason", reason).withColumn("stats_valid", valid).withColumn("vote_outlier", outlier).drop("early", "is_first", "is_repeat")


def named_exports(exports: DataFrame) -> DataFrame:
    """Rows of the export files with the column names of the other contests; village_code and tps are their two ids."""
    return exports.withColumnsRenamed({**EXPORT_NAMES, "id_wilayah": "village_code", "id_tps": "tps"})


def export_rows(delivered: DataFrame, villages: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Rows (file_path, row_no, village_code, tps, measures) judged by the waterfall of the exports: unknown_village_id, unreadable_tps, duplicate_natural_tps_key, malformed_numeric.

    A malformed row still takes its key (village, number of the polling place), so a later good row is a repeat. The measures come out as numbers (0 where blank or unreadable), with blank_result.
    """
    known = villages.select(F.col("concat").alias("village_code")).distinct().withColumn("known", F.lit(True))
    rows = read_numbers(delivered.select("file_path", "row_no", "village_code", tps_plain(F.col("tps")).alias("tps_no"), *map(q, measures)), measures).join(known, "village_code", "left")
    early = F.when(F.col("known").isNull(), "unknown_village_id").when(F.col("tps_no").isNull(), "unreadable_tps")
    rows = first_wins(rows.withColumn("early", early), ["village_code", "tps_no"], ["file_path", "row_no"], F.lit(0), F.col("early").isNull())
    reason = F.coalesce("early", F.when(F.col("is_repeat"), "duplicate_natural_tps_key"), F.when(F.col("n_malformed") > 0, "malformed_numeric"))
    return rows.withColumn("reject_reason", reason).drop("known", "early", "n_malformed", "is_first", "is_repeat", "is_conflict")


def lent_rows(lent: DataFrame, villages: DataFrame, contest: str, options: Sequence[str], exempt: Sequence[str] = ()) -> DataFrame:
    """Rows of export_rows with a donor's registered and users (donor.lend) as judged rows of the contest, with codes, stats_valid (which takes a donor) and vote_outlier."""
    names = villages.select(F.col("concat").alias("village_code"), "kodeprov", "kodekab", "kodekec", "kodekel", clean_name(F.col("namaprov")).isin(*exempt).alias("large"))
    pemilih, pengguna = F.col("registered"), F.col("users")
    total, sah, tidak_sah = (q(c) for c in COUNTS[2:])
    stats = [pemilih, pengguna, total, sah, tidak_sah]
    large = F.col("large")
    valid = ~F.col("blank_result") & F.col("has_donor") & (F.least(*stats) >= 0) & (large | (F.greatest(*stats) <= LIMIT)) & (total == sah + tidak_sah) & (pengguna == total) & (pengguna <= pemilih)
    outlier = ~large & (F.greatest(*(q(c) for c in options)) > LIMIT)
    rows = lent.join(names, "village_code", "left").withColumns({COUNTS[0]: pemilih, COUNTS[1]: pengguna, "stats_valid": valid, "vote_outlier": outlier, "contest": F.lit(contest)})
    return rows.drop("registered", "users", "large")
