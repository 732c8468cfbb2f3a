"""The same results as plans.dealt in SQL for DuckDB, by another way: row-by-row checks, self joins and windows over whole tables."""

from __future__ import annotations

from tabulara.schemas import CONTEST_COLUMNS, COPY_FIELDS, COUNTS, PARTIES

_WS = r"[\t\n\v\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def name(x: str) -> str:
    return f"upper(regexp_replace({strip(x)}, '{_WS}+', ' ', 'g'))"


def number_key(x: str) -> str:
    t, run = strip(x), "[0-9]+(_[0-9]+)*"
    f = f"TRY_CAST(replace({t}, '_', '') AS DOUBLE)"
    return f"""CASE WHEN coalesce({t}, '') = '' THEN NULL
      WHEN regexp_full_match({t}, '[+-]?{run}') THEN CAST(CAST(replace(replace({t}, '_', ''), '+', '') AS HUGEINT) AS VARCHAR)
      WHEN regexp_full_match({t}, '[+-]?({run}([.]({run})?)?|[.]{run})([eE][+-]?{run})?') AND {f} = floor({f}) THEN CAST(CAST({f} AS HUGEINT) AS VARCHAR)
      ELSE '!' || {t} END"""


def _p1_rows(table: str) -> str:
    geo = ["provinsi", "kabupaten", "kecamatan", "kelurahan"]
    named = " AND ".join(f"coalesce({strip(c)}, '') <> ''" for c in geo)
    sid = strip("id")
    return f"""SELECT '{table}' AS table_name, row_no, 'id' AS field, left({sid}, greatest(length({sid}) - 9, 0)) AS key, loaded_at AS seen FROM {table} WHERE coalesce({sid}, '') <> ''
      UNION ALL SELECT '{table}', row_no, 'kelurahan', {" || chr(31) || ".join(name(c) for c in geo)}, loaded_at FROM {table} WHERE {named}"""


P1 = f"""WITH refs AS ({_p1_rows("hasil_tps")} UNION ALL {_p1_rows("pilpres_situs")}),
  dim AS (SELECT DISTINCT 'id' AS field, kodeprov || kodekab || kodekec || kodekel AS key, created_at, deleted_at FROM wilayah
    UNION SELECT 'kelurahan', {" || chr(31) || ".join(name(c) for c in ("namaprov", "namakab", "namakec", "namakel"))}, created_at, deleted_at FROM wilayah),
  met AS (SELECT r.table_name, r.row_no, r.field, r.seen, bool_or(d.created_at <= r.seen AND (d.deleted_at IS NULL OR r.seen < d.deleted_at)) AS live, bool_or(d.created_at <= r.seen) AS begun, count(d.key) AS n
    FROM refs r LEFT JOIN dim d USING (field, key) WHERE r.seen IS NOT NULL GROUP BY ALL),
  found AS (SELECT table_name, row_no, field, CASE WHEN n = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'later' END AS reason, strftime(seen, '%Y-%m') AS period FROM met WHERE NOT coalesce(live, false))"""

_F = '("([^"]|"")*"|[^",]*)'
_FIELDS = "list_transform(regexp_extract_all(',' || line, ',(\"(?:[^\"]|\"\")*\"|[^\",]*)', 1), lambda x: CASE WHEN x[1] = '\"' THEN replace(x[2:len(x) - 1], '\"\"', '\"') ELSE x END)"
_HEADER = ",".join(CONTEST_COLUMNS)
P2 = f"""WITH lines AS (SELECT *, regexp_replace(raw_line, '(\\r\\n|\\n|\\r)$', '') AS line FROM rekaman_mentah WHERE coalesce({strip("raw_line")}, '') <> ''),
  judged AS (SELECT *, regexp_full_match(line, '{_F}(,{_F})*') AS quoted FROM lines),
  split AS (SELECT *, CASE WHEN quoted THEN {_FIELDS} END AS f, NOT quoted OR regexp_full_match(line, '{_F.replace(",]", ",\\r\\n]")}(,{_F.replace(",]", ",\\r\\n]")})*') AS one FROM judged),
  rows_ AS (SELECT *, f IS NOT NULL AND len(f) = 38 AND list_aggregate(list_transform(f, lambda x: {strip("x")}), 'string_agg', ',') IN ('{_HEADER}', chr(65279) || '{_HEADER}') AS header FROM split),
  bad AS (SELECT *, CASE WHEN NOT quoted THEN 'broken_quoting' WHEN len(f) <> 38 OR NOT one THEN 'column_count' END AS whole,
    NOT regexp_full_match({strip("f[1]")}, '[0-9]+') AS b_id, NOT regexp_full_match({strip("f[6]")}, '([Tt][Pp][Ss]{_WS}*)?[0-9]+') AS b_tps, coalesce(({number_key("f[28]")})[1] = '!', false) AS b_total FROM rows_ WHERE NOT header),
  found AS (SELECT raw_no, whole AS reason, '' AS field FROM bad WHERE whole IS NOT NULL
    UNION ALL SELECT raw_no, 'invalid_value', 'id' FROM bad WHERE whole IS NULL AND b_id
    UNION ALL SELECT raw_no, 'invalid_value', 'tps' FROM bad WHERE whole IS NULL AND b_tps
    UNION ALL SELECT raw_no, 'invalid_value', 'total-pemilih' FROM bad WHERE whole IS NULL AND b_total)"""
P2_LOADED = P2 + f""" SELECT raw_no, contest, loaded_at, {", ".join(f'f[{i + 1}] AS "{c}"' for i, c in enumerate(CONTEST_COLUMNS))} FROM bad WHERE whole IS NULL AND NOT b_id AND NOT b_tps AND NOT b_total"""

P3_RECORDS = """WITH features AS (SELECT file_id, run_id, unnest(json_extract(content, '$.features[*]')) AS f, generate_subscripts(json_extract(content, '$.features[*]'), 1) - 1 AS ordinal FROM desa_file),
  records AS (SELECT file_id, run_id, ordinal, nullif(f->'properties'->>'key', '') AS key, f->'properties'->>'name' AS name, f->'properties'->>'level' AS level, f->'properties'->>'source' AS source,
    f->'properties'->>'match' AS match, f->'geometry'->>'type' AS kind, TRY_CAST(f->'geometry'->'coordinates' AS DOUBLE[][][]) AS p, TRY_CAST(f->'geometry'->'coordinates' AS DOUBLE[][][][]) AS mp FROM features)"""
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("name", "level", "source", "match", "kind", "p", "mp"))
P3 = f"{P3_RECORDS} SELECT DISTINCT a.file_id AS file_a, b.file_id AS file_b, a.key FROM records a JOIN records b ON a.run_id = b.run_id AND a.key = b.key AND a.file_id < b.file_id AND {_SAME}"
P3_CONSOLIDATED = f"""{P3_RECORDS}, keyed AS (SELECT run_id, key, file_id, ordinal, count(*) OVER w AS n_copies, row_number() OVER (w ORDER BY file_id, ordinal) AS r
  FROM records WHERE key IS NOT NULL WINDOW w AS (PARTITION BY run_id, key, name, level, source, match, kind, p, mp))
  SELECT run_id, key, file_id, CAST(ordinal AS INTEGER) AS ordinal, n_copies FROM keyed WHERE r = 1 UNION ALL SELECT run_id, NULL, file_id, CAST(ordinal AS INTEGER), 1 FROM records WHERE key IS NULL"""
P3_INDEX = "SELECT file_id, run_id, path, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS sha256 FROM desa_file"


def _p4(columns: list[str]) -> str:
    cells = " UNION ALL ".join(f"""SELECT load_id, '{c}' AS column_name, {number_key(f'"{c}"')} AS k FROM hasil_tps""" for c in columns)
    return f"""WITH cells AS ({cells}), read AS (SELECT load_id, column_name, k, CASE WHEN k[1] <> '!' THEN CAST(k AS BIGINT) END AS v FROM cells),
  stats AS (SELECT column_name, load_id, count(*) AS n_rows, count(*) FILTER (k IS NULL) AS n_missing, count(*) FILTER (k[1] = '!') AS n_unreadable, count(v) AS n_numbers, count(DISTINCT v) AS n_distinct,
    min(v) AS min_value, max(v) AS max_value FROM read GROUP BY ALL)"""


_P4_PAIRS = """, pairs AS (SELECT s.*, m.prev_load_id, p.n_rows AS p_n_rows, p.n_missing AS p_n_missing, p.n_unreadable AS p_n_unreadable, p.n_numbers AS p_n_numbers, p.n_distinct AS p_n_distinct,
    p.min_value AS p_min_value, p.max_value AS p_max_value FROM stats s JOIN muatan m USING (load_id) JOIN stats p ON p.load_id = m.prev_load_id AND p.column_name = s.column_name),
  both_ AS (SELECT q.column_name, q.load_id, r.v, 1 AS a, 0 AS b FROM pairs q JOIN read r USING (column_name, load_id) WHERE r.v IS NOT NULL
    UNION ALL SELECT q.column_name, q.load_id, r.v, 0, 1 FROM pairs q JOIN read r ON r.column_name = q.column_name AND r.load_id = q.prev_load_id WHERE r.v IS NOT NULL),
  merged AS (SELECT column_name, load_id, v, sum(a) AS a, sum(b) AS b FROM both_ GROUP BY ALL),
  curves AS (SELECT column_name, load_id, v, a, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM merged WINDOW w AS (PARTITION BY column_name, load_id ORDER BY v)),
  met AS (SELECT column_name, load_id, CAST(sum(CASE WHEN v < p_min_value OR v > p_max_value THEN a ELSE 0 END) AS BIGINT) AS n_outside,
    max(CASE WHEN n_numbers > 0 AND p_n_numbers > 0 THEN abs(ca / n_numbers - cb / p_n_numbers) END) AS ks,
    coalesce(bool_or(abs(ca * p_n_numbers - cb * n_numbers) * 1000 > 250 * n_numbers * p_n_numbers), false) AND any_value(n_numbers > 0 AND p_n_numbers > 0) AS far
    FROM curves JOIN pairs USING (column_name, load_id) GROUP BY ALL),
  tests AS (SELECT p.*, n_outside, ks, [
    CASE WHEN abs(n_missing * p_n_rows - p_n_missing * n_rows) * 1000 > 50 * n_rows * p_n_rows THEN 'null_rate' END,
    CASE WHEN n_rows > n_missing AND p_n_rows > p_n_missing AND abs(n_unreadable * (p_n_rows - p_n_missing) - p_n_unreadable * (n_rows - n_missing)) * 1000 > 20 * (n_rows - n_missing) * (p_n_rows - p_n_missing) THEN 'pattern' END,
    CASE WHEN n_numbers > 0 AND p_n_numbers > 0 AND n_outside * 1000 > 20 * n_numbers THEN 'value_range' END,
    CASE WHEN n_distinct * 2 < p_n_distinct OR n_distinct > 2 * p_n_distinct THEN 'distinct_count' END,
    CASE WHEN far THEN 'distribution' END] AS f FROM pairs p LEFT JOIN met USING (column_name, load_id))"""
P4 = _p4(["pkb", "suara-tidak-sah", "total-pemilih"]) + _P4_PAIRS + ", t AS (SELECT load_id, column_name, unnest(f) AS finding FROM tests) SELECT * FROM t WHERE finding IS NOT NULL"
_ALL = [*PARTIES, *COUNTS]
P4_CHANGES = _p4(_ALL) + _P4_PAIRS + " SELECT * EXCLUDE (f), array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS findings FROM tests"
P4_PROFILE = (
    _p4(_ALL)
    + """ SELECT s.*, n_missing / n_rows AS missing_rate, CASE WHEN n_rows > n_missing THEN n_unreadable / (n_rows - n_missing) END AS unreadable_rate, q25, q50, q75 FROM stats s LEFT JOIN (
  SELECT column_name, load_id, quantile_disc(v, 0.25) AS q25, quantile_disc(v, 0.5) AS q50, quantile_disc(v, 0.75) AS q75 FROM read WHERE v IS NOT NULL GROUP BY ALL) USING (column_name, load_id)"""
)

_NAMED = "(?s).*\\p{L}.*"
_TEXT_PATTERNS = {
    "id": "[0-9]+", "provinsi": _NAMED, "kabupaten": _NAMED, "kecamatan": _NAMED, "kelurahan": _NAMED, "tps": f"([Tt][Pp][Ss]{_WS}*)?[0-9]+",
    "timestamp": "([0-9]{4}-[0-9]{2}-[0-9]{2}[ T]|[0-9]{2}/[0-9]{2}/[0-9]{4} )[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?Z?", **{f"c1-{i}": r"[^ \t\n\x0B\f\r]+[.][A-Za-z0-9]+" for i in range(1, 7)},
}


def _p4_texts() -> str:
    cells = " UNION ALL ".join(f"""SELECT load_id, '{c}' AS column_name, {strip(f'"{c}"')} AS t, regexp_full_match({strip(f'"{c}"')}, '{x}') AS fits FROM hasil_tps""" for c, x in _TEXT_PATTERNS.items())
    return f"""WITH cells AS ({cells}), read AS (SELECT load_id, column_name, nullif(t, '') AS v, fits FROM cells),
  stats AS (SELECT column_name, load_id, count(*) AS n_rows, count(*) - count(v) AS n_missing, count(*) FILTER (v IS NOT NULL AND NOT fits) AS n_unreadable, count(v) AS n_numbers, count(DISTINCT v) AS n_distinct,
    min(v) AS min_value, max(v) AS max_value FROM read GROUP BY ALL)"""


def _as_text(sql: str, before: str = "") -> str:
    columns = ", ".join(f"{b}n_numbers AS {b}n_texts, {b}min_value AS {b}min_text, {b}max_value AS {b}max_text" for b in dict.fromkeys(("", before)))
    gone = ", ".join(f"{b}{c}" for b in dict.fromkeys(("", before)) for c in ("n_numbers", "min_value", "max_value"))
    quantiles = "" if before else ", q25, q50, q75"
    return f"SELECT * EXCLUDE ({gone}{quantiles}), {columns}{'' if before else ', q25 AS q25_text, q50 AS q50_text, q75 AS q75_text'} FROM ({sql})"


P4_PROFILE_ALL = f"SELECT * FROM ({P4_PROFILE}) UNION ALL BY NAME {_as_text(P4_PROFILE.replace(_p4(_ALL), _p4_texts()))}"
P4_CHANGES_ALL = f"SELECT * FROM ({P4_CHANGES}) UNION ALL BY NAME {_as_text(P4_CHANGES.replace(_p4(_ALL), _p4_texts()), 'p_')}"


def _copy(table: str) -> str:
    return f"""SELECT {strip("id")} AS id, {", ".join(f'{number_key(f'"{c}"')} AS k{i}' for i, c in enumerate(COPY_FIELDS))} FROM (
    SELECT *, row_number() OVER (PARTITION BY {strip("id")} ORDER BY row_no) AS r FROM {table} WHERE coalesce({strip("id")}, '') <> '') WHERE r = 1"""


P5 = f"""WITH a AS ({_copy("pilpres_situs")}), b AS ({_copy("pilpres_arsip")})
  SELECT id, '*' AS field, 'missing_in_arsip' AS kind FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT id, '*', 'missing_in_situs' FROM b WHERE id NOT IN (SELECT id FROM a)
  {" ".join(f"UNION ALL SELECT id, '{c}', 'differs' FROM a JOIN b USING (id) WHERE a.k{i} IS DISTINCT FROM b.k{i}" for i, c in enumerate(COPY_FIELDS))}"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1 + " SELECT * FROM found",
        "p1_report": P1 + " SELECT table_name, period, field, reason, count(*) AS n_orphans FROM found GROUP BY ALL",
        "p2_found": P2 + " SELECT * FROM found",
        "p2_loaded": P2_LOADED,
        "p3_found": P3,
        "p3_index": P3_INDEX,
        "p3_lookup": "SELECT file_id, path, sha256(content) AS sha256 FROM desa_file",
        "p3_consolidated": P3_CONSOLIDATED,
        "p4_found": P4,
        "p4_profile": P4_PROFILE,
        "p4_changes": P4_CHANGES,
        "p4_profile_all": P4_PROFILE_ALL,
        "p4_changes_all": P4_CHANGES_ALL,
        "p5_found": P5,
    }
