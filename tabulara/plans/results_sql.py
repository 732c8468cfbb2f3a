"""The same results as plans.results in SQL for DuckDB, from the tables up."""

from __future__ import annotations

from tabulara.plans.dealt_sql import name, number_key, strip
from tabulara.schemas import COPY_FIELDS, COUNTS, GEO, PARTIES

MEASURES = [*PARTIES, *COUNTS]
STATS = [*COUNTS, "tps", "validated-tps", "blank-tps", "outlier-vote-tps"]
CODES, NAMES = ["kodeprov", "kodekab", "kodekec", "kodekel"], ["namaprov", "namakab", "namakec", "namakel"]


def qq(c: str) -> str:
    return f'"{c}"'


def cols(names: list[str], prefix: str = "") -> str:
    return ", ".join(f"{prefix}{qq(c)}" for c in names)


def value(key: str) -> str:
    return f"CASE WHEN {key} IS NOT NULL AND {key}[1] <> '!' THEN CAST({key} AS BIGINT) END"


SPINE = f"""spine AS (SELECT * EXCLUDE (r), 'P' || kodeprov || '.' || kodekab || '.' || kodekec || '.' || kodekel AS key, kodeprov || kodekab || kodekec || kodekel AS concat FROM (
    SELECT *, row_number() OVER (PARTITION BY {", ".join(CODES)} ORDER BY created_at DESC, {", ".join(n + " DESC" for n in NAMES)}) AS r FROM wilayah) WHERE r = 1)"""
_KEYS = ["'P' || " + " || '.' || ".join(CODES[: i + 1]) for i in range(4)]
NODES = f"""{SPINE}, nodes AS (SELECT level, key, code, parent_key, min(name) AS name FROM (
    {" UNION ALL ".join(f"SELECT {i + 1} AS level, {_KEYS[i]} AS key, {CODES[i]} AS code, {_KEYS[i - 1] if i else "''"} AS parent_key, {NAMES[i]} AS name FROM spine" for i in range(4))}) GROUP BY ALL)"""

_KEYED = ", ".join(f"{number_key(qq(c))} AS {qq(c)}" for c in MEASURES)
_VALUES = ", ".join(f"coalesce({value(qq(c))}, 0) AS {qq(c)}" for c in MEASURES)
_BAD = " + ".join(f"CAST(coalesce({qq(c)}[1] = '!', false) AS INTEGER)" for c in MEASURES)
_SIG = f"ROW(g1, g2, g3, g4, {name('coalesce(tps, chr(0))')}, {cols(MEASURES)})"
_P, _U, _T, _S, _N = map(qq, COUNTS)
_STATS_OK = " AND ".join(f"{x} BETWEEN 0 AND CASE WHEN g1 = '+MANCANEGARA' THEN 9000000000000000000 ELSE 1000 END" for x in (_P, _U, _T, _S, _N))
JUDGED = f"""{NODES}, districts AS (SELECT g1, g2, g3, c.p AS dp, c.k AS dk, c.c AS dc FROM (SELECT {name("namaprov")} AS g1, {name("namakab")} AS g2, {name("namakec")} AS g3, min({{'p': kodeprov, 'k': kodekab, 'c': kodekec}}) AS c FROM spine GROUP BY ALL)),
  keyed AS (SELECT contest, file_path, row_no, {strip("id")} AS rid, {", ".join(f"{name(f"coalesce({c}, '')")} AS g{i + 1}" for i, c in enumerate(GEO))}, tps, {_KEYED} FROM hasil_tps),
  read AS (SELECT contest, file_path, row_no, rid, g1, g2, g3, g4, tps, {_VALUES}, {_BAD} AS n_malformed, {" AND ".join(f"{qq(c)} IS NULL" for c in MEASURES)} AS blank_result FROM keyed),
  placed AS (SELECT r.*, dp, dk, dc FROM read r LEFT JOIN districts USING (g1, g2, g3)),
  wanted AS (SELECT DISTINCT rid, dp, dk, dc, g4 FROM placed WHERE length(rid) > 4),
  hits AS (SELECT w.*, s.kodeprov AS p, s.kodekab AS k, s.kodekec AS c, s.kodekel AS l, s.kodeprov = dp AND s.kodekab = dk AND s.kodekec = dc AS same, {name("s.namakel")} = g4 AS named
    FROM (SELECT *, unnest(range(4, length(rid))) AS n FROM wanted) w JOIN spine s ON left(rid, n) = s.concat),
  found AS (SELECT rid, dp, dk, dc, g4, count(*) AS n, count(*) FILTER (same) AS ns, count(*) FILTER (named) AS nn, count(*) FILTER (same AND named) AS nb, min(ROW(p, k, c, l)) AS v1,
    min(ROW(p, k, c, l)) FILTER (same) AS vs, min(ROW(p, k, c, l)) FILTER (named) AS vn, min(ROW(p, k, c, l)) FILTER (same AND named) AS vb FROM hits GROUP BY ALL),
  chosen AS (SELECT rid, dp, dk, dc, g4, n > 1 AS was_ambiguous, CASE WHEN n = 1 THEN v1 WHEN ns = 1 THEN vs WHEN ns > 1 AND nb = 1 THEN vb WHEN ns = 0 AND nn = 1 THEN vn END AS v FROM found),
  resolved AS (SELECT p.*, coalesce(c.was_ambiguous, false) AS was_ambiguous, c.v[1] AS kodeprov, c.v[2] AS kodekab, c.v[3] AS kodekec, c.v[4] AS kodekel FROM placed p LEFT JOIN chosen c
    ON p.rid = c.rid AND p.dp IS NOT DISTINCT FROM c.dp AND p.dk IS NOT DISTINCT FROM c.dk AND p.dc IS NOT DISTINCT FROM c.dc AND p.g4 = c.g4),
  early_ AS (SELECT *, CASE WHEN coalesce(rid, '') = '' OR g1 = '' OR g2 = '' OR g3 = '' OR g4 = '' OR contains(rid || g1 || g2 || g3 || g4, chr(0)) THEN 'invalid_record' WHEN dp IS NULL THEN 'unmatched_district'
    WHEN kodekel IS NULL THEN 'unresolved_leaf_id' WHEN kodeprov <> dp OR kodekab <> dk OR kodekec <> dc THEN 'id_district_mismatch' WHEN n_malformed > 0 THEN 'malformed_numeric' END AS early FROM resolved),
  firsts AS (SELECT contest, row_no, row_number() OVER w AS rn, first_value({_SIG}) OVER w <> {_SIG} AS differs FROM early_ WHERE early IS NULL WINDOW w AS (PARTITION BY contest, rid ORDER BY file_path, row_no)),
  judged AS (SELECT e.* EXCLUDE (early), coalesce(early, CASE WHEN rn > 1 THEN 'duplicate_id' END) AS reject_reason, coalesce(rn > 1 AND differs, false) AS is_conflict,
    NOT blank_result AND {_STATS_OK} AND {_T} = {_S} + {_N} AND {_U} = {_T} AND {_U} <= {_P} AS stats_valid, g1 <> '+MANCANEGARA' AND greatest({cols(PARTIES)}) > 1000 AS vote_outlier
    FROM early_ e LEFT JOIN firsts f ON e.contest = f.contest AND e.row_no = f.row_no)"""

_SUMMANDS = ", ".join([*map(qq, PARTIES), *(f"CASE WHEN stats_valid THEN {qq(c)} ELSE 0 END AS {qq(c)}" for c in COUNTS), "1 AS tps", 'CAST(stats_valid AS INTEGER) AS "validated-tps"', 'CAST(blank_result AS INTEGER) AS "blank-tps"', 'CAST(vote_outlier AS INTEGER) AS "outlier-vote-tps"'])
ALL = [*PARTIES, *STATS]
_SUMS = ", ".join(f"CAST(sum({qq(c)}) AS BIGINT) AS {qq(c)}" for c in ALL)
TOTALS = f"""{JUDGED}, measured AS (SELECT contest, {", ".join(CODES)}, {_SUMMANDS} FROM judged WHERE reject_reason IS NULL),
  villages AS (SELECT {", ".join(CODES)}, contest, {_SUMS} FROM measured GROUP BY ALL),
  district_sums AS (SELECT {", ".join(CODES[:3])}, contest, {_SUMS} FROM villages GROUP BY ALL)"""
ROLLED = f"""{TOTALS}, every AS (SELECT * FROM (SELECT DISTINCT {", ".join(CODES[:3])} FROM spine), (SELECT unnest(['dpr', 'dprdprov', 'dprdkab']) AS contest)),
  met AS (SELECT e.*, {cols(ALL, "d.")}, d.tps IS NOT NULL AS has FROM every e LEFT JOIN district_sums d USING ({", ".join(CODES[:3])}, contest)),
  grown AS ({" UNION ALL ".join(f"SELECT {i} AS level, {_KEYS[i - 1] if i else "'P'"} AS key, * FROM met" for i in range(4))}),
  summed AS (SELECT level, key, contest, {_SUMS}, count(*) FILTER (has) AS covered, count(*) AS total_units FROM grown GROUP BY ALL),
  rolled AS (SELECT s.*, CASE level WHEN 0 THEN NULL WHEN 1 THEN 'P' ELSE regexp_replace(s.key, '[.][^.]*$', '') END AS parent_key, n.name, {" + ".join(map(qq, PARTIES))} AS votes FROM summed s LEFT JOIN (SELECT key, name FROM nodes) n USING (key))"""
_LIST = "[" + cols(PARTIES) + "]"
_LEAD = f"CASE WHEN votes > 0 THEN list_filter([{", ".join(f"CASE WHEN {qq(c)} = greatest({cols(PARTIES)}) THEN '{c}' END" for c in PARTIES)}], lambda x: x IS NOT NULL) ELSE [] END"
_DESC = f"list_reverse_sort({_LIST})"
WINNERS = f"""{ROLLED}, led AS (SELECT *, {_LEAD} AS l FROM rolled), winners AS (SELECT *, CASE WHEN len(l) = 1 THEN l[1] END AS winner, len(l) > 1 AS is_tie, CASE WHEN votes > 0 THEN ({_DESC}[1] - {_DESC}[2]) / votes END AS margin FROM led)"""
_TURNOUT = '''CASE WHEN "validated-tps" > 0 AND "total-pemilih" > 0 THEN "total-pengguna" / "total-pemilih" END'''
_INVALID = '''CASE WHEN "suara-total" > 0 THEN "suara-tidak-sah" / "suara-total" END'''
RANKS = f"""{ROLLED}, options AS ({" UNION ALL ".join(f"SELECT level, key, contest, '{c}' AS option, {i} AS o, {qq(c)} AS votes, votes AS total FROM rolled WHERE tps IS NOT NULL" for i, c in enumerate(PARTIES))}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY key, contest ORDER BY votes DESC, o) AS rank, CASE WHEN total <> 0 THEN votes / total END AS share FROM options)""".replace(f"AS votes, votes AS total", "AS votes_, votes AS total").replace("ORDER BY votes DESC", "ORDER BY votes_ DESC").replace("THEN votes / total", "THEN votes_ / total")

_CODE = lambda t: f"left({strip('id')}, length({strip('id')}) - 9)"
_SITUS = f"SELECT row_no, {_CODE('')} AS village_code, CASE WHEN regexp_full_match({strip('tps')}, '[0-9]+') THEN TRY_CAST({strip('tps')} AS BIGINT) END AS tps_no, provinsi, {', '.join(f'{number_key(qq(c))} AS {qq(c)}' for c in COPY_FIELDS)} FROM pilpres_situs"
DONORS = f"""WITH donors AS (SELECT * FROM (SELECT row_no, {_CODE('')} AS village_code, TRY_CAST(nullif(regexp_replace(coalesce(tps, ''), '[^0-9]', '', 'g'), '') AS BIGINT) AS tps_no, {value("p")} AS registered, {value("u")} AS users
    FROM (SELECT *, {number_key(_P)} AS p, {number_key(_U)} AS u FROM pilpres_arsip)) WHERE tps_no IS NOT NULL AND registered >= 0 AND users >= 0),
  index_ AS (SELECT village_code, tps_no, any_value(registered) AS registered, any_value(users) AS users FROM donors GROUP BY ALL HAVING count(DISTINCT ROW(registered, users)) = 1)"""
LENT = f"""{DONORS}, situs AS ({_SITUS}), lent AS (SELECT row_no, provinsi, coalesce(registered, 0) AS registered, coalesce(users, 0) AS users, registered IS NOT NULL AS has_donor FROM situs LEFT JOIN index_ USING (village_code, tps_no))"""

_VOTES = ["pemilih-1", "pemilih-2"]
_READ = [*_VOTES, *COUNTS[2:]]
PILPRES = f"""WITH {SPINE}, {DONORS.removeprefix("WITH ")}, situs AS ({_SITUS}),
  waiting AS (SELECT s.*, kodeprov, kodekab, kodekec, kodekel, {name("namaprov")} = '+MANCANEGARA' AS large FROM situs s JOIN spine ON village_code = concat WHERE tps_no IS NOT NULL),
  kept AS (SELECT * FROM waiting QUALIFY row_number() OVER (PARTITION BY village_code, tps_no ORDER BY row_no) = 1),
  good AS (SELECT kodeprov, kodekab, kodekec, kodekel, large, {" AND ".join(f"{qq(c)} IS NULL" for c in _READ)} AS empty_, registered IS NOT NULL AS donor, coalesce(registered, 0) AS r, coalesce(users, 0) AS u, {", ".join(f"coalesce({value(qq(c))}, 0) AS v{i}" for i, c in enumerate(_READ))}
    FROM kept LEFT JOIN index_ USING (village_code, tps_no) WHERE NOT ({" OR ".join(f"coalesce({qq(c)}[1] = '!', false)" for c in _READ)})),
  gated AS (SELECT *, NOT empty_ AND donor AND least(r, u, v2, v3, v4) >= 0 AND (large OR greatest(r, u, v2, v3, v4) <= 1000) AND v2 = v3 + v4 AND u = v2 AND u <= r AS ok, NOT large AND greatest(v0, v1) > 1000 AS far FROM good),
  pilpres_villages AS (SELECT kodeprov, kodekab, kodekec, kodekel, 'pilpres' AS contest, {", ".join(f'CAST(sum({e}) AS BIGINT) AS {qq(c)}' for c, e in [(_VOTES[0], "v0"), (_VOTES[1], "v1"), *((c, f"CASE WHEN ok THEN {v} ELSE 0 END") for c, v in zip(COUNTS, ("r", "u", "v2", "v3", "v4"), strict=True)), *zip(STATS[5:], ("1", "CAST(ok AS INTEGER)", "CAST(empty_ AS INTEGER)", "CAST(far AS INTEGER)"), strict=True)])} FROM gated GROUP BY ALL)"""
_OPTIONS = "SELECT * FROM (VALUES " + ", ".join(
    [f"('{k}', '{c}', {i}, '{label}', {known})" for k, rows in (
        ("pilpres", [("pemilih-1", "Jokowi–Ma''ruf", "true"), ("pemilih-2", "Prabowo–Sandi", "true")]),
        ("dpr", [*zip(PARTIES, "PKB|Gerindra|PDI-P|Golkar|NasDem|Garuda|Berkarya|PKS|Perindo|PPP|PSI|PAN|Hanura|Demokrat|PA|SIRA|PDA|PNA|PBB|PKPI".split("|"), ["true"] * 20, strict=True), ("calon-lain", "Calon Lain", "false")]),
    ) for i, (c, label, known) in enumerate(rows, 1)]
) + ") t(contest, \"column\", place, label, known)"
_FIRST = f"""WITH {NODES}, whole AS (SELECT file_id, unnest(json_extract(content, '$.features[*]')) AS f, generate_subscripts(json_extract(content, '$.features[*]'), 1) AS ordinal FROM desa_file),
  first_ AS (SELECT f->'properties'->>'key' AS key, f->'properties'->>'source' AS source, f->'properties'->>'match' AS match FROM whole
    WHERE (f->'properties'->>'key') IS NOT NULL AND (f->'geometry'->>'type') IN ('Polygon', 'MultiPolygon') QUALIFY row_number() OVER (PARTITION BY (f->'properties'->>'key') ORDER BY file_id, ordinal) = 1)"""


def canon(x: str) -> str:
    t = f"replace(upper(regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g')), '&', ' DAN ')"
    t = f"regexp_replace({t}, '\\bKOTA\\s+ADMINISTRASI\\b', 'ADMINISTRASI', 'g')"
    t = f"regexp_replace({t}, '\\bADM(INISTRASI)?\\.?\\s+KEP(ULAUAN)?\\.?\\b', 'ADMINISTRASI KEPULAUAN', 'g')"
    return f"trim(regexp_replace({t}, '[^A-Z0-9]+', ' ', 'g'))"


def tight(x: str) -> str:
    return f"replace({x}, ' ', '')"


_CAT = " UNION ALL ".join(
    f"SELECT '{s}' AS source, min(row_no) AS fid, {', '.join(f'{name(f"coalesce({c}, {chr(39)}{chr(39)})")} AS {c}' for c in GEO)} FROM {t} GROUP BY ALL" for s, t in (("situs", "pilpres_situs"), ("arsip", "pilpres_arsip"), ("hasil", "hasil_tps"))
)
LINK = f"""{NODES}, cnodes AS (SELECT *, {canon("name")} AS canon FROM nodes),
  cat AS (SELECT source, fid, {canon("provinsi")} AS province, {canon("kabupaten")} AS regency, {canon("kecamatan")} AS district, {canon("kelurahan")} AS village FROM ({_CAT})),
  exact AS (SELECT level, parent_key AS scope, canon AS norm, min(key) AS target FROM cnodes GROUP BY ALL HAVING count(*) = 1),
  tights AS (SELECT level, parent_key AS scope, {tight("canon")} AS norm, min(key) AS target FROM cnodes GROUP BY ALL HAVING count(*) = 1),
  l1 AS (SELECT c.*, coalesce(e.target, t.target) AS p_key, CASE WHEN e.target IS NOT NULL THEN 'exact' WHEN t.target IS NOT NULL THEN 'compact' END AS m1 FROM cat c
    LEFT JOIN exact e ON e.level = 1 AND e.scope = '' AND e.norm = province LEFT JOIN tights t ON t.level = 1 AND t.scope = '' AND t.norm = {tight("province")}),
  l2 AS (SELECT c.*, coalesce(e.target, t.target) AS k_key, CASE WHEN e.target IS NOT NULL THEN 'exact' WHEN t.target IS NOT NULL THEN 'compact' END AS m2 FROM l1 c
    LEFT JOIN exact e ON e.level = 2 AND e.scope = p_key AND e.norm = regency LEFT JOIN tights t ON t.level = 2 AND t.scope = p_key AND t.norm = {tight("regency")}),
  l3 AS (SELECT c.*, coalesce(e.target, t.target) AS c_key, CASE WHEN e.target IS NOT NULL THEN 'exact' WHEN t.target IS NOT NULL THEN 'compact' END AS m3 FROM l2 c
    LEFT JOIN exact e ON e.level = 3 AND e.scope = k_key AND e.norm = district LEFT JOIN tights t ON t.level = 3 AND t.scope = k_key AND t.norm = {tight("district")})"""

_FEATURES = """WITH f AS (SELECT file_id, unnest(json_extract(content, '$.features[*]')) AS f FROM desa_file),
  polys AS (SELECT file_id, row_number() OVER () AS fno, CASE WHEN (f->'geometry'->>'type') = 'Polygon' THEN [CAST(f->'geometry'->'coordinates' AS DOUBLE[][][])] WHEN (f->'geometry'->>'type') = 'MultiPolygon' THEN CAST(f->'geometry'->'coordinates' AS DOUBLE[][][][]) END AS g FROM f)"""


def oracle_sql() -> dict[str, str]:
    judged = lambda rest: f"WITH {JUDGED} {rest}"
    totals = lambda rest: f"WITH {TOTALS} {rest}"
    rolled = lambda rest: f"WITH {ROLLED} {rest}"
    winners = lambda rest: f"WITH {WINNERS} {rest}"
    reached = "(reject_reason IS NULL OR reject_reason IN ('malformed_numeric', 'duplicate_id'))"
    options = " + ".join(map(qq, PARTIES))
    anomalies = {
        **{r: f"reject_reason = '{r}'" for r in ("invalid_record", "unmatched_district", "unresolved_leaf_id", "id_district_mismatch", "duplicate_id")},
        "ambiguous_leaf_id": "was_ambiguous AND (reject_reason IS NULL OR reject_reason NOT IN ('invalid_record', 'unmatched_district'))",
        "blank_result_row": f"blank_result AND {reached}",
        "conflicting_duplicate_id": "is_conflict",
        "outlier_vote_row": "reject_reason IS NULL AND vote_outlier",
        "invalid_stats_row": "reject_reason IS NULL AND NOT stats_valid",
        "option_sum_ne_suara_sah": f"reject_reason IS NULL AND {options} <> {_S}",
        "suara_total_ne_sah_plus_tidak_sah": f"reject_reason IS NULL AND {_T} <> {_S} + {_N}",
        "pengguna_ne_suara_total": f"reject_reason IS NULL AND {_U} <> {_T}",
    }
    pkey = " || '.' || ".join(CODES)
    return {
        "hierarchy_flat": f"WITH {NODES} SELECT * FROM nodes",
        "hierarchy_paths": f"""WITH {NODES} SELECT a.level, a.key, array_to_string([x.key FOR x IN list_sort(list({{'level': b.level, 'key': b.key}}))], '>') AS path, array_to_string([x.name FOR x IN list_sort(list({{'level': b.level, 'name': b.name}}))], ' / ') AS breadcrumb
          FROM nodes a JOIN nodes b ON a.key = b.key OR starts_with(a.key, b.key || '.') GROUP BY ALL""",
        "hierarchy_recursive": f"WITH RECURSIVE {NODES}, walk AS (SELECT key, 1 AS depth, key AS trail FROM nodes WHERE parent_key = '' UNION ALL SELECT n.key, w.depth + 1, w.trail || '>' || n.key FROM walk w JOIN nodes n ON n.parent_key = w.key) SELECT * FROM walk",
        "hierarchy_repeated": f"SELECT {', '.join(CODES)}, count(*) AS n FROM wilayah GROUP BY ALL HAVING count(*) > 1",
        "hierarchy_reconcile": f"WITH a AS (SELECT DISTINCT {_CODE('')} AS code FROM pilpres_situs), b AS (SELECT DISTINCT {_CODE('')} AS code FROM pilpres_arsip) SELECT code, 'left' AS side FROM a WHERE code NOT IN (SELECT code FROM b) UNION ALL SELECT code, 'right' FROM b WHERE code NOT IN (SELECT code FROM a)",
        "hierarchy_nested": f"WITH {SPINE} SELECT kodeprov AS k, count(DISTINCT kodekab) AS n_regencies, count(DISTINCT ROW(kodekab, kodekec)) AS n_districts, count(*) AS n_villages, max(namakel) AS last_name FROM spine GROUP BY kodeprov",
        "clean_names": f"SELECT raw, {name("coalesce(raw, '')")} AS name FROM ({' UNION '.join(f'SELECT {c} AS raw FROM hasil_tps' for c in GEO)})",
        "hierarchy_with_results": judged(f"SELECT kodeprov AS k, count(DISTINCT ROW(kodekab, kodekec)) AS n_districts, count(*) AS n_villages FROM spine WHERE key IN (SELECT 'P' || {pkey} FROM judged WHERE reject_reason IS NULL) GROUP BY kodeprov"),
        "contest_options": _OPTIONS,
        "audit_sections": judged("""SELECT 'rejects' AS section, count(DISTINCT ROW(contest, reject_reason)) AS n, true AS stamped FROM judged UNION ALL SELECT 'totals', count(DISTINCT contest) + 1, true FROM judged
          UNION ALL SELECT 'coverage', count(DISTINCT contest), true FROM judged WHERE reject_reason IS NULL"""),
        "pilpres_totals": PILPRES + " SELECT * FROM pilpres_villages",
        "union_totals": totals(f""", {PILPRES.removeprefix("WITH ").removeprefix(SPINE + ", ")}, both_ AS (SELECT * FROM villages UNION ALL BY NAME SELECT * FROM pilpres_villages) SELECT * EXCLUDE ({", ".join(CODES)}), 'P' || {pkey} AS village_key FROM both_"""),
        "geojson_parents": f"""{_FIRST} SELECT d.parent_key, 'derived-complete-villages' AS source, 'union' AS match FROM nodes d LEFT JOIN first_ f ON f.key = d.key WHERE level = 4 GROUP BY d.parent_key HAVING count(f.key) = count(*)""",
        "geojson_provenance": f"""{_FIRST}, direct AS (SELECT regexp_replace(key, '[.][^.]*$', '') AS key, string_agg(DISTINCT source, '+' ORDER BY source) AS source, CASE WHEN count(*) > 1 THEN 'parts_union' ELSE min(match) END AS match FROM first_ GROUP BY 1),
          derived AS (SELECT d.parent_key AS key FROM nodes d LEFT JOIN first_ f ON f.key = d.key WHERE level = 4 GROUP BY d.parent_key HAVING count(f.key) = count(*)), plus AS (SELECT * FROM direct WHERE contains(source, '+'))
          SELECT * FROM plus UNION ALL SELECT key, 'derived-complete-villages', 'union' FROM derived WHERE key NOT IN (SELECT key FROM plus)""",
        "canonical_names": f"SELECT raw, {canon('raw')} AS canon, {tight(canon('raw'))} AS tight FROM ({' UNION '.join(f'SELECT {c} AS raw FROM wilayah' for c in NAMES)})",
        "parse_int_edges": f"""SELECT text, coalesce({value("k")}, CASE WHEN regexp_full_match({strip("text")}, '[+-]?[0-9.eE+-]+') THEN CAST(trunc(TRY_CAST({strip("text")} AS DOUBLE)) AS BIGINT) END, 0) AS value, coalesce(k[1] = '!', false) AS malformed
          FROM (SELECT text, {number_key("text")} AS k FROM ({" UNION ".join(f"SELECT {qq(c)} AS text FROM hasil_tps" for c in MEASURES)}))""",
        "tps_numbers": f"SELECT DISTINCT tps, TRY_CAST(nullif(regexp_replace(coalesce(tps, ''), '[^0-9]', '', 'g'), '') AS BIGINT) AS by_digits, CASE WHEN regexp_full_match({strip('tps')}, '[0-9]+') THEN TRY_CAST({strip('tps')} AS BIGINT) END AS plain FROM hasil_tps",
        "year_extract": "SELECT doc_id, list_max([CAST(y AS INTEGER) FOR y IN regexp_extract_all(text, '[0-9]+') IF regexp_full_match(y, '(19|20)[0-9][0-9]')]) AS year FROM documents",
        "text_formats": f"""WITH {NODES} SELECT key, CASE WHEN regexp_matches(name, '[",\\r\\n]') THEN '"' || replace(name, '"', '""') || '"' ELSE name END AS cell,
          replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
          CASE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') WHEN 'gerindra' THEN 'gerinda' ELSE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') END AS column_key, CASE WHEN level > 2 THEN regexp_replace(key, '[.][^.]*[.][^.]*$', '') END AS grandparent FROM nodes""",
        "judged_rows": judged("SELECT contest, file_path, row_no, reject_reason, was_ambiguous, blank_result, n_malformed, stats_valid, vote_outlier, is_conflict FROM judged"),
        "concat_prefix_resolve": judged(f"SELECT row_no, rid, 'P' || {pkey} AS village_key, was_ambiguous FROM judged WHERE kodekel IS NOT NULL"),
        "reject_waterfall": judged("SELECT contest, reject_reason, count(*) AS n FROM judged GROUP BY ALL"),
        "blank_rows": judged("SELECT contest, row_no, reject_reason FROM judged WHERE blank_result"),
        "outlier_flags": judged(f"SELECT contest, row_no, greatest({cols(PARTIES)}) AS most FROM judged WHERE vote_outlier"),
        "conflict_classify": judged("SELECT contest, count(*) AS n_repeats, count(*) FILTER (is_conflict) AS n_conflicting FROM judged WHERE reject_reason = 'duplicate_id' GROUP BY ALL"),
        "export_waterfall": f"""WITH {SPINE}, situs AS ({_SITUS}), a AS (SELECT *, CASE WHEN village_code NOT IN (SELECT concat FROM spine) THEN 'unknown_village_id' WHEN tps_no IS NULL THEN 'unreadable_tps' END AS early, {" OR ".join(f"coalesce({qq(c)}[1] = '!', false)" for c in COPY_FIELDS)} AS bad FROM situs),
          b AS (SELECT row_no, row_number() OVER (PARTITION BY village_code, tps_no ORDER BY row_no) AS rn FROM a WHERE early IS NULL)
          SELECT a.row_no, tps_no, coalesce(early, CASE WHEN rn > 1 THEN 'duplicate_natural_tps_key' WHEN bad THEN 'malformed_numeric' END) AS reject_reason FROM a LEFT JOIN b ON a.row_no = b.row_no""",
        "donor_index": DONORS + " SELECT * FROM index_",
        "donor_conflicts": DONORS + """, r AS (SELECT *, row_number() OVER (PARTITION BY village_code, tps_no ORDER BY row_no) AS n, first_value(ROW(registered, users)) OVER (PARTITION BY village_code, tps_no ORDER BY row_no) <> ROW(registered, users) AS differs FROM donors),
          c AS (SELECT n, bool_or(differs) OVER (PARTITION BY village_code, tps_no ORDER BY row_no) AS broken FROM r) SELECT count(*) FILTER (NOT broken) AS duplicate, count(*) FILTER (broken) AS conflicting_duplicate FROM c WHERE n > 1""",
        "donor_join": LENT + " SELECT row_no, registered, users, has_donor FROM lent",
        "donor_by_province": LENT + f" SELECT {name("coalesce(provinsi, '')")} AS province, count(*) FILTER (has_donor) AS matched, count(*) FILTER (NOT has_donor) AS unmatched FROM lent GROUP BY 1",
        "village_agg": totals("SELECT * FROM villages"),
        "district_agg": totals("SELECT * FROM district_sums"),
        "rollup_national": rolled("SELECT * EXCLUDE (votes, name) FROM rolled"),
        "source_totals": totals(f"""SELECT contest, {", ".join(f"CAST(sum({qq(c)}) AS BIGINT) AS {qq(c)}" for c in MEASURES)}, {", ".join(f'any_value({qq("v_" + c)}) AS {qq("v_" + c)}' for c in STATS)} FROM judged JOIN (
          SELECT contest, {", ".join(f'CAST(sum({qq(c)}) AS BIGINT) AS {qq("v_" + c)}' for c in STATS)} FROM measured GROUP BY contest) USING (contest) WHERE reject_reason IS NULL GROUP BY contest"""),
        "totals_reconcile": totals(f"""SELECT contest, column_name, n AS over_rows, n AS over_villages, n AS over_districts FROM (UNPIVOT (SELECT contest, {_SUMS} FROM measured GROUP BY contest) ON {cols(ALL)} INTO NAME column_name VALUE n)"""),
        "anomaly_counters": judged(" UNION ALL ".join(f"SELECT contest, '{a}' AS anomaly, count(*) FILTER ({t}) AS n FROM judged GROUP BY contest" for a, t in anomalies.items()) + f" UNION ALL SELECT contest, 'malformed_numeric', CAST(sum(CASE WHEN {reached} THEN n_malformed ELSE 0 END) AS BIGINT) FROM judged GROUP BY contest"),
        "column_maxima": judged(f""", long AS ({" UNION ALL ".join(f"SELECT contest, '{c}' AS column_name, {qq(c)} AS value, file_path, row_no FROM judged WHERE {reached}" for c in MEASURES)}),
          r AS (SELECT *, row_number() OVER (PARTITION BY contest, column_name ORDER BY value DESC, file_path, row_no) AS r, count(*) FILTER (value > 1000) OVER (PARTITION BY contest, column_name) AS n_over, count(*) FILTER (value < 0) OVER (PARTITION BY contest, column_name) AS n_negative FROM long)
          SELECT contest, column_name, n_over, n_negative, value AS max_value, file_path, row_no FROM r WHERE r = 1"""),
        "capped_examples": judged(""", e AS (SELECT contest, file_path, row_no, coalesce(reject_reason, CASE WHEN blank_result THEN 'blank_result_row' END) AS reason FROM judged),
          f AS (SELECT *, row_number() OVER (PARTITION BY contest, reason ORDER BY file_path, row_no) AS k FROM e WHERE reason IS NOT NULL),
          g AS (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY file_path, row_no) AS rn FROM f WHERE reason <> 'blank_result_row' OR k <= 3) SELECT contest, row_no, reason, rn FROM g WHERE rn <= 30"""),
        "coverage_distinct": judged(f"SELECT contest, {', '.join(f'count(DISTINCT {_KEYS[i]}) AS n_{n}' for i, n in enumerate(('provinces', 'regencies', 'districts', 'villages')))} FROM judged WHERE reject_reason IS NULL GROUP BY contest"),
        "coverage_gap": judged(f"SELECT key, name, parent_key FROM nodes WHERE level = 4 AND key NOT IN (SELECT 'P' || {pkey} FROM judged WHERE reject_reason IS NULL)"),
        "file_counts": judged("SELECT file_path, count(row_no) AS n_read, count(row_no) FILTER (reject_reason IS NULL) AS n_included, count(row_no) FILTER (reject_reason IS NOT NULL) AS n_rejected FROM (SELECT file_path FROM hasil_tps UNION SELECT file_path FROM rekaman_mentah) LEFT JOIN judged USING (file_path) GROUP BY ALL"),
        "contest_totals": judged("SELECT contest, count(DISTINCT file_path) AS n_files, count(*) AS n_rows, count(*) FILTER (reject_reason IS NULL) AS n_included, count(*) FILTER (reject_reason IS NOT NULL) AS n_rejected FROM judged GROUP BY ROLLUP (contest)"),
        "union_contests": totals(f""", situs AS ({_SITUS}) SELECT 'P' || {pkey} AS village_key, contest, {_S} AS valid_votes, tps FROM villages UNION ALL
          SELECT key, 'pilpres', CAST(coalesce(sum({value(_S)}), 0) AS BIGINT), NULL FROM situs JOIN spine ON village_code = concat GROUP BY key"""),
        "alias_spellings": judged(f"SELECT key, string_agg(g4, '|' ORDER BY g4) AS spellings FROM (SELECT DISTINCT s.key, g4 FROM judged j JOIN spine s USING ({', '.join(CODES)}) WHERE reject_reason IS NULL AND g4 <> {name('s.namakel')}) GROUP BY key"),
        "display_names": judged(f""", legacy AS (SELECT 'P' || {pkey} AS key, {strip("h.kelurahan")} AS n, row_number() OVER (PARTITION BY {", ".join("j." + c for c in CODES)} ORDER BY list_position(['dpr', 'dprdprov', 'dprdkab'], j.contest), j.file_path, j.row_no) AS r FROM judged j JOIN hasil_tps h USING (row_no) WHERE reject_reason IS NULL),
          other AS (SELECT {_CODE('')} AS concat, {strip("kelurahan")} AS n, row_number() OVER (PARTITION BY {_CODE('')} ORDER BY row_no) AS r FROM pilpres_situs WHERE {strip("kelurahan")} <> '')
          SELECT s.key, coalesce(l.n, o.n, s.namakel) AS name FROM spine s LEFT JOIN legacy l ON l.key = s.key AND l.r = 1 LEFT JOIN other o ON o.concat = s.concat AND o.r = 1""").replace("'P' || " + pkey + " AS key, " + strip("h.kelurahan"), "'P' || " + " || '.' || ".join("j." + c for c in CODES) + " AS key, " + strip("h.kelurahan")),
        "winner_by_region": winners("SELECT level, key, contest, votes AS total, winner, is_tie, margin FROM winners"),
        "tie_villages": totals(f", v AS (SELECT *, {options} AS votes, 'P' || {pkey} AS key FROM villages), l AS (SELECT *, {_LEAD} AS l FROM v) SELECT key, contest, votes AS total, array_to_string(l, ',') AS leaders FROM l WHERE len(l) > 1"),
        "option_rank": f"WITH {RANKS} SELECT key, contest, option, votes_ AS votes, rank, share FROM ranked WHERE rank <= 6",
        "option_share": f"WITH {RANKS} SELECT key, contest, option, share FROM ranked WHERE level <= 1",
        "tooltip_top3": f"WITH {RANKS} SELECT key, contest, option, share FROM ranked WHERE rank <= 3",
        "bar_slices": f"WITH {RANKS} SELECT key, contest, option, share FROM ranked WHERE share > 0.008",
        "source_note": rolled(", f AS (SELECT contest, count(DISTINCT file_path) AS n_files, count(*) AS n_rows FROM hasil_tps GROUP BY contest) SELECT contest, covered, total_units, n_files, n_rows, (SELECT count(*) FROM nodes) AS n_nodes FROM rolled JOIN f USING (contest) WHERE level = 0"),
        "turnout": rolled(f"SELECT key, contest, {_TURNOUT} AS turnout, {_INVALID} AS invalid_rate FROM rolled"),
        "coverage_note": rolled(f"""SELECT key, contest, tps IS NOT NULL AS present, greatest(0, coalesce(tps, 0) - coalesce("blank-tps", 0)) AS reported, greatest(0, coalesce(tps, 0) - coalesce("validated-tps", 0) - coalesce("blank-tps", 0)) AS rejected, votes - {_S} AS difference FROM rolled"""),
        "turnout_domain": rolled(f""", t AS (SELECT parent_key, contest, quantile_cont({_TURNOUT}, 0.02) AS a, quantile_cont({_TURNOUT}, 0.98) AS b FROM rolled WHERE level > 0 GROUP BY ALL), u AS (SELECT parent_key, contest, coalesce(a, 0.55) AS a, coalesce(b, 0.9) AS b FROM t)
          SELECT parent_key, contest, CASE WHEN b - a < 0.02 THEN greatest(0, a - 0.01) ELSE a END AS low, CASE WHEN b - a < 0.02 THEN b + 0.01 ELSE b END AS high FROM u"""),
        "share_domain": rolled("SELECT parent_key, contest, greatest(0.08, coalesce(nullif(max(CASE WHEN votes > 0 THEN pdip / votes END), 0), 0.5)) AS high FROM rolled WHERE level > 0 GROUP BY ALL"),
        "colour_class": winners("SELECT key, contest, CASE WHEN coalesce(votes, 0) <= 0 THEN 'no-data' WHEN is_tie THEN 'tie' WHEN winner IS NULL THEN 'no-data' ELSE 'winner' END AS class, CASE WHEN winner IS NOT NULL THEN least(1, margin / 0.5) END AS intensity FROM winners"),
        "children_summary": winners(f"SELECT parent_key, key, contest, votes AS total, winner, is_tie, margin, {_TURNOUT} AS turnout, {_INVALID} AS invalid_rate, covered, total_units, row_number() OVER (PARTITION BY parent_key, contest ORDER BY votes DESC NULLS LAST, key) AS place FROM winners WHERE level > 0"),
        "table_sort_share": rolled(", v AS (SELECT parent_key, key, contest, coalesce(CASE WHEN votes > 0 THEN golkar / votes END, -1) AS value FROM rolled WHERE level > 0) SELECT *, row_number() OVER (PARTITION BY parent_key, contest ORDER BY value DESC, key) AS place FROM v"),
        "search_topk": f"""WITH {NODES}, s AS (SELECT * FROM nodes WHERE starts_with(upper(name), 'RA') ORDER BY key LIMIT 40), w AS (SELECT *, row_number() OVER (ORDER BY key) AS i FROM nodes WHERE contains(upper(name), 'RA') AND NOT starts_with(upper(name), 'RA')),
          h AS (SELECT level, key, name FROM s UNION ALL SELECT level, key, name FROM w WHERE (SELECT count(*) FROM s) < 25 AND i + (SELECT count(*) FROM s) <= 40) SELECT * FROM h ORDER BY level, name, key LIMIT 30""",
        "export_csv_lines": rolled(f"""SELECT parent_key, key, contest, array_to_string([CASE WHEN regexp_matches(x, '[",\\r\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END FOR x IN [key, coalesce(name, ''), CAST(level AS VARCHAR), CASE WHEN tps IS NULL THEN '0' ELSE '1' END, coalesce(CAST(votes AS VARCHAR), ''),
          {", ".join(f"coalesce(CAST({qq(c)} AS VARCHAR), '')" for c in [*STATS, *PARTIES])}]], ',') AS line FROM rolled WHERE level > 0"""),
        "unique_scope_index": f"WITH {LINK} SELECT scope, norm, target FROM exact WHERE level = 4",
        "chained_resolve": f"WITH {LINK} SELECT source, fid, p_key, k_key, c_key, concat_ws(',', m1, m2, m3) AS methods FROM l3",
        "source_priority_match": f"""WITH {LINK}, r AS (SELECT c_key AS target, source, fid, list_position(['situs', 'arsip', 'hasil'], source) AS rank, 'compact' IN (m1, m2, m3) AS c FROM l3 WHERE c_key IS NOT NULL),
          b AS (SELECT *, min(rank) OVER (PARTITION BY target) AS best FROM r) SELECT target, source, fid, CASE WHEN bool_or(coalesce(c, false)) OVER (PARTITION BY target) THEN 'compact' ELSE 'exact' END AS method FROM b WHERE rank = best""",
        "unresolved_parents": f"WITH {LINK} SELECT source, count(*) AS n_rows, count(*) FILTER (p_key IS NULL) AS no_p_key, count(*) FILTER (k_key IS NULL) AS no_k_key, count(*) FILTER (c_key IS NULL) AS no_c_key FROM l3 GROUP BY source",
        "vintage_breakdown": """WITH y AS (SELECT source, list_max([CAST(y AS INTEGER) FOR y IN regexp_extract_all(text, '[0-9]+') IF regexp_full_match(y, '(19|20)[0-9][0-9]')]) AS year FROM documents)
          SELECT source, CASE WHEN year IS NULL THEN 'unknown' WHEN year <= 2018 THEN 'upto' ELSE 'after' END AS vintage, count(*) AS n FROM y GROUP BY ALL""",
        "alias_join": f"""WITH {LINK}, a AS (SELECT parent_key AS k_key, canon, min(key) AS target FROM cnodes WHERE level = 3 GROUP BY ALL HAVING count(*) = 1) SELECT k_key, 'OLD ' || canon AS district, target, 'alias' AS method FROM a""",
        "code_bridge": """WITH c AS (SELECT c_custkey AS fid, lpad(CAST(c_nationkey % 100 AS VARCHAR), 2, '0') || '0102' || lpad(CAST(c_custkey % 500 AS VARCHAR), 4, '0') AS digits, CAST(c_nationkey AS VARCHAR) AS k FROM customer),
          s AS (SELECT s_name AS target, s_suppkey AS fid, CASE WHEN s_suppkey % 7 <> 0 THEN lpad(CAST(s_nationkey % 100 AS VARCHAR), 2, '0') || '0102' || lpad(CAST(s_suppkey % 500 AS VARCHAR), 4, '0') END AS digits, CAST(s_nationkey AS VARCHAR) AS k, CASE WHEN s_suppkey % 11 <> 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'x' END AS t FROM supplier),
          o AS (SELECT digits, count(*) AS n, min(fid) AS fid, min(k) AS k FROM c GROUP BY digits), m AS (SELECT digits, count(*) AS n FROM s WHERE digits IS NOT NULL GROUP BY digits),
          r AS (SELECT s.*, o.fid AS ofid, CASE WHEN s.digits IS NULL THEN 'invalid_modern_code' WHEN m.n <> 1 THEN 'nonunique_selected_modern_code' WHEN coalesce(o.n, 0) <> 1 THEN 'missing_or_nonunique_historic_code' WHEN s.k <> s.t THEN 'modern_parent_regency_mismatch' WHEN o.k <> s.t THEN 'historic_parent_regency_mismatch' END AS block_reason FROM s LEFT JOIN o USING (digits) LEFT JOIN m USING (digits))
          SELECT target, 'modern' AS source, fid, CASE WHEN block_reason IS NULL THEN ofid END AS historic_fid, block_reason FROM r""",
        "best_overlap": f"""WITH a AS (SELECT DISTINCT {", ".join(f"{name(f"coalesce({c}, '')")} AS {c}" for c in GEO)} FROM pilpres_arsip), b AS (SELECT DISTINCT {", ".join(f"{name(f"coalesce({c}, '')")} AS {c}" for c in GEO)} FROM pilpres_situs),
          n AS (SELECT provinsi, kabupaten, kecamatan, count(*) AS n_own FROM a GROUP BY ALL), s AS (SELECT a.provinsi, a.kabupaten, a.kecamatan, b.kabupaten AS b_kab, b.kecamatan AS b_kec, count(*) AS n_shared FROM a JOIN b USING (provinsi, kelurahan) GROUP BY ALL HAVING count(*) >= 2),
          r AS (SELECT s.*, n_own, row_number() OVER (PARTITION BY s.provinsi, s.kabupaten, s.kecamatan ORDER BY n_shared / n_own DESC, n_shared DESC, b_kab, b_kec) AS r FROM s JOIN n USING (provinsi, kabupaten, kecamatan)) SELECT * EXCLUDE (r) FROM r WHERE r = 1""",
        "doc_digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "tree_digest": "SELECT count(*) AS n, sha256(string_agg(path || ':' || sha256(content), chr(10) ORDER BY path || ':' || sha256(content))) AS digest FROM desa_file",
        "props_json": "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events",
        "geojson_bounds": f"{_FEATURES}, pts AS (SELECT file_id, fno, unnest(flatten(flatten(g))) AS p FROM polys) SELECT file_id, count(DISTINCT fno) AS n, min(p[1]) AS x0, min(p[2]) AS y0, max(p[1]) AS x1, max(p[2]) AS y1 FROM pts GROUP BY file_id",
        "geojson_collections": f"""WITH {NODES}, k AS (SELECT DISTINCT f->'properties'->>'key' AS key FROM (SELECT unnest(json_extract(content, '$.features[*]')) AS f FROM desa_file) WHERE (f->'geometry'->>'type') IN ('Polygon', 'MultiPolygon')),
          p AS (SELECT regexp_replace(key, '[.][^.]*$', '') AS parent_key, count(*) AS n FROM k WHERE key IS NOT NULL GROUP BY 1) SELECT n.key AS parent_key, coalesce(p.n, 0) AS n_features FROM nodes n LEFT JOIN p ON p.parent_key = n.key WHERE level = 3""",
        "winner_by_region_star": """WITH u AS (SELECT r_name, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
          SELECT *, rank() OVER (PARTITION BY r_name ORDER BY units DESC) AS rank, units / sum(units) OVER (PARTITION BY r_name) AS share FROM u""",
        "first_wins_lineitem": """WITH r AS (SELECT l_returnflag, row_number() OVER w AS n, first_value(l_quantity) OVER w <> l_quantity AS differs FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice))
          SELECT l_returnflag, count(*) AS n, count(*) FILTER (n = 1) AS n_first, count(*) FILTER (n > 1) AS n_repeats, count(*) FILTER (n > 1 AND differs) AS n_conflicts FROM r GROUP BY ALL""",
        "rollup_star": """WITH per AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL)
          SELECT n_regionkey, n_nationkey, CAST(grouping_id(n_regionkey, n_nationkey) AS BIGINT) AS gid, CAST(sum(cents) AS BIGINT) AS cents, count(cents) AS covered, count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN per ON o_custkey = c_custkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""",
    }
