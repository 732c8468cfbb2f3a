from pyspark.sql import functions as F

from tabulara.operators import aggregate as A
from tabulara.operators import analytics as V
from tabulara.operators import donor as D
from tabulara.operators import hierarchy as H
from tabulara.operators import validate as X
from tabulara.plans import results as Q
from tabulara.schemas import PARTIES

SP = "kodeprov string, namaprov string, kodekab string, namakab string, kodekec string, namakec string, kodekel string, namakel string, created_at timestamp_ntz, deleted_at timestamp_ntz"
IDS = [("1", "P", "1492", "K", "1753", "C", "1776", "V"), ("1", "P", "2", "K2", "9", "C2", "20", "W"), ("12920", "Q", "5", "K5", "6", "C6", "7", "W"), ("12", "R", "34", "K3", "5", "C5", "6", "D"), ("123", "R", "4", "K3", "5", "C5", "6", "D")]


def spine(spark):
    return H.spine(spark.createDataFrame([(*r, None, None) for r in IDS], SP))


def delivered(spark, rows):
    columns = ["id", "provinsi", "kabupaten", "kecamatan", "kelurahan", "tps", *PARTIES, *X.COUNTS]
    base = dict.fromkeys(columns, "0") | {"tps": "1", "total-pemilih": "300", "total-pengguna": "250", "suara-total": "250", "suara-sah": "245", "suara-tidak-sah": "5"}
    data = [("dpr", "f", i, *((base | r)[c] for c in columns)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "contest string, file_path string, row_no bigint, " + ", ".join(f"`{c}` string" for c in columns))


def geo(p, k, c, v, id_, **more):
    return {"provinsi": p, "kabupaten": k, "kecamatan": c, "kelurahan": v, "id": id_} | more


def judge(spark, rows, **kw):
    return {r.row_no: r for r in X.contest_rows(delivered(spark, rows), spine(spark), **kw).collect()}


def test_waterfall(spark):
    ok = geo(" p ", "k", "C", "v", "1149217531776900003704")
    got = judge(spark, [
        ok, ok | {"pkb": "7"}, ok, geo("P", "K", "C", "V", ""), geo("P", "K", "C", None, "1"), geo("P", "K", "C", "V", "1\x00"), geo("P", "K", "none", "V", "1149217531776900003704"), geo("P", "K", "C", "V", "1149"),
        geo("Q", "K5", "C6", "W", "1149217531776900003705"), ok | {"id": "1149217531776900003706", "pkb": "x"}, ok | {"id": "1149217531776900003706"},
    ])
    assert [got[i].reject_reason for i in range(11)] == [None, "duplicate_id", "duplicate_id", "invalid_record", "invalid_record", "invalid_record", "unmatched_district", "unresolved_leaf_id", "id_district_mismatch", "malformed_numeric", None]
    assert [got[i].is_conflict for i in range(3)] == [False, True, False] and got[0].kodekel == "1776"


def test_ambiguous_prefix(spark):
    got = judge(spark, [geo("Q", "K5", "C6", "W", "12920567900000001"), geo("P", "K2", "C2", "W", "12920900000001"), geo("R", "K3", "C5", "D", "123456900000001")])
    assert got[0].was_ambiguous and (got[0].kodeprov, got[0].kodekel) == ("12920", "7")
    assert not got[1].was_ambiguous and got[1].kodeprov == "1"
    assert got[2].was_ambiguous and got[2].kodeprov == "12"  # two readings; the row's district decides


def test_gate_blank_outlier(spark):
    base = geo("P", "K", "C", "V", "x")
    blank = dict.fromkeys([*PARTIES, *X.COUNTS], " ")
    rows = [base, base | {"total-pemilih": "200"}, base | blank, base | {"pkb": "1001"}, base | {"total-pemilih": "1500"}, base | {"suara-sah": "244"}, base | {"suara-tidak-sah": "-5", "suara-sah": "255"}]
    rows = [r | {"id": f"114921753177690000370{i}"} for i, r in enumerate(rows)]
    got = judge(spark, rows)
    assert [got[i].stats_valid for i in range(7)] == [True, False, False, True, False, False, False]
    assert got[2].blank_result and not got[1].blank_result and got[3].vote_outlier and not got[0].vote_outlier
    free = judge(spark, rows, exempt=["P"])
    assert free[4].stats_valid and not free[3].vote_outlier


def test_export_waterfall(spark):
    data = [("f", 1, "114921753 1776".replace(" ", ""), "1", "x"), ("f", 2, "1149217531776", "01", "5"), ("f", 3, "1149217531776", "TPS 2", "5"), ("f", 4, "nowhere", "1", "5"), ("f", 5, "1149217531776", "3", "5")]
    df = spark.createDataFrame(data, "file_path string, row_no bigint, village_code string, tps string, m string")
    got = {r.row_no: r.reject_reason for r in X.export_rows(df, spine(spark), ["m"]).collect()}
    assert got == {1: "malformed_numeric", 2: "duplicate_natural_tps_key", 3: "unreadable_tps", 4: "unknown_village_id", 5: None}


def test_donor_conflict(spark, rows):
    s = "o int, village_code string, tps_no bigint, registered bigint, users bigint"
    df = spark.createDataFrame([(i, "v", 1, a, 5) for i, a in enumerate((10, 10, 11, 10))] + [(9, "v", 2, 7, 3), (10, "v", 2, 7, 3)], s)
    assert rows(D.donor_index(df)) == [("v", 2, 7, 3)]
    assert rows(D.donor_conflicts(df, "o")) == [(2, 2)]
    lent = D.lend(spark.createDataFrame([(1, "v", 1), (2, "v", 2), (3, "v", None)], "row_no int, village_code string, tps_no bigint"), D.donor_index(df))
    assert {r.row_no: (r.has_donor, r.registered) for r in lent.collect()} == {1: (False, 0), 2: (True, 7), 3: (False, 0)}


def test_ties_margins_turnout(spark):
    s = "key string, contest string, tps bigint, a bigint, b bigint, `validated-tps` bigint, `total-pemilih` bigint, `total-pengguna` bigint"
    df = spark.createDataFrame([("tie", "x", 1, 17, 17, 0, 9, 9), ("none", "x", None, None, None, None, None, None), ("zero", "x", 1, 0, 0, 1, 0, 0), ("won", "x", 1, 3, 1, 1, 10, 8)], s)
    got = {r.key: r for r in V.with_winner(df, ["a", "b"]).withColumn("t", V.turnout()).collect()}
    assert got["tie"].winner is None and got["tie"].is_tie and got["tie"].margin == 0 and got["tie"].t is None
    assert got["none"].winner is None and not got["none"].is_tie and got["none"].margin is None and got["none"].total is None
    assert got["zero"].winner is None and got["zero"].margin is None and got["zero"].t is None
    assert got["won"].winner == "a" and got["won"].margin == 0.5 and got["won"].t == 0.8


def test_turnout_percentiles(spark):
    s = "g string, tps bigint, `validated-tps` bigint, `total-pemilih` bigint, `total-pengguna` bigint"
    df = spark.createDataFrame([("x", 1, 1, 1, n) for n in (1, 2, 5)] + [("y", None, None, None, None), ("z", 1, 1, 2, 1)], s)
    got = {r.g: (round(r.low, 9), round(r.high, 9)) for r in V.turnout_domain(df, "g").collect()}
    assert got == {"x": (1.04, 4.88), "y": (0.55, 0.9), "z": (0.49, 0.51)}


def test_invariants(spark, sf):
    judged = Q.judged(spark, sf).cache()
    assert judged.count() == Q.table(spark, sf, "hasil_tps").count()
    assert A.reconciliation(judged).where("over_rows <> over_villages OR over_rows <> over_districts OR over_rows IS NULL").count() == 0
    v = A.village_totals(judged)
    assert v.where("`total-pengguna` > `total-pemilih` OR `validated-tps` + `blank-tps` > tps OR `outlier-vote-tps` > tps").count() == 0
    assert H.repeated(v, *H.CODES, "contest").count() == 0
    w = V.with_winner(Q.rolled(spark, sf), PARTIES)
    assert w.where("(is_tie OR total IS NULL OR total = 0) AND winner IS NOT NULL").count() == 0
    judged.unpersist()


def test_helpers(spark, rows):
    n = H.nodes(spine(spark))
    assert H.children_of(n, "P1").count() == 2 and H.children_of(n, "P1.2.9.20").count() == 1
    related = n.where(H.is_related(F.col("key"), "P1.2")).select("key")
    assert sorted(r.key for r in related.collect()) == ["P1", "P1.2", "P1.2.9", "P1.2.9.20"]
    assert V.search(n.withColumn("path_key", F.col("key")), "x").count() == 0


def test_union_holds_judged_presidential_totals(spark, sf):
    from collections import defaultdict

    from tabulara.operators import aggregate as A
    from tabulara.plans import results as R
    from tabulara.plans.dealt import table
    from tabulara.schemas import COUNTS, PARTIES

    def number(t):
        t = (t or "").strip()
        try:
            return int(t) if t else 0
        except ValueError:
            try:
                return int(float(t)) if float(t).is_integer() else None
            except ValueError:
                return None

    villages = {r.concat: (r.key, " ".join(r.namaprov.upper().split()) in R.EXEMPT) for r in R.spine(spark, sf).collect()}
    donors = defaultdict(set)
    for r in table(spark, sf, "pilpres_arsip").collect():
        no, pair = "".join(x for x in r.tps or "" if x.isdigit()), (number(r["total-pemilih"]), number(r["total-pengguna"]))
        blank = any(not (r[c] or "").strip() for c in COUNTS[:2])
        if no and not blank and None not in pair and min(pair) >= 0:
            donors[(r.id or "").strip()[:-9], int(no)].add(pair)
    want, seen, dropped = {}, set(), 0
    for r in table(spark, sf, "pilpres_situs").orderBy("row_no").collect():
        code, no = (r.id or "").strip()[:-9], (r.tps or "").strip()
        if code not in villages or not no.isdigit() or (code, int(no)) in seen:
            dropped += code in villages
            continue
        seen.add((code, int(no)))
        texts = [r[c] for c in (*R.PILPRES_OPTIONS, *COUNTS[2:])]
        values = [number(t) for t in texts]
        if None in values:
            dropped += 1
            continue
        key, large = villages[code]
        pairs = donors[code, int(no)]
        blank = not any((t or "").strip() for t in texts)
        stats = [*(next(iter(pairs)) if len(pairs) == 1 else (0, 0)), *values[2:]]
        ok = not blank and len(pairs) == 1 and min(stats) >= 0 and (large or max(stats) <= 1000) and stats[2] == stats[3] + stats[4] and stats[1] == stats[2] and stats[1] <= stats[0]
        row = [*values[:2], *(stats if ok else [0] * 5), 1, int(ok), int(blank), int(not large and max(values[:2]) > 1000)]
        want[key] = [a + b for a, b in zip(want.get(key, [0] * 11), row, strict=True)]
    union = R.union_totals(spark, sf)
    assert set(union.columns) == {"village_key", "contest", *PARTIES, *R.PILPRES_OPTIONS, *A.STATS}
    got = {r.village_key: [r[c] for c in (*R.PILPRES_OPTIONS, *A.STATS)] for r in union.where("contest = 'pilpres'").collect()}
    assert got == want and dropped > 0 and sum(v[8] for v in want.values()) > 0
    assert union.where("contest <> 'pilpres'").count() == A.village_totals(R.judged(spark, sf)).count()
