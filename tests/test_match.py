import random
from collections import defaultdict

from pyspark.sql import functions as F

from tabulara.operators import match as M

ROWS = "source string, fid bigint, province string, regency string, district string, village string"
NODES = "level int, key string, parent_key string, canon string"


def nodes(spark, extra=()):
    base = [(1, "P1", "", "NORTH"), (2, "P1.1", "P1", "EAST KAB"), (2, "P1.2", "P1", "WEST KAB"), (3, "P1.1.1", "P1.1", "AB C"), (3, "P1.1.2", "P1.1", "OTHER"), (3, "P1.2.1", "P1.2", "TWIN"), (3, "P1.2.2", "P1.2", "TWIN")]
    return spark.createDataFrame([*base, *extra], NODES)


def test_resolution(spark):
    rows = [("s", 1, "NORTH", "EAST KAB", "AB C", "v"), ("s", 2, "NORTH", "EASTKAB", "ABC", "v"), ("s", 3, "NORTH", "WEST KAB", "TWIN", "v"), ("s", 4, "SOUTH", "EAST KAB", "AB C", "v"), ("s", 5, "NORTH", "EAST KAB", "OLD", "v"), ("s", 6, "NORTH", "WEST KAB", "OLD", "v"), ("s", 7, None, None, None, None)]
    aliases = spark.createDataFrame([("OLD", "OTHER", "P1.1")], "canon string, alias string, scope string")
    got = {r.fid: (r.p_key, r.k_key, r.c_key, tuple(r.methods)) for r in M.resolve_parents(spark.createDataFrame(rows, ROWS), nodes(spark), aliases).collect()}
    assert got[1] == ("P1", "P1.1", "P1.1.1", ("exact", "exact", "exact"))
    assert got[2] == ("P1", "P1.1", "P1.1.1", ("exact", "compact", "compact"))
    assert got[3] == ("P1", "P1.2", None, ("exact", "exact"))  # a name borne twice never resolves
    assert got[4] == (None, None, None, ())
    assert got[5] == ("P1", "P1.1", "P1.1.2", ("exact", "exact", "alias")) and got[6][2] is None and got[7][0] is None


def test_ambiguous_by_spaces(spark):
    extra = [(3, "P1.1.3", "P1.1", "A BC")]
    rows = [("s", 1, "NORTH", "EAST KAB", "AB C", "v"), ("s", 2, "NORTH", "EAST KAB", "ABC", "v")]
    got = {r.fid: r.c_key for r in M.resolve_parents(spark.createDataFrame(rows, ROWS), nodes(spark, extra)).collect()}
    assert got == {1: "P1.1.1", 2: None}


def brute_villages(rows, villages, sources):
    """The staged rules, row by row."""
    tight = lambda s: s.replace(" ", "")
    matches, used, blocked = {}, set(), set()
    for source in sources:
        own = [r for r in rows if r[0] == source and r[2] and r[4]]
        for method, f in (("full_exact", str), ("full_compact", tight)):
            cand = defaultdict(list)
            for r in own:
                if not r[3] or (source, r[1]) in used | blocked:
                    continue
                hits = [v for v in villages if v[2] == r[3] and f(v[3]) == f(r[4])]
                if len(hits) == 1:
                    if hits[0][0] in matches:
                        blocked.add((source, r[1]))
                    else:
                        cand[hits[0][0]].append(r)
            for target, rs in cand.items():
                if len(rs) > 1:
                    blocked |= {(source, r[1]) for r in rs}
                else:
                    matches[target] = (source, rs[0][1], method)
                    used.add((source, rs[0][1]))
        for method, f in (("regency_unique_exact", str), ("regency_unique_compact", tight)):
            groups = defaultdict(list)
            for r in own:
                groups[r[2], f(r[4])].append(r)
            for (k, n), rs in groups.items():
                ts = [v for v in villages if v[1] == k and f(v[3]) == n]
                if len(rs) != 1 or len(ts) != 1:
                    if ts:
                        blocked |= {(source, r[1]) for r in rs}
                elif ts[0][0] not in matches and (source, rs[0][1]) not in used | blocked:
                    matches[ts[0][0]] = (source, rs[0][1], method)
                    used.add((source, rs[0][1]))
    return sorted((t, *m) for t, m in matches.items())


def test_stages_against_brute_force(spark, rows):
    rnd = random.Random(5)
    name = lambda: rnd.choice(["A B", "AB", "C", "D E", "DE", "F", "G H I", "GH I", "J", "K"])
    villages = [(f"t{i}", f"k{i % 3}", f"c{i % 6}", name()) for i in range(40)]
    data = [(s, i, rnd.choice(["k0", "k1", "k2", None]), rnd.choice([f"c{j}" for j in range(6)] + [None]), rnd.choice([name(), name(), ""])) for s in ("x", "y") for i in range(40)]
    data = [(s, i, k, c if k and c and f"k{int(c[1]) % 3}" == k else None, v) for s, i, k, c, v in data]
    got = M.match_villages(spark.createDataFrame(data, "source string, fid bigint, k_key string, c_key string, village string").repartition(5), spark.createDataFrame(villages, "key string, k_key string, c_key string, village string"), ["x", "y"])[0]
    assert rows(got) == brute_villages(data, villages, ["x", "y"])


def test_priority(spark, rows):
    data = spark.createDataFrame([("b", 1, "t", ["exact"]), ("a", 2, "t", ["compact"]), ("a", 3, "t", ["exact"]), ("b", 4, "u", ["alias", "exact"]), ("a", 5, None, [])], "source string, fid bigint, t string, methods array<string>")
    assert rows(M.priority_match(data, ["a", "b"], "t")) == [("t", "a", 2, "compact"), ("t", "a", 3, "compact"), ("u", "b", 4, "alias")]


def test_code_bridge(spark):
    s = "target string, target_regency string, source string, fid bigint, code string, k_key string"
    data = [("t1", "k", "m", 1, "11.22.33.4444", "k"), ("t2", "k", "m", 2, "11.22.33", "k"), ("t3", "k", "m", 3, "11.22.33.5555", "k"), ("t4", "k", "m", 4, "11.22.33.5555", "k"), ("t5", "k", "m", 5, "11.22.33.6666", "z"), ("t6", "k", "m", 6, "11.22.33.7777", "k"), ("t7", "k", "m", 7, "11.22.33.8888", "k"), ("t8", "k", "m", 8, None, "k")]
    modern = spark.createDataFrame([("m", r[4]) for r in data], "source string, code string")
    old = spark.createDataFrame([(9, "1122334444", "k"), (10, "11.22.33.6666", "k"), (11, "1122337777", "z")], "fid bigint, code string, k_key string")
    got = {r.target: (r.historic_fid, r.block_reason) for r in M.code_bridge(spark.createDataFrame(data, s), modern, old).collect()}
    assert got == {"t1": (9, None), "t2": (None, "invalid_modern_code"), "t3": (None, "nonunique_selected_modern_code"), "t4": (None, "nonunique_selected_modern_code"), "t5": (None, "modern_parent_regency_mismatch"), "t6": (None, "historic_parent_regency_mismatch"), "t7": (None, "missing_or_nonunique_historic_code"), "t8": (None, "invalid_modern_code")}


def test_unique_names(spark, rows):
    df = spark.createDataFrame([("a", "p", "N"), ("b", "p", "N"), ("c", "p", "M"), ("d", "q", "N")], "key string, parent_key string, canon string")
    assert rows(M.unique_names(df, "parent_key", "canon").select(F.col("scope"), "norm", "target")) == [("p", "M", "c"), ("q", "N", "d")]


def test_code_bridge_uses_a_historic_row_once(spark, rows):
    s = "target string, target_regency string, source string, fid bigint, code string, k_key string"
    data = [
        ("t1", "k", "a", 1, "11.22.33.4444", "k"), ("t2", "k", "b", 1, "11.22.33.4444", "k"), ("t3", "k", "c", 1, "11.22.33.4444", "z"),
        ("t4", "k", "b", 2, "11.22.33.5555", "z"), ("t5", "k", "a", 2, "11.22.33.5555", "k"), ("t6", "k", "a", 3, "11.22.33.6666", "k"),
    ]
    modern = spark.createDataFrame([(r[2], r[4]) for r in data], "source string, code string")
    old = spark.createDataFrame([(9, "1122334444", "k"), (10, "1122335555", "k"), (11, "1122336666", "k")], "fid bigint, code string, k_key string")
    used = spark.createDataFrame([(11,)], "fid bigint")
    got = rows(M.code_bridge(spark.createDataFrame(data, s), modern, old, ["b", "a"], used).select("target", "historic_fid", "block_reason"))
    again = "historic_feature_already_used"
    assert got == [("t1", None, again), ("t2", 9, None), ("t3", None, again), ("t4", None, "modern_parent_regency_mismatch"), ("t5", 10, None), ("t6", None, again)]
