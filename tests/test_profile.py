import random

import numpy as np

from tabulara.operators import profile as P

SCHEMA = "load_id int, `a-b` string, c string, n string, value string, kind int"
LOADS = "load_id int, prev_load_id int, n int"


def data():
    rnd = random.Random(1)
    out = []
    for load in (1, 2, 3, 4, 5):
        for _ in range(400):
            v = str(int(rnd.gauss(100 + (60 if load == 3 else 0), 20)))
            if rnd.random() < (0.3 if load == 2 else 0.05):
                v = rnd.choice([None, "", " "])
            elif rnd.random() < (0.2 if load == 4 else 0.01):
                v = rnd.choice(["x", "1.5"])
            out.append((load, v, str(rnd.randint(0, 9 if load != 5 else 99)) if load != 1 else None, "z", "y", 1))
    return out + [(None, "1", "1", "", "", 0)] * 5


def brute_ks(a, b):
    xs = sorted({*a, *b})
    return max(abs(np.mean(np.array(a) <= x) - np.mean(np.array(b) <= x)) for x in xs)


def number(s):
    s = (s or "").strip()
    return None if not s else int(s) if s.lstrip("-").isdigit() else "bad"


def test_against_brute_force(spark):
    rows = data()
    counts = P.value_counts(spark.createDataFrame(rows, SCHEMA), ["a-b", "c"])
    loads = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 2, 0), (4, 3, 0), (5, 4, 0), (5, 4, 1), (9, 5, 0)], LOADS)
    got = {(r.column_name, r.load_id): r for r in P.load_changes(counts, loads).collect()}
    assert set(got) == {(c, l) for c in ("a-b", "c") for l in (2, 3, 4, 5)}
    col = {"a-b": 1, "c": 2}
    for (c, load), r in got.items():
        new, old = ([number(x[col[c]]) for x in rows if x[0] == k] for k in (load, load - 1))
        num = lambda v: [x for x in v if isinstance(x, int)]
        a, b = num(new), num(old)
        want = set()
        rate = lambda v, what: sum(x == what if what == "bad" else x is None for x in v)
        if abs(rate(new, None) / len(new) - rate(old, None) / len(old)) > 0.05:
            want.add("null_rate")
        na, nb = len(new) - rate(new, None), len(old) - rate(old, None)
        if na and nb and abs(rate(new, "bad") / na - rate(old, "bad") / nb) > 0.02:
            want.add("pattern")
        if a and b:
            assert abs(r.ks - brute_ks(a, b)) < 1e-12
            if sum(not min(b) <= x <= max(b) for x in a) > 0.02 * len(a):
                want.add("value_range")
            if brute_ks(a, b) > 0.25:
                want.add("distribution")
        if len(set(a)) * 2 < len(set(b)) or len(set(a)) > 2 * len(set(b)):
            want.add("distinct_count")
        assert set(r.findings) == want, (c, load)


def test_exact_quantiles(spark):
    rows = data()
    got = {(r.column_name, r.load_id): r for r in P.profile(P.value_counts(spark.createDataFrame(rows, SCHEMA), ["a-b"])).collect()}
    for load in range(1, 6):
        v = sorted(x for x in (number(r[1]) for r in rows if r[0] == load) if isinstance(x, int))
        r = got["a-b", load]
        assert (r.min_value, r.max_value, r.n_distinct, r.n_numbers, r.n_rows) == (v[0], v[-1], len(set(v)), len(v), 400)
        assert [r.q25, r.q50, r.q75] == [v[int(np.ceil(q * len(v))) - 1] for q in (0.25, 0.5, 0.75)]


def test_edges(spark, rows):
    empty = P.value_counts(spark.createDataFrame([], SCHEMA), ["c"])
    no_loads = spark.createDataFrame([], LOADS)
    assert rows(P.profile(empty)) == [] and rows(P.load_findings(P.load_changes(empty, no_loads))) == []
    only_null = spark.createDataFrame([(1, None, None, "", "", 0), (2, "x" * 100_000, "9" * 40, "", "", 0)], SCHEMA)
    counts = P.value_counts(only_null, ["a-b", "c"])
    loads = spark.createDataFrame([(2, 1, 0), (1, None, 0)], LOADS)
    assert rows(P.load_findings(P.load_changes(counts, loads))) == [(2, "a-b", "null_rate"), (2, "c", "distinct_count"), (2, "c", "null_rate")]
    assert {(r.column_name, r.load_id): r.max_value for r in P.profile(counts).collect()}["c", 2] == 2**63 - 1


def test_texts(spark):
    rows = [(1, " ab ", None), (1, "ab", ""), (1, "7", "x"), (1, "é", None), (2, None, "x"), (2, " ", "y"), (2, "7", "x"), (None, "z", "z")]
    counts = P.text_counts(spark.createDataFrame(rows, "load_id int, `a-b` string, c string"), {"a-b": r"\p{L}+", "c": "x"})
    got = {(r.column_name, r.load_id): r for r in P.named_as_text(P.profile(counts)).collect()}
    assert set(got) == {(c, k) for c in ("a-b", "c") for k in (1, 2)}
    r = got["a-b", 1]
    assert (r.n_rows, r.n_missing, r.n_unreadable, r.n_texts, r.n_distinct, r.min_text, r.max_text, r.q50_text, r.unreadable_rate) == (4, 0, 1, 4, 3, "7", "é", "ab", 0.25)
    r = got["c", 1]
    assert (r.n_missing, r.n_distinct, r.missing_rate) == (3, 1, 0.75)
    loads = spark.createDataFrame([(1, None, 0), (2, 1, 0)], LOADS)
    met = {r.column_name: r for r in P.named_as_text(P.load_changes(counts, loads)).collect()}
    assert met["a-b"].findings == ["null_rate", "pattern", "distinct_count", "distribution"] and met["a-b"].ks == 0.75
    assert met["c"].findings == ["null_rate", "pattern", "value_range", "distribution"] and met["c"].n_outside == 1 and met["c"].p_max_text == "x"


def test_every_column_is_profiled(spark, sf):
    from tabulara.plans import dealt
    from tabulara.schemas import CONTEST_COLUMNS

    t = dealt.table(spark, sf, "hasil_tps")
    cells = {c: [(r.load_id, (r[1] or "").strip()) for r in t.select("load_id", f"`{c}`").collect()] for c in ("id", "kelurahan", "timestamp", "c1-2")}
    got = {(r.column_name, r.load_id): r for r in dealt.p4_profile_all(spark, sf).collect()}
    loads = {k for _, k in got}
    assert set(got) == {(c, k) for c in CONTEST_COLUMNS for k in loads}
    for c, rows in cells.items():
        for load in loads:
            v = [x for k, x in rows if k == load]
            r, full = got[c, load], [x for x in v if x]
            assert (r.n_rows, r.n_missing, r.n_distinct, r.min_text, r.max_text) == (len(v), v.count(""), len(set(full)), min(full, default=None), max(full, default=None))
    changed = dealt.p4_changes_all(spark, sf)
    assert {r.column_name for r in changed.collect()} == set(CONTEST_COLUMNS)
