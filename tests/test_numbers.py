from hypothesis import given, settings
from hypothesis import strategies as st

from tabulara.functions import text as T
from tabulara.functions.numbers import number_key, number_value, parse_int
from pyspark.sql import functions as F

EDGES = {"": (0, False), " 7 ": (7, False), "007": (7, False), "1_000": (1000, False), "12.0": (12, False), "12.5": (12, True), "1e3": (1000, False), "nan": (0, True), "x": (0, True), "inf": (0, True),
         None: (0, False), "+5": (5, False), "-0": (0, False), "--4": (0, True), "1__0": (0, True), "_1": (0, True), "١٢": (12, False), "5.": (5, False), ".5": (0, True), "\x1f 3　": (3, False), "1e400": (0, True),
         "-12": (-12, False), "3 org": (0, True), "\x003": (0, True)}


def test_fixture_edges(spark):
    df = spark.createDataFrame([(k,) for k in EDGES], "s string").select("s", parse_int(F.col("s")).alias("p"))
    assert {r.s: (r.p.value, r.p.malformed) for r in df.collect()} == EDGES


def reference(s):
    t = (s or "").strip()
    if not t:
        return "missing"
    try:
        return int(t)
    except ValueError:
        pass
    try:
        x = float(t)
        return int(x) if x == int(x) else "bad"
    except (ValueError, OverflowError):
        return "bad"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+-._eE ٣\t\xa0nx", max_size=9), max_size=60))
def test_like_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string").select("s", number_key(F.col("s")).alias("k"))
    for r in df.collect():
        want = reference(r.s)
        got = "missing" if r.k is None else "bad" if r.k[0] == "!" else float(r.k) if "E" in r.k else int(r.k)
        assert got == want or (isinstance(want, int) and abs(want) >= 10**18 and float(got) == float(want)), (r.s, r.k)


def test_beyond_bigint(spark):
    df = spark.createDataFrame([("9" * 30,), ("-" + "9" * 30,), ("0" * 40 + "5",)], "s string").select(number_value(number_key(F.col("s"))).alias("v"))
    assert [r.v for r in df.collect()] == [2**63 - 1, -(2**63), 5]


def test_text_functions(spark):
    def one(c, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(c(F.col("s"))).collect()]

    assert one(T.clean_name, " a\t b ", None, "　x", "Straße  1") == ["A B", "", "X", "STRASSE 1"]
    assert one(T.canonical, "Kota Administrasi Jakarta & Kép.", "Adm. Kep. Seribu", None) == ["ADMINISTRASI JAKARTA DAN KEP", "ADMINISTRASI KEPULAUAN SERIBU", ""]
    assert one(T.latest_year, "UU 12/2003, 20195 thn 2008", "none", None) == [2008, None, None]
    assert one(T.csv_cell, 'a,"b"', "ab", None) == ['"a,""b"""', "ab", ""]
    assert one(T.tps_digits, "TPS 01", "-", None) == [1, None, None] and one(T.tps_plain, " 7 ", "TPS 7") == [7, None]
    assert one(T.column_key, "Gerindra", "P K B") == ["gerinda", "pkb"] and one(T.slug, "+Luar Negeri!") == ["luar-negeri"]
    assert one(T.preview, "a\né", "x" * 90) == ["a\\u000a\\u00e9", "x" * 80 + "..."]
    assert one(lambda c: T.grouped_count(c), "1234567", None) == ["1.234.567", "—"] and one(lambda c: T.percent(c), "0.1234", None) == ["12,3%", "—"]
