import random

from tabulara.operators.diff import copy_differences

SCHEMA = "row_no bigint, id string, `p-1` string, q string, side int, v int, next int"


def key(s):
    s = (s or "").strip()
    try:
        return int(s.replace("+", "", 1)) if s else None
    except ValueError:
        try:
            return int(float(s)) if float(s).is_integer() else "!" + s
        except (ValueError, OverflowError):
            return "!" + s


def brute(left, right):
    def copy(rows):
        out = {}
        for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
            if r[1] and r[1].strip():
                out.setdefault(r[1].strip(), (key(r[2]), key(r[3])))
        return out

    a, b = copy(left), copy(right)
    out = [(i, "*", "missing_in_right") for i in a.keys() - b.keys()] + [(i, "*", "missing_in_left") for i in b.keys() - a.keys()]
    return sorted(out + [(i, f, "differs") for i in a.keys() & b.keys() for j, f in enumerate(("p-1", "q")) if a[i][j] != b[i][j]], key=repr)


def test_against_brute_force(spark, rows):
    rnd = random.Random(3)
    value = lambda: rnd.choice(["5", " 5", "5.0", "+5", "6", None, "", "x", "x ", "y", "1e1", "10"])

    def side():
        ids = [rnd.choice([f"{i}", f" {i} ", "hot"]) for i in range(400) if rnd.random() < 0.8] + ["hot"] * 200 + [None, "", " "]
        return [(n, i, value(), value(), 1, 2, 3) for n, i in enumerate(ids)]

    a, b = side(), side()
    a += a[:30]
    got = copy_differences(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ("left", "right"), "id", "row_no", ["p-1", "q"])
    assert rows(got) == brute(a, b)
    assert "MapIn" not in got._jdf.queryExecution().toString()


def test_edges(spark, rows):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "k", "z" * 100_000, None, 0, 0, 0), (2, "k", "other", None, 0, 0, 0)], SCHEMA)
    names = (("left", "right"), "id", "row_no", ["p-1", "q"])
    assert rows(copy_differences(none, none, *names)) == []
    assert rows(copy_differences(one, none, *names)) == [("k", "*", "missing_in_right")]
    assert rows(copy_differences(none, one, *names)) == [("k", "*", "missing_in_left")]
    assert rows(copy_differences(one, one, *names)) == []
