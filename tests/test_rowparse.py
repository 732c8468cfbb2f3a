import random

from tabulara.operators import rowparse as R

S = R.RowSchema(["id", "name", "tps", "n"], {"id": R.DIGITS, "tps": R.TPS, "n": R.COUNT}, frozenset({"n"}))
CASES = [
    ("1,a,2,3", "valid", None, None), ('"1","a ""b"", c","TPS 2","3"', "valid", None, None), ("1,a,tps2,", "valid", None, None), (" 1 ,a,\t2 , 1e3 ", "valid", None, None), ("1,aé,2,1_0", "valid", None, None),
    ('1,"a\nb",2,3', "valid", None, None), ("1,,2,3\r\n", "valid", None, None), ("1,a,2,12.5", "failed", "invalid_value", ["n"]), ("x,a,TPS,?", "failed", "invalid_value", ["id", "tps", "n"]), (",a,,", "failed", "invalid_value", ["id", "tps"]),
    ('1,a"b,2,3', "failed", "broken_quoting", None), ('1,"a,2,3', "failed", "broken_quoting", None), ('1,"a"x,2,3', "failed", "broken_quoting", None), ('1, "a",2,3', "failed", "broken_quoting", None), ('1,a,2,3"', "failed", "broken_quoting", None),
    ("1,a,2", "failed", "column_count", None), ("1,a,2,3,", "failed", "column_count", None), ("1,a\nb,2,3", "failed", "column_count", None), ("abc", "failed", "column_count", None), ('x,"a,2', "failed", "broken_quoting", None),
    ("id,name,tps,n", "header", None, None), ('﻿"id","name","tps","n"', "header", None, None), ("﻿id,name,tps,n\r\n", "header", None, None), ("", "empty", None, None), (" \t", "empty", None, None), (None, "empty", None, None),
    ("1," + "y" * 300_000 + ",2,3", "valid", None, None), ('1,"' + '""' * 100_000 + '",2,3', "valid", None, None), ('1,"' + '""' * 100_000 + ",2,3", "failed", "broken_quoting", None), ("," * 50_000, "failed", "column_count", None),
]


def frame(spark, cases):
    return spark.createDataFrame([(i, c[0], 7, "clash") for i, c in enumerate(cases)], "no int, line string, id int, parsed string")


def test_cases(spark):
    got = R.parse_rows(frame(spark, CASES), "line", S).collect()
    for r in got:
        line, status, reason, bad = CASES[r.no]
        assert (r.parsed.status, r.parsed.reason, r.parsed.bad_fields) == (status, reason, bad), (line and line[:40], r.parsed)


def test_first_broken_field(spark):
    lines = ['1,"a,2,3', "x,a,2,3", "1,a,b,3", '1,a,2,3"', "1,a,2"]
    got = {r.no: r.parsed.first_broken for r in R.parse_rows(frame(spark, [(x,) for x in lines]), "line", S).collect()}
    assert got == {0: "name", 1: "id", 2: "tps", 3: "n", 4: "n"}


def test_loaded_and_failures(spark, rows):
    parsed = R.parse_rows(frame(spark, CASES[:5] + CASES[7:9]), "line", S)
    loaded = R.loaded(parsed, S, "no", "id")
    assert loaded.columns == ["no", "kept_id", "id", "name", "tps", "n"]
    assert rows(loaded)[1] == (1, 7, "1", 'a "b", c', "TPS 2", "3")
    assert rows(R.failures(parsed, "no")) == [(5, "invalid_value", "n"), (6, "invalid_value", "id"), (6, "invalid_value", "n"), (6, "invalid_value", "tps")]


def test_empty_table(spark, rows):
    parsed = R.parse_rows(spark.createDataFrame([], "no int, line string"), "line", S)
    assert rows(R.failures(parsed, "no")) == [] and rows(R.loaded(parsed, S, "no")) == []


def _state_machine(line):
    """RFC 4180 by hand: list of fields, or None where quotes are out of place."""
    fields, i = [], 0
    while True:
        if i < len(line) and line[i] == '"':
            j, text = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        text, j = text + '"', j + 2
                        continue
                    break
                text, j = text + line[j], j + 1
            i = j + 1
        else:
            j = i
            while j < len(line) and line[j] != ",":
                if line[j] == '"':
                    return None
                j += 1
            text, i = line[i:j], j
        fields.append(text)
        if i >= len(line):
            return fields
        if line[i] != ",":
            return None
        i += 1


def test_against_state_machine(spark):
    rnd = random.Random(2)
    lines = ["".join(rnd.choice('12a,,"" ') for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    got = R.parse_rows(frame(spark, [(x,) for x in lines]), "line", S).collect()
    for r in got:
        f = _state_machine(r.line)
        if r.line.strip() == "":
            want = "empty"
        elif f is None:
            want = "broken_quoting"
        elif len(f) != 4:
            want = "column_count"
        else:
            want = None
        assert r.parsed.reason == want or (want == "empty" and r.parsed.status == "empty") or (want is None and r.parsed.reason in (None, "invalid_value")), (r.line, r.parsed, f)
        if r.parsed.status == "valid":
            assert r.parsed.fields == f
