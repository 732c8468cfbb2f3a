"""Small cases of the export names, options, provenance of parents, audit and file stems."""

import json

from tabulara.operators import analytics as V
from tabulara.operators import geometry as G
from tabulara.operators import validate as X
from tabulara.schemas import EXPORT_COLUMNS, PARTY_OPTIONS
from tabulara.sources import files, publish


def square(x, y=0.0):
    x = float(x)
    return [[[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]]


def test_export_names(spark):
    df = spark.createDataFrame([tuple("abcdefghijk")], ", ".join(f"{c} string" for c in EXPORT_COLUMNS))
    assert X.named_exports(df).columns == ["provinsi", "kabupaten", "kecamatan", "kelurahan", "village_code", "tps", "pemilih-1", "pemilih-2", "suara-sah", "suara-tidak-sah", "suara-total"]


def test_options(spark):
    rows = [("dpr", "new-party_x", 0), ("dpr", "pkpi", 1), ("dpr", "Gerindra", 2), ("dpr", "pkb", 3), ("dpr", "other", 4)]
    got = V.option_dimension(spark.createDataFrame(rows, "contest string, column string, ordinal int"), PARTY_OPTIONS).orderBy("place").collect()
    assert [(r.column, r.label, r.known) for r in got] == [("pkb", "PKB", True), ("Gerindra", "Gerindra", True), ("pkpi", "PKPI", True), ("new-party_x", "New Party X", False), ("other", "Other", False)]


def test_parents(spark):
    schema = f"parent_key string, key string, source string, match string, g {G.GEOMETRY}"
    parts = spark.createDataFrame([("P1", "P1.1", "b", "exact", square(0)), ("P1", "P1.2", "a", "exact", square(1)), ("P2", "P2.1", "a", "compact", square(5)), ("P2", "P2.2", "a", "exact", None)], schema)
    joined = {r.parent_key: r for r in G.joined_parts(parts, "parent_key", "source", "match", "g").collect()}
    assert (joined["P1"].source, joined["P1"].match, len(joined["P1"].g)) == ("a+b", "parts_union", 1)
    assert (joined["P2"].source, joined["P2"].match) == ("a", "compact")
    every = parts.select("parent_key", "key")
    derived = G.derived_parents(parts.select("parent_key", "key", "g"), every, "g", "derived")
    assert [(r.parent_key, r.source, r.match) for r in derived.collect()] == [("P1", "derived", "union")]
    direct = G.joined_parts(parts.where("parent_key = 'P2'"), "parent_key", "source", "match", "g").select("parent_key", "g", "source", "match")
    assert sorted((r.parent_key, r.source) for r in G.direct_first(direct, derived, "parent_key").collect()) == [("P1", "derived"), ("P2", "a")]
    assert G.derived_parents(parts.where("false").select("parent_key", "key", "g"), every.where("false"), "g", "x").count() == 0


def test_audit(spark):
    whole = json.loads(publish.audit({"b": spark.createDataFrame([(2, "x"), (1, None)], "n int, s string"), "a": spark.createDataFrame([], "n int")}).first().json)
    assert list(whole) == ["generated_at", "a", "b"] and whole["a"] == [] and whole["b"] == [{"n": 1}, {"n": 2, "s": "x"}] and whole["generated_at"].endswith("Z")


def test_stems(spark, tmp_path):
    for name in ("1101.json", "1101.txt", "110.json", "x1101.json", "9999.json"):
        (tmp_path / name).write_text(name)
    assert sorted(r.content for r in files.read_stems(spark, str(tmp_path), "[0-9]{4}").collect()) == ["1101.json", "9999.json"]
