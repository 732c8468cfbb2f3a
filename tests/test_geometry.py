from pyspark.sql import functions as F

from tabulara.operators import geometry as G


def square(x, y, w=1.0, h=1.0):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def frame(spark, *geoms):
    return spark.createDataFrame([(i, g) for i, g in enumerate(geoms)], "i int, j string").withColumn("g", G.from_geojson(F.col("j")))


def polygon(*rings):
    return '{"type":"Polygon","coordinates":%s}' % (list(rings),)


def test_expressions(spark):
    multi = '{"type":"MultiPolygon","coordinates":%s}' % ([[square(0, 0)], [square(5, 5, 2, 2), square(5.5, 5.5)]],)
    df = frame(spark, polygon(square(0, 0)), multi, '{"type":"Point","coordinates":[1,2]}', None, polygon([[0, 0], [1, 1], [0, 0], [0, 0]]), polygon([[0, 0], [1, 0], [1, 1], [0, 1]]))
    got = {r.i: r for r in df.select("i", G.area(F.col("g")).alias("a"), G.is_sound(F.col("g")).alias("ok"), G.bounds(F.col("g")).alias("b"), F.size("g").alias("n")).collect()}
    assert (got[0].a, got[0].ok, tuple(got[0].b), got[0].n) == (1, True, (0, 0, 1, 1), 1)
    assert (got[1].a, got[1].ok, tuple(got[1].b), got[1].n) == (4, True, (0, 0, 7, 7), 2)
    assert not any(got[i].ok for i in (2, 3, 4, 5))


def test_dissolve_keeps_area(spark):
    grid = [polygon(square(x, y)) for x in range(4) for y in range(4) if (x, y) != (1, 1)] + [polygon(square(9, 9)[::-1])]
    df = frame(spark, *grid).withColumn("k", F.lit("a"))
    got = G.dissolve(df, ["k"], "g").select("g", G.area(F.col("g")).alias("a"), G.is_sound(F.col("g")).alias("ok")).first()
    assert got.a == 16 and got.ok and len(got.g) == 2 and sorted(len(p) for p in got.g) == [1, 2]
    part = df.withColumn("ok", F.col("i") > 0)
    assert G.dissolve(part, ["k"], "g", complete="ok").count() == 0


def test_simplify_and_snap(spark):
    ring = [[i / 100, 0.00001 * (i % 2)] for i in range(101)] + [[1, 1], [0, 1], [0, 0]]
    df = G.simplify(frame(spark, polygon(ring)), "g", 0.001)
    got = df.select(F.size(F.col("g")[0][0]).alias("n"), G.area(F.col("g")).alias("a")).first()
    assert got.n <= 8 and abs(got.a - 1) < 0.001
    snapped = frame(spark, polygon([[0, 0], [0.000001, 0], [1, 0], [1, 1], [0, 0]])).select(G.snapped(F.col("g")).alias("g")).first()
    assert len(snapped.g[0][0]) == 4


def test_feature_and_collections(spark, rows):
    import json

    df = frame(spark, polygon(square(0, 0))).select(G.feature_json(F.lit("P1.1.1.1"), F.lit('a"b'), F.lit("village"), F.lit("s"), F.lit(None).cast("string"), F.col("g")).alias("feature"))
    f = json.loads(df.first().feature)
    assert f["properties"] == {"key": "P1.1.1.1", "name": 'a"b', "level": "village", "source": "s", "match": None} and f["geometry"]["coordinates"] == [square(0, 0)]
    parents = spark.createDataFrame([("P1.1.1",), ("P1.1.2",)], "parent_key string")
    got = dict(rows(G.collections(parents, df.select(F.lit("P1.1.1").alias("parent_key"), F.lit("P1.1.1.1").alias("key"), "feature"))))
    assert len(json.loads(got["P1.1.1"])["features"]) == 1 and json.loads(got["P1.1.2"])["features"] == []


def test_clean_falls_back(spark):
    tiny = polygon([[0, 0], [0.000001, 0], [0.000001, 0.000001], [0, 0.000001], [0, 0]])
    got = {r.i: r for r in G.clean(frame(spark, polygon(square(0, 0)), tiny, None, polygon([[0, 0], [1, 1], [0, 0], [0, 0]])), "g", 0.001).collect()}
    assert [got[i].cleaned for i in range(4)] == ["simplified", "kept", "dropped", "dropped"] and got[1].g is not None and got[2].g is None
