import json
from collections import defaultdict
from itertools import combinations

from tabulara.operators import archive as A

FILES = "file_id bigint, run_id int, path string, content string, payload string, entries int"


def feature(key="P1.2", name="X", x=1.5, **more):
    p = {"key": key, "name": name, "level": "village", "source": "s", "match": None} | more
    return {"type": "Feature", "properties": {k: v for k, v in p.items() if v != "-"}, "geometry": {"type": "Polygon", "coordinates": [[[x, 2], [3, 4], [5, 6], [x, 2]]]}}


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": list(features)})


def files():
    odd = collection(feature(x=1.0)).replace("1.0", "10e-1").replace(" ", "\n").replace('"X"', '"\\u0058"')
    texts = [collection(feature(x=1)), odd, collection(), None, "", "not json", "[1]", '{"features": 5}', collection(feature(key="-"), feature(key=None), feature(key="")), collection(feature(x=1), feature(x=1)), collection(feature(x=1, name="é")), "ü" * 200_000]
    out = [(i, 1, f"a/{i}", t, "clash", 0) for i, t in enumerate(texts)] + [(100, 2, "a/0", texts[0], "", 0), (101, 2, "a/1", texts[1], "", 0)]
    return out


def test_round_trip_and_index(spark, tmp_path, rows):
    fs = files()
    path = A.write_archive(spark.createDataFrame(fs, FILES), str(tmp_path / "arc"), block_bytes=2000, file_bytes=100_000)
    arc = A.read_archive(spark, path)
    got = {r.file_id: r for r in A.unpack(arc).collect()}
    assert {i: r.content if r.content is None else bytes(r.content) for i, r in got.items()} == {f[0]: f[3] if f[3] is None else f[3].encode() for f in fs}
    index = A.archive_index(arc).collect()
    assert len(index) == len(fs) and sum(r.length for r in index) == sum(len((f[3] or "").encode()) for f in fs)
    assert arc.count() > 1


def brute(fs):
    held = defaultdict(set)
    for file_id, run, _, text, *_ in fs:
        try:
            found = json.loads(text or "")
        except ValueError:
            continue
        found = found.get("features") if isinstance(found, dict) else None
        for f in found if isinstance(found, list) else []:
            if f["properties"].get("key"):
                held[run, f["properties"]["key"], A.feature_record(f)[1]].add(file_id)
    return sorted({(a, b, k) for (_, k, _), ids in held.items() for a, b in combinations(sorted(ids), 2)})


def test_shared_and_consolidated(spark, tmp_path, rows):
    fs = files()
    arc = A.read_archive(spark, A.write_archive(spark.createDataFrame(fs, FILES), str(tmp_path / "arc"), block_bytes=3000))
    assert rows(A.shared_records(arc)) == brute(fs) == [(0, 1, "P1.2"), (0, 9, "P1.2"), (1, 9, "P1.2"), (100, 101, "P1.2")]
    kept = A.consolidated(arc).collect()
    assert sum(r.n_copies for r in kept) == A.records(arc).count()
    assert sorted((r.run_id, r.file_id, r.ordinal) for r in kept if r.key is None) == [(1, 8, 0), (1, 8, 1), (1, 8, 2)]
    assert sorted((r.run_id, r.file_id, r.n_copies) for r in kept if r.key) == [(1, 0, 4), (1, 10, 1), (2, 100, 2)]


def test_hot_record(spark, tmp_path, rows):
    fs = [(i, 1, f"p/{i}", collection(feature()), "", 0) for i in range(60)]
    arc = A.read_archive(spark, A.write_archive(spark.createDataFrame(fs, FILES), str(tmp_path / "arc")))
    assert A.shared_records(arc).count() == 60 * 59 // 2 and A.consolidated(arc).count() == 1


def test_empty(spark, tmp_path, rows):
    arc = A.read_archive(spark, A.write_archive(spark.createDataFrame([], FILES), str(tmp_path / "arc")))
    assert rows(A.shared_records(arc)) == [] and rows(A.archive_index(arc)) == [] and rows(A.consolidated(arc)) == [] and rows(A.unpack(arc)) == []


def test_damage_is_noticed(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    arc = A.read_archive(spark, A.write_archive(spark.createDataFrame(files(), FILES), str(tmp_path / "arc")))
    broken = arc.withColumn("payload", F.encode(F.regexp_replace(F.decode("payload", "UTF-8"), "village", "vilXage"), "UTF-8"))
    with pytest.raises(Exception, match="checksum"):
        A.unpack(broken).count()


def test_consolidated_store_holds_the_features(spark, tmp_path):
    fs = [*files(), (12, 1, "a/12", '{"features": [{"properties": 1}], "x": {"features": [0]}, "features" : [ 7 , {"properties" : {"key":"Q", "name":"\\u00e9é"}}\n] }', "", 0), (13, 1, "a/13", "\ufeff" + collection(feature(key="R")), "", 0)]
    arc = A.read_archive(spark, A.write_archive(spark.createDataFrame(fs, FILES), str(tmp_path / "arc"), block_bytes=3000))
    path = A.write_consolidated(arc, str(tmp_path / "out"), block_bytes=300, file_bytes=600)
    store = A.read_consolidated(spark, path)
    got = {(r.file_id, r.ordinal): r for r in A.unpack_features(store).collect()}
    pointers = {(r.run_id, r.key, r.file_id, r.ordinal, r.n_copies) for r in A.consolidated(arc).collect()}
    assert {(r.run_id, r.key, r.file_id, r.ordinal, r.n_copies) for r in got.values()} == pointers and len(got) == len(pointers) == A.feature_index(store).count()
    texts = {f[0]: f[3] for f in fs}
    for (file_id, ordinal), r in got.items():
        written = bytes(r.feature).decode()
        assert written in texts[file_id] and json.loads(written) == json.loads(texts[file_id].encode())["features"][ordinal]
    assert bytes(got[12, 1].feature).decode() == '{"properties" : {"key":"Q", "name":"\\u00e9é"}}' and (13, 0) in got
    sizes = [r.n_bytes for r in store.select("n_bytes").collect()]
    assert sum(sizes) == sum(len(r.feature) for r in got.values()) and len(sizes) > 1


def test_p3_store_is_few_files(spark, sf, tmp_path):
    from tabulara.plans import dealt

    dealt.p3_store(spark, sf).write.parquet(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 1
    kept = A.unpack_features(A.read_consolidated(spark, str(tmp_path / "out")))
    assert kept.drop("feature").exceptAll(dealt.p3_consolidated(spark, sf, str(tmp_path / "kept"))).count() == 0 and kept.count() > 0
    assert (tmp_path / "kept").exists() and kept.where("octet_length(feature) < 2").count() == 0
