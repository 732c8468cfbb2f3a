import json
import os
import zipfile

import pytest

from tabulara.sources import files as S
from tabulara.sources import publish as K


def test_csv(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_bytes('﻿id,n\r\n1,"x\ny"\r\n\r\n,\r\n2, \r\n"3","q""r"'.encode())
    (tmp_path / "b.csv").write_bytes(b"id,n\n")
    got = S.read_csv(spark, str(tmp_path / "*.csv"), ["id", "n"]).select("record_no", "id", "n")
    assert rows(got) == [(2, "1", "x\ny"), (3, "2", " "), (4, "3", 'q"r')]
    (tmp_path / "c.csv").write_bytes(b"id,m\n1,2\n")
    with pytest.raises(S.HeaderError):
        S.read_csv(spark, str(tmp_path / "*.csv"), ["id", "n"])
    assert S.inventory(spark, str(tmp_path / "*.csv")).count() == 3
    assert S.describe(got, 1)[:2] == (["record_no", "id", "n"], 3)


def test_tree_and_nested(spark, tmp_path, rows):
    for name, kids in {"0": [["1", "A", 5], ["2", "+B"]], "1": [["11", "K"]], "11": [["111", "C"]], "111": [["1111", "V"], ["1112", "W"]]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"children": kids}))
    walked = S.walk_tree(S.read_tree_nodes(spark, str(tmp_path)))
    assert [r.kodekel for r in walked.orderBy("kodekel").collect()] == ["1111", "1112"]
    nested = {"prov": [{"k": "1", "n": "A", "kab": [{"k": "11", "n": "K", "kec": [{"k": "111", "n": "C", "kel": [{"k": "1", "n": "V"}]}, {"k": "112", "n": "D"}]}]}, {"k": "-99", "n": "+Luar Negeri", "kab": []}]}
    (tmp_path / "w.txt").write_text(json.dumps(nested))
    every = rows(S.read_nested_hierarchy(spark, str(tmp_path / "w.txt")))
    assert every[-1] == (4, "P1.11.111.1", "V", "P1.11.111") and len(every) == 6 and (1, "P-99", "+Luar Negeri", "") in every
    assert S.read_nested_hierarchy(spark, str(tmp_path / "w.txt"), foreign=False).count() == 5


def test_partition_and_unzip(spark, tmp_path):
    df = spark.createDataFrame([("P1", 1), ("P2", 2)], "province_key string, v int")
    K.write_by_province(df, str(tmp_path / "t"))
    assert S.read_partition(spark, str(tmp_path / "t"), "province_key", "P2", "v int, province_key string").first().v == 2
    assert S.read_partition(spark, str(tmp_path / "t"), "province_key", "P9", "v int, province_key string").count() == 0
    with zipfile.ZipFile(tmp_path / "in.zip", "w") as z:
        z.writestr("layer.json", "{}")
    with zipfile.ZipFile(tmp_path / "out.zip", "w") as z:
        z.write(tmp_path / "in.zip", "in.zip")
    data = (tmp_path / "out.zip").read_bytes()
    (tmp_path / "p.001").write_bytes(data[:50])
    (tmp_path / "p.002").write_bytes(data[50:])
    assert S.unzip_parts([str(tmp_path / "p.002"), str(tmp_path / "p.001")], str(tmp_path / "u"), "*.json").endswith("layer.json")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.json", "{}")
    with pytest.raises(ValueError):
        S.unzip_parts([str(tmp_path / "bad.zip")], str(tmp_path / "v"), "*.json")


def tree(base, **files):
    for p, text in files.items():
        f = base / p.replace("__", "/")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)


def snapshot(base):
    return {p.relative_to(base).as_posix(): p.read_text() for p in base.rglob("*") if p.is_file()}


def test_install(tmp_path):
    live, staged = tmp_path / "live", tmp_path / "staged"
    tree(live, **{"a.json": "old", "d__e.json": "old", "gone__x.json": "stale", "audit.json": "old"})
    tree(staged, **{"a.json": "new", "d__e.json": "new", "f__g__h.json": "new", "audit.json": "new"})
    before = snapshot(live)
    calls = []

    def fail_on(name, error, times=99):
        def replace(a, b):
            calls.append(b.name)
            if b.name == name and calls.count(name) <= times:
                raise error
            os.replace(a, b)

        return replace

    everything = dict(allowed=lambda p: p.endswith(".json"), markers=["audit.json"], pause=0)
    for name in ("a.json", "h.json", "audit.json"):
        with pytest.raises(K.PublishError):
            K.install(staged, live, replace=fail_on(name, OSError("disk")), **everything)
        assert snapshot(live) == before and not (tmp_path / "live.backup").exists()
    calls.clear()
    assert K.install(staged, live, replace=fail_on("a.json", PermissionError("busy"), 3), **everything) == {"installed": 4, "removed": 1}
    assert snapshot(live) == snapshot(staged) and calls[-1] == "audit.json" and K.tree_digest(live) == K.tree_digest(staged)
    with pytest.raises(K.PublishError):
        K.install(staged, live, allowed=lambda p: False, markers=[])
    with pytest.raises(K.PublishError):
        K.install(staged, live, allowed=lambda p: True, markers=["missing.json"])


def test_small_writers(spark, tmp_path):
    K.write_json(tmp_path / "x" / "j.json", {"a": "é"})
    assert (tmp_path / "x" / "j.json").read_text() == '{"a":"é"}\n'
    K.write_export(["a,b", "1,2"], tmp_path / "e.csv")
    assert (tmp_path / "e.csv").read_bytes() == b"\xef\xbb\xbfa,b\r\n1,2"
    K.write_texts(spark.createDataFrame([("d/a.json", "{}"), ("b.json", "[]")], "path string, content string"), str(tmp_path / "w"))
    assert snapshot(tmp_path / "w") == {"d/a.json": "{}", "b.json": "[]"}
    assert json.loads(K.audit_row(spark.createDataFrame([(1,), (2,)], "a int")).first().json) == [{"a": 1}, {"a": 2}]
