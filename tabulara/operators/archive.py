"""Consolidating very many small files into indexed archive containers.

The original bytes of the files are packed into blocks of about BLOCK_BYTES; an index entry per file holds path, offset, length and checksum, so any file can be cut out again unchanged and
blocks are read in parallel. Blocks lie together in container files of about FILE_BYTES, sorted by run and path, which lets a lookup skip containers by their path statistics.

Records (GeoJSON features) are read from the containers: canonical JSON makes records equal that are the same JSON values in different notation. `consolidated` keeps every feature without a
key, and each keyed record of a run once; `shared_records` names the pairs of files of a run that hold the same record. `pack_features` puts the kept features, in the bytes they were written in (as UTF-8),
into blocks and containers of the same sizes, sorted by run and key, with an index entry per feature; `write_consolidated` keeps them under a path.

Nulls and edge cases: a null content is an empty file of length 0 (and stays null-flagged in the index); empty collections and texts that are no JSON object hold no records and lose no bytes;
a key that is absent, null or the empty string makes a feature keyless; the same record several times in one file is one membership; a file larger than a block gets its own block; an empty
table gives an empty archive; extra columns are ignored; members of `features` that are no JSON objects are no features.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulara.session import delete_at_exit, scratch_path, ship_code

BLOCK_BYTES = 16 << 20
FILE_BYTES = 64 << 20

ENTRY = "struct<file_id:bigint,run_id:int,path:string,offset:bigint,length:bigint,is_null:boolean,sha256:string>"
BLOCKS = f"block_id string, n_files bigint, n_bytes bigint, first_path string, last_path string, entries array<{ENTRY}>, payload binary"
_ENTRY_PA = pa.struct(
    [("file_id", pa.int64()), ("run_id", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("is_null", pa.bool_()), ("sha256", pa.string())]
)
_BLOCK_PA = pa.schema(
    [("block_id", pa.string()), ("n_files", pa.int64()), ("n_bytes", pa.int64()), ("first_path", pa.string()), ("last_path", pa.string()), ("entries", pa.list_(_ENTRY_PA)), ("payload", pa.binary())]
)

#: A row group for each block of the usual size, so that the blocks of a container can be read by several tasks.
_GROUPS = {"parquet.block.size": str(BLOCK_BYTES), "parquet.page.size.row.check.min": "1"}

FEATURE_ENTRY = "struct<run_id:int,key:string,file_id:bigint,ordinal:int,n_copies:bigint,offset:bigint,length:bigint,sha256:string>"
FEATURE_BLOCKS = f"block_id string, n_features bigint, n_bytes bigint, first_run int, last_run int, entries array<{FEATURE_ENTRY}>, payload binary"
_PLACE_PA = [("run_id", pa.int32()), ("key", pa.string()), ("file_id", pa.int64()), ("ordinal", pa.int32()), ("n_copies", pa.int64())]
_FEATURE_ENTRY_PA = pa.struct([*_PLACE_PA, ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])
_FEATURE_BLOCK_PA = pa.schema(
    [("block_id", pa.string()), ("n_features", pa.int64()), ("n_bytes", pa.int64()), ("first_run", pa.int32()), ("last_run", pa.int32()), ("entries", pa.list_(_FEATURE_ENTRY_PA)), ("payload", pa.binary())]
)


def pack(files: DataFrame, block_bytes: int = BLOCK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """files: file_id, run_id, path, content (string or binary). One row per block; a partition becomes one container file."""
    ship_code(files.sparkSession)
    source = files.select("file_id", "run_id", "path", F.col("content").cast("binary").alias("content"))
    total = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    parts = max(1, math.ceil(total / file_bytes))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        payload, entries = bytearray(), []

        def block() -> pa.RecordBatch:
            row = {"block_id": f"{part:06d}-{seq:06d}", "n_files": len(entries), "n_bytes": len(payload), "first_path": entries[0]["path"], "last_path": entries[-1]["path"]}
            return pa.RecordBatch.from_pylist([row | {"entries": entries, "payload": bytes(payload)}], schema=_BLOCK_PA)

        for batch in batches:
            for file_id, run_id, path, content in zip(*(batch.column(i) for i in range(3)), batch.column(3), strict=True):
                data = content.as_py()
                raw = data or b""
                if entries and len(payload) + len(raw) > block_bytes:
                    yield block()
                    payload, entries, seq = bytearray(), [], seq + 1
                entry = {"file_id": file_id.as_py(), "run_id": run_id.as_py(), "path": path.as_py(), "offset": len(payload), "length": len(raw), "is_null": data is None}
                entries.append(entry | {"sha256": hashlib.sha256(raw).hexdigest()})
                payload += raw
        if entries:
            yield block()

    ranged = source.repartitionByRange(parts, "run_id", "path", "file_id").sortWithinPartitions("run_id", "path", "file_id")
    return ranged.mapInArrow(blocks, BLOCKS)


def write_archive(files: DataFrame, path: str | None = None, **sizes: int) -> str:
    """Packs files into containers under path and returns it. Without a path they lie in the shared folder until the application ends."""
    at = path or scratch_path(files.sparkSession, "archive")
    pack(files, **sizes).write.options(**_GROUPS).parquet(at)
    if path is None:
        delete_at_exit(files.sparkSession, at)
    return at


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def archive_index(archive: DataFrame) -> DataFrame:
    """One row per file: block_id, file_id, run_id, path, offset, length, is_null, sha256. Reads no payload."""
    return archive.select("block_id", F.explode("entries").alias("e")).select("block_id", "e.*")


def unpack(archive: DataFrame) -> DataFrame:
    """The files as they went in (file_id, run_id, path, content binary); a wrong checksum is an error."""
    ship_code(archive.sparkSession)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries, payload in zip(batch.column("entries"), batch.column("payload"), strict=True):
                view, rows = payload.as_buffer(), []
                for e in entries.as_py():
                    raw = view[e["offset"] : e["offset"] + e["length"]].to_pybytes()
                    if hashlib.sha256(raw).hexdigest() != e["sha256"]:
                        raise ValueError(f"checksum of {e['path']} doesn't hold")
                    rows.append({"file_id": e["file_id"], "run_id": e["run_id"], "path": e["path"], "content": None if e["is_null"] else raw})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file_id", pa.int64()), ("run_id", pa.int32()), ("path", pa.string()), ("content", pa.binary())]))

    return archive.select("entries", "payload").mapInArrow(files, "file_id bigint, run_id int, path string, content binary")


def _plain(value: object) -> object:
    """A JSON value in one notation: numbers by value, members sorted by the dump."""
    if type(value) is float:
        return int(value) if value.is_integer() else value
    if type(value) is list:
        return [_plain(x) for x in value]
    if type(value) is dict:
        return {k: _plain(x) for k, x in value.items()}
    return value


def canonical_json(value: object) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


RECORD_MEMBERS = ("key", "name", "level", "source", "match")


def feature_record(feature: dict) -> tuple[str | None, str]:
    """(key or None, canonical text of the five properties and the geometry). An absent member differs from null."""
    own = feature.get("properties")
    own = own if isinstance(own, dict) else {}
    key = own.get("key")
    text = canonical_json([{m: own[m] for m in RECORD_MEMBERS if m in own}, feature.get("geometry")])
    return (None if key is None or key == "" else key if isinstance(key, str) else canonical_json(key)), text


_SPACE = re.compile(r"[ \t\n\r]*").match


def feature_texts(text: str) -> list[str]:
    """The members of the array `features` as they are written. text: an object that json.loads reads; of members of the same name the last counts."""
    decode, skip, out = json.JSONDecoder().raw_decode, (lambda i: _SPACE(text, i).end()), []
    at = skip(skip(0) + 1)
    while text[at] != "}":
        name, at = decode(text, skip(at + 1) if text[at] == "," else at)
        at = skip(skip(at) + 1)
        if name == "features":
            out = []
        if name == "features" and text[at] == "[":
            at = skip(at + 1)
            while text[at] != "]":
                at = skip(at + 1) if text[at] == "," else at
                end = decode(text, at)[1]
                out.append(text[at:end])
                at = skip(end)
            at = skip(at + 1)
        else:
            at = skip(decode(text, at)[1])
    return out


def records(archive: DataFrame, texts: bool = False) -> DataFrame:
    """One row per feature: run_id, file_id, ordinal, key (null if keyless), record (digest of 128 bits); with texts also feature, its bytes as written."""
    ship_code(archive.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries, payload in zip(batch.column("entries"), batch.column("payload"), strict=True):
                view = payload.as_buffer()
                run, file, ordinal, keys, digests, written = [], [], [], [], [], []
                for e in entries.as_py():
                    raw = view[e["offset"] : e["offset"] + e["length"]].to_pybytes()
                    if hashlib.sha256(raw).hexdigest() != e["sha256"]:
                        raise ValueError(f"checksum of {e['path']} doesn't hold")
                    try:
                        collection = json.loads(raw)
                    except ValueError:
                        continue
                    found = collection.get("features") if isinstance(collection, dict) else None
                    found = found if isinstance(found, list) else []
                    as_written = feature_texts(raw.decode(json.detect_encoding(raw), "surrogatepass")) if texts and found else []
                    for i, feature in enumerate(found):
                        if isinstance(feature, dict):
                            key, text = feature_record(feature)
                            run.append(e["run_id"])
                            file.append(e["file_id"])
                            ordinal.append(i)
                            keys.append(key)
                            digests.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                            if texts:
                                written.append(as_written[i].encode("utf-8", "surrogatepass"))
                more = {"feature": pa.array(written, pa.binary())} if texts else {}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(run, pa.int32()), pa.array(file, pa.int64()), pa.array(ordinal, pa.int32()), pa.array(keys, pa.string()), pa.array(digests, pa.binary()), *more.values()],
                    names=["run_id", "file_id", "ordinal", "key", "record", *more],
                )

    schema = "run_id int, file_id bigint, ordinal int, key string, record binary"
    return archive.select("entries", "payload").mapInArrow(features, schema + ", feature binary" if texts else schema)


def shared_records(archive: DataFrame) -> DataFrame:
    """(file_a, file_b, key), file_a < file_b: files of one run with the same keyed record, each triple once."""
    held = records(archive).where("key is not null").select("run_id", "key", "record", "file_id").distinct()
    a, b = held.withColumnRenamed("file_id", "file_a"), held.withColumnRenamed("file_id", "file_b")
    return a.join(b, ["run_id", "key", "record"]).where("file_a < file_b").select("file_a", "file_b", "key").distinct()


def consolidated(archive: DataFrame) -> DataFrame:
    """Which features the consolidated set keeps: every keyless one; of a run's equal keyed records the first by (file_id, ordinal), with n_copies."""
    every = records(archive)
    place = F.struct("file_id", "ordinal")
    keyed = every.where("key is not null").groupBy("run_id", "key", "record").agg(F.min(place).alias("p"), F.count("*").alias("n_copies"))
    rows = keyed.select("run_id", "key", "p.file_id", "p.ordinal", "n_copies")
    return rows.unionByName(every.where("key is null").select("run_id", "key", "file_id", "ordinal", F.lit(1).cast("bigint").alias("n_copies")))


def kept_features(archive: DataFrame) -> DataFrame:
    """The features that `consolidated` keeps, with their bytes: run_id, key, file_id, ordinal, n_copies, feature. One grouping: a keyless feature is a group of its own."""
    own = F.when(F.col("key").isNull(), F.struct("file_id", "ordinal"))
    groups = records(archive, texts=True).groupBy("run_id", "key", "record", own.alias("own")).agg(F.min(F.struct("file_id", "ordinal", "feature")).alias("p"), F.count("*").alias("n_copies"))
    return groups.select("run_id", "key", "p.file_id", "p.ordinal", "n_copies", "p.feature")


def pack_features(kept: DataFrame, block_bytes: int = BLOCK_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """kept: rows of kept_features. One row per block; a partition becomes one container file."""
    spark = kept.sparkSession
    ship_code(spark)
    at = scratch_path(spark, "kept")
    kept.write.parquet(at)  # measured first, then dealt to containers
    delete_at_exit(spark, at)
    kept = spark.read.schema(kept.schema).parquet(at)
    parts = max(1, math.ceil((kept.agg(F.sum(F.octet_length("feature"))).first()[0] or 0) / file_bytes))
    names = [n for n, _ in _PLACE_PA]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        payload, entries = bytearray(), []

        def block() -> pa.RecordBatch:
            row = {"block_id": f"{part:06d}-{seq:06d}", "n_features": len(entries), "n_bytes": len(payload), "first_run": entries[0]["run_id"], "last_run": entries[-1]["run_id"]}
            return pa.RecordBatch.from_pylist([row | {"entries": entries, "payload": bytes(payload)}], schema=_FEATURE_BLOCK_PA)

        for batch in batches:
            for place, feature in zip(batch.select(names).to_pylist(), batch.column("feature"), strict=True):
                raw = feature.as_py()
                if entries and len(payload) + len(raw) > block_bytes:
                    yield block()
                    payload, entries, seq = bytearray(), [], seq + 1
                entries.append(place | {"offset": len(payload), "length": len(raw), "sha256": hashlib.sha256(raw).hexdigest()})
                payload += raw
        if entries:
            yield block()

    order = ["run_id", "key", "file_id", "ordinal"]
    return kept.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*names, "feature").mapInArrow(blocks, FEATURE_BLOCKS)


def write_consolidated(archive: DataFrame, path: str, **sizes: int) -> str:
    """Packs the kept features into containers under path, where they stay, and returns it."""
    pack_features(kept_features(archive), **sizes).write.options(**_GROUPS).parquet(path)
    return path


def read_consolidated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_BLOCKS).parquet(path)


def feature_index(store: DataFrame) -> DataFrame:
    """One row per kept feature: block_id, run_id, key, file_id, ordinal, n_copies, offset, length, sha256. Of a written store it reads no payload."""
    return store.select("block_id", F.explode("entries").alias("e")).select("block_id", "e.*")


def unpack_features(store: DataFrame) -> DataFrame:
    """The kept features (run_id, key, file_id, ordinal, n_copies, feature binary); a wrong checksum is an error."""
    ship_code(store.sparkSession)
    schema = pa.schema([*_PLACE_PA, ("feature", pa.binary())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries, payload in zip(batch.column("entries"), batch.column("payload"), strict=True):
                view, rows = payload.as_buffer(), []
                for e in entries.as_py():
                    raw = view[e["offset"] : e["offset"] + e["length"]].to_pybytes()
                    if hashlib.sha256(raw).hexdigest() != e["sha256"]:
                        raise ValueError(f"checksum of feature {e['ordinal']} of file {e['file_id']} doesn't hold")
                    rows.append({n: e[n] for n, _ in _PLACE_PA} | {"feature": raw})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return store.select("entries", "payload").mapInArrow(features, "run_id int, key string, file_id bigint, ordinal int, n_copies bigint, feature binary")
