"""Publishing: atomic small files, partitioned tables, export files, and a transactional swap of a whole tree of files."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUDIT = "audit.json"


def write_json(path: str | Path, data: Any) -> None:
    """Compact JSON with a final line feed, written beside the target and moved over it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(path.name + ".new")
    beside.write_text(json.dumps(data, ensure_ascii=False, separators=(",", ":")) + "\n", encoding="utf-8")
    os.replace(beside, path)


def write_by_province(df: DataFrame, path: str, province: str = "province_key") -> None:
    """One folder per province; provinces no longer there disappear with the overwrite."""
    df.repartition(province).write.mode("overwrite").partitionBy(province).parquet(path)


def write_export(lines: Iterable[str], path: str | Path) -> None:
    """A CSV export of one node's children: byte order mark, CRLF between lines."""
    Path(path).write_bytes(("\ufeff" + "\r\n".join(lines)).encode("utf-8"))


def write_texts(df: DataFrame, folder: str) -> None:
    """(path, content) rows as files below folder, each written by the task that has it. For layouts that readers outside Spark need; a table is written as a table."""

    def write(rows: Iterable[Any]) -> None:
        for row in rows:
            target = Path(folder, row["path"])
            target.parent.mkdir(parents=True, exist_ok=True)
            beside = target.with_name(f"{target.name}.{os.getpid()}.new")
            beside.write_text(row["content"], encoding="utf-8")
            os.replace(beside, target)

    df.select("path", "content").foreachPartition(write)


def tree_digest(folder: str | Path, leave_out: str = AUDIT) -> str:
    """SHA-256 over the sorted files of a tree, each path and content preceded by its length."""
    base, h = Path(folder), hashlib.sha256()
    for p in sorted(p for p in base.rglob("*") if p.is_file() and p.relative_to(base).as_posix() != leave_out):
        for part in (p.relative_to(base).as_posix().encode(), p.read_bytes()):
            h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


def audit_row(df: DataFrame) -> DataFrame:
    """All rows of a small report as one JSON array in one row."""
    return df.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("json"))


def audit(sections: Mapping[str, DataFrame]) -> DataFrame:
    """One row (json): an object with generated_at, an ISO UTC time, and each small report as an array of its rows."""
    parts = [audit_row(df).select(F.lit(name).alias("section"), "json") for name, df in sections.items()]
    joined = reduce(DataFrame.unionByName, parts).agg(F.sort_array(F.collect_list(F.struct("section", "json"))).alias("s"))
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.array_join(F.transform("s", lambda x: F.concat(F.lit('"'), x["section"], F.lit('":'), F.coalesce(x["json"], F.lit("[]")))), ",")
    return joined.select(F.concat(F.lit('{"generated_at":"'), stamp, F.lit('",'), body, F.lit("}")).alias("json"))


class PublishError(RuntimeError):
    """A publish that failed and was undone (or could not be undone: then the backups stay)."""


def install(staged: str | Path, live: str | Path, allowed: Callable[[str], bool], markers: Iterable[str], replace: Callable[[Path, Path], None] = os.replace, tries: int = 6, pause: float = 0.05) -> dict[str, int]:
    """Puts the staged tree in place of the live one: all or nothing.

    Staged paths must be allowed and hold the markers. Files go deepest first and the audit file last, so a reader that finds the new audit finds everything; live files that are not staged are removed. Before a file
    changes it is copied to a backup; on any error all changed files get their old bytes back. A permission error is tried again.
    """
    staged, live = Path(staged), Path(live)
    new = {p.relative_to(staged).as_posix() for p in staged.rglob("*") if p.is_file()}
    if strange := sorted(p for p in new if not allowed(p)):
        raise PublishError(f"unexpected path {strange[0]}")
    if missing := sorted(set(markers) - new):
        raise PublishError(f"missing {missing[0]}")
    backup = live.with_name(live.name + ".backup")
    if backup.exists():
        raise PublishError(f"{backup} is left from an earlier publish")
    old = {p.relative_to(live).as_posix() for p in live.rglob("*") if p.is_file()} if live.exists() else set()
    order = sorted(new, key=lambda p: (p == AUDIT, -p.count("/"), p))
    touched: list[str] = []

    def again(step: Callable[[], None]) -> None:
        for i in range(tries):
            try:
                return step()
            except PermissionError:
                if i == tries - 1:
                    raise
                time.sleep(pause * 2**i)

    def keep(p: str) -> None:
        touched.append(p)
        if p in old:
            (backup / p).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(live / p, backup / p)

    def put(p: str) -> None:
        (live / p).parent.mkdir(parents=True, exist_ok=True)
        beside = (live / p).with_name((live / p).name + ".new")
        shutil.copy2(staged / p, beside)
        try:
            replace(beside, live / p)
        finally:
            beside.unlink(missing_ok=True)

    try:
        for p in order:
            if p == AUDIT:
                for gone in sorted(old - new):
                    keep(gone)
                    again((live / gone).unlink)
            keep(p)
            again(lambda p=p: put(p))
        if AUDIT not in new:
            for gone in sorted(old - new):
                keep(gone)
                again((live / gone).unlink)
    except Exception as error:
        failed = []
        for p in reversed(touched):
            try:
                if p in old:
                    (live / p).parent.mkdir(parents=True, exist_ok=True)
                    shutil.copy2(backup / p, live / p)
                else:
                    (live / p).unlink(missing_ok=True)
            except OSError:
                failed.append(p)
        if not failed:
            shutil.rmtree(backup, ignore_errors=True)
        raise PublishError(f"undone: {error}" if not failed else f"{len(failed)} files could not be put back; see {backup}") from error
    shutil.rmtree(backup, ignore_errors=True)
    return {"installed": len(new), "removed": len(old - new)}
