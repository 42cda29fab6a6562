"""Tables that change together: attempt folders of Parquet files, and one commit record that makes all of them visible at once.

A root holds ``<table>/<attempt>/`` folders and ``_commits/<version>``, a small record that names the folders of every table. A
writer first writes its folders, which no reader looks at, and then creates the record of the next version. Creating a record
that exists already fails, so of two writers one wins and the other builds its change again on what the winner left. A writer
that is lost leaves only folders without a record; ``sweep`` removes those.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMMITS = "_commits"
#: Versions are padded to this many digits, so names sort as numbers.
DIGITS = 12


class Conflict(RuntimeError):
    """Another writer has committed in between."""


@dataclass(frozen=True)
class Snapshot:
    """What a version holds: the attempt folders of each table and the notes of the writer that made it."""

    root: str
    version: int = -1
    tables: dict[str, tuple[str, ...]] = field(default_factory=dict)
    notes: dict[str, str] = field(default_factory=dict)

    def paths(self, table: str) -> list[str]:
        return [f"{self.root}/{table}/{a}" for a in self.tables.get(table, ())]

    def read(self, spark: SparkSession, table: str, schema: T.StructType | str) -> DataFrame:
        """A table of this version; without any folder an empty one."""
        paths = self.paths(table)
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


# --- the file system of a path, as Spark resolves it --------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """The Hadoop file system that Spark itself uses for the path: Parquet writers cannot create a file only if it is absent."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return bool(files.exists(place))


def names(spark: SparkSession, path: str) -> list[str]:
    """Entries of a folder, in order; none where it does not exist."""
    files, place = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _files(spark, path)
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file in one step: under a name of its own first, then moved to a name that must be free."""
    files, place = _files(spark, path)
    _, draft = _files(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.exists(place) or not files.rename(draft, place):
        files.delete(draft, False)
        raise Conflict(path)


def remove(spark: SparkSession, path: str) -> None:
    files, place = _files(spark, path)
    files.delete(place, True)


# --- versions -----------------------------------------------------------------------------------------------------


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in names(spark, f"{root}/{COMMITS}") if n.isdigit()]


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest version, or the one asked for; version -1 without tables where nothing has been committed."""
    root = root.rstrip("/")
    known = versions(spark, root)
    if version is None:
        version = known[-1] if known else -1
    if version < 0:
        return Snapshot(root)
    if version not in known:
        raise ValueError(f"{root} has no version {version}")
    record = json.loads(read_text(spark, f"{root}/{COMMITS}/{version:0{DIGITS}d}"))
    return Snapshot(root, version, {t: tuple(a) for t, a in record["tables"].items()}, record["notes"])


def write_table(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    writer = rows.write.option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def commit(
    spark: SparkSession, base: Snapshot, add: dict[str, DataFrame], replace: tuple[str, ...] = (), notes: dict[str, str] | None = None,
    by: dict[str, tuple[str, ...]] | None = None,
) -> Snapshot:
    """Add rows to tables (or take their place, for those in ``replace``) as the version after ``base``."""
    attempt = f"attempt-{uuid.uuid4().hex}"
    for table, rows in add.items():
        write_table(rows, f"{base.root}/{table}/{attempt}", (by or {}).get(table, ()))
    tables = {t: list(a) for t, a in base.tables.items() if t not in replace}
    for table in add:
        tables[table] = [*tables.get(table, []), attempt]
    record = {"tables": tables, "notes": {**base.notes, **(notes or {})}}
    create(spark, f"{base.root}/{COMMITS}/{base.version + 1:0{DIGITS}d}", json.dumps(record))
    return Snapshot(base.root, base.version + 1, {t: tuple(a) for t, a in tables.items()}, record["notes"])


def transact(spark: SparkSession, root: str, change: Callable[[Snapshot], Snapshot | None], tries: int = 8) -> Snapshot:
    """Apply a change to the newest version; after a conflict build it again on the version that came in between.

    ``change`` gets the snapshot and commits on it, or returns None where there is nothing to do.
    """
    for attempt in range(tries):
        base = snapshot(spark, root)
        try:
            return change(base) or base
        except Conflict:
            time.sleep(min(2.0, 0.05 * 2**attempt))
    raise Conflict(f"{root}: no commit in {tries} tries")


def sweep(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove the folders that none of the last ``keep`` versions names, and the records before those; what was removed.

    Not while a writer is at work: its folders have no record yet.
    """
    root, known = root.rstrip("/"), versions(spark, root)
    kept = [snapshot(spark, root, v) for v in known[-keep:]]
    gone = []
    for table in names(spark, root):
        if table == COMMITS:
            continue
        used = {a for s in kept for a in s.tables.get(table, ())}
        gone += [f"{root}/{table}/{a}" for a in names(spark, f"{root}/{table}") if a not in used]
    gone += [f"{root}/{COMMITS}/{n}" for n in names(spark, f"{root}/{COMMITS}") if n.endswith(".tmp")]
    gone += [f"{root}/{COMMITS}/{v:0{DIGITS}d}" for v in known[:-keep]]
    for path in gone:
        remove(spark, path)
    return gone
