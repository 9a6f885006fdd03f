"""A table kept in folders by key bucket, of which a change rewrites only those that it touches.

``data/<snapshot>/bucket=<n>`` holds the rows of a bucket that a snapshot wrote,
``snapshots/<number>.json`` says which of these folders make up the table. A
snapshot counts once its file is there, which a rename brings about in one step;
what a failed writer leaves behind is in no snapshot. Readers of an older
snapshot keep their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import rows as row_ops

BUCKETS = 256
MOST_FOLDERS = 8  # of a bucket, before they are written as one


@dataclass
class Snapshot:
    """Folders by bucket; ``number`` is 0 for a table that nothing was written to."""

    number: int = 0
    folders: dict[int, list[str]] = field(default_factory=dict)
    mark: int | None = None  # what the writer noted, e.g. its last batch


class Store:
    """The table at ``path``. Rows are dealt to buckets by the hash of ``by``, which need not be the whole key."""

    def __init__(
        self, spark: SparkSession, path: str, schema: StructType, by: Sequence[str], buckets: int = BUCKETS, bloom: str | None = None
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.by, self.buckets, self.bloom = list(by), buckets, bloom

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows fall into; there are ``buckets`` of them at most."""
        return sorted(row.b for row in rows.select(self.bucket().alias("b")).distinct().collect())

    # Snapshots

    def _files(self):
        location = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots")
        return location.getFileSystem(self.spark._jsc.hadoopConfiguration()), location

    def snapshot(self) -> Snapshot:
        """The newest one."""
        files, location = self._files()
        if not files.exists(location):
            return Snapshot()
        names = [status.getPath().getName() for status in files.listStatus(location)]
        numbers = [int(name.removesuffix(".json")) for name in names if name.endswith(".json") and not name.startswith(("_", "."))]
        if not numbers:
            return Snapshot()
        raw = self.spark.read.text(f"{self.path}/snapshots/{max(numbers):010d}.json", wholetext=True).first().value
        said = json.loads(raw)
        return Snapshot(max(numbers), {int(b): names for b, names in said["folders"].items()}, said["mark"])

    def _commit(self, before: Snapshot, folders: dict[int, list[str]], mark: int | None) -> Snapshot:
        files, location = self._files()
        made = Snapshot(before.number + 1, {b: names for b, names in folders.items() if names}, mark)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        draft, final = path(location, f"_{uuid.uuid4()}"), path(location, f"{made.number:010d}.json")
        out = files.create(draft, True)
        out.write(json.dumps({"folders": made.folders, "mark": mark}).encode())
        out.close()
        if files.exists(final) or not files.rename(draft, final):
            raise RuntimeError(f"{self.path}: snapshot {made.number} was written by another writer")
        return made

    # Reading

    def paths(self, snapshot: Snapshot, buckets: Iterable[int] | None = None) -> list[str]:
        wanted = snapshot.folders if buckets is None else [b for b in buckets if b in snapshot.folders]
        return [f"{self.path}/data/{name}/bucket={b}" for b in sorted(wanted) for name in snapshot.folders[b]]

    def read(self, buckets: Iterable[int] | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """The rows of some buckets, or of all; no folder of any other bucket is listed or opened."""
        paths = self.paths(snapshot or self.snapshot(), buckets)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # Writing

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """Writes rows as folders of their buckets; those that hold anything are returned."""
        name = str(uuid.uuid4())
        names = self.schema.fieldNames()
        placed = rows.select(*names, self.bucket().alias("bucket")).hint("rebalance", "bucket")
        writer = placed.sortWithinPartitions("bucket", *self.by).write
        if self.bloom:  # for the search of single keys
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.bloom}", "true")
        writer.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        files, _ = self._files()
        found = files.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}"))
        folders = [status.getPath().getName() for status in found]
        return name, [int(f.removeprefix("bucket=")) for f in folders if f.startswith("bucket=")]

    def append(self, rows: DataFrame, mark: int | None = None) -> Snapshot:
        """Adds rows, and notes ``mark``; buckets in many pieces become one piece each."""
        before = self.snapshot()
        name, written = self._write(rows)
        folders = {b: list(names) for b, names in before.folders.items()}
        for b in written:
            folders.setdefault(b, []).append(name)
        made = self._commit(before, folders, before.mark if mark is None else mark)
        many = [b for b, names in folders.items() if len(names) > MOST_FOLDERS]
        return self.compact(many) if many else made

    def compact(self, buckets: Sequence[int]) -> Snapshot:
        """Writes each of some buckets as one folder."""
        before = self.snapshot()
        return self._replace(before, buckets, self.read(buckets, before))

    def _replace(self, before: Snapshot, buckets: Sequence[int], rows: DataFrame) -> Snapshot:
        """Puts rows, which fall into these buckets only, in place of what the buckets hold."""
        name, written = self._write(rows)
        folders = {b: names for b, names in before.folders.items() if b not in set(buckets)}
        folders |= {b: [name] for b in written}
        return self._commit(before, folders, before.mark)

    def upsert(self, updates: DataFrame, keys: Sequence[str]) -> Snapshot:
        """Rows with the same key are overwritten, the others added; ``updates`` holds each key once, and ``keys`` hold ``by``."""
        before, touched = self.snapshot(), self.touched(updates)
        updates = updates.select(*self.schema.fieldNames())
        return self._replace(before, touched, row_ops.upsert(self.read(touched, before), updates, list(keys)))

    def delete(self, gone: DataFrame, keys: Sequence[str]) -> Snapshot:
        before, touched = self.snapshot(), self.touched(gone)
        return self._replace(before, touched, row_ops.delete(self.read(touched, before), gone, list(keys)))

    def delete_all(self) -> Snapshot:
        """A snapshot of nothing; the files of earlier ones stay until they are cleared away."""
        before = self.snapshot()
        return self._commit(before, {}, before.mark)
