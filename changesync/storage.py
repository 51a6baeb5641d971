"""Keyed tables on plain Parquet: copy-on-write buckets, and a manifest per batch id.

Parquet has no MERGE, so a batch writes the buckets it changes under `v=<batch>` and then puts a
manifest in place that names the files of every bucket. Running a batch id again overwrites the
same files and manifest, which makes a restarted batch exactly-once. Writers without batch ids
commit against the version they read, and start over when another was faster. A table format with
MERGE can take the same deltas instead.
"""

import atexit
import contextlib
import json
import random
import uuid
from collections.abc import Callable, Iterator, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from changesync.session import ensure_checkpoint_dir


def _files(spark: SparkSession, folder: str):
    """(file system, path constructor) of a folder, whatever store it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _text(spark: SparkSession, file: str) -> str:
    fs, path = _files(spark, file)
    stream = fs.open(path(file))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


# Scratch folders not deleted yet, with what it takes to delete them.
_open: dict = {}


@atexit.register
def _delete_left_overs() -> None:
    """Results that were handed out lazily keep their scratch tables until the program ends."""
    for root, (fs, path) in list(_open.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            fs.delete(path(root), True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back as soon as it is done. Left to Spark they lie on the executors' disks
    until the driver's garbage collector meets their plan, so those of a whole batch add up. Only for results that are written:
    one that is read twice would be shuffled twice."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


class Scratch:
    """Intermediate tables of one batch, in the shared checkpoint folder.

    Writing a result and reading it back cuts lineage, costs nothing when executors are
    lost, and lets later readers prune columns. `free` a table when its last reader was written,
    `delete` all of them when the batch is done (or enter the scratch); what is left goes when the program ends.
    They are compressed as the session says, or by the codec given.
    """

    def __init__(self, spark: SparkSession, codec: str | None = None) -> None:
        self.codec = codec
        self.spark, self.root = spark, f"{ensure_checkpoint_dir(spark)}/work-{uuid.uuid4().hex}"
        self._count, self._kept = 0, []
        _open[self.root] = _files(spark, self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}-{name}"
        df.write.parquet(path, compression=self.codec)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((kept, path))
        return kept

    def free(self, *tables: DataFrame) -> None:
        """Delete tables that `keep` returned. Nothing made of them can be read any more."""
        fs, path = _files(self.spark, self.root)
        for _, folder in [k for k in self._kept if any(k[0] is t for t in tables)]:
            fs.delete(path(folder), True)
        self._kept = [k for k in self._kept if not any(k[0] is t for t in tables)]

    def delete(self) -> None:
        fs, path = _open.pop(self.root, None) or _files(self.spark, self.root)
        fs.delete(path(self.root), True)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.delete()


class Lease:
    """The scratch folders that are opened while it is entered, to be deleted together."""

    def __enter__(self) -> "Lease":
        self._before, self._mine = set(_open), set()
        return self

    def __exit__(self, *_) -> None:
        self._mine = set(_open) - self._before

    def delete(self) -> None:
        for root in self._mine & set(_open):
            fs, path = _open.pop(root)
            fs.delete(path(root), True)


class StaleWriter(RuntimeError):
    """The table has moved on from the version that a write was made for."""


ATTEMPT_BITS = 40  # files of an attempt at version n lie under v = n << ATTEMPT_BITS and a random number


class KeyedTable:
    """A versioned table under `root`; `schema` is used while nothing was written yet.

    Rows lie in `buckets` by the hash of their `key` (ignoring case; the first column if not
    given). A version is a manifest that names, for each bucket, the batch that wrote it last, so
    an update writes the buckets it touches and shares all others with the version before.
    Versions older than the newest `keep` are removed with what only they refer to.

    A table is written either in batches by one writer (`write`, `update`), of which one older than the
    newest version is refused, or by any number of writers at a time (`change`).
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: Sequence[str] = (), buckets: int = 64, keep: int = 3) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.columns = spark.createDataFrame([], schema).columns
        self.key, self.buckets, self.keep = list(key) or self.columns[:1], buckets, keep

    def _committed(self) -> list[int]:
        """Versions that were finished: one manifest each, which a rename puts in place whole."""
        fs, path = _files(self.spark, self.root)
        folder = path(f"{self.root}/_commits")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, version: int | None) -> dict[int, int]:
        """bucket → batch that wrote it."""
        if version is None:
            return {}
        found = json.loads(_text(self.spark, f"{self.root}/_commits/{version}"))
        self.buckets = found["buckets"]  # fixed when the table was first written
        return {int(b): v for b, v in found["written"].items()}

    def version(self) -> int | None:
        return max(self._committed(), default=None)

    def older(self, batch_id: int) -> int | None:
        """The version a batch starts from: the newest one older than it, so a repeated batch sees what
        its first run saw."""
        return max((v for v in self._committed() if v < batch_id), default=None)

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        if not manifest:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/v={v}/bucket={b}" for b, v in sorted(manifest.items())])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._manifest(self.version() if version is None else version))

    def before(self, batch_id: int) -> DataFrame:
        """The state a batch starts from."""
        return self._read(self._manifest(self.older(batch_id)))

    def _bucket(self, key: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*[F.lower(F.col(c).cast("string")) for c in key]), F.lit(self.buckets)).cast("int")

    def _touched(self, changes: DataFrame, key: Sequence[str]) -> set[int]:
        return {r["b"] for r in changes.select(self._bucket(key or self.key).alias("b")).distinct().collect()}  # at most `buckets`

    def before_of(self, changes: DataFrame, batch_id: int, key: Sequence[str] = ()) -> DataFrame:
        """The rows a batch starts from, of the buckets that `changes` touch only."""
        manifest = self._manifest(self.older(batch_id))
        touched = self._touched(changes, key)
        return self._read({b: v for b, v in manifest.items() if b in touched})

    def _refuse_stale(self, batch_id: int) -> None:
        newest = self.version()
        if newest is not None and newest > batch_id:
            raise StaleWriter(f"{self.root} is at version {newest}: batch {batch_id} came too late")

    def write(self, df: DataFrame, batch_id: int) -> None:
        """A whole new version."""
        self._refuse_stale(batch_id)
        self._commit(batch_id, {}, self._put(df, batch_id, self.buckets))

    def update(self, changes: DataFrame, batch_id: int, merge: Callable[[DataFrame], DataFrame], key: Sequence[str] = ()) -> None:
        """A version in which the buckets of `changes` (found by `key`, the table's own if not given) hold what
        `merge` makes of their old rows. `merge` must keep rows of other keys and add none."""
        self._refuse_stale(batch_id)
        manifest = self._manifest(self.older(batch_id))
        touched = self._touched(changes, key)
        written = set()
        if touched:
            old = self._read({b: v for b, v in manifest.items() if b in touched})
            written = self._put(merge(old), batch_id, len(touched))
        self._commit(batch_id, {b: v for b, v in manifest.items() if b not in touched}, written)

    def change(self, changes: DataFrame, merge: Callable[[DataFrame], DataFrame], key: Sequence[str] = (), attempts: int = 10) -> int:
        """Like `update`, beside other writers; returns the version made. The commit goes through only
        if the version that was read is still the newest; otherwise the buckets are read again and
        `merge` runs anew, so it must not depend on anything but its argument. `StaleWriter` after
        `attempts` lost races. Whether two commits can both go through depends on the store: it must not
        rename onto an existing file."""
        fs, path = _files(self.spark, self.root)
        for _ in range(attempts):
            base = self.version()
            manifest, version = self._manifest(base), (base or 0) + 1
            touched = self._touched(changes, key)
            attempt, written = version << ATTEMPT_BITS | random.getrandbits(ATTEMPT_BITS), set()
            if touched:
                old = self._read({b: v for b, v in manifest.items() if b in touched})
                written = self._put(merge(old), attempt, len(touched))
            kept = {b: v for b, v in manifest.items() if b not in touched}
            if self._place(fs, path, version, kept | dict.fromkeys(written, attempt), replace=False):
                self._remove_old(fs, path)
                return version
            fs.delete(path(f"{self.root}/v={attempt}"), True)
        raise StaleWriter(f"{self.root}: {attempts} attempts lost to other writers")

    def _put(self, df: DataFrame, batch_id: int, parts: int) -> set[int]:
        """Write the rows by bucket; returns the buckets that have any."""
        rows = df.select(*self.columns, self._bucket(self.key).alias("bucket")).repartition(parts, "bucket")
        with freeing_shuffles(self.spark):
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v={batch_id}")
        fs, path = _files(self.spark, self.root)
        names = [s.getPath().getName() for s in fs.listStatus(path(f"{self.root}/v={batch_id}"))]
        return {int(n.split("=")[1]) for n in names if n.startswith("bucket=")}

    def _commit(self, batch_id: int, kept: dict[int, int], written: set[int]) -> None:
        self._refuse_stale(batch_id)
        fs, path = _files(self.spark, self.root)
        self._place(fs, path, batch_id, kept | dict.fromkeys(written, batch_id), replace=True)
        self._remove_old(fs, path)

    def _place(self, fs, path, version: int, manifest: dict[int, int], replace: bool) -> bool:
        """Put a manifest in place whole. Without `replace`, False if the version is there already."""
        draft, final = path(f"{self.root}/_commits/.{uuid.uuid4().hex}"), path(f"{self.root}/_commits/{version}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"buckets": self.buckets, "written": manifest}).encode()))
        stream.close()
        if replace:
            fs.delete(final, False)  # of a run of this batch that ended early
            fs.rename(draft, final)
            return True
        sc = self.spark.sparkContext
        hadoop = sc._jvm.org.apache.hadoop.fs
        plain = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)  # fails where the file exists
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(draft, final, plain)
            return True
        except Py4JJavaError as failed:
            if "FileAlreadyExistsException" not in failed.java_exception.getClass().getName():
                raise
            fs.delete(draft, False)
            return False

    def _remove_old(self, fs, path) -> None:
        versions = self._committed()
        live = {(v, b) for version in versions[-self.keep :] for b, v in self._manifest(version).items()}
        for version in versions[: -self.keep]:
            fs.delete(path(f"{self.root}/_commits/{version}"), False)
        newest = versions[-1]
        for folder in fs.listStatus(path(self.root)):
            name = folder.getPath().getName()
            if not name.startswith("v="):
                continue
            version, gone = int(name[2:]), 0
            made_for = version >> ATTEMPT_BITS
            if (made_for > versions[0]) if made_for else (version > newest):
                continue  # may be under way
            inside = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().startswith("bucket=")]
            for bucket in inside:
                if (version, int(bucket.getName().split("=")[1])) not in live:
                    gone += fs.delete(bucket, True)
            if gone == len(inside):
                fs.delete(folder.getPath(), True)


class Published:
    """Which batches of a streaming query were written to a log whole: an empty file each, beside the log.

    Batch numbers mean something together with their checkpoint only. A log that another
    checkpoint wrote to is refused, as its batches would be taken for those of this query.
    """

    def __init__(self, spark: SparkSession, log: str, checkpoint: str) -> None:
        query = json.loads(_text(spark, f"{checkpoint.rstrip('/')}/metadata"))["id"]
        self.fs, self.path = _files(spark, log)
        root = f"{log.rstrip('/')}/_done"
        self.folder = f"{root}/{query}"
        if self.fs.exists(self.path(root)) and not self.fs.exists(self.path(self.folder)):
            raise RuntimeError(f"{log} was written with another checkpoint than {checkpoint}")

    def has(self, batch_id: int) -> bool:
        return self.fs.exists(self.path(f"{self.folder}/{batch_id}"))

    def add(self, batch_id: int) -> None:
        self.fs.create(self.path(f"{self.folder}/{batch_id}"), True).close()


def append_partitioned(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Append to a log partitioned by batch and `partitions`; a repeated batch replaces
    its own part only."""
    (
        df.withColumn("batch_id", F.lit(batch_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions, "batch_id").parquet(path)
    )
