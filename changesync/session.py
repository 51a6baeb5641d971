"""Session settings the toolkit relies on, and where to cut lineage."""

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).parent

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # HotSpot never compiles methods over 8000 bytes. Wide projections reach that, and then run
    # several times faster as separate expressions than as one interpreted method.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A batch of 10,000 long texts is held several times over, outside the heap and in Python workers.
    "spark.sql.execution.arrow.maxBytesPerBatch": "7m",
    # A payload that repeats a member name is readable; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Duplicate detection may remember very many message ids: keep them on local disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Ids are hashes in hex, of which lz4 makes nothing shorter.
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and send the package to the executors' Python workers
    (the streaming folds run there); cluster sizing stays with the caller."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if not any(f"{PACKAGE.name}.zip" in f for f in spark.sparkContext.listFiles):
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='changesync-')}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name
        )
        spark.sparkContext.addPyFile(archive)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Only a local session may
    fall back to a folder of its own: on a cluster a machine-local path would not survive."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="changesync-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
