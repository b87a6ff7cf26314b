"""Session defaults and the stage boundary that cuts long lineages."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.types import StructType

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_shared_stages: dict[tuple, tuple[str, StructType]] = {}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("crossweave")
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: the session's spark.checkpoint.dir.

    Only a local master may fall back to a folder of its own, because executors
    on other machines could not read it.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a shared folder.")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[app]


def _write_stage(df: DataFrame, tag: str, partition_by: list[str] | None = None, codec: str | None = None) -> str:
    path = f"{stage_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", codec) if codec else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once; needed where they cannot import it from their own path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    package = Path(__file__).resolve().parent
    # the driver's own temporary file: Spark hands it to the executors
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


class Checks:
    """Conditions on rows whose counts are taken by the very pass that writes them; the job fails after it if one does not hold.

    A retried task may count its rows twice, so conditions compare counts with zero, never with each other.
    """

    def __init__(self):
        self._found: list[tuple[Observation, Callable[[dict], str | None]]] = []

    def watch(self, df: DataFrame, message: Callable[[dict], str | None], **counts: Column) -> DataFrame:
        """df, watched: message gets the aggregates by name and returns what is wrong, or None. Filters above do not reach below it."""
        seen = Observation()
        self._found.append((seen, message))
        return df.observe(seen, *[c.alias(name) for name, c in counts.items()])

    def verify(self) -> None:
        found, self._found = self._found, []
        wrong = [m for m in (message(seen.get) for seen, message in found) if m]
        if wrong:
            raise ValueError(" ".join(wrong))


def stage(df: DataFrame, tag: str, partition_by: list[str] | None = None, checks: Checks | None = None, codec: str | None = None) -> DataFrame:
    """Write df as a Parquet table and read it back; then verify the checks that watched it.

    Later plans start from columnar files (pruned, with statistics), a lost
    executor re-reads files instead of replaying the history, and several
    consumers do not recompute the same input.
    """
    path = _write_stage(df, tag, partition_by, codec)
    if checks:
        checks.verify()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, source: str) -> int:
    """Number that follows the names, sizes and times of the files under source, wherever Spark can list them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return 0
    found, each = [], files.listFiles(path, True)
    while each.hasNext():
        f = each.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


def shared_stage(spark: SparkSession, source: str, tag: str, build, checks: Checks | None = None) -> DataFrame:
    """Stage build() once per application and state of the files under source; later calls reuse the table, rewritten inputs do not."""
    key = (spark.sparkContext.applicationId, source, fingerprint(spark, source), tag)
    if key not in _shared_stages:
        df = build()
        path = _write_stage(df, tag, codec="zstd")
        if checks:
            checks.verify()
        _shared_stages[key] = (path, df.schema)
    path, schema = _shared_stages[key]
    return spark.read.schema(schema).parquet(path)
