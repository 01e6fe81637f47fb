"""Session settings and the shared folder that staged tables live in."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. A term, document or query text may hold a large share of the rows, so
# skewed joins are split even where that costs another shuffle.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "rankloom") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", "file:" + tempfile.mkdtemp(prefix="rankloom-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where it is set, else the configured warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


class Workspace:
    """Tables written once and read back: they cut lineage, survive lost executors and keep column pruning.

    The default root belongs to one application; name a ``root`` to find tables again in a later one.
    """

    _default: dict[str, Workspace] = {}

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = configure(spark)
        self.root = root or f"{shared_folder(spark)}/rankloom/{spark.sparkContext.applicationId}"
        self._staged: list[str] = []

    @classmethod
    def of(cls, spark: SparkSession) -> Workspace:
        app = spark.sparkContext.applicationId
        if app not in cls._default:
            cls._default[app] = cls(spark)
        return cls._default[app]

    @classmethod
    def use(cls, spark: SparkSession, root: str | None = None) -> Workspace:
        """Make ``root`` (or a new folder) the session's workspace; earlier tables are no longer found."""
        workspace = cls(spark, root or f"{shared_folder(spark)}/rankloom-{uuid.uuid4().hex}")
        cls._default[spark.sparkContext.applicationId] = workspace
        return workspace

    def new_path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def exists(self, path: str) -> bool:
        return path_status(self.spark, path) is not None

    def stage(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        path = self.new_path(name)
        df.write.partitionBy(*partition_by).parquet(path)
        self._staged.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete the staged tables, once nothing reads them any more; tables built under a fingerprint stay."""
        for path in self._staged:
            jvm_path, fs = _filesystem(self.spark, path)
            fs.delete(jvm_path, True)
        self._staged.clear()

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def build_or_load(
        self,
        name: str,
        fingerprint: Mapping[str, object],
        build: Callable[[], DataFrame],
        partition_by: Sequence[str] = (),
    ) -> DataFrame:
        """Read the table built earlier under the same parameters, else build and write it.

        The path is a digest of all parameters, so another ``k`` or a changed source never finds an old table.
        A table counts only once it is published whole; of two that are built at once, both builders read the first.
        """
        digest = hashlib.sha256(json.dumps(fingerprint, sort_keys=True, default=str).encode()).hexdigest()[:24]
        path = f"{self.root}/{name}-{digest}"
        found = published(self.spark, path)
        if found is None:
            found = publish(self.spark, path, lambda out: build().write.partitionBy(*partition_by).parquet(out))
        return self.spark.read.parquet(found)


def _filesystem(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_status(spark: SparkSession, path: str) -> dict[str, object] | None:
    """Bytes, file count and modification time below ``path``, or None if there is nothing."""
    jvm_path, fs = _filesystem(spark, path)
    if not fs.exists(jvm_path):
        return None
    summary = fs.getContentSummary(jvm_path)
    return {
        "path": path,
        "bytes": summary.getLength(),
        "files": summary.getFileCount(),
        "modified": fs.getFileStatus(jvm_path).getModificationTime(),
    }


_MARKER = "_PUBLISHED"


def published(spark: SparkSession, path: str) -> str | None:
    """The folder published below ``path``, or None as long as no writer has finished."""
    marker, fs = _filesystem(spark, f"{path}/{_MARKER}")
    if not fs.exists(marker):
        return None
    stream = fs.open(marker)
    try:
        return f"{path}/{stream.readUTF()}"
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Write to a folder of its own below ``path``, then publish it, unless another one was published meanwhile.

    Returns the published folder. A writer that dies leaves files that nobody reads; one that comes second deletes its
    own. The storage must honour create-without-overwrite, as HDFS, ABFS, GCS and current S3A do.
    """
    attempt = f"attempt={uuid.uuid4().hex}"
    write(f"{path}/{attempt}")
    if not _put_if_absent(spark, f"{path}/{_MARKER}", attempt):
        jvm_path, fs = _filesystem(spark, f"{path}/{attempt}")
        fs.delete(jvm_path, True)
    return published(spark, path)


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    jvm_path, fs = _filesystem(spark, path)
    if fs.getScheme() == "file":  # its create-without-overwrite first looks, then creates; a hard link is one step
        target = jvm_path.toUri().getPath()
        aside = f"{target}-{uuid.uuid4().hex}"
        with open(aside, "wb") as out:
            out.write(len(text.encode()).to_bytes(2, "big") + text.encode())
        try:
            os.link(aside, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
        return True
    try:
        stream = fs.create(jvm_path, False)
        stream.writeUTF(text)
        stream.close()
    except Py4JJavaError:
        if fs.exists(jvm_path):
            return False
        raise
    return True


def committed(spark: SparkSession, path: str) -> list[str]:
    """The published folders of all direct children of ``path``, in the order of their names."""
    jvm_path, fs = _filesystem(spark, path)
    if not fs.exists(jvm_path):
        return []
    names = sorted(child.getPath().getName() for child in fs.listStatus(jvm_path) if child.isDirectory())
    found = [published(spark, f"{path}/{name}") for name in names]
    return [folder for folder in found if folder is not None]
