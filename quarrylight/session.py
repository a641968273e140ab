"""Session helpers: building a session, the shared folder, and cutting lineage by written tables."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quarrylight", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test) a temporary folder of this machine is
    made and set; a session on a cluster without the setting raises, because a folder of
    one machine would be lost with it.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quarrylight-")
    spark.conf.set("spark.checkpoint.dir", folder)
    context.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a file or folder of any Hadoop file system; a missing one is no error."""
    found, fs = _path(spark, path)
    fs.delete(found, True)


class Workspace:
    """A private folder under the shared folder for the written tables of one operator call.

    ``write`` cuts the lineage: the table is written as Parquet and read again, so a lost
    executor costs the rereading of a file and never the recomputation of earlier rounds.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        path = self.path(name)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete_path(self.spark, self.path(name))

    def clear(self) -> None:
        delete_path(self.spark, self.root)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The sorted names below a folder; none for a missing folder."""
    found, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []


def _rename(fs, source, target) -> bool:
    return fs.rename(source, target)


def replace_path(spark: SparkSession, part: str, path: str) -> None:
    """Puts the finished file or folder ``part`` in the place of ``path``.

    A former version is set aside first and removed last. If the renaming fails it is put
    back; if the process dies in between, :func:`restore_path` puts it back. So a complete
    version exists at every moment.
    """
    source, fs = _path(spark, part)
    target, _ = _path(spark, path)
    aside = None
    if fs.exists(target):
        aside, _ = _path(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}.old")
        if not _rename(fs, target, aside):
            raise OSError(f"cannot set {path} aside")
    done = False
    try:
        done = _rename(fs, source, target)
    finally:
        if not done and aside is not None:
            fs.rename(aside, target)
    if not done:
        raise OSError(f"cannot publish {path}")
    if aside is not None:
        fs.delete(aside, True)


def restore_path(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, after putting back a version that a process which died had set aside."""
    target, fs = _path(spark, path)
    if fs.exists(target):
        return True
    parent, name = target.getParent(), target.getName()
    if not fs.exists(parent):
        return False
    left = [s for s in fs.listStatus(parent) if s.getPath().getName().startswith(f"{name}.") and s.getPath().getName().endswith(".old")]
    if not left:
        return False
    newest = max(left, key=lambda s: (s.getModificationTime(), s.getPath().getName()))
    return fs.rename(newest.getPath(), target)


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """The whole of a small file, or None where there is none."""
    if not restore_path(spark, path):
        return None
    found, fs = _path(spark, path)
    stream = fs.open(found)
    try:
        return bytes(stream.readAllBytes())
    except Py4JJavaError as error:
        raise OSError(f"cannot read {path}: {error.java_exception.getMessage()}") from error
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole of a small text file, or None where there is none."""
    found = read_bytes(spark, path)
    return None if found is None else found.decode("utf-8")


def write_bytes_atomic(spark: SparkSession, path: str, body: bytes) -> None:
    """Writes a small file beside ``path`` and puts it there: readers see the former or the new one, never part of it."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    found, fs = _path(spark, part)
    try:
        stream = fs.create(found, True)
        try:
            stream.write(bytearray(body))
        finally:
            stream.close()
        replace_path(spark, part, path)
    finally:
        fs.delete(found, False)


def write_text_atomic(spark: SparkSession, path: str, text: str) -> None:
    write_bytes_atomic(spark, path, text.encode("utf-8"))


def clear_workspaces(spark: SparkSession) -> None:
    """Removes the written tables of all operator calls of this application; results that read them are void then.

    Operators drop what their own results don't read. The rest stays until this is called,
    or the shared folder's own cleaning takes it.
    """
    delete_path(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
