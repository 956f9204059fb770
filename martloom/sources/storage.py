"""Directory operations on whatever file system the cluster uses, and the shared scratch folder."""

import atexit
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession


_LOCAL: list[str] = []


def _named_folder(spark: SparkSession) -> str | None:
    """The folder set for checkpoints, by option or by call."""
    option = spark.conf.get("spark.checkpoint.dir", None)
    if option:
        return option
    called = spark.sparkContext._jsc.sc().getCheckpointDir()
    return called.get() if called.isDefined() else None


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder for one run, in the folder that all executors share.

    It is the one named by ``spark.checkpoint.dir`` or by ``setCheckpointDir``. Only a local session may go without
    and gets a temporary one; on a cluster executors would not see each other's files.
    """
    base = _named_folder(spark)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="martloom-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/martloom/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, keeping a folder the cluster has set."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))


def settle(df: DataFrame, label: str) -> DataFrame:
    """Keep a much smaller result in the shared folder and go on from there.

    What follows reads the stored rows instead of running the lineage again, survives lost
    executors, and plans with the true size, so a join with a huge table can broadcast it.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(seen: Observation, name: str = "rows") -> int:
    """An observed number; zero where the whole plan was found to be empty and so nothing was observed."""
    try:
        return seen.get[name]
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "AssertionError":
            raise
        return 0


class Folder:
    """A directory addressed through the Hadoop file system API."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._jpath(self.path).getFileSystem(self._conf)

    def _jpath(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def child(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._jpath(self.child(name)))

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._jpath(self.child(name)))

    def list(self, name: str = "") -> list[tuple[str, bool]]:
        """(entry name, is directory) of one level, sorted; empty when absent."""
        path = self._jpath(self.child(name))
        if not self._fs.exists(path):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in self._fs.listStatus(path))

    def move(self, source: str, target: str) -> None:
        """Rename inside the folder; the target must not exist yet."""
        dst = self._jpath(self.child(target))
        self._fs.mkdirs(dst.getParent())
        if self._fs.exists(dst) or not self._fs.rename(self._jpath(self.child(source)), dst):
            raise OSError(f"cannot move {self.child(source)} to {dst}")

    def remove(self, name: str = "") -> bool:
        return self._fs.delete(self._jpath(self.child(name)), True)

    def write_text(self, name: str, text: str) -> None:
        """Write a small file beside its target, then swap it in with one overwriting rename."""
        temporary = self._jpath(self.child(f".{name}.{uuid.uuid4().hex}"))
        target = self._jpath(self.child(name))
        out = self._fs.create(temporary, True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(target), options)

    def write_new(self, name: str, text: str) -> bool:
        """Write a small file that must not exist yet; False when another writer was first."""
        temporary = f".{name.replace('/', '-')}.{uuid.uuid4().hex}"
        out = self._fs.create(self._jpath(self.child(temporary)), True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        options = self._spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        target = self._jpath(self.child(name))
        self._fs.mkdirs(target.getParent())
        try:
            context.rename(self._fs.makeQualified(self._jpath(self.child(temporary))), self._fs.makeQualified(target), options)
        except Py4JJavaError as error:
            if not self._fs.exists(target) or "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self.remove(temporary)
            return False
        return True

    def read_text(self, name: str) -> str | None:
        path = self._jpath(self.child(name))
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()
