"""Session settings, table loading and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_MARKED: set[str] = set()


def builder(app: str = "bandwright", cores: str = "*", partitions: int = 8):
    """A SparkSession builder with the settings the engine is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _path(spark: SparkSession, path: str):
    """A Hadoop file system and path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def versions(spark: SparkSession, path: str) -> tuple:
    """Name, time of change, bytes and number of files of what a folder holds: it changes when a table is written anew."""
    fs, p = _path(spark, path)
    found = []
    for x in fs.listStatus(p):
        c = fs.getContentSummary(x.getPath())
        found.append((x.getPath().getName(), x.getModificationTime(), c.getLength(), c.getFileCount()))
    return tuple(sorted(found))


@contextmanager
def locked(spark: SparkSession, path: str):
    """Holds ``path``/lock, which only one writer can make; RuntimeError if another has it."""
    fs, p = _path(spark, path)
    fs.mkdirs(p)
    _, lock = _path(spark, f"{path}/lock")
    if not fs.createNewFile(lock):
        raise RuntimeError(f"another writer holds {path}")
    try:
        yield
    finally:
        fs.delete(lock, False)


def newest(spark: SparkSession, path: str) -> str | None:
    """The last version that ``publish`` put in place."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    done = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())
    return f"{path}/v{done[-1]}" if done else None


def publish(spark: SparkSession, path: str, write) -> str:
    """A new version of ``path``: ``write`` fills a folder beside it, which a rename puts in place; the version before the last goes."""
    last = newest(spark, path)
    n = int(last.rsplit("/v", 1)[1]) + 1 if last else 0
    beside, to = f"{path}/next-{uuid.uuid4().hex}", f"{path}/v{n}"
    write(beside)
    fs, p = _path(spark, beside)
    if not fs.rename(p, _path(spark, to)[1]):
        raise RuntimeError(f"{to} could not be put in place")
    if n > 1:
        remove(spark, f"{path}/v{n - 2}")
    return to


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent, a local session gets a folder of its own (removed at exit); on a cluster that is an error, as no
    folder is known to be shared there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        import shutil

        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="bandwright-")
        atexit.register(shutil.rmtree, _OWN_DIRS[app], ignore_errors=True)
    return "file://" + _OWN_DIRS[app]


def _folder(spark: SparkSession) -> str:
    """The application's part of the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/bandwright-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        fs, p = _path(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _MARKED.add(path)
    return path


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that nothing is at yet, removed when the driver ends."""
    return f"{_folder(spark)}/scratch-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: the lineage ends here and lost executors lose nothing.

    Parquet rather than ``checkpoint()``: it is compressed and later readers prune columns. ``release`` removes it before the session ends.
    """
    spark, names = df.sparkSession, df.columns
    path = f"{_folder(spark)}/cut-{uuid.uuid4().hex}"
    clash = len({c.lower() for c in names}) < len(names)  # a file can't hold such names
    plain = df.toDF(*[f"c{i}" for i in range(len(names))]) if clash else df
    plain.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(plain.schema).parquet(path)
    back = back.toDF(*names) if clash else back
    back._cut = path
    return back


def release(*tables: DataFrame) -> None:
    """Removes the files of tables that ``cut`` made and nothing reads any more: the tables a loop has replaced."""
    for t in tables:
        if (path := getattr(t, "_cut", None)) is not None:
            remove(t.sparkSession, path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
