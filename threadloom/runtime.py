"""Session helpers: the shared scratch folder, cutting lineage, reading tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session may go without: it gets a folder that ends with it."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="threadloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed with the others."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


@atexit.register
def forget(spark: SparkSession | None = None) -> None:
    """Removes what this process has written to the shared folder: with a session on any file system, at exit where the folder is a mounted one."""
    for path in list(_written):
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        elif spark is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        else:
            continue
        _written.remove(path)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it back; lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wide(spark: SparkSession) -> int:
    """A number of partitions for few but heavy rows, which adaptive execution would put together by their bytes."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of the session, once."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "threadloom_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


#: Smaller tables stay as they are.
SPREAD_BYTES = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a file scan over all cores, where the files give less than half as many partitions as there are cores; else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or 2 * df._jdf.rdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def latest(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """One row per key, the one with the greatest ts (null ts counts as oldest); equal ts: the greatest row wins.

    Aggregates with a partial maximum, so repeated rows of a hot key meet in the map tasks first.
    Rows whose key is null are left out.
    """
    rest = [c for c in columns if c not in keys]
    best = F.max(F.struct(F.col(ts).alias("__ts"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(rest)]))
    kept = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(best.alias("__best"))
    return kept.select(*keys, *[F.col(f"__best.__{i}").alias(c) for i, c in enumerate(rest)])
