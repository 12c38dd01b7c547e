"""What the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

import hostlens
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# functions for Arrow tasks travel with the job: executors need not have this package installed
cloudpickle.register_pickle_by_value(hostlens)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where neither that setting nor setCheckpointDir() names one, a single-machine session (tests) gets a temporary folder; a cluster is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="hostlens-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/hostlens-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str, of: str = "") -> Column:
    """A column of exactly this name, whatever characters it has; `of`: the struct that it is a field of."""
    return F.col((f"{of}." if of else "") + "`" + name.replace("`", "``") + "`")


def renamed(df: DataFrame) -> DataFrame:
    """The columns as _c0, _c1, ...: Arrow functions don't take names with dots."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])


_scope: ContextVar[Scope | None] = ContextVar("hostlens-scope", default=None)


class Scope:
    """Tables that written() makes inside are deleted at the end: what leaves the scope must not read them.

    keep() writes a table that outlives the scope; it belongs to the scope around it, if any.
    """

    def __init__(self):
        self.folders: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scope:
        self.outer, self._token = _scope.get(), _scope.set(self)
        return self

    def __exit__(self, *_) -> None:
        _scope.reset(self._token)
        for spark, folder in self.folders:
            _delete(spark, folder)

    def keep(self, df: DataFrame) -> DataFrame:
        return _write(df, self.outer)


def _write(df: DataFrame, scope: Scope | None) -> DataFrame:
    spark = df.sparkSession
    path = shared_dir(spark)
    if scope is not None:
        scope.folders.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    vars(out)["_folder"] = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(df: DataFrame) -> None:
    """Deletes the table that written() or keep() returned; another DataFrame stays."""
    if folder := vars(df).get("_folder"):
        _delete(df.sparkSession, folder)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder: it survives lost executors. It lives as long as the Scope around it; without one, until somebody clears the folder."""
    return _write(df, _scope.get())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5 of the parts, the same in every run and engine: 52 bits."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
