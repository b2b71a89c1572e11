"""Shared plumbing of the training-data operators: scratch space, table access, files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    The cluster names it in ``spark.checkpoint.dir``; only in local mode, where that is unset, a
    temporary folder of this machine is chosen and set. On a cluster that would be seen by one
    machine alone, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = getattr(spark.sparkContext, "_freshet_shared", None)
    if not where:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.sparkContext.setCheckpointDir(where)
        spark.sparkContext._freshet_shared = where
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/freshet/{name}-{uuid.uuid4().hex}"
    scratch(spark).append(path)
    return path


def scratch(spark: SparkSession) -> list[str]:
    """The paths that this session made below the shared folder and that weren't discarded yet."""
    context = spark.sparkContext
    if not hasattr(context, "_freshet_scratch"):
        context._freshet_scratch = []
    return context._freshet_scratch


def discard_scratch(spark: SparkSession, but: DataFrame | None = None, since: int = 0) -> None:
    """Delete what was made (from the since-th path on), for when results have been written and
    nothing lazy reads scratch any more; ``but``: a materialized table that stays."""
    kept = getattr(but, "_freshet_path", None)
    for path in scratch(spark)[since:]:
        if path != kept:
            discard(path, spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends at files
    that survive the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._freshet_path = path
    return out


def materialize_counted(df: DataFrame, name: str, **values) -> tuple[DataFrame, dict]:
    """The same, and what the named aggregates give, worked out as the rows are written."""
    seen = Observation()
    out = materialize(df.observe(seen, *(v.alias(k) for k, v in values.items())), name)
    return out, seen.get


def discard(df_or_path: DataFrame | str, spark: SparkSession) -> None:
    """Delete a scratch table that nothing reads any more."""
    path = df_or_path if isinstance(df_or_path, str) else getattr(df_or_path, "_freshet_path", None)
    if path:
        if path in scratch(spark):
            scratch(spark).remove(path)
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a driver table; all others are pruned from the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spread(spark: SparkSession) -> int:
    """Partitions for a shuffle made by hand."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Shares of a group that are looked at on their own.
SALTS = 64

#: Up to so many groups' minima (two numbers each) are broadcast.
FEW = 200_000


def with_minimum(rows: DataFrame, by: str, value: str, name: str, salt: Sequence[str], groups: int | None = None) -> DataFrame:
    """rows with the least value of their group, null where all are null; rows with a null group
    are dropped. ``groups``: the most groups there can be, if the caller has counted; of up to FEW
    the minima are broadcast.

    A group may hold a large share of all rows: it is dealt out over SALTS tasks by a hash of
    the columns of salt, both for its minimum and for handing that back, and what meets under the
    group alone is at most SALTS rows.
    """
    if groups is not None and groups <= FEW:
        own = rows.where(F.col(by).isNotNull())
        return own.join(F.broadcast(own.groupBy(by).agg(F.min(value).alias(name))), by)
    dealt = rows.where(F.col(by).isNotNull()).withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int"))
    shares = dealt.groupBy(by, "_salt").agg(F.min(value).alias("_least"))
    groups = shares.groupBy(by).agg(F.min("_least").alias(name))
    back = shares.select(by, "_salt").join(groups, by)
    return dealt.join(back, [by, "_salt"]).drop("_salt")


def free_name(taken: Sequence[str], name: str) -> str:
    """name, or that with underscores in front, so that it isn't one of taken (whatever case)."""
    own = {c.lower() for c in taken}
    while name.lower() in own:
        name = "_" + name
    return name


def struct_of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


def let(value, body):
    """``body(value)`` with value evaluated once per row.

    Catalyst inlines a projected expression into the lambda that uses it and would evaluate
    it again for each element; a one-element array binds it instead.
    """
    return F.transform(F.array(value), body)[0]
