"""Written tables in the folder that the cluster shares: where loops cut their lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session on one machine may leave it unset: it gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tesserae/{uuid.uuid4().hex}/{name}"
    atexit.register(_remove_at_exit, spark, path)
    return path


def materialise(df: DataFrame, name: str = "table", **seen) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and lineage ends at files that survive lost
    executors. Aggregates given by keyword are taken while it is written, and stand in the result's `seen`."""
    spark = df.sparkSession
    path = new_path(spark, name)
    names = df.columns
    found = Observation(uuid.uuid4().hex) if seen else None
    rows = df.observe(found, *[v.alias(k) for k, v in seen.items()]) if seen else df
    rows = rows.toDF(*[f"c{i}" for i in range(len(names))])
    void = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.NullType)]
    rows = rows.withColumns({c: F.col(c).cast("string") for c in void}) if void else rows
    rows.write.parquet(path)
    out = spark.read.schema(rows.schema).parquet(path).toDF(*names)
    if any(f.metadata for f in df.schema.fields):
        out = out.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata) for f in df.schema.fields])
    out._written_at, out.seen = path, found.get if seen else {}
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    remove(df.sparkSession, df._written_at)


def cut(df: DataFrame, **seen) -> DataFrame:
    """df, computed once and read from the shared folder from here on; `seen` as in materialise()."""
    return materialise(df, "cut", **seen)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) and the number of its rows, without a job of its own."""
    out = cut(df, n=F.count(F.lit(1)))
    return out, out.seen["n"]


#: Rows of a part that spread() makes, and how many times its even share of all rows a part may hold before they are dealt out.
PART_ROWS, UNEVEN = 1 << 14, 1.5


def spread(df: DataFrame, by: str) -> DataFrame:
    """df for costly work on each row, dealt out by a column over all cores where it has fewer parts than those, or where few
    of its parts hold most rows: a file is cut into parts by its bytes, but one task reads a whole row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, by)
    parts = df.select(F.spark_partition_id().alias("part")).groupBy("part").count()  # no column is read
    found = parts.agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    if (found["most"] or 0) <= UNEVEN * (found["n"] or 0) / cores:
        return df
    return df.repartition(max(cores, -(-found["n"] // PART_ROWS)), by)


def sorted_join(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. Spark takes a list for one element and an explode for one row of each,
    so a table that follows from the input may be sized below the threshold of a broadcast and not fit the driver."""
    return df.hint("merge")


#: Bytes, as Spark sizes a table, of a part whose distinct rows a task holds.
DISTINCT_BYTES = 1 << 20


def distinct_rows(df: DataFrame) -> DataFrame:
    """df.distinct() in parts of bounded size: a table too large for the session's number of parts is dealt into more."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = -(-size // DISTINCT_BYTES)
    if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(n, *[F.col(f"`{c}`") for c in df.columns])
    return df.distinct()
