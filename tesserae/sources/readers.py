"""Readers as fixed rules: delimited text, JSON, constants."""

from __future__ import annotations

import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.plans.ir import EngineError
from tesserae.storage import new_path

TYPES = {"Any": T.StringType(), "String": T.StringType(), "Uuid": T.StringType(), "Int": T.LongType(), "Float": T.DoubleType()}


def lines(spark: SparkSession, url: str) -> str | DataFrame:
    """A path that Spark reads, or the lines fetched over HTTP."""
    if url.startswith(("http://", "https://")):
        with urllib.request.urlopen(url) as r:  # one file, read by the driver
            return spark.createDataFrame([(x,) for x in r.read().decode().splitlines()], "value string")
    return url


def indexed(df: DataFrame, prepend: bool) -> DataFrame:
    """Numbers rows from 0 in the order of the file."""
    if not prepend:
        return df
    from tesserae.operators.graph import numbered_as_is

    return numbered_as_is(df, "_index").select("_index", *df.columns)


def read_csv(spark: SparkSession, url: str, types: list[str], delimiter: str = ",", has_headers: bool = True, prepend_index: bool = False) -> DataFrame:
    if len(delimiter.encode()) != 1:
        raise EngineError("csv", "a delimiter is one byte")
    text = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(types))])
    source = lines(spark, url)
    if isinstance(source, DataFrame):
        rows = indexed(source, True).where("_index > 0").select("value") if has_headers else source
        df = rows.select(F.from_csv("value", text.simpleString()[7:-1].replace(":", " "), {"sep": delimiter}).alias("r")).select("r.*")
    else:
        df = spark.read.csv(source, schema=text, sep=delimiter, header=has_headers, enforceSchema=True, mode="PERMISSIVE")
    out = []
    for f, kind in zip(text.fields, types, strict=True):
        base = kind.rstrip("?")
        if base not in TYPES:
            raise EngineError("csv", f"a CSV column can't be {kind}")
        c = F.col(f.name)
        loose = c.try_cast(TYPES[base])
        out.append((loose if kind.endswith("?") or isinstance(TYPES[base], T.StringType) else F.coalesce(loose, F.raise_error(F.concat(F.lit(f"not a {base}: "), F.coalesce(c, F.lit("null")))).cast(TYPES[base]))).alias(f.name))
    return indexed(df.select(*out), prepend_index)


def read_json(spark: SparkSession, url: str, fields: list[str], json_lines: bool = True, null_if_absent: bool = False, prepend_index: bool = False) -> DataFrame:
    source = lines(spark, url)
    if isinstance(source, DataFrame):
        path = new_path(spark, "fetched")
        source.coalesce(1).write.text(path)
        source = path
    df = spark.read.json(source, multiLine=not json_lines)
    out = []
    for f in fields:
        if f in df.columns:
            c = F.col(f"`{f}`")
            out.append(c if null_if_absent else F.coalesce(c, F.raise_error(F.lit(f"field {f} is absent")).cast(df.schema[f].dataType)).alias(f))
        elif null_if_absent:
            out.append(F.lit(None).cast("string").alias(f))
        else:
            raise EngineError("json", f"field {f} is absent")
    return indexed(df.select(*out), prepend_index)
