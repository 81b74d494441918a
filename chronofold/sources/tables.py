"""Time series and spectra from ordinary tables and from arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, chan, value): each embedding is a spectrum, its components scaled to integers."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("chan", "x"))
    return rows.select("t", "chan", F.floor((F.col("x").cast("double") + 4) * 16).cast("long").alias("value"))


def event_series(spark: SparkSession, sf_dir: str, hours: int = 720) -> DataFrame:
    """(event_type, t, value): events by hour since the first hour of all, hours without any as 0.

    An event beyond ``hours`` is an error: none drops out silently.
    """
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.date_trunc("hour", "ts").alias("h"))
    counts = rows.groupBy("event_type", "h").agg(F.count("*").alias("n"))
    start = rows.agg(F.min("h").alias("h0"))
    seconds = F.unix_timestamp(F.col("h").cast("timestamp")) - F.unix_timestamp(F.col("h0").cast("timestamp"))
    hourly = counts.crossJoin(F.broadcast(start)).select("event_type", F.floor(seconds / 3600).cast("long").alias("t"), "n")
    beyond = F.raise_error(F.lit(f"events go on beyond {hours} hours")).cast("long")
    hourly = hourly.withColumn("t", F.when(F.col("t") < hours, F.col("t")).otherwise(beyond))
    grid = counts.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long"))).alias("t"))
    return grid.join(hourly, ["event_type", "t"], "left").select("event_type", "t", F.coalesce("n", F.lit(0)).cast("long").alias("value"))


def shipping_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, value): quantity by shipping day since the first."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.to_date("l_shipdate").alias("d"), "l_quantity")
    daily = rows.groupBy("d").agg(F.sum("l_quantity").cast("long").alias("value"))
    start = rows.agg(F.min("d").alias("d0"))
    return daily.crossJoin(F.broadcast(start)).select(F.datediff("d", "d0").cast("long").alias("t"), "value")


def samples_from_numpy(spark: SparkSession, data: np.ndarray) -> DataFrame:
    """(t, chan, value) of a [time][channel] array, or (t, ifno, chan, value) of one with an IF axis."""
    at = np.indices(data.shape).reshape(data.ndim, -1)
    names = ["t", "chan"] if data.ndim == 2 else ["t", "ifno", "chan"]
    kind = {"u1": np.int16, "u2": np.int32, "u4": np.int64}.get(data.dtype.str[1:], data.dtype)
    columns = {"t": at[0].astype(np.int64)} | {n: a.astype(np.int32) for n, a in zip(names[1:], at[1:], strict=True)}
    return spark.createDataFrame(pa.table(columns | {"value": data.astype(kind).ravel()}))


def series_from_numpy(spark: SparkSession, data: np.ndarray, tsamp: float, dm_low: float = 0.0, dm_step: float = 0.0) -> DataFrame:
    """(dm_index, dm, tsamp, data) of a [dm][time] array."""
    n = np.arange(len(data), dtype=np.int32)
    columns = {"dm_index": n, "dm": dm_low + n * float(dm_step), "tsamp": np.full(len(data), float(tsamp)), "data": pa.array(list(data.astype(np.float32)), pa.list_(pa.float32()))}
    return spark.createDataFrame(pa.table(columns))
