"""Streaming forms of the gap and session operators, over a growing folder of event files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def events(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*", kind: str = "parquet") -> DataFrame:
    """New files of a folder as an append-only stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(folder)


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of (session_id, ts): user, start, last event, events.  A session ends ``gap`` after its last event."""
    w = stream.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n"), F.max("ts").alias("last")).select("session_id", F.col("w.start").alias("first"), "last", "n")


def tumbling(stream: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    """Events and their mean value in windows of one length."""
    w = stream.withWatermark("ts", late).groupBy("session_id", F.window("ts", length).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("session_id", F.col("w.start").alias("start"), "n", "total")


def idle(stream: DataFrame, least: int) -> DataFrame:
    """Gaps of ``least`` microseconds or more between consecutive events (session_id, t_us) of a session, as soon as the event
    that ends one arrives; the last time of each session is the only state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        t = sorted(v for pdf in batches for v in pdf.t_us.tolist())
        out = []
        for v in t:
            if last is not None and v - last >= least:
                out.append((key[0], last, v))
            last = v if last is None else max(last, v)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["session_id", "s", "e"])

    return stream.groupBy("session_id").applyInPandasWithState(step, "session_id long, s long, e long", "last long", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files that are there now, as a table in the shared folder."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tempograph-")
    root = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{root}/log").option("path", f"{root}/out").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
