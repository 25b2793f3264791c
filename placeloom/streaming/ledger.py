"""Streams: an idempotent ledger, convergent per-site state, a reaper of stale claims, event windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEDGER_KEY = ["site_id", "field", "observed_at", "source_md5", "value_md5"]
#: Folders of a batch, by a hash of the key: a batch reads those of the stored ledger that its own keys fall in.
SLOTS = 256


def append_stream(stream: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends each natural key once: a batch's new keys only, each batch in a folder of its own, so a batch written again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        new = batch.dropDuplicates(LEDGER_KEY).withColumn("slot", F.pmod(F.xxhash64(*LEDGER_KEY), F.lit(SLOTS)).cast("int"))
        if fs.exists(path):
            touched = [r.slot for r in new.select("slot").distinct().collect()]  # SLOTS numbers at most
            had = spark.read.parquet(folder).where((F.col("batch") != epoch) & F.col("slot").isin(touched))
            new = new.join(had.select(*LEDGER_KEY), LEDGER_KEY, "left_anti")
        new.write.mode("overwrite").partitionBy("slot").parquet(f"{folder.rstrip('/')}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def refresh_stream(stream: DataFrame) -> DataFrame:
    """The best (confidence, then least value) per site and field so far; merging what is stored with itself changes nothing."""

    def merge(key, batches, state: GroupState):
        best = state.get if state.exists else None
        for pdf in batches:
            for confidence, value in pdf[["confidence", "value"]].itertuples(index=False):
                new = (int(confidence), -int(value))
                best = new if best is None or new > tuple(best) else best
        state.update(tuple(best))
        yield pd.DataFrame({"site_id": [key[0]], "field": [key[1]], "value": [-best[1]], "confidence": [best[0]]})

    return stream.groupBy("site_id", "field").applyInPandasWithState(merge, "site_id long, field string, value long, confidence long", "confidence long, value long", "update", GroupStateTimeout.NoTimeout)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and type; for streams, under a watermark."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
