"""Stream-shaped operators: the resource guard, resumable logs and last votes, as batch and as Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def guard_windows(samples: DataFrame, width: int = 36, limit: float = 90.0) -> DataFrame:
    """samples (host, ts, cpu, ram_pct) in batch: the CPU mean over a full window of `width` samples, the run of RAM
    breaches, and whether the guard fires (a full window above the limit, or two breaches in a row)."""
    order = Window.partitionBy("host").orderBy("ts", "seq")
    last = order.rowsBetween(-(width - 1), 0)
    rows = samples.withColumn("n", F.count(F.lit(1)).over(last)).withColumn("mean", F.avg("cpu").over(last)).withColumn("breach", (F.col("ram_pct") > limit).cast("int"))
    island = F.sum(1 - F.col("breach")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("island", island)
    streak = F.sum("breach").over(Window.partitionBy("host", "island").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    cpu_mean = F.when(F.col("n") == width, F.round("mean", 6))
    out = rows.withColumn("streak", streak).withColumn("cpu_mean", cpu_mean)
    return out.withColumn("fires", F.coalesce(F.col("cpu_mean") > limit, F.lit(False)) | (F.col("streak") >= 2)).select("host", "ts", "seq", "cpu_mean", F.col("streak").cast("long").alias("streak"), "fires")


def guard_stream(samples: DataFrame, every: str = "60 seconds", late: str = "30 seconds") -> DataFrame:
    """The tumbling log of a stream of samples: count, mean and top by host; late rows go by the watermark."""
    w = F.window("ts", every)
    return samples.withWatermark("ts", late).groupBy("host", w).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("cpu"), 6).alias("cpu_mean"), F.max("ram_pct").alias("ram_top")).select("host", F.col("window.start").alias("start"), "n", "cpu_mean", "ram_top")


def streaks_stream(samples: DataFrame, limit: float = 90.0, swap_limit: float = 2.0, least_free: float = 0.0) -> DataFrame:
    """Stateful: the run of breaches (RAM above the limit, or with a column free_gb less than `least_free` of it) and the growth of swap
    from a host's first sample, over micro-batches."""

    def step(key, batches, state: GroupState):
        run, base = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches), ignore_index=True)  # a host's samples of one trigger, in order whatever their batches were
        if len(rows):
            fired = []
            for r in rows.sort_values(["ts", "seq"]).itertuples():
                base = float(r.swap_gb) if base is None else base
                run = run + 1 if r.ram_pct > limit or getattr(r, "free_gb", least_free) < least_free else 0
                fired.append((key[0], int(r.seq), run, float(r.swap_gb) - base, run >= 2 or r.swap_gb - base > swap_limit))
            yield pd.DataFrame(fired, columns=["host", "seq", "streak", "swap_growth", "fires"])
        state.update((run, base))

    return samples.groupBy("host").applyInPandasWithState(step, "host string, seq long, streak long, swap_growth double, fires boolean", "run long, base double", "append", GroupStateTimeout.NoTimeout)


def resume(work: DataFrame, done: DataFrame, run: str) -> DataFrame:
    """Keys of the work list without a record under this run."""
    return work.join(done.where(F.col("run") == run).select("key"), "key", "left_anti")


def last_records(log: DataFrame) -> DataFrame:
    """The last record of each (run, key)."""
    return log.groupBy("run", "key").agg(F.max_by("record", "seq").alias("record"), F.max("seq").alias("seq"))


def last_votes_stream(log: DataFrame) -> DataFrame:
    """The last valid vote of each key of a stream of votes (key, label, seq), in update or complete mode."""
    return log.where(F.col("label") != "unparsed").groupBy("key").agg(F.max_by("label", "seq").alias("label"))


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str = "key"):
    """Appends each key of a stream once: a batch is held against what the table has (so a repeated batch adds nothing)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
