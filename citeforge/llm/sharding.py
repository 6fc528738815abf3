"""Proportional stratified interleaving into shards, with DataFrame operations only.

Rows of each source are shuffled by a seeded digest and ranked; a row's fractional rank (rank - 1/2) / rows of
the source spreads every source evenly over [0, 1). Sorted by it, any contiguous cut has the sources in their
overall proportions, and cutting at i * n / shards gives shards whose row counts differ by at most one (law
`rows`).

No rank needs a source in one task: digests are dealt into `buckets` per source, rows are ranked inside a
(source, bucket), and the counts of earlier buckets (an aggregate of at most sources * buckets rows) are added.
The global order is ranked in the same way over equal steps of the fractional rank. Only ids, digests and
sizes are shuffled, never texts.

Cases: a null source is a stratum of its own; a null text has size 1 and crc32 0; rows with the same id are
ordered by crc32, size and source, and wholly equal rows are interchangeable; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SEED, BUCKETS = 8, "citeforge", 4096


def shard(docs: DataFrame, text: str = "text", source: str = "source", shards: int = SHARDS, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and stratum (source)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("stratum"),
        digest.alias("digest"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumn("bucket", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % buckets)

    counts = rows.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    of_stratum = Window.partitionBy("stratum")
    before = counts.select("stratum", "bucket", F.sum("n").over(of_stratum).alias("total"), (F.sum("n").over(of_stratum.orderBy("bucket")) - F.col("n")).alias("earlier"))
    inside = Window.partitionBy("stratum", "bucket").orderBy("digest", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("r", F.row_number().over(inside)).join(before, ["stratum", "bucket"]).select(
        "doc_id", "stratum", "digest", "size", "text_crc32", "total", (F.col("r") + F.col("earlier")).alias("rank")
    )
    # (2 rank - 1) / (2 total) in whole steps of 1 / buckets, and the remainder for the order inside a step
    ranked = ranked.withColumn("at", (2 * F.col("rank") - 1) / (2 * F.col("total"))).withColumn("step", F.floor(F.col("at") * buckets))

    steps = ranked.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    over_all = Window.orderBy("step")  # at most `buckets` rows
    starts = steps.select("step", (F.sum("n").over(over_all) - F.col("n")).alias("earlier"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all_rows"))
    in_step = Window.partitionBy("step").orderBy("at", "stratum", "digest", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("r", F.row_number().over(in_step)).join(starts, "step").withColumn("g", F.col("r") - 1 + F.col("earlier"))
    # whole-number cut: shard k holds the global places ceil(k n / shards) up to ceil((k + 1) n / shards)
    placed = placed.withColumn("shard", F.expr(f"cast(g * {shards} div all_rows as int)"))
    slot = F.col("g") - F.expr(f"(shard * all_rows + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.when(F.col("stratum") != "", F.substring("stratum", 2, 1 << 30)).alias("stratum"),
    )
