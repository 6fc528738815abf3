"""Readers and writers: Parquet tables, JSON documents and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "doc_id long, chunk_no int, chunk_id string, strategy string, text string, section string, section_number string, section_path array<string>, para_start int, para_end int, n_words int, est_tokens int"
GOLDEN = "retrieval array<struct<id:string,question:string,question_zh:string,target_paras:array<int>,section:string>>, traps array<struct<id:string,type:string,question:string,question_zh:string,note:string>>"
ITEM = "id string, `group` string, split string, source string, perturbation string, gold_label string, claim string, passage string, chunk_id string, note string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later plans read it instead of growing. It lies in the folder that spark.checkpoint.dir names, or in one in
    the warehouse where that is unset."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return df.checkpoint()


def write_chunks(chunks: DataFrame, path: str) -> None:
    """A partition for each strategy replaces the earlier one."""
    chunks.write.mode("overwrite").partitionBy("strategy").parquet(path)


def read_chunks(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("strategy") == strategy)


def read_chunks_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def golden_set(spark: SparkSession, path: str, language: str = "en") -> tuple[DataFrame, DataFrame]:
    """(retrieval questions, traps) of one JSON document; the Chinese wording where asked and given."""
    doc = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    asked = F.coalesce("question_zh", "question") if language == "zh" else F.col("question")
    pick = lambda c: doc.select(F.explode(c).alias("g")).select("g.*").withColumn("question", asked)
    return pick("retrieval"), pick("traps").withColumn("type", F.coalesce("type", F.lit("far_absent")))


def judge_items(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Item files by source; missing files are skipped, blank lines too, and absent fields get the source's defaults."""
    out = spark.createDataFrame([], ITEM)
    for source, path in paths.items():
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            rows = spark.read.schema(ITEM).option("mode", "DROPMALFORMED").json(path)
            out = out.unionByName(rows.withColumn("source", F.coalesce("source", F.lit(source))).withColumn("perturbation", F.coalesce("perturbation", F.lit(source))).withColumn("split", F.coalesce("split", F.lit("test"))))
    return out


def read_log(spark: SparkSession, path: str, schema: str, run: str | None = None) -> DataFrame:
    """An append-only log of JSON lines: a torn line is dropped, rows of other runs too."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows if run is None else rows.where(F.col("run") == run)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def retire_log(spark: SparkSession, path: str, run: str, limited: bool = False) -> str | None:
    """A finished run's log gets a name of its own; runs that were limited keep theirs. The new name, or null."""
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.done-{run}")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return new.toString() if not limited and fs.exists(old) and fs.rename(old, new) else None


def last_records(spark: SparkSession, path: str, schema: str, run: str) -> DataFrame:
    """The last record of each key of one run in an append-only log of JSON lines (run, key, seq, record)."""
    return read_log(spark, path, schema, run).groupBy("key").agg(F.max_by("record", "seq").alias("record"))


def write_embeddings(vectors: DataFrame, path: str) -> None:
    """id, vector, model, strategy: a partition for each model and strategy."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "strategy").parquet(path)
