"""Text columns of tables as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A scan of fewer bytes is left as it is.
SPREAD_BYTES = 4 << 20
#: Bytes and rows of an Arrow batch: whole texts travel in them, and a batch exists in the JVM and in Python at once.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def lean(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, in sessions that leave Spark's defaults as they are."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, "10000") == "10000":
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """A scan dealt to all cores where its files give fewer tasks than there are cores.

    Files of one row group are one task each, however large. On a cluster's
    inputs, which have more row groups than cores, this changes nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    made = df._jdf.queryExecution()
    if made.toRdd().getNumPartitions() >= cores or int(str(made.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES:
        return df
    return df.repartition(cores)


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns) if columns else df)


def records_from(df: DataFrame, text: Column, archive: Column, member: Column, header: Column | None = None) -> DataFrame:
    """A record for each line of a text: lines end in \\n, \\r\\n or \\r, an end of line at the end starts none."""
    lines = F.split(text, "\r\n|\r|\n", -1)
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    rows = df.select(archive.cast("string").alias("archive"), member.cast("string").alias("member"), F.posexplode(lines).alias("pos", "text"), (header if header is not None else F.lit(None).cast("string")).alias("header"))
    none = F.array()
    return rows.select("archive", "member", none.cast("array<string>").alias("nested_path"), none.cast("array<int>").alias("route"), (F.col("pos") + 1).cast("long").alias("line"), "text", "header")


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: the archive is the source, the member the document's number as a .txt."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return records_from(docs, F.col("text"), F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
