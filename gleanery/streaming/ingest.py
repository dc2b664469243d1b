"""New documents as they come: chunked, and added unless their chunks are there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery import schema
from gleanery.operators import chunkers


#: Parts of the written table, by the hash of chunk set and document; a batch reads those that it writes to.
PARTS = 256


def chunk_stream(docs: DataFrame, chunker: str, over: dict | None = None) -> DataFrame:
    """A stream of documents (with loaded_at) as a stream of chunks; a document sent again within a day is dropped."""
    once = docs.withWatermark("loaded_at", "1 day").dropDuplicatesWithinWatermark(["doc_id"]) if "loaded_at" in docs.columns else docs
    return chunkers.chunk(once, chunker, over)


def ingest(docs: DataFrame, folder: str, checkpoint: str, chunker: str, over: dict | None = None) -> StreamingQuery:
    """Write the chunks of a document stream to a Parquet folder, each (chunk_set_id, doc_id, ordinal) once, and stop when the input is used up.

    A batch that is done again after a failure adds nothing twice: it looks for
    its keys in the parts of the folder that its documents belong to.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        key = ["chunk_set_id", "doc_id", "ordinal"]
        new = chunkers.chunk(batch, chunker, over).select(*(f.name for f in schema.CHUNK.fields)).dropDuplicates(key)
        new = new.withColumn("part", F.pmod(F.xxhash64("chunk_set_id", "doc_id"), F.lit(PARTS)).cast("int"))
        fs = (path := spark._jvm.org.apache.hadoop.fs.Path(folder)).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            sets = batch.select("corpus", "doc_id").distinct().select(chunkers.chunk_set_of(F.col("corpus"), chunker, over).alias("chunk_set_id"), "doc_id")
            parts = sets.select(F.pmod(F.xxhash64("chunk_set_id", "doc_id"), F.lit(PARTS)).cast("int").alias("part")).distinct().collect()  # PARTS rows at most
            old = spark.read.parquet(folder).filter(F.col("part").isin([r["part"] for r in parts]))
            new = new.join(old.select(*key), key, "left_anti")
        new.repartition("part").write.mode("append").partitionBy("part").parquet(folder)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of a stream of events (ts, event_type, value) in tumbling windows; rows later than `late` are dropped."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "total",
    )
