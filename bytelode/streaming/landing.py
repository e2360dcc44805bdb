"""Carving of images as they arrive: whole ones, which are independent, or by chunks, of which light rows wait for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bytelode.operators.reporter import Reporter
from bytelode.plans.carve import CarveConfig, carve, finished, scanned


#: What opening a file counts as in bytes where tasks are made of many small files: some hundred of them, not 32, fill one.
OPENING = 256 << 10


def _for_small_files(spark: SparkSession) -> SparkSession:
    """A session with the settings of spark in which few tasks list and read many small files.

    By default each batch of a stream is listed by a job of up to 10,000 tasks. What a stream reads keeps to the session
    that it was defined in, so these settings are not made and taken back in the caller's.
    """
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.files.openCostInBytes", OPENING)
    return own


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, config: CarveConfig | None = None, files_per_batch: int = 100, reporter: Reporter | None = None) -> StreamingQuery:
    """Carve every new file of folder into Parquet at out, with batch_id; stops when all present files are done.

    A batch that is tried again replaces its own rows, since each batch writes its own partition. A reporter is told of
    every batch, under its number, after its rows are written. The query belongs to a session of its own.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = _for_small_files(spark).readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    images = stream.select(F.col("path").alias("image_id"), "content")

    def one(batch: DataFrame, batch_id: int) -> None:
        at = f"{out}/batch_id={batch_id}"
        carve(batch, config).write.mode("overwrite").parquet(at)
        if reporter is not None:
            reporter.add(batch.sparkSession.read.parquet(at), batch_id)

    return images.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_chunks(chunks: DataFrame, out: str, state: str, checkpoint: str, config: CarveConfig | None = None) -> StreamingQuery:
    """Carve images in file mode whose chunks arrive in any number of batches and any order, as `carve` does from all of them.

    chunks is a stream of image_id, chunk_no, chunk_offset, bytes and last (whether it is the image's last chunk). Of every
    chunk only its hits and what it tells of its ends are kept, at state; an image's files are written to out, with batch_id,
    by the batch that brings the last chunk that it lacked. A batch that is tried again replaces its own rows in both. A
    chunk that comes twice, in one batch or in several, counts once.
    """
    config = config or CarveConfig()

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(["image_id", "chunk_no"])
        once.where("last").select("image_id", (F.col("chunk_no") + 1).alias("chunks")).write.mode("overwrite").parquet(f"{state}/lengths/batch_id={batch_id}")
        scanned(once, config).write.mode("overwrite").parquet(f"{state}/rows/batch_id={batch_id}")
        rows = spark.read.parquet(f"{state}/rows").where(F.col("batch_id") <= batch_id)
        lengths = spark.read.parquet(f"{state}/lengths").where(F.col("batch_id") <= batch_id).groupBy("image_id").agg(F.max("chunks").alias("chunks"))
        # a chunk's first batch is the one that counts
        came = rows.where("_ends and spec_idx = -1").groupBy("image_id", "chunk_no").agg(F.min("batch_id").alias("batch_id"))
        whole = came.groupBy("image_id").agg(F.count("*").alias("n"), F.max("batch_id").alias("done")).join(lengths, "image_id").where((F.col("n") == F.col("chunks")) & (F.col("done") == batch_id))
        here = rows.join(came, ["image_id", "chunk_no", "batch_id"], "left_semi").join(whole.select("image_id"), "image_id", "left_semi").drop("batch_id")
        finished(here, config).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return chunks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
