"""Incremental ingest of price files into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import PRICES, latest, touched, upsert, write_store
from ..operators.work import Saved


def ingest(spark: SparkSession, landing: str, store: str, checkpoint: str) -> StreamingQuery:
    """Upserts every new file of ``landing`` (Parquet) into ``store`` and stops; a batch that is run again changes nothing.

    Of rows with one key, that of the newest file counts.  Only the folders (price mode and month) that a batch has rows
    for are read and rewritten, from a copy in the shared folder that is whole before they are replaced.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        save = Saved(spark, "ingest")
        fresh = save(latest(batch.where("open is not null or close is not null"), ["ticker", "date", "price_mode"], "written").drop("written"), "fresh")
        old = touched(spark, store, fresh)
        write_store(fresh if old is None else save(upsert(old, fresh), "merged"), store)
        save.close()

    stream = spark.readStream.schema(PRICES).parquet(landing)
    stream = stream.withColumn("written", F.struct("_metadata.file_modification_time", "_metadata.file_path"))
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
