"""An append-only index of window signatures that a file stream feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.operators import clones


def start(stream: DataFrame, index: str, checkpoint: str, width: int = 50, lower: bool = True):
    """Append (file_id, pos, sig, batch) of each micro-batch of (file_id, content) to a Parquet table at `index`.

    Lexing is stateless, so no state store is kept.  A batch that runs again after a failure replaces its own folder, so
    the index holds every window once."""

    def put(batch: DataFrame, number: int) -> None:
        rows = clones.windows(clones.text_arrays(batch, lower=lower), width)
        rows.write.mode("overwrite").parquet(f"{index}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def repeated(spark, index: str) -> DataFrame:
    """(sig, n, first_batch, last_batch) of signatures that the index holds more than once."""
    rows = spark.read.parquet(index)
    return rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch")).where("n > 1")
