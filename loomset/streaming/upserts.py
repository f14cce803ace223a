"""A table that streams correct in place: batches replace rows by key, and may be replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomset.runtime import BROADCAST_BYTES, materialise

_NUMBER = "_batch"
PARTS = 1_000_000  # most partitions whose newest batches are broadcast


class UpsertTable:
    """Rows with unique ``keys`` below ``path``, partitioned by the column ``part``, which is never NULL.

    A batch writes the partitions it touches anew, under its own number, and then lists them; readers
    take each partition from the last batch that lists it. A batch that is replayed starts from the batches before
    it and replaces what it wrote, so that it changes nothing. Files of earlier batches stay until the table is dropped.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], part: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema, self.keys, self.part = schema, keys, part
        self.whole = StructType([*schema.fields, StructField(_NUMBER, LongType())])
        self.listed = StructType([schema[part], StructField(_NUMBER, LongType())])

    def _stored(self, kind: str, schema: StructType) -> DataFrame:
        """Rows of all batches; the folder is made first, so that a table without batches reads as empty."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")

    def read(self, before: int | None = None) -> DataFrame:
        """The rows, or those that batches before the given one left."""
        listed = self._stored("commits", self.listed)
        if before is not None:
            listed = listed.where(F.col(_NUMBER) < before)
        newest = listed.groupBy(self.part).agg(F.max(_NUMBER).alias(_NUMBER))
        rows, size = newest.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(self.part).cast("string")) + 16), F.lit(0))).first()
        newest = F.broadcast(newest) if rows <= PARTS and size <= BROADCAST_BYTES else newest
        return self._stored("data", self.whole).join(newest, [self.part, _NUMBER], "left_semi").select(*self.schema.names)

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Put the rows of ``batch`` in place of those with their keys."""
        batch = materialise(batch.select(*self.schema.names), "batch")
        touched = batch.select(self.part).distinct()
        kept = self.read(number).join(touched, self.part, "left_semi").join(batch.select(*self.keys), self.keys, "left_anti")
        kept.unionByName(batch).write.mode("overwrite").partitionBy(self.part).parquet(f"{self.path}/data/{_NUMBER}={number}")
        touched.write.mode("overwrite").parquet(f"{self.path}/commits/{_NUMBER}={number}")


def run_upserts(df: DataFrame, table: UpsertTable, checkpoint: str) -> None:
    """Process everything there is of a stream in update mode, batch by batch into ``table``, and stop."""
    query = (
        df.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, number))
        .option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    )
    query.awaitTermination()
