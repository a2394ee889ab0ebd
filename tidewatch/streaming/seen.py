"""The keys that a watch has seen, in Spark's state store.

What a step lists is written and picked up by one deduplication that runs as long as the watch.  Its
state, in RocksDB, has one entry per seed and key, spread by hash over the state partitions; a step looks
up and adds its own keys only, so its cost doesn't grow with what was seen before, and a seed with most of the keys is
spread over all partitions.  The log of the deduplication's checkpoint tells which steps it has taken in.

Under ``root``: ``listed/step=N``, deleted once it is taken in; ``new/batch=B``, what was new; ``state``, the checkpoint.
"""

from __future__ import annotations

import weakref

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.streaming.run import stream_session
from tidewatch.workspace import is_complete

KEY = ("seed", "key_hash")
#: How often a running watch looks whether a step was listed.
LOOK = "100 milliseconds"


class SeenKeys:
    """Keys by ``seed`` and ``key_hash``; steps are admitted one after another, each once.

    Whoever opens it closes it; opened again on the same ``root`` it goes on.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._batches: list[int] = []
        self._query: StreamingQuery | None = None

    def __enter__(self) -> "SeenKeys":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None

    def admit(self, listed: DataFrame, step: int) -> DataFrame:
        """The rows of ``listed`` whose key no earlier step had, as a table.

        ``listed`` has one row per seed and key.  A step that was admitted before gives the rows it
        gave then, whatever is listed now.
        """
        folder = f"{self.root}/listed/step={step}"
        known = self._query is not None
        if not is_complete(self.spark, folder):
            listed.withColumn("_step", F.lit(step).cast("long")).write.mode("overwrite").parquet(folder)
        else:
            known = False
        before = len(self._batches)
        self._started(listed.schema).processAllAvailable()
        # In a running watch the step's rows are in the batches since; else they are looked for in all.
        paths = [f"{self.root}/new/batch={b}" for b in self._batches[before:]] if known else [f"{self.root}/new"]
        found = self._read(paths, listed.schema)
        return found.filter(F.col("_step") == step).select(*listed.columns)

    def _read(self, paths: list[str], schema: StructType) -> DataFrame:
        stamped = StructType([*schema.fields, StructField("_step", LongType())])
        try:
            return self.spark.read.schema(stamped).parquet(*paths) if paths else self.spark.createDataFrame([], stamped)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], stamped)

    def _started(self, schema: StructType) -> StreamingQuery:
        if self._query is None:
            stamped = StructType([*schema.fields, StructField("_step", LongType())])
            stream = (
                stream_session(self.spark).readStream.schema(stamped)
                .option("cleanSource", "delete").option("ignoreMissingFiles", "true")
                .parquet(f"{self.root}/listed")
            )
            batches, root = self._batches, self.root

            def keep(batch: DataFrame, batch_id: int) -> None:
                batch.write.mode("overwrite").parquet(f"{root}/new/batch={batch_id}")
                batches.append(batch_id)

            self._query = (
                stream.dropDuplicates(list(KEY)).select(*stamped.names).writeStream.foreachBatch(keep)
                .option("checkpointLocation", f"{root}/state").trigger(processingTime=LOOK).start()
            )
            weakref.finalize(self, self._query.stop)
        return self._query
