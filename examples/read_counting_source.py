"""Read a split source as a stream: ten integers, each with its event time.

    python examples/read_counting_source.py
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import tidewatch.sources
from tidewatch.sources import CountingSource
from tidewatch.streaming.run import drained, stream_session

if __name__ == "__main__":
    cloudpickle.register_pickle_by_value(tidewatch.sources)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session = stream_session(spark)
    session.dataSource.register(CountingSource)
    numbers = session.readStream.format("counting_source").option("maxCount", 10).option("numSplits", 2).load()
    drained(spark, numbers, "example").orderBy("value").show()
