"""Watch a folder: poll it every half second, emit each file name once, stop after 3 seconds.

    python examples/watch_folder.py /data/incoming
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from tidewatch import PollResult, Watch, after_total_of, per_seed
from tidewatch.streaming import ticks
from tidewatch.workspace import new_folder


def list_folder(folder: str) -> PollResult:
    return PollResult.of(sorted(os.listdir(folder)))


if __name__ == "__main__":
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spec = (
        Watch.growth_of(per_seed(list_folder, "string"))
        .with_poll_interval(0.5)
        .with_termination_per_input(after_total_of(3.0))
    )
    seeds = "seed string, added_at timestamp_ntz, event_ts timestamp_ntz"
    watch = ticks.Ticks(
        spark, spec, lambda s: s.createDataFrame([(sys.argv[1], None, None)], seeds), new_folder(spark, "example")
    )
    ticks.run(watch)
    watch.emitted().select("seed", "poll_no", "value", "discovered_ts").orderBy("poll_no", "value").show(truncate=False)
