from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch import DEFAULT_MAX_COMPLETED_SIZE, Watch, after_iterations


def test_builder_copies():
    first = Watch.growth_of()
    second = first.with_poll_interval(2).with_termination_per_input(after_iterations(3)).with_max_completed_size(5)
    assert (first.poll_interval, first.max_completed_size) == (1.0, DEFAULT_MAX_COMPLETED_SIZE)
    assert (second.poll_interval, second.max_completed_size) == (2.0, 5)
    assert second.termination == after_iterations(3) and first.termination != second.termination
    assert first.with_poll_interval(timedelta(milliseconds=500)).poll_interval == 0.5


def test_default_memory_is_bounded():
    assert DEFAULT_MAX_COMPLETED_SIZE == 100_000


@pytest.mark.parametrize("bad", [0, -1, float("inf"), float("nan")])
def test_bad_interval(bad):
    with pytest.raises(ValueError):
        Watch.growth_of().with_poll_interval(bad)


def test_bad_arguments():
    spec = Watch.growth_of()
    for call in (
        lambda: spec.with_poll_interval("1 s"),
        lambda: spec.with_termination_per_input("never"),
        lambda: spec.with_output_key("value"),
        lambda: spec.with_max_completed_size(1.5),
        lambda: spec.with_max_completed_size(True),
        lambda: spec.with_value_type(int),
        lambda: Watch.growth_of("poll"),
    ):
        with pytest.raises(TypeError):
            call()
    with pytest.raises(ValueError):
        spec.with_max_completed_size(-1)


def test_declared_types(spark):
    outputs = spark.createDataFrame([("s", "7")], "seed string, value string")
    typed, key = Watch.growth_of().with_value_type("int").keyed(outputs)
    assert dict(typed.dtypes)["value"] == "int" and key == ["value"]
    spec = Watch.growth_of(output_key=lambda v: F.substring(v, 1, 1)).with_key_type("bigint")
    typed, key = spec.keyed(outputs)
    assert dict(typed.dtypes)["key"] == "bigint" and key == ["key"]
