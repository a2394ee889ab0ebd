"""Stable 128-bit digests of deduplication keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# Micro-second patterns: the JSON default keeps milliseconds only, which would
# give two different timestamps the same digest.  The zone is fixed, so that an instant has
# the same digest in every session.
_JSON_OPTIONS = {
    "timeZone": "UTC",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def canonical_key(*parts: Column | str) -> Column:
    """One unambiguous string per key: quoted, separated and NULL-safe."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    named = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])
    return F.to_json(named, _JSON_OPTIONS)


def with_one_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Floating ``columns`` with 0.0 in place of -0.0, which grouping takes for equal but JSON does not."""
    floating = [c for c in columns if isinstance(df.schema[c].dataType, (DoubleType, FloatType))]
    zeros = {c: F.when(F.col(c) == 0, F.lit(0.0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in floating}
    return df.withColumns(zeros) if zeros else df


def key_digest(*parts: Column | str) -> Column:
    """128-bit digest of a key as 32 hex characters, the same in every process."""
    return F.md5(canonical_key(*parts))
