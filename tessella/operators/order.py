"""Positions in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys that bounds are chosen from, for each range.
KEYS_A_RANGE = 20
MAX_RANGES = 256


def _bounds(df: DataFrame, order: tuple[str, ...], ranges: int) -> list:
    """Keys that cut the order into about equal ranges: quantiles of those with the least hashes, at most 20 a range."""
    some = df.select(*order).orderBy(F.xxhash64(*order)).limit(KEYS_A_RANGE * ranges)
    keys = [r[0] for r in some.select(F.struct(*order).alias("key")).distinct().orderBy("key").collect()]
    return [keys[k * len(keys) // ranges] for k in range(1, ranges) if k * len(keys) // ranges > 0] if len(keys) > 1 else []


def numbered(df: DataFrame, *order: str, name: str = "_at") -> DataFrame:
    """``df`` with each row's position from 0 over a global order, which should be total: ties are settled by chance.

    Ranges are cut at constant keys, so that counts and rows agree however often, and wherever,
    they are computed; the driver sees at most 256 counts. Each range numbers its own rows and
    starts where those before end. Nulls come first; an empty table stays empty.
    """
    ranges = max(1, min(MAX_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = list(dict.fromkeys(_bounds(df, order, ranges)))
    key = F.struct(*order)
    kinds = dict(df.dtypes)
    part: Column = F.lit(0)
    for b in bounds:
        part = part + (key >= F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, b, strict=True)])).cast("int")
    parted = df.withColumn("_part", part)
    counts = {r._part: r["count"] for r in parted.groupBy("_part").count().collect()}
    starts, total = [], 0
    for k in range(len(bounds) + 1):
        starts.append(total)
        total += counts.get(k, 0)
    first = F.get(F.array(*[F.lit(n).cast("long") for n in starts]), F.col("_part"))
    return parted.withColumn(name, first + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part")
