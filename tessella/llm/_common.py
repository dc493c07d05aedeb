"""What the operators of this package share: reading tables, Arrow batches and shared storage."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_dir, written  # noqa: F401  for the operators

#: Bounds of one Arrow batch, so that a worker's memory doesn't depend on the table's size.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def per_row(df: DataFrame, columns: list[str], schema: str, fn: Callable[[Iterator[tuple]], Iterable[tuple]]) -> DataFrame:
    """Run ``fn`` over the rows of Arrow batches: it takes tuples of ``columns`` and yields output tuples.

    The input is narrowed to ``columns`` first, so other columns, whatever their names, never reach Python.
    """
    bound_batches(df.sparkSession)
    out = StructType.fromDDL(schema)
    names = out.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        made: list[tuple] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        size = 0
        for row in fn(rows()):
            made.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(made) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(made, names, arrow)
                made, size = [], 0
        if made:
            yield _batch(made, names, arrow)

    return df.select(*columns).mapInArrow(run, out)


def _batch(made: list[tuple], names: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*made, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(n).type) for c, n in zip(cols, names, strict=True)], schema=arrow)


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return (text or "").encode()


def held_out(doc_id) -> bool:
    """The documents whose labels are never learnt from."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def held_out_col(doc_id):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1
