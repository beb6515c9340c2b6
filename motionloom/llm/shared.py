"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a side may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint where its counted rows are few enough, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text: Column) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(text)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of so many rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def text_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def indices(n: Column) -> Column:
    """0 .. n-1, empty for n = 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def inline_rows(spark: SparkSession, names: str, rows: Sequence[tuple]) -> DataFrame:
    """A few literal rows as a local relation, whose size the planner knows."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    values = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({names})")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Texts of the jobs run inside go to Python in batches of so many rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_pieces(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words between ASCII blanks, in lists of about `size` bytes."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end].split()
        at = end
    yield (data[at:] if at else data).split()


def share_of(keys: Sequence[str], wanted: int, total: int) -> Column:
    """Whether a row is among about `wanted` of `total`, by a 64-bit hash of its keys; all rows of a smaller table."""
    if total <= wanted:
        return F.lit(True)
    return F.xxhash64(*keys) < F.lit((wanted << 64) // total - 2**63).cast("long")
