"""Shared plumbing of the training-data operators: table access, shared-folder tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_importable, materialise, shared_dir, spread

__all__ = ["WORD_PATTERN", "byte_groups", "free_name", "hash_sample", "id_bucket", "map_batches", "materialise", "read_table", "release_memory", "shared_dir", "shielded", "spread", "word_count"]

# ASCII white space of the word rule used across the operators; everything else belongs to words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, through Spark's readers only (any Hadoop path works)."""
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(
    df: DataFrame,
    schema: str,
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
) -> DataFrame:
    """``mapInArrow`` with one function per batch; empty results are skipped."""

    ensure_importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def byte_groups(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to about ``limit``; one larger row makes a range of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shielded(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with the columns that bear one of an operator's own names renamed, and the way back (for ``withColumnsRenamed``)."""
    renamed: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in names:
            renamed[c] = free_name(df, f"kept{len(renamed)}")
    return df.withColumnsRenamed(renamed), {v: k for k, v in renamed.items()}


def word_count(column: str = "text") -> F.Column:
    """Number of words (``WORD_PATTERN``) as a long; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def id_bucket(column: str, modulus: int) -> F.Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the split rule of the learning operators (null id: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0)).cast("int")


def hash_sample(df: DataFrame, key: F.Column, most: int, salt: str) -> DataFrame:
    """The rows of about ``most`` distinct keys, chosen by a seeded digest: all rows while there are no more keys than that.

    The distinct keys are counted first (eight bytes each) and the digest's bound follows from the count, so nothing but chosen
    rows is ever moved, and a key repeated any number of times counts once; the sample's size stays within a few
    square roots of ``most``.
    """
    drawn = F.xxhash64(key.cast("string"), F.lit(salt))
    n = df.select(drawn.alias("drawn")).distinct().count()
    if n <= most:
        return df
    return df.where(F.pmod(drawn, F.lit(1 << 32)) < int(most / n * (1 << 32)))


def release_memory() -> None:
    """Give memory that a worker no longer uses back to the system, where the platform can (glibc)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return
