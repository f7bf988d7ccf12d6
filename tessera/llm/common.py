"""Shared pieces: the shared scratch folder, written cut points, bounded text batches."""

from __future__ import annotations

import contextlib
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..paths import delete, scratch

SPACES = " \t\n\x0b\f\r"
#: Byte table that lower-cases A-Z, and the bytes of a long text that are cut into words at once.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 1 << 20


def lean() -> None:
    """Hand a Python worker's unused memory back; called at the end of a task, as workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_WATCHED: list[list[str]] = []


@contextlib.contextmanager
def watched():
    """Collects the paths that `materialise` writes inside the block, for `drop_paths` once nothing reads them."""
    _WATCHED.append([])
    try:
        yield _WATCHED[-1]
    finally:
        _WATCHED.pop()


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        delete(spark, p)
    paths.clear()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and outlives any executor."""
    path = scratch(df.sparkSession, label)
    for paths in _WATCHED:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised DataFrame that nothing will read again."""
    drop_paths(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def unused(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    held = {c.lower() for c in docs.columns}
    return next(n for n in (f"_{name}{i}" for i in itertools.count()) if n not in held)


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with columns c0, c1, ... in place of its own names, and what the given ones are called there."""
    low = [c.lower() for c in docs.columns]
    return docs.toDF(*[f"c{i}" for i in range(len(low))]), [f"c{low.index(n.lower())}" for n in names]


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(texts: list, limit: int):
    """Index ranges [a, b) of consecutive texts holding about limit characters; a longer text stands alone."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and held + n > limit:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(texts):
        yield a, len(texts)
