"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, spread, stored  # noqa: F401

#: Code points that one vectorised step holds; a longer text is a step of its own.
STEP_CHARS = 600_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder that the cluster names and go on from there.

    Only on one machine, where the session names none, is a temporary folder set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fresh(df: DataFrame, *names: str, hidden: bool = True) -> list[str]:
    """The names, with underscores around (or after, if not hidden) where a column of the rows has one of them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        own = f"__{name}" if hidden else name
        while own.lower() in taken:
            own += "_"
        out.append(own)
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def in_steps(texts: list[str | None], limit: int = STEP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of at most `limit` code points (or one longer text): first index, texts."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def map_rows(df: DataFrame, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch | pa.Table]], schema: str) -> DataFrame:
    """mapInArrow where `each` turns one batch into any number of batches."""

    def run(batches):
        for batch in batches:
            for out in each(batch):
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return df.mapInArrow(run, schema)


def as_lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive values as one list for each length."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
