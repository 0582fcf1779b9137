"""Scores that a service gives, asked for side by side, each with a time limit."""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def scored(df: DataFrame, column: str, ask: Callable[[str], Awaitable[float]], out: str = "score", seconds: float = 120.0, side_by_side: int = 32, default: float = 0.0) -> DataFrame:
    """`df` with what `ask` answers for each value of a column; works alike on tables and streams.

    The rows of a batch are asked for side by side, at most so many at a time in a task; what takes longer than the
    limit, or fails, has the default. Nulls are not asked for and stay null.
    """
    names = [c for c in df.columns if c != out]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{out}` double"])

    async def every(values: list[str | None]) -> list[float | None]:
        gate = asyncio.Semaphore(side_by_side)

        async def one(value: str | None) -> float | None:
            if value is None:
                return None
            async with gate:
                try:
                    return float(await asyncio.wait_for(ask(value), seconds))
                except Exception:  # noqa: BLE001  a service that fails has no say
                    return default

        return await asyncio.gather(*map(one, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = asyncio.run(every(batch.column(column).to_pylist()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.float64())], [*names, out])

    return df.select(*names).mapInArrow(run, schema)
