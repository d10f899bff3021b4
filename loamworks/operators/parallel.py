"""Python functions over rows: errors are data, batches stay whole, stages are chained."""

from __future__ import annotations

import asyncio
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Turns:
    """Spreads calls evenly: `next` says how long to wait for the next turn. Threads may share it."""

    def __init__(self, per_second: float | None, tasks: int = 1) -> None:
        self.gap = max(1, tasks) / per_second if per_second else 0.0
        self.due, self.lock = 0.0, threading.Lock()

    def next(self) -> float:
        if not self.gap:
            return 0.0
        with self.lock:
            now = time.monotonic()
            at = max(self.due, now)
            self.due = at + self.gap
        return at - now


def apply(fn: Callable[[Any], Any], returns: str = "string", threads: int = 1, per_second: float | None = None, tasks: int = 1) -> Callable[[Column], Column]:
    """struct<result, error, duration_ms> of each value; an async function is awaited, `threads` at a time.

    `per_second` limits the calls of all of `tasks` tasks that run at a time: each makes its share.
    """

    @F.pandas_udf(f"struct<result: {returns}, error: string, duration_ms: double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        turns = Turns(per_second, tasks)

        def one(x: Any) -> tuple:
            began = time.monotonic()
            try:
                return fn(x), None, (time.monotonic() - began) * 1000
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}", (time.monotonic() - began) * 1000

        async def gather(xs: Sequence[Any]) -> list[tuple]:
            gate = asyncio.Semaphore(max(1, threads))

            async def single(x: Any) -> tuple:
                async with gate:
                    await asyncio.sleep(turns.next())
                    began = time.monotonic()
                    try:
                        return await fn(x), None, (time.monotonic() - began) * 1000
                    except Exception as e:  # noqa: BLE001
                        return None, f"{type(e).__name__}: {e}", (time.monotonic() - began) * 1000

            return list(await asyncio.gather(*map(single, xs)))

        with ThreadPoolExecutor(max(1, threads)) as pool:
            for part in parts:
                if asyncio.iscoroutinefunction(fn):
                    rows = asyncio.run(gather(part.tolist()))
                else:
                    jobs = []
                    for x in part.tolist():
                        time.sleep(turns.next())
                        jobs.append(pool.submit(one, x))
                    rows = [j.result() for j in jobs]
                yield pd.DataFrame(rows, columns=["result", "error", "duration_ms"])

    return run.asNondeterministic()


def apply_batches(fn: Callable[[list], list], returns: str = "string", batch_size: int = 10) -> Callable[[Column], Column]:
    """struct<result, error>: `fn` gets lists; a list that fails, or whose result is of another length, fails whole."""

    @F.pandas_udf(f"struct<result: {returns}, error: string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            xs, rows = part.tolist(), []
            for lo in range(0, len(xs), batch_size):
                own = xs[lo : lo + batch_size]
                try:
                    got = fn(own)
                    if len(got) != len(own):
                        raise ValueError(f"{len(got)} results for {len(own)} values")
                    rows += [(g, None) for g in got]
                except Exception as e:  # noqa: BLE001
                    rows += [(None, f"{type(e).__name__}: {e}")] * len(own)
            yield pd.DataFrame(rows, columns=["result", "error"])

    return run.asNondeterministic()


def counters(results: DataFrame, column: str = "result") -> DataFrame:
    """(successes, failures, success_rate) of a column made by apply()."""
    ok = F.count_if(F.col(f"{column}.error").isNull())
    return results.agg(ok.alias("successes"), F.count_if(F.col(f"{column}.error").isNotNull()).alias("failures"), F.coalesce(ok / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("success_rate"))


class Stages:
    """Functions one after another over one column; a filter keeps what is true, another stage drops nulls and errors."""

    def __init__(self) -> None:
        self.stages: list[tuple[str, Callable, str, bool]] = []

    def add(self, name: str, fn: Callable, returns: str = "string", is_filter: bool = False) -> Stages:
        self.stages.append((name, fn, returns, is_filter))
        return self

    def process(self, values: DataFrame, column: str = "value") -> DataFrame:
        for _, fn, returns, is_filter in self.stages:
            got = values.withColumn("__r", apply(fn, "boolean" if is_filter else returns)(F.col(column)))
            values = (got.where("__r.result") if is_filter else got.where("__r.result IS NOT NULL").withColumn(column, F.col("__r.result"))).drop("__r")
        return values
