"""Where fills, deposits and equity readings come from, behind one interface."""

from __future__ import annotations

import random
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.operators.dedup import last_written
from ledgertide.schema import FILL_ORDER
from ledgertide.sources import feeds


class Source(ABC):
    """Fills, deposits and equity of wallets. Windows are inclusive at both ends; ``coin`` None or "" means all coins."""

    @abstractmethod
    def fills(self, user: str | None = None, coin: str | None = None, from_ms: int = 0, to_ms: int = 2**63 - 1) -> DataFrame: ...

    @abstractmethod
    def deposits(self, user: str | None = None, from_ms: int = 0, to_ms: int = 2**63 - 1) -> DataFrame: ...

    @abstractmethod
    def equity(self, user: str | None = None) -> DataFrame:
        """``(user, equity)``: the latest reading of each wallet, no row where there is none."""


def _asked(df: DataFrame, user: str | None, coin: str | None, from_ms: int, to_ms: int) -> DataFrame:
    rows = df.where(F.col("time_ms").between(from_ms, to_ms))
    rows = rows if user is None else rows.where(F.col("user") == user)
    return rows if not coin else rows.where(F.col("coin") == coin)


class TableSource(Source):
    """DataFrames that are there already: stored tables, or a few rows in a test. Filters reach their scans."""

    def __init__(self, fills: DataFrame, deposits: DataFrame | None = None, readings: DataFrame | None = None) -> None:
        self._fills, self._deposits, self._readings = fills, deposits, readings

    def fills(self, user: str | None = None, coin: str | None = None, from_ms: int = 0, to_ms: int = 2**63 - 1) -> DataFrame:
        return _asked(self._fills, user, coin, from_ms, to_ms)

    def deposits(self, user: str | None = None, from_ms: int = 0, to_ms: int = 2**63 - 1) -> DataFrame:
        if self._deposits is None:
            raise LookupError("this source has no deposits")
        return _asked(self._deposits, user, None, from_ms, to_ms)

    def equity(self, user: str | None = None) -> DataFrame:
        if self._readings is None:
            raise LookupError("this source has no equity readings")
        rows = self._readings if user is None else self._readings.where(F.col("user") == user)
        return last_written(rows, "user", ["time_ms", "id"]).select("user", "equity")


class LandedSource(Source):
    """Answers of the feeds, landed as tables of ``(user, coin, answer)`` and ``(user, answer)``: an array of records in JSON each.

    Records that can't be read are skipped. An equity answer is an object whose ``equity`` is a text.
    """

    def __init__(self, fills: DataFrame, deposits: DataFrame | None = None, states: DataFrame | None = None) -> None:
        self._fills, self._deposits, self._states = fills, deposits, states

    def fills(self, user: str | None = None, coin: str | None = None, from_ms: int = 0, to_ms: int = 2**63 - 1) -> DataFrame:
        rows = feeds.parsed_fills(feeds.records_of(self._fills, "answer"), "record")
        return _asked(rows, user, coin, from_ms, to_ms).orderBy(*FILL_ORDER)

    def deposits(self, user: str | None = None, from_ms: int = 0, to_ms: int = 2**63 - 1) -> DataFrame:
        if self._deposits is None:
            raise LookupError("this source has no deposits")
        return _asked(feeds.parsed_deposits(feeds.records_of(self._deposits, "answer"), "record"), user, None, from_ms, to_ms)

    def equity(self, user: str | None = None) -> DataFrame:
        if self._states is None:
            raise LookupError("this source has no equity readings")
        rows = self._states if user is None else self._states.where(F.col("user") == user)
        return feeds.parsed_equity(rows, "answer")


# --- calls over a network


class Refused(Exception):
    """A call that was answered with a status other than success, or with something that can't be read."""

    def __init__(self, status: int | None, message: str = "") -> None:
        super().__init__(f"status {status}: {message}")
        self.status = status

    @property
    def passing(self) -> bool:
        """Whether a later call may succeed: no answer at all, too many calls, or an error of the server."""
        return self.status is None or self.status == 429 or self.status >= 500


def with_retries(call: Callable[[], str], max_elapsed_s: float = 30.0, first_s: float = 0.5, factor: float = 1.5, spread: float = 0.5,
                 clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> str:
    """What ``call`` gives, called again after growing pauses while it raises a passing :class:`Refused`.

    Any other refusal, and one that comes when the next pause would end after ``max_elapsed_s``, is raised.
    """
    began, pause = clock(), first_s
    while True:
        try:
            return call()
        except Refused as e:
            wait = pause * (1 + spread * (2 * random.random() - 1))
            if not e.passing or clock() - began + wait > max_elapsed_s:
                raise
        sleep(wait)
        pause *= factor


def fetched(asked: DataFrame, call: Callable[[dict], str], max_elapsed_s: float = 30.0) -> DataFrame:
    """``asked`` with ``answer``, what ``call`` gives for each row, to be landed before anything is made of it.

    The rows are asked one after the other in each task, so the number of partitions is that of calls at a
    time. A refused call fails its task and, when the engine's own repeats are used up, the job. ``call``
    is whatever client the caller has; nothing here opens a connection.
    """
    names = asked.columns
    schema = asked.withColumn("answer", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = [with_retries(lambda row=row: call(row), max_elapsed_s) for row in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(answers, pa.string())], names=[*names, "answer"])

    return asked.mapInArrow(run, schema)


class Remembered:
    """Answers kept for some seconds by key, for callers that ask for the same again and again."""

    def __init__(self, ask: Callable[[str], object], seconds: float = 5.0, clock: Callable[[], float] = time.monotonic, most: int = 10_000) -> None:
        self._ask, self._seconds, self._clock, self._most = ask, seconds, clock, most
        self._kept: dict[str, tuple[float, object]] = {}

    def get(self, key: str) -> object:
        now = self._clock()
        at, answer = self._kept.get(key, (None, None))
        if at is None or now - at >= self._seconds:
            answer = self._ask(key)
            if len(self._kept) >= self._most:
                self._kept = {k: v for k, v in self._kept.items() if now - v[0] < self._seconds}
            self._kept[key] = (now, answer)
        return answer


def user_file(spark: SparkSession, path: str) -> DataFrame:
    """``(user)`` from files with one wallet a line or several between commas: trimmed, without empty and repeated ones."""
    names = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("user")).select(F.btrim("user").alias("user"))
    return names.where(F.col("user") != "").distinct()
