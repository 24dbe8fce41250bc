"""Registry of the queries: a Spark function, its column list and the SQL it must match."""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.sqlbase import with_tables
from shelfsense.plans.marts import MARTS
from shelfsense.session import durable_scope, release_shuffles, shared_dir, tune
from shelfsense.sources import standin
from shelfsense.sources.raw import materialize
from shelfsense.sources.staging import Staging

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK_TYPES = {"s": "string", "i": "bigint", "f": "double", "d": "date", "t": "timestamp_ntz", "b": "boolean"}
_SQL_TYPES = {"s": "VARCHAR", "i": "BIGINT", "f": "DOUBLE", "d": "DATE", "t": "TIMESTAMP", "b": "BOOLEAN"}
SCALE = 100000.0  # five digits
NUDGE = 6.180339887e-8  # moves decimal ties off the rounding border, alike on both sides


class Space:
    """Raw tables, staging and written marts of one scale folder in one session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.given = standin.GivenTables(spark, folder)
        self.staging = Staging(self.raw)
        self._marts: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.RLock] = {}

    def alone(self, name: str) -> threading.RLock:
        """Held while a result is built, so that jobs run at the same time build it once."""
        return self._locks.setdefault(name, threading.RLock())

    def raw(self, name: str) -> DataFrame:
        """A raw table; those the adapter has to aggregate or join are written once."""
        if name in standin.COMPUTED:
            return self.stored(f"raw_{name}", lambda: standin.RAW_TABLES[name](self.given))
        if name in standin.DAILY:
            return standin.RAW_TABLES[name](self.given, self.stored("raw_daily", lambda: standin.daily_totals(self.given)))
        return standin.RAW_TABLES[name](self.given)

    @cached_property
    def mart_folder(self) -> str:
        tag = self.folder.strip("/").replace("/", "_")
        return f"{shared_dir(self.spark)}/marts-{self.spark.sparkContext.applicationId}/{tag}"

    def mart(self, name: str) -> DataFrame:
        """A mart, built and written on first use and read back from then on."""
        full = f"mart_{name}"
        with self.alone(full):
            if full not in self._marts:
                with durable_scope(self.spark):
                    self._marts[full] = materialize(MARTS[full](self.staging), self.mart_folder, full)
                release_shuffles(self.spark)
        return self._marts[full]

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Any other result that several queries share, written on first use."""
        with self.alone(name):
            if name not in self._marts:
                self._marts[name] = materialize(build(), self.mart_folder, name)
                release_shuffles(self.spark)
        return self._marts[name]


_SPACES: dict[tuple[str, str], Space] = {}


def space(spark: SparkSession, folder: str) -> Space:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SPACES:
        _SPACES[key] = Space(tune(spark), folder)
    return _SPACES[key]


def _fields(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) if ":" in c else (c, "s") for c in columns.split()]


def _spark_side(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _fields(columns):
        value = F.col(name).cast(_SPARK_TYPES[kind])
        if kind == "f":
            # Plain double arithmetic, the same steps on both sides.
            rounded = F.rint((value + F.lit(NUDGE)) * F.lit(SCALE)) / F.lit(SCALE)
            value = F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
        out.append(value.alias(name))
    return df.select(*out)


def _sql_side(body: str, columns: str) -> str:
    out = []
    for name, kind in _fields(columns):
        value = f"CAST({name} AS {_SQL_TYPES[kind]})"
        if kind == "f":
            value = f"round(({value} + {NUDGE}::DOUBLE) * {SCALE}::DOUBLE) / {SCALE}::DOUBLE"
            value = f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END"
        out.append(f"{value} AS {name}")
    return with_tables(f"SELECT {', '.join(out)} FROM ({body.strip()}) AS answer")


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(space) -> DataFrame`` under ``name``.

    ``columns`` lists ``name`` or ``name:type`` (s text, i integer, f double, d date,
    t timestamp, b boolean) and shapes both sides alike.
    """

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _spark_side(fn(space(spark, sf_dir)), columns)

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _sql_side(sql, columns)
        return fn

    return wrap
