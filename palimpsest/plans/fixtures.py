"""The driver's tables as versioned tables, built once per session and settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..conf import TableConfig
from ..sources.store import scratch_root
from ..sources.table import VersionedTable


@dataclass(frozen=True)
class Fixture:
    source: str
    group: str | None
    order: str
    ties: tuple[str, ...]
    delta: tuple[str, ...]
    k: int = 100


EVENTS = Fixture("events", "user_id", "ts", ("event_id",), ("props", "event_type"), 10)
TALKS = Fixture("conversations", "conv_id", "turn", ("role", "text"), ("text", "role"), 3)
DOCUMENTS = Fixture("documents", "source", "doc_id", ("text",), ("text",), 10)
ORDERS = Fixture("orders", "o_custkey", "o_orderdate", ("o_orderkey",), ("o_orderpriority",))
PAGES = Fixture("pages", None, "page_id", ("url",), ("html",), 20)

_BUILT: dict[tuple, VersionedTable] = {}


def rows(spark: SparkSession, sf_dir: str, f: Fixture) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{f.source}.parquet")


def strict(schema: T.StructType, f: Fixture) -> T.StructType:
    return T.StructType([T.StructField(x.name, x.dataType, x.name not in f.delta) for x in schema.fields])


def empty(spark: SparkSession, sf_dir: str, f: Fixture, **settings: object) -> VersionedTable:
    config = TableConfig(**({"group_by": f.group, "order_by": f.order, "delta_columns": f.delta, "keyframe_every": f.k} | settings))
    return VersionedTable.create(spark, scratch_root(spark), strict(rows(spark, sf_dir, f).schema, f), config, f.source)


def arrival(f: Fixture) -> list[str]:
    return [f.order, *f.ties]


def fresh(spark: SparkSession, sf_dir: str, f: Fixture, **settings: object) -> VersionedTable:
    table = empty(spark, sf_dir, f, **settings)
    table.append(rows(spark, sf_dir, f), arrival=arrival(f))
    return table


def built(spark: SparkSession, sf_dir: str, f: Fixture, **settings: object) -> VersionedTable:
    """A table that callers only read."""
    key = (spark.sparkContext.applicationId, sf_dir, f, tuple(sorted(settings.items())))
    if key not in _BUILT:
        _BUILT[key] = fresh(spark, sf_dir, f, **settings)
    return _BUILT[key]
