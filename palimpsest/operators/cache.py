"""Warming: decoded rows of a table kept by Spark, within a bound, and the counters that report it."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..errors import ConfigurationError, NotVersioned
from ..schema import SEQUENCE
from . import sections as S

if TYPE_CHECKING:
    from ..sources.table import VersionedTable


@dataclass
class Cache:
    """What is held of a table's snapshot.  Each frame has the chains that it holds whole; None: all of them."""

    frames: list[tuple[DataFrame, frozenset | None]] = field(default_factory=list)
    entries: int = 0
    size: int = 0
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    skips: int = 0


_CACHES: dict[tuple[str, int], Cache] = {}
#: Chains up to which a frame that holds only some remembers which.
_REMEMBERED = 10_000


def warmed(table: VersionedTable, group: object = None) -> DataFrame | None:
    """The held rows that answer a read of ``group`` (None: of all), and the read is counted as a hit or a miss."""
    cache = _CACHES.get((table.state.table_id, table.state.version))
    if cache is None:
        return None
    for frame, groups in cache.frames:
        if groups is None or group is not None and group in groups:
            cache.hits += 1
            return frame if group is None else frame.where(F.col(f"`{table.roles.group_by}`") == F.lit(group).cast(table.schema[table.roles.group_by].dataType))
    cache.misses += 1
    return None


def cache_of(table: VersionedTable) -> Cache:
    return _CACHES.setdefault((table.state.table_id, table.state.version), Cache())


def _limit(name: str, value: int | None) -> int | None:
    if value is not None and value < 0:
        raise ConfigurationError(f"{name} must be non-negative, got {value}")
    return value


def _checked(table: object) -> None:
    if not hasattr(table, "sections"):
        raise NotVersioned(f'"{table}" is not a versioned table')


def _stored(table: VersionedTable) -> DataFrame:
    """All rows from the files, whatever is held."""
    return S.explode(table.sections(), table.schema, table.state.physical, table.roles)


def _keep(table: VersionedTable, rows: DataFrame, groups: frozenset | None, conf: EngineConf) -> None:
    """Persist decoded rows within the size bound; values beyond the entry limit are counted as skipped.  Rows that do not
    fit are not held, which counts as no eviction: nothing leaves for them."""
    cache = cache_of(table)
    size = sum((F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n in table.roles.delta), F.lit(0))
    most = conf.cache_max_entry_kb * 1024
    n, total, skipped = rows.agg(F.count("*"), F.sum(size), F.count_if(size > most)).first()
    cache.skips += skipped
    if n and (total or 0) + cache.size <= conf.cache_size_mb << 20:
        kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
        kept.count()
        cache.frames.append((kept, groups))
        cache.entries += n
        cache.size += total or 0


def release(table: VersionedTable) -> None:
    cache = _CACHES.pop((table.state.table_id, table.state.version), None)
    for frame, _ in cache.frames if cache else ():
        frame.unpersist()


def warm_cache(table: VersionedTable, max_rows: int | None = None, max_groups: int | None = None, conf: EngineConf | None = None) -> DataFrame:
    """Decode rows in group order up to the limits: rows_scanned, groups_warmed, duration_ms.

    Where the group limit ends the scan, the row that exceeded it has been counted already, and its group too."""
    _checked(table)
    _limit("max_rows", max_rows), _limit("max_groups", max_groups)
    begin, roles = time.monotonic(), table.roles
    key = F.col(f"`{roles.group_by}`") if roles.group_by else F.lit(0)
    rows, groups = 0, 0
    if max_rows != 0 and table.state.files:
        counts = table.sections().groupBy(table._group_key().alias("g")).agg(F.sum("_rows").alias("n")).orderBy("g")
        taken = counts.limit(max_groups + 1).collect() if max_groups is not None else None
        if taken is None:
            groups, rows = counts.agg(F.count("*"), F.sum("n")).first()
        else:
            groups = len(taken)
            rows = sum(r.n for r in taken[:max_groups]) + (groups > max_groups)
        whole = None if taken is None else frozenset(r.g for r in taken[:max_groups])
        warmed = _stored(table).withColumn("__g", key)
        if whole is not None:
            warmed = warmed.where(F.col("__g").isin(list(whole)))
        if max_rows is not None and (rows or 0) > max_rows:
            warmed = warmed.orderBy("__g", SEQUENCE).limit(max_rows)
            found = warmed.groupBy("__g").count()
            rows, groups = found.agg(F.sum("count"), F.count("*")).first()
            known = {r.g: r.n for r in counts.limit(_REMEMBERED).collect()} if max_rows <= _REMEMBERED else {}
            whole = frozenset(r[0] for r in found.collect() if known.get(r[0]) == r[1]) if known else frozenset()
        _keep(table, warmed.drop("__g"), whole, conf or EngineConf())
    return table.spark.createDataFrame([(int(rows or 0), int(groups or 0), (time.monotonic() - begin) * 1000)], "rows_scanned long, groups_warmed long, duration_ms double")


def warm_cache_parallel(table: VersionedTable, max_workers: int | None = None, max_groups: int | None = None, conf: EngineConf | None = None) -> DataFrame:
    """Decode whole sections as tasks: rows_warmed (sequence slots), groups_warmed, sections_warmed, workers_used,
    duration_ms."""
    _checked(table)
    _limit("max_workers", max_workers), _limit("max_groups", max_groups)
    conf = conf or EngineConf()
    begin = time.monotonic()
    result = (0, 0, 0, 0)
    if max_groups != 0 and table.state.files:
        k = table.config.keyframe_every
        chains = table.sections().groupBy(table._group_key().alias("g")).agg(F.max("_hi").alias("hi"))
        if max_groups is not None:
            chains = chains.orderBy("g").limit(max_groups)
        groups, slots, tasks = chains.agg(F.count("*"), F.sum("hi"), F.sum(F.ceil(F.col("hi") / F.lit(k)))).first()
        workers = conf.warm_cache_workers if max_workers is None else max_workers
        used = 1 if workers == 0 or tasks <= 1 else min(workers, tasks)
        rows, whole = _stored(table), None
        if max_groups is not None and table.roles.group_by:
            rows = rows.join(chains.select(F.col("g").alias("__g")), F.col(f"`{table.roles.group_by}`") == F.col("__g"), "left_semi")
            whole = frozenset(r.g for r in chains.select("g").collect()) if max_groups <= _REMEMBERED else frozenset()
        _keep(table, rows, whole, conf)
        result = (int(slots), int(groups), int(tasks), int(used))
    return table.spark.createDataFrame([(*result, (time.monotonic() - begin) * 1000)], "rows_warmed long, groups_warmed long, sections_warmed long, workers_used long, duration_ms double")


def cache_stats(table: VersionedTable, conf: EngineConf | None = None) -> DataFrame:
    """What is held of this snapshot; hits and misses are reads (DataFrames made) that held rows did or did not answer."""
    c, conf = cache_of(table), conf or EngineConf()
    row = (c.size, conf.cache_size_mb << 20, c.entries, c.hits, c.misses, c.evictions, c.skips)
    return table.spark.createDataFrame([row], "cache_size_bytes long, cache_max_bytes long, entries_count long, hit_count long, miss_count long, eviction_count long, skip_count long")


def insert_cache_stats(table: VersionedTable, conf: EngineConf | None = None) -> DataFrame:
    """Appends keep no memory between jobs: no slot is ever in use, and nothing is there to hit, miss or evict."""
    conf = conf or EngineConf()
    row = (0, conf.insert_cache_slots, 0, 0, 0, 0)
    return table.spark.createDataFrame([row], "slots_in_use long, total_slots long, hits long, misses long, evictions long, eviction_misses long")
