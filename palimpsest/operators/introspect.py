"""What a table's storage holds: counts, sizes, tags, blobs.  Counts come from section rows; nothing is decoded but by
``refresh_stats``."""

from __future__ import annotations

import time
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SEQUENCE
from . import sections as S


if TYPE_CHECKING:
    from ..sources.table import VersionedTable

#: Microseconds from 1970 to 2000: order values of time columns are shown as microseconds since 2000.
_EPOCH_2000 = 946_684_800_000_000


def group_stats(table: VersionedTable) -> DataFrame:
    """One row per chain: group_value, row_count, keyframe_count, max_seq, raw and stored bytes, sum of mean tags."""
    key = table._group_key().cast("string") if table.roles.group_by else F.lit(None).cast("string")
    return table.sections().groupBy(key.alias("group_value")).agg(
        F.sum("_rows").alias("row_count"), F.sum("_keys").alias("keyframe_count"), F.max("_hi").alias("max_seq"),
        F.sum("_raw").alias("raw_size_bytes"), F.sum("_stored").alias("compressed_size_bytes"), F.sum("_tags").alias("sum_avg_delta_tags"),
    )


def _totals(groups: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows, keys, raw, stored = zero("row_count"), zero("keyframe_count"), zero("raw_size_bytes"), zero("compressed_size_bytes")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return groups.agg(
        rows.alias("total_rows"), F.count("*").alias("total_groups"), keys.alias("keyframe_count"), (rows - keys).alias("delta_count"),
        raw.alias("raw_size_bytes"), stored.alias("compressed_size_bytes"), F.round(ratio(raw, stored), 2).alias("compression_ratio"),
        F.round(ratio(zero("sum_avg_delta_tags"), rows - keys), 2).alias("avg_compression_depth"),
    )


def stats(table: VersionedTable) -> DataFrame:
    """One row of totals.  A row is a keyframe if any of its delta columns is stored whole."""
    from .cache import cache_of

    cache = cache_of(table)
    return _totals(group_stats(table)).withColumns({"cache_hits": F.lit(cache.hits).cast("long"), "cache_misses": F.lit(cache.misses).cast("long")})


def stats_exist(table: VersionedTable) -> bool:
    return bool(table.state.files) and table.count() > 0


def refresh_stats(table: VersionedTable) -> DataFrame:
    """Recount by decoding every value: groups_scanned, rows_scanned, duration_ms."""
    begin = time.monotonic()
    roles = table.roles
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n in roles.delta])
    key = F.col(f"`{roles.group_by}`") if roles.group_by else F.lit(0)
    rows = S.explode(table.sections(), table.schema, table.state.physical, roles)  # from the files, whatever is held
    row = rows.groupBy(key.alias("g")).agg(F.count("*").alias("n"), F.sum(size).alias("raw")).agg(F.count("*"), F.sum("n"), F.sum("raw")).first()
    kept = group_stats(table).agg(F.sum("raw_size_bytes")).first()[0]
    if (row[2] or 0) != (kept or 0):
        from ..errors import CorruptChain

        raise CorruptChain(f"{row[2]} bytes decoded, {kept} recorded")
    took = (time.monotonic() - begin) * 1000
    return table.spark.createDataFrame([(row[0], row[1] or 0, took)], "groups_scanned long, rows_scanned long, duration_ms double")


def order_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampNTZType):
        c = F.timestamp_diff("MICROSECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), c)
    elif isinstance(kind, T.TimestampType):
        c = F.unix_micros(c) - F.lit(_EPOCH_2000)
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def _blobs(table: VersionedTable, group: object, seq: tuple[int | None, int | None] | None, with_bytes: bool) -> DataFrame:
    """One row per version and delta column."""
    roles, physical = table.roles, table.state.physical
    key = table._group_key().cast("string") if roles.group_by else F.lit(None).cast("string")
    order = order_value(F.get(f"p_{physical[roles.order_by]}", F.col("i")), table.schema[roles.order_by].dataType)
    at = lambda n: F.get(n, F.col("i"))
    cells = []
    for n in roles.delta:
        blob = at(f"d_{physical[n]}")
        cell = [F.lit(n).alias("column_name"), at(f"t_{physical[n]}").alias("tag"), F.octet_length(blob).cast("long").alias("delta_size")]
        cells.append(F.struct(*cell, *([blob.alias("delta_bytes")] if with_bytes else [])))
    rows = table.sections(group, seq).select("*", F.posexplode("_seqs").alias("i", "seq"))
    rows = rows.select(key.alias("group_value"), order.alias("version"), "seq", F.explode(F.array(*cells)).alias("c"))
    if seq and seq[0] is not None:
        rows = rows.where(F.col("seq") >= seq[0])
    return rows.select("group_value", "version", "seq", (F.col("c.tag") == 0).alias("is_keyframe"), "c.*")


def inspect(table: VersionedTable, group: object = None) -> DataFrame:
    """version, seq, is_keyframe, tag, delta_size_bytes, column_name of a chain, or of all."""
    return _blobs(table, group, None, False).select("version", "seq", "is_keyframe", "tag", F.col("delta_size").alias("delta_size_bytes"), "column_name")


def physical(table: VersionedTable, group: object = None, from_seq: int | None = None) -> DataFrame:
    """Stored blobs, with those after ``from_seq`` only if it is given."""
    seq = None if from_seq is None else (from_seq + 1, None)
    columns = ("group_value", "version", "seq", "is_keyframe", "tag", "delta_bytes", "delta_size", "column_name")
    return _blobs(table, group, seq, True).select(*columns)


def describe(table: VersionedTable) -> DataFrame:
    """Ordered (property, value) pairs."""
    state, roles, config = table.state, table.roles, table.config
    rows = [("table", state.name), ("table_id", state.table_id), ("format", "versioned"), ("config_source", "explicit" if state.config else "auto-detected"), ("group_by", roles.group_by or "(none)"), ("order_by", roles.order_by), ("sequence_column", SEQUENCE), ("keyframe_every", config.keyframe_every), ("compress_depth", config.compress_depth), ("enable_zstd", config.enable_zstd), ("delta_columns", ", ".join(roles.delta))]
    for i, f in enumerate(table.schema.fields, 1):
        role = "group_by" if f.name == roles.group_by else "order_by" if f.name == roles.order_by else "delta" if f.name in roles.delta else "sequence" if f.name == SEQUENCE else "plain"
        rows.append((f"column[{i}]", f"{f.name} {f.dataType.simpleString()} ({role})"))
    total = stats(table).first()
    rows += [(n, total[n]) for n in total.__fields__]
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    return table.spark.createDataFrame([(i, n, text(v)) for i, (n, v) in enumerate(rows)], "ordinal int, property string, value string").orderBy("ordinal").drop("ordinal")


def get_config(table: VersionedTable) -> DataFrame:
    """The stored settings; no row where they are detected."""
    c = table.state.config
    rows = [(c.group_by, c.order_by, list(c.delta_columns) if c.delta_columns is not None else None, c.keyframe_every, c.compress_depth, c.enable_zstd)] if c else []
    return table.spark.createDataFrame(rows, "group_by string, order_by string, delta_columns array<string>, keyframe_every int, compress_depth int, enable_zstd boolean")


def analyze(table: VersionedTable, share: float = 1.0, seed: int = 1) -> DataFrame:
    """Statistics of each column, as ANALYZE gives them: column_name, rows, nulls, n_distinct (approximate), avg_width.

    share: of all sections, by a hash of group and place; the others are not decoded."""
    part = F.pmod(F.xxhash64(table._group_key(), F.col("_base"), F.col("_sec"), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
    rows = S.explode(table.sections().where(part), table.schema, table.state.physical, table.roles)
    names = [f.name for f in table.schema.fields]
    of = lambda n, f: f(F.col(f"`{n}`"))
    facts = [F.struct(F.lit(n).alias("column_name"), F.count("*").alias("rows"), of(n, lambda c: F.count_if(c.isNull())).alias("nulls"), of(n, F.approx_count_distinct).alias("n_distinct"), of(n, lambda c: F.avg(F.octet_length(c.cast("string")))).alias("avg_width")) for n in names]
    return rows.agg(F.array(*facts).alias("all")).select(F.explode("all").alias("one")).select("one.*")



