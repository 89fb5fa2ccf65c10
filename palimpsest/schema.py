"""Roles of columns, inferred from a schema or checked against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .conf import TableConfig
from .errors import ConfigurationError, UnknownColumn

SEQUENCE = "_xp_seq"
ORDER_TYPES = (T.ShortType, T.IntegerType, T.LongType, T.TimestampType, T.TimestampNTZType)
DELTA_TYPES = (T.StringType, T.BinaryType)


@dataclass(frozen=True)
class Roles:
    group_by: str | None
    order_by: str
    delta: tuple[str, ...]
    plain: tuple[str, ...]  # everything else, the order column included
    indexed: tuple[str, ...]  # of the plain ones, those whose bounds each section keeps: the order column, and what is set


def _find(schema: T.StructType, name: str, table: str) -> T.StructField:
    for field in schema.fields:
        if field.name == name:
            return field
    raise UnknownColumn(f'Column "{name}" does not exist in table "{table}"')


def infer_order(schema: T.StructType, group_by: str | None = None) -> str | None:
    """The last integer or timestamp column, the sequence left out."""
    named = [f.name for f in schema.fields if isinstance(f.dataType, ORDER_TYPES) and f.name not in (SEQUENCE, group_by)]
    return named[-1] if named else None


def infer_delta(schema: T.StructType, group_by: str | None, order_by: str | None) -> tuple[str, ...]:
    return tuple(f.name for f in schema.fields if isinstance(f.dataType, DELTA_TYPES) and f.name not in (SEQUENCE, group_by, order_by))


def resolve(schema: T.StructType, config: TableConfig, table: str = "table") -> Roles:
    """Roles under ``config``; what it leaves open is inferred, what it names is checked."""
    if config.group_by is not None:
        _find(schema, config.group_by, table)
    if config.order_by is not None:
        field = _find(schema, config.order_by, table)
        if not isinstance(field.dataType, ORDER_TYPES):
            raise ConfigurationError(f'order_by column "{config.order_by}" must be an integer or timestamp type')
    order_by = config.order_by or infer_order(schema, config.group_by)
    if order_by is None:
        raise ConfigurationError("versioned tables require an order_by column", "name one, or add an integer or timestamp column")
    if config.delta_columns is not None:
        for name in config.delta_columns:
            field = _find(schema, name, table)
            if not isinstance(field.dataType, DELTA_TYPES):
                raise ConfigurationError(f'delta column "{name}" must be STRING or BINARY (text, varchar, json or bytes)')
            if field.nullable:
                raise ConfigurationError(f'Delta column "{name}" must be NOT NULL', "declare it so, or let delta columns be detected")
    delta = config.delta_columns if config.delta_columns is not None else infer_delta(schema, config.group_by, order_by)
    if not delta:
        raise ConfigurationError("versioned tables require at least one delta column", "name one, or add a text-like column")
    plain = tuple(f.name for f in schema.fields if f.name not in (SEQUENCE, config.group_by, *delta))
    for name in config.index_columns:
        if name not in plain or isinstance(_find(schema, name, table).dataType, T.ArrayType | T.MapType | T.StructType):
            raise ConfigurationError(f'index column "{name}" must be a plain column of one value a row')
    indexed = tuple(n for n in plain if n == order_by or n in config.index_columns)
    return Roles(config.group_by, order_by, tuple(delta), plain, indexed)
