"""Questions that version history invites, as plain DataFrame operations over decoded rows."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEQUENCE

if TYPE_CHECKING:
    from ..sources.table import VersionedTable


def _chain(table: VersionedTable) -> list[Column]:
    return [F.col(f"`{table.roles.group_by}`")] if table.roles.group_by else []


def latest_per_group(table: VersionedTable) -> DataFrame:
    """The newest version of each chain.  Only each chain's last section is read and decoded."""
    from . import sections as S

    tails = S.explode(table.sections(kind="tail"), table.schema, table.state.physical, table.roles, ("_hi",))
    return tails.where(F.col(SEQUENCE) == F.col("_hi")).drop("_hi")


def as_of(table: VersionedTable, seq: int) -> DataFrame:
    """The newest version of each chain among its first ``seq``; later sections are not read."""
    rank = F.row_number().over(Window.partitionBy(*_chain(table)).orderBy(F.desc(SEQUENCE)))
    return table.df(seq=(None, seq)).withColumn("__n", rank).where("__n = 1").drop("__n")


def history(table: VersionedTable, group: object) -> DataFrame:
    return table.df(group=group)


def version_diff(table: VersionedTable, column: str) -> DataFrame:
    """Each version with the change of a delta column's length from the version before."""
    before = F.lag(F.length(F.col(f"`{column}`"))).over(Window.partitionBy(*_chain(table)).orderBy(SEQUENCE))
    return table.df().withColumn("length_change", F.length(F.col(f"`{column}`")) - before)


def next_version(table: VersionedTable, group: object, column: str) -> int:
    """One more than the largest value of an integer column in a chain; 1 for a new chain."""
    return (table.df(group=group).agg(F.max(F.col(f"`{column}`"))).first()[0] or 0) + 1
