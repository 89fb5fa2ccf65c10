"""Tables by name below one folder: <root>/<schema>/<table>, and a registry with a file of settings for each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..conf import EngineConf, TableConfig
from ..errors import NotVersioned, VersionedTableError
from .store import Files
from .table import VersionedTable

VERSION = "0.1.0"
_REGISTRY = "_registry"


class Catalog:
    def __init__(self, spark: SparkSession, root: str, conf: EngineConf | None = None) -> None:
        self.spark, self.root, self.conf = spark, root.rstrip("/"), conf or EngineConf()
        self._files = Files(spark, self.root)

    @staticmethod
    def _split(name: str) -> tuple[str, str]:
        schema, _, table = name.rpartition(".")
        return schema or "public", table

    def _path(self, name: str) -> str:
        return f"{self.root}/" + "/".join(self._split(name))

    def _registry(self) -> dict[str, dict]:
        return {n.removesuffix(".json"): json.loads(self._files.read(f"{_REGISTRY}/{n}")) for n in self._files.names(_REGISTRY) if n.endswith(".json")}

    def _enter(self, full: str, entry: dict) -> None:
        """A table's entry is a file of its own: who registers one table touches no other."""
        self._files.put(f"{_REGISTRY}/{full}.json", json.dumps(entry, sort_keys=True))

    def _forget(self, name: str) -> None:
        self._files.delete(f"{_REGISTRY}/{'.'.join(self._split(name))}.json")

    def _register(self, name: str, table: VersionedTable) -> None:
        if table.state.config:
            self._enter(".".join(self._split(name)), {"table_id": table.state.table_id, "config": table.state.config.to_json()})

    # Tables

    def create_table(self, name: str, schema: T.StructType | str, config: TableConfig | None = None, buckets: int = 8) -> VersionedTable:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        table = VersionedTable.create(self.spark, self._path(name), schema, config, self._split(name)[1], buckets)
        self._register(name, table)
        return table

    def table(self, name: str, version: int | None = None) -> VersionedTable:
        path = "/".join(self._split(name))
        if not self._files.exists(f"{path}/_log"):
            raise NotVersioned(f'"{name}" is not a versioned table')
        return VersionedTable.open(self.spark, self._path(name), version)

    def tables(self) -> list[str]:
        found = []
        for schema in sorted(self._files.names("")):
            if schema.startswith("_"):
                continue
            found += [f"{schema}.{t}" for t in sorted(self._files.names(schema)) if self._files.exists(f"{schema}/{t}/_log")]
        return found

    def drop_table(self, name: str) -> None:
        self.table(name)
        self._files.delete("/".join(self._split(name)))
        self._forget(name)

    def rename_table(self, old: str, new: str) -> VersionedTable:
        """The folder is renamed; no byte of data moves."""
        if self._files.exists("/".join(self._split(new)) + "/_log"):
            raise VersionedTableError(f'table "{new}" already exists')
        self.table(old)
        self._files.move("/".join(self._split(old)), "/".join(self._split(new)))
        table = self.table(new)
        table.renamed(self._split(new)[1])
        self._forget(old)
        self._register(new, table)
        return table

    def refresh(self, name: str) -> VersionedTable:
        """The table at its newest commit; nothing that was known of it before is used."""
        from ..operators.cache import release

        table = self.table(name)
        release(table)
        return table

    # Settings

    def configure(self, name: str, **settings: object) -> VersionedTable:
        table = self.table(name)
        table.configure(TableConfig(**settings))
        self._register(name, table)
        return table

    def table_config(self) -> DataFrame:
        rows = []
        for name, entry in sorted(self._registry().items()):
            c = TableConfig.from_json(entry["config"])
            schema, table = self._split(name)
            rows.append((schema, table, c.group_by, c.order_by, list(c.delta_columns) if c.delta_columns is not None else None, c.keyframe_every, c.compress_depth, c.enable_zstd))
        return self.spark.createDataFrame(rows, "schema_name string, table_name string, group_by string, order_by string, delta_columns array<string>, keyframe_every int, compress_depth int, enable_zstd boolean")

    def dump_configs(self) -> DataFrame:
        """One statement per configured table that sets it up again; ``load_configs`` runs them."""
        rows = []
        for i, (name, entry) in enumerate(sorted(self._registry().items())):
            settings = json.loads(entry["config"])
            rows.append((i, f"configure({json.dumps(name)}, {json.dumps(settings, sort_keys=True)})"))
        return self.spark.createDataFrame(rows, "n int, statement string").orderBy("n").select("statement")

    def load_configs(self, statements: list[str]) -> int:
        done = 0
        for text in statements:
            name, settings = json.loads("[" + text.removeprefix("configure(").removesuffix(")") + "]")
            if settings["delta_columns"] is not None:
                settings["delta_columns"] = tuple(settings["delta_columns"])
            self.configure(name, **settings)
            done += 1
        return done

    def fix_restored_configs(self) -> int:
        """Link settings again to tables that came back under their names; forget those of tables that are gone."""
        registry, linked = self._registry(), 0
        for name, entry in registry.items():
            if not self._files.exists("/".join(self._split(name)) + "/_log"):
                self._forget(name)
                continue
            state = self.table(name).state
            if state.table_id != entry["table_id"]:
                linked += 1
                if state.config is None or state.config.to_json() != entry["config"]:
                    VersionedTable.open(self.spark, self._path(name)).configure(TableConfig.from_json(entry["config"]))
                self._enter(name, entry | {"table_id": state.table_id})
        return linked


def version() -> str:
    from ..functions import codec

    return f"palimpsest {VERSION} (codec 1, {'zstd' if codec.zstandard else 'zlib'})"
