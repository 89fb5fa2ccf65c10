"""Settings of the engine and of a table, checked where they are made."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from .errors import ConfigurationError

KEYFRAME_MOST, DEPTH_MOST = 10_000, 65_535

#: name: (default, least, most, when it can change).  Those that only size another engine's memory are accepted.
PARAMETERS: dict[str, tuple[int, int, int | None, str]] = {
    "cache_size_mb": (256, 1, None, "restart"),
    "cache_max_entries": (65_536, 1000, None, "restart"),
    "cache_max_entry_kb": (256, 16, None, "runtime"),
    "cache_slot_size_kb": (4, 1, 64, "restart"),
    "cache_partitions": (32, 1, 256, "restart"),
    "group_cache_size_mb": (16, 1, None, "restart"),
    "tid_cache_size_mb": (16, 1, None, "restart"),
    "seq_tid_cache_size_mb": (16, 1, None, "restart"),
    "insert_cache_slots": (16, 1, None, "restart"),
    "max_delta_columns": (32, 1, None, "restart"),
    "encode_threads": (0, 0, 64, "session"),
    "warm_cache_workers": (4, 0, None, "session"),
}


class EngineConf:
    """The engine's parameters.  Ones of context "restart" are fixed once the engine has started."""

    def __init__(self, **values: int) -> None:
        self._values = {name: spec[0] for name, spec in PARAMETERS.items()}
        self._started = False
        for name, value in values.items():
            self.set(name, value)
        self._started = True

    def set(self, name: str, value: int) -> None:
        if name not in PARAMETERS:
            raise ConfigurationError(f'unrecognized parameter "{name}"')
        _, least, most, context = PARAMETERS[name]
        if self._started and context == "restart":
            raise ConfigurationError(f'parameter "{name}" cannot be changed without restarting the engine')
        if not isinstance(value, int) or value < least or most is not None and value > most:
            raise ConfigurationError(f'{value!r} is outside the valid range for parameter "{name}" ({least} .. {most if most is not None else "unbounded"})')
        self._values[name] = value

    def reset(self, name: str) -> None:
        self.set(name, PARAMETERS[name][0])

    def show(self, name: str) -> int:
        if name not in PARAMETERS:
            raise ConfigurationError(f'unrecognized parameter "{name}"')
        return self._values[name]

    def __getattr__(self, name: str) -> int:
        if name in PARAMETERS:
            return self._values[name]
        raise AttributeError(name)


@dataclass(frozen=True)
class TableConfig:
    """How a table is stored.  Settings hold for rows appended from then on."""

    group_by: str | None = None
    order_by: str | None = None
    delta_columns: tuple[str, ...] | None = None
    keyframe_every: int = 100
    compress_depth: int = 1
    enable_zstd: bool = True
    #: Plain columns whose least and largest value every section keeps, as it does for the order column.
    index_columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.keyframe_every < 1:
            raise ConfigurationError(f"keyframe_every must be at least 1, got {self.keyframe_every}")
        if self.keyframe_every > KEYFRAME_MOST:
            raise ConfigurationError(f"keyframe_every must be at most {KEYFRAME_MOST}, got {self.keyframe_every}")
        if self.compress_depth < 1:
            raise ConfigurationError(f"compress_depth must be at least 1, got {self.compress_depth}")
        if self.compress_depth > DEPTH_MOST:
            raise ConfigurationError(f"compress_depth must be at most {DEPTH_MOST}, got {self.compress_depth}")

    def to_json(self) -> str:
        return json.dumps({n: v for n, v in asdict(self).items() if n != "index_columns" or v})

    @classmethod
    def from_json(cls, text: str) -> TableConfig:
        values = json.loads(text)
        delta = values.pop("delta_columns")
        index = tuple(values.pop("index_columns", ()))
        return cls(delta_columns=None if delta is None else tuple(delta), index_columns=index, **values)

    def with_values(self, **values: object) -> TableConfig:
        return replace(self, **values)
