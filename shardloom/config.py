"""Configuration: data sources, sharding rules, read/write splitting; YAML or JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """A configuration that can't be used."""


#: Driver names and the database each stands for; names are compared without case.
DRIVERS = {"mysql": "mysql", "postgres": "postgresql", "postgresql": "postgresql", "oracle": "oracle", "sqlserver": "sqlserver", "mssql": "sqlserver", "parquet": "parquet"}


@dataclass(frozen=True)
class Dialect:
    """What differs between SQL dialects when text is produced for them."""

    name: str
    quote: str
    now: str
    auto_increment: str

    def quoted(self, identifier: str) -> str:
        return f"{self.quote}{identifier.replace(self.quote, self.quote * 2)}{self.quote}"

    def limit(self, count: int, offset: int = 0) -> str:
        if self.name == "mysql":
            return f"LIMIT {offset}, {count}" if offset else f"LIMIT {count}"
        return f"LIMIT {count} OFFSET {offset}" if offset else f"LIMIT {count}"


DIALECTS = {"mysql": Dialect("mysql", "`", "NOW()", "AUTO_INCREMENT"), "postgresql": Dialect("postgresql", '"', "CURRENT_TIMESTAMP", "SERIAL")}


def database_type(driver: str) -> str:
    try:
        return DRIVERS[driver.strip().lower()]
    except KeyError:
        raise ConfigError(f"unsupported driver: {driver}") from None


@dataclass
class DataSource:
    driver_name: str = ""
    url: str = ""
    username: str = ""
    password: str = ""
    max_idle: int = 0
    max_open: int = 0


@dataclass
class Strategy:
    """Where rows go on one axis. type: inline, mod, hash_mod, range, complex_inline or hint_inline."""

    sharding_column: str = ""
    algorithm: str = ""
    type: str = "inline"
    properties: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [c.strip() for c in self.sharding_column.split(",") if c.strip()]


@dataclass
class KeyGenerator:
    column: str = ""
    type: str = "snowflake"
    properties: dict[str, int] = field(default_factory=dict)


@dataclass
class TableRule:
    logic_table: str = ""
    actual_data_nodes: str = ""
    database_strategy: Strategy | None = None
    table_strategy: Strategy | None = None
    key_generator: KeyGenerator | None = None


@dataclass
class ShardingRule:
    tables: dict[str, TableRule] = field(default_factory=dict)
    default_database_strategy: Strategy | None = None
    default_table_strategy: Strategy | None = None
    default_key_generator: KeyGenerator | None = None


@dataclass
class ReadWriteSplit:
    name: str = ""
    master_data_source: str = ""
    slave_data_sources: list[str] = field(default_factory=list)
    load_balance_algorithm: str = "round_robin"
    weights: list[int] = field(default_factory=list)


@dataclass
class Config:
    data_sources: dict[str, DataSource] = field(default_factory=dict)
    sharding_rule: ShardingRule | None = None
    read_write_splits: dict[str, ReadWriteSplit] = field(default_factory=dict)

    def validate(self) -> Config:
        """Raises ConfigError; fills in logic tables and default strategies."""
        if not self.data_sources:
            raise ConfigError("at least one data source must be configured")
        for name, source in self.data_sources.items():
            if not source.driver_name:
                raise ConfigError(f"driver name is required for data source {name}")
            if not source.url:
                raise ConfigError(f"URL is required for data source {name}")
        if rule := self.sharding_rule:
            for name, table in rule.tables.items():
                table.logic_table = table.logic_table or name
                if not table.actual_data_nodes:
                    raise ConfigError(f"actual data nodes is required for table {name}")
                table.database_strategy = table.database_strategy or rule.default_database_strategy
                table.table_strategy = table.table_strategy or rule.default_table_strategy
                table.key_generator = table.key_generator or rule.default_key_generator
        return self

    def one_dialect(self) -> str:
        """The database all sources share; ConfigError if they differ."""
        kinds = {database_type(s.driver_name) for s in self.data_sources.values()}
        if len(kinds) != 1:
            raise ConfigError(f"data sources must share one driver, found {', '.join(sorted(kinds))}")
        return kinds.pop()


#: Other spellings of keys, as found in configuration files in use.
ALIASES = {
    "databaseShardingStrategy": "databaseStrategy", "tableShardingStrategy": "tableStrategy", "algorithmExpression": "algorithm",
    "maxOpenConns": "maxOpen", "maxIdleConns": "maxIdle", "readWriteSplitting": "readWriteSplits", "driver": "driverName",
    "sharding": "shardingRule", "dataSource": "dataSources", "user": "username",
}
_NESTED: dict[tuple[type, str], tuple[type, bool]] = {
    (Config, "data_sources"): (DataSource, True), (Config, "sharding_rule"): (ShardingRule, False), (Config, "read_write_splits"): (ReadWriteSplit, True),
    (ShardingRule, "tables"): (TableRule, True), (ShardingRule, "default_database_strategy"): (Strategy, False), (ShardingRule, "default_table_strategy"): (Strategy, False),
    (ShardingRule, "default_key_generator"): (KeyGenerator, False), (TableRule, "database_strategy"): (Strategy, False), (TableRule, "table_strategy"): (Strategy, False), (TableRule, "key_generator"): (KeyGenerator, False),
}


def _snake(key: str) -> str:
    key = ALIASES.get(key, key)
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in key)


def _camel(key: str) -> str:
    first, *rest = key.split("_")
    return first + "".join(x.capitalize() for x in rest)


def _build(kind: type, data: dict[str, Any]) -> Any:
    known, out = {f.name for f in fields(kind)}, {}
    for key, value in (data or {}).items():
        name = _snake(key)
        if name not in known:
            raise ConfigError(f"unknown key {key} in {kind.__name__}")
        if (nested := _NESTED.get((kind, name))) and value is not None:
            inner, by_name = nested
            if isinstance(value, list):
                value = {x.get("name", str(i)): x for i, x in enumerate(value)}
            value = {k: _build(inner, v) for k, v in value.items()} if by_name else _build(inner, value)
        out[name] = value
    return kind(**out)


def from_dict(data: dict[str, Any]) -> Config:
    return _build(Config, data)


def to_dict(config: Config) -> dict[str, Any]:
    def camel(x: Any, fixed: bool = False) -> Any:
        if isinstance(x, dict):
            return {k if fixed else _camel(k): camel(v, not fixed and k in ("data_sources", "tables", "read_write_splits", "properties")) for k, v in x.items() if v is not None}
        return x

    return camel(asdict(config))


def load(path: str | Path) -> Config:
    """Reads .json as JSON and anything else as YAML."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return from_dict(json.loads(text))
    import yaml

    return from_dict(yaml.safe_load(text) or {})


def save(config: Config, path: str | Path) -> None:
    data = to_dict(config)
    if str(path).endswith(".json"):
        Path(path).write_text(json.dumps(data, indent=2))
        return
    import yaml

    Path(path).write_text(yaml.safe_dump(data, sort_keys=False, allow_unicode=True))
