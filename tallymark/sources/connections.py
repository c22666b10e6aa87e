"""Named connections: functions that turn a declared dataset into a DataFrame."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tallymark.sources.readers import (Dataset, DatasetError, capped, filtered, pick_columns,
                                       read_dataset, read_jdbc)

Connection = Callable[[Dataset], DataFrame]

_YES = ("yes", "true", "1")


def catalog_connection(spark: SparkSession) -> Connection:
    """Tables and views of the catalog, SQL text, and files by path."""
    return lambda ds: read_dataset(spark, ds)


def files_connection(spark: SparkSession, base_dir: str = ".") -> Connection:
    """Delimited files below a folder; a dataset's table is its path or glob."""
    def read(ds: Dataset) -> DataFrame:
        name = ds.path or ds.table or ""
        absolute = re.match(r"^(/|[a-z0-9]+:)", name)
        path = name if absolute else f"{base_dir.rstrip('/')}/{name}"
        return read_dataset(spark, replace(ds, path=path, table=None, query=None))
    return read


def count_query(ds: Dataset) -> str | None:
    """A query by which a database counts a dataset itself, as ``row_total``; None where a filter, which
    is Spark SQL, would have to be put into its own dialect."""
    if ds.where or not (ds.query or ds.table):
        return None
    return f"SELECT COUNT(*) AS row_total FROM {f'({ds.query}) q' if ds.query else ds.table}"


def jdbc_connection(spark: SparkSession, url: str, **options: object) -> Connection:
    """Tables and queries of a database; filters and column choice are pushed down.

    ``row_total`` of the connection has a dataset counted where it lies.
    """
    def read(ds: Dataset) -> DataFrame:
        df = read_jdbc(spark, url, table=None if ds.query else ds.table, query=ds.query,
                       **{**options, **dict(ds.options)})
        return pick_columns(filtered(df, ds.where), ds.columns)

    def row_total(ds: Dataset) -> DataFrame | None:
        query = count_query(ds)
        ranges = ("partition_column", "lower", "upper", "partitions")
        plain = {k: v for k, v in {**options, **dict(ds.options)}.items() if k not in ranges}
        return query and read_jdbc(spark, url, query=query, **plain)
    read.row_total = row_total
    return read


def frames_connection(frames: Mapping[str, DataFrame]) -> Connection:
    """DataFrames by name."""
    def read(ds: Dataset) -> DataFrame:
        if ds.table not in frames:
            raise DatasetError(f"no dataset named {ds.table!r}")
        return pick_columns(filtered(frames[ds.table], ds.where), ds.columns)
    return read


def _need(config: Mapping[str, object], *names: str) -> object:
    value = next((config[n] for n in names if config.get(n)), None)
    if value is None:
        raise DatasetError(f"{config.get('type')} connection requires {' or '.join(names)!r}")
    return value


def jdbc_settings(config: Mapping[str, object]) -> tuple[str, dict[str, object]]:
    """JDBC address and options of a declared database connection."""
    kind = config["type"]
    login = {"user": config.get("user") or config.get("username"),
             "password": config.get("password")}
    if kind == "sqlite":
        return f"jdbc:sqlite:{_need(config, 'path', 'database')}", {}
    if kind == "access":
        return f"jdbc:ucanaccess://{_need(config, 'path', 'database')}", {
            k: v for k, v in login.items() if k == "password" and v}
    if kind == "sqlserver":
        host = _need(config, "host", "server")
        address = f"{host}:{config['port']}" if config.get("port") else host
        parts = [f"jdbc:sqlserver://{address}", f"databaseName={_need(config, 'database')}"]
        if str(config.get("trusted", "no")).strip().lower() in _YES:
            parts.append("integratedSecurity=true")
            login = {}
        else:
            _need(config, "user", "username")
        for name, setting in (("encrypt", "encrypt"),
                              ("trustServerCertificate", "trust_server_certificate")):
            on = str(config.get(setting, "yes")).strip().lower() in _YES
            parts.append(f"{name}={'true' if on else 'false'}")
        return ";".join(parts), {k: v or "" for k, v in login.items()}
    if kind == "snowflake":
        account = _need(config, "account")
        _need(config, "user")
        names = {"db": "database", "schema": "schema", "warehouse": "warehouse", "role": "role",
                 "authenticator": "authenticator"}
        query = "&".join(f"{k}={config[v]}" for k, v in names.items() if config.get(v))
        return (f"jdbc:snowflake://{account}.snowflakecomputing.com/?{query}",
                {k: v for k, v in login.items() if v})
    raise DatasetError(f"unknown connection type {kind!r}")


def connect(spark: SparkSession, config: Mapping[str, object]) -> Connection:
    """A connection from its declaration (``type`` and settings).

    ``max_rows`` is an opt-in guard: more rows are an error, or with ``allow_truncation`` a
    sample. ``jdbc_options`` are handed to every read (partition column, bounds, driver).
    """
    config = {**config, "type": str(config.get("type", "")).strip().lower()}
    if config["type"] == "files":
        inner = files_connection(spark, str(config.get("base_dir", ".")))
    elif config["type"] == "catalog":
        inner = catalog_connection(spark)
    else:
        url, options = jdbc_settings(config)
        inner = jdbc_connection(spark, url, **{**options, **dict(config.get("jdbc_options") or {})})
    if not config.get("max_rows"):
        return inner
    if config.get("allow_truncation"):
        raise ValueError("a check of a truncated side would say nothing; raise max_rows instead")
    return lambda ds: capped(inner(ds), int(config["max_rows"]))
