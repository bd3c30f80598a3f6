"""Sources beside the store: folders and DataFrames, which are read only, and databases."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, SparkSession

from ..schema import Table


@dataclass(frozen=True)
class ParquetFolder:
    """A table is <path>/<source>.parquet."""

    path: str

    def load(self, spark: SparkSession, table: Table) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{table.source}.parquet")


@dataclass(frozen=True)
class Frames:
    """Tables as DataFrames (batch or streaming) by name."""

    frames: dict[str, DataFrame] = field(hash=False)

    def load(self, spark: SparkSession, table: Table) -> DataFrame:
        return self.frames[table.table_name]


def database_url(host: str, database: str, *, port: int = 5432, user: str | None = None, password: str | None = None, ssl: bool | str | None = None, **params: Any) -> str:
    """postgresql://user:password@host:port/database with parameters; ssl: False or a mode's name."""
    if ssl is not None and not isinstance(ssl, (bool, str)):
        raise ValueError("ssl in a url is a boolean or a mode's name")
    who = "" if user is None else quote(user, safe="") + ("" if password is None else ":" + quote(password, safe="")) + "@"
    if ssl is not None:
        params["sslmode"] = ("require" if ssl else "disable") if isinstance(ssl, bool) else ssl
    return f"postgresql://{who}{host}:{port}/{quote(database, safe='')}" + (f"?{urlencode(params)}" if params else "")


@dataclass(frozen=True)
class Jdbc:
    """Tables of a database that Spark reads, and appends to, by JDBC; the driver's jar must be on the class path."""

    url: str
    properties: dict[str, str] = field(default_factory=dict, hash=False)
    partitions: dict[str, tuple[str, int, int, int]] = field(default_factory=dict, hash=False)

    def load(self, spark: SparkSession, table: Table) -> DataFrame:
        """partitions: table -> (column, lower bound, upper bound, number), to read in parallel."""
        r = spark.read.format("jdbc").option("url", self.url).option("dbtable", self.name(table)).options(**self.properties)
        if table.table_name in self.partitions:
            column, low, high, n = self.partitions[table.table_name]
            r = r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", n)
        return r.load()

    def append(self, table: Table, rows: DataFrame) -> None:
        """Inserts rows, a connection and a transaction for each partition; the database fills in the other columns and checks its constraints."""
        rows.write.format("jdbc").mode("append").option("url", self.url).option("dbtable", self.name(table)).options(**self.properties).save()

    @staticmethod
    def name(table: Table) -> str:
        return f'"{table.schema}"."{table.source}"'
