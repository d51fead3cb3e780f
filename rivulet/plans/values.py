"""Small literal tables that Spark and DuckDB read alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


@dataclass(frozen=True)
class Values:
    """name, "column type, ...", rows; timestamps are texts and cast where they are used."""

    name: str
    schema: str
    rows: list[tuple]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def cte(self) -> str:
        """A common table expression with the same columns and types."""
        columns = [c.split() for c in self.schema.split(", ")]
        kinds = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
        body = ", ".join(f"CAST({c} AS {kinds[t]}) AS {c}" for c, t in columns)
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {body} FROM (VALUES {rows}) AS v({', '.join(c for c, _ in columns)}))"


@dataclass(frozen=True)
class PerEvent(Values):
    """A row for each event of the supplied table: its number in the first column, an id, and the rest of the literal row of
    its number modulo theirs."""

    def of(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        first, kept = self.schema.split(" ", 1)[0], self.schema.split(", ", 1)[1]
        own = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(self.rows)], f"_n int, {kept}")
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias(first), (F.col("event_id") % len(self.rows)).cast("int").alias("_n"))
        return events.join(F.broadcast(own), "_n").drop("_n")  # the literal rows

    @property
    def cte(self) -> str:
        first = self.schema.split(" ", 1)[0]
        inner = Values(f"{self.name}_rows", self.schema, [(n, *r[1:]) for n, r in enumerate(self.rows)]).cte
        return f"{inner}, {self.name} AS (SELECT r.* REPLACE (e.event_id AS {first}) FROM events e JOIN {self.name}_rows r ON r.{first} = e.event_id % {len(self.rows)})"

    def place(self, first: object) -> int:
        """The number modulo of the literal row whose first column is given."""
        return [r[0] for r in self.rows].index(first)
