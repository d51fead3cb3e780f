"""Sequence operators over long histories: numbering, running sums, carried values, runs and file rollover.

A window over a whole history, or over a key that holds a third of it, would put it into one task. Here rows are dealt
into blocks by ranges of (group, order), so that a block holds neighbours whatever their order values are, and written to
the shared folder once. Windows run inside the blocks. Only the group that a block begins with can go on from the block
before; what it brings along (a sum, a last value) is folded over a row for each block, and returns to its rows as a
broadcast table of that size. So a chain of steps is one plan over one scan, with one exchange.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rivulet.session import staged

_B = "_block"
#: The most rows that a block is planned for, unless a width is given; a longer history has more blocks and partitions.
BLOCK_ROWS = 500_000


class Blocks:
    """A history in blocks. level() adds columns to rows; those of a level may be used by the next.

    width: rows to a block; by default there are a few blocks to a shuffle partition, and more where they would be long.
    """

    def __init__(self, df: DataFrame, order: str, by: tuple[str, ...] = (), width: int | None = None):
        spark = df.sparkSession
        count, usual = df.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
        needed = -(-count // (width or BLOCK_ROWS))
        many = needed if width else max(4 * usual, needed)
        self.parts = needed if count > usual * BLOCK_ROWS else None  # None: the session's partitions do
        self.spread = self.parts is None
        dealt = df.repartitionByRange(max(1, many), *by, order).withColumn(_B, F.spark_partition_id()).sortWithinPartitions(*by, order)
        self.rows, self.order, self.by = staged(dealt, "ordered"), order, by
        self.fields = [self.rows.schema[c] for c in by]
        if by:
            edges = self.rows.groupBy(_B).agg(F.min(F.struct(*by)).alias("first"), F.max(F.struct(*by)).alias("last"))
            self.edges = {r[_B]: (tuple(r.first), tuple(r.last)) for r in edges.collect()}  # a row for each block
        else:  # one group; least and greatest structs would be found by a sort of the rows
            self.edges = {r[_B]: ((), ()) for r in self.rows.select(_B).distinct().collect()}  # a row for each block

    def _on(self, table: DataFrame, prefix: str) -> list[Column]:
        return [F.col(_B) == table[f"{prefix}{_B}"], *(F.col(c).eqNullSafe(table[f"{prefix}{c}"]) for c in self.by)]

    def _table(self, rows: list[tuple], fields: list[StructField], prefix: str) -> DataFrame:
        """A table of blocks, groups and further fields, with prefixed names; small enough to be sent to all tasks."""
        schema = StructType([StructField(prefix + _B, LongType()), *(StructField(prefix + f.name, f.dataType) for f in self.fields), *fields])
        return F.broadcast(self.rows.sparkSession.createDataFrame(rows, schema))  # a row for each block

    def level(self, sums: Mapping[str, Column] | None = None, carries: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None, descents: Mapping[str, Column] | None = None) -> Blocks:
        """sums: the sum up to and including this row. carries: the last value that is not null, up to this row; before:
        the same without this row. descents: how many values so far were less than the one before, nulls passed over."""
        sums, carries, before, descents = sums or {}, carries or {}, before or {}, descents or {}
        values = {**sums, **carries, **before, **descents}
        inside = Window.partitionBy(_B, *self.by).orderBy(self.order)
        upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
        rows = self.rows.withColumns({f"_v_{n}": v for n, v in values.items()})
        if descents:
            rows = self._dealt(rows)
            rows = rows.withColumns({f"_d_{n}": F.coalesce((F.col(f"_v_{n}") < F.last(f"_v_{n}", ignorenulls=True).over(earlier)).cast("long"), F.lit(0)) for n in descents})
        carry = self._carry(rows, sums, [*carries, *before], descents)
        rows = self._dealt(rows).withColumns(
            {f"_l_{n}": F.sum(f"_v_{n}").over(upto) for n in sums}
            | {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in carries}
            | {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(earlier) for n in before}
            | {f"_l_{n}": F.sum(f"_d_{n}").over(upto) for n in descents}
            | {f"_f_{n}": F.first(f"_v_{n}", ignorenulls=True).over(upto) for n in descents}
        )
        rows = rows.join(carry, self._on(carry, "_c_"), "left")
        add = lambda *parts: sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)).cast("long")
        rows = rows.withColumns(
            {n: add(F.col(f"_l_{n}"), F.col(f"_e_{n}")) for n in sums}
            | {n: F.coalesce(f"_l_{n}", f"_e_{n}") for n in (*carries, *before)}
            | {n: add(F.col(f"_l_{n}"), F.col(f"_e_{n}"), (F.col(f"_f_{n}") < F.col(f"_w_{n}")).cast("long")) for n in descents}
        )
        self.rows = rows.drop(*carry.columns, *(f"{k}{n}" for n in values for k in ("_v_", "_d_", "_l_", "_f_")))
        return self

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """The rows by blocks in as many partitions as a long history needs; once, since later levels keep them so. Blocks
        are dealt by number: hashed, several large ones would meet in one partition."""
        if self.spread:
            return rows
        self.spread = True
        return rows.repartitionById(self.parts, F.col(_B))

    def _carry(self, rows: DataFrame, sums, carries, descents) -> DataFrame:
        """What each block's first group brings from the blocks before, by a fold over what they end with."""
        ends = self._table([(b, *last[: len(self.by)]) for b, (_, last) in self.edges.items()], [], "_n_")
        last = lambda n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(self.order)))
        own = rows.join(ends, self._on(ends, "_n_")).groupBy(_B).agg(
            *(F.sum(f"_v_{n}").alias(n) for n in sums),
            *(last(n).alias(n) for n in carries),
            *(F.struct(F.sum(f"_d_{n}").alias("many"), F.min_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(self.order))).alias("first"), last(n).alias("last")).alias(n) for n in descents),
        )
        found: dict[int, Row] = {r[_B]: r for r in own.collect()}  # a row for each block
        brought, state, group = [], None, None
        for b in sorted(self.edges):
            first, final = self.edges[b]
            more = state is not None and group == first
            if more:
                brought.append((b, *first[: len(self.by)], *(state[n] for n in sums), *(state[n] for n in carries), *(x for n in descents for x in state[n])))
            state, group = self._after(state if more and first == final else None, found[b], sums, carries, descents), final
        types = {f.name: f.dataType for f in rows.schema}
        extra = [StructField(f"_e_{n}", own.schema[n].dataType) for n in (*sums, *carries)]
        extra += [StructField(k + n, t) for n in descents for k, t in (("_e_", LongType()), ("_w_", types[f"_v_{n}"]))]
        return self._table(brought, extra, "_c_")

    @staticmethod
    def _after(state: dict[str, Any] | None, own: Row, sums, carries, descents) -> dict[str, Any]:
        """What a group has after a block, from what it came with and what the block's rows of it have."""
        out: dict[str, Any] = {}
        for n in sums:
            parts = [x for x in ((state or {}).get(n), own[n]) if x is not None]
            out[n] = sum(parts) if parts else None
        for n in carries:
            out[n] = own[n] if own[n] is not None else (state or {}).get(n)
        for n in descents:
            many, end = state[n] if state else (0, None)
            o = own[n]
            met = end is not None and o["first"] is not None and o["first"] < end
            out[n] = (many + (o["many"] or 0) + met, o["last"] if o["last"] is not None else end)
        return out

    def done(self) -> DataFrame:
        return self.rows.drop(_B)


def running_sum(df: DataFrame, value: Column, order: str, name: str, by: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """df with the sum of value over the rows of its group up to and including this one."""
    return Blocks(df, order, by, width).level(sums={name: value}).done()


def numbered(df: DataFrame, order: str, name: str, by: tuple[str, ...] = (), width: int | None = None) -> DataFrame:
    """df with the row's number in its group, from 1."""
    return running_sum(df, F.lit(1), order, name, by, width)


def carried_all(df: DataFrame, values: dict[str, Column], order: str, by: tuple[str, ...] = (), width: int | None = None, inclusive: bool = True) -> DataFrame:
    """df with, for each name, the last of its values that is not null, up to this row or (not inclusive) before it."""
    rows = Blocks(df, order, by, width)
    return (rows.level(carries=values) if inclusive else rows.level(before=values)).done()


def carried(df: DataFrame, value: Column, order: str, name: str, by: tuple[str, ...] = (), width: int | None = None, inclusive: bool = True) -> DataFrame:
    """carried_all() of one value."""
    return carried_all(df, {name: value}, order, by, width, inclusive)


def wagons(events: DataFrame, keys: list[str], most: int, order: str = "id", width: int | None = None) -> DataFrame:
    """wagon_seq and wagon_event_index: consecutive events of one key, at most `most` to a wagon."""
    key = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    rows = Blocks(events.withColumn("wagon_key", key), order, (), width)
    rows.level(before={"_last": F.col("wagon_key")}, sums={"_n": F.lit(1)})
    rows.level(carries={"_start": F.when(F.col("_last").isNull() | (F.col("_last") != F.col("wagon_key")), F.col("_n"))})
    rows.rows = rows.rows.withColumn("wagon_event_index", ((F.col("_n") - F.col("_start")) % most + 1).cast("long"))
    return rows.level(sums={"wagon_seq": (F.col("wagon_event_index") == 1).cast("int")}).done().drop("_last", "_n", "_start")


def file_indexes(lines: DataFrame, position: str, files: int, order: str, width: int | None = None) -> DataFrame:
    """file_index: a position lower than the one before starts the next file; the last file takes what follows."""
    rows = Blocks(lines, order, (), width).level(descents={"_file": F.col(position)}).done()
    return rows.withColumn("file_index", F.least("_file", F.lit(files - 1)).cast("long")).drop("_file")


def log_index(name: str | Column = "log_file") -> Column:
    """The number at the end of a log file's name; -1 if there is none."""
    return F.coalesce(F.substring_index(F.trim(name), ".", -1).try_cast("int"), F.lit(-1))


def at_or_before(file: str, pos: str, other_file: str, other_pos: str) -> Column:
    """Whether a log position is not after another."""
    point = lambda f, p: F.struct(log_index(f).alias("file"), F.col(p).cast("long").alias("pos"))
    return point(file, pos) <= point(other_file, other_pos)


def latest(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    """The row of each group with the greatest order values; an aggregation with map-side combining."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(row).select("_row.*")


def all_but_latest(df: DataFrame, by: list[str], *order: str, unique: str = "id") -> DataFrame:
    """The rows of each group except the latest."""
    newest = latest(df, by, *order).select(F.col(unique).alias("_newest"))
    return df.join(newest, F.col(unique) == F.col("_newest"), "left_anti")


def execution_orders(tables: DataFrame, existing: DataFrame, by: list[str], order: list[str], reset: bool = False, first: int = 100, step: int = 10) -> DataFrame:
    """tables with execution_order 100, 110, ... in their order; existing (by..., execution_order) stays unless reset."""
    n = F.row_number().over(Window.orderBy(*order)) - 1  # a catalog, not data: a row for each table
    rows = tables.withColumn("_default", F.lit(first) + n * step)
    known = existing.select(*by, F.col("execution_order").alias("_known"))
    value = F.col("_default") if reset else F.coalesce(F.when(F.col("_known") != 0, F.col("_known")), "_default")
    return rows.join(known, by, "left").withColumn("execution_order", value.cast("long")).drop("_default", "_known")
