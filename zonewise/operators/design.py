"""Design of the residual forecaster: zone reports and zone features carried along a graph.

A column name says what it holds: ``z_`` a scaled zone feature, ``f1_``, ``b2_`` the first term along
forward or the second along backward links, ``x_income`` a product of a scaled coordinate and feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from zonewise.functions.scalars import one_row
from zonewise.operators import windows
from zonewise.session import parts_of, pin

PACKED_ROWS = 128  # of a written file of rows that hold an array per column: a reader holds them at once

DIRECTIONS = {"f": "forward", "b": "backward"}


def hops(rows: DataFrame, support: DataFrame, columns: Sequence[str], steps: int, directions: str = "fb", by: Sequence[str] = (), key: str = "zone") -> DataFrame:
    """``rows`` with the Chebyshev terms 1..``steps`` of ``columns`` along ``support(direction, row, col, w)``.

    One join with the links and one sum a step carry all columns and directions together; every row
    of ``rows`` is one node of the graph ``by``. A node without links gets zeros (and signs of them).
    """
    out = rows
    weigh = [F.sum(F.when(F.col("direction") == DIRECTIONS[d], F.col("w"))).alias(f"_w_{d}") for d in directions]
    links = support.filter(F.col("direction").isin(*[DIRECTIONS[d] for d in directions])).groupBy("row", "col").agg(*weigh)
    for k in range(1, steps + 1):
        last = {(d, c): c if k == 1 else f"{d}{k - 1}_{c}" for d in directions for c in columns}
        moved = out.select(*by, F.col(key).alias("col"), *sorted(set(last.values()))).join(links, "col")
        sums = [F.sum(F.col(f"_w_{d}") * F.col(src)).alias(f"{d}{k}_{c}") for (d, c), src in last.items()]
        summed = moved.groupBy(*by, F.col("row").alias(key)).agg(*sums)
        out = out.join(summed, [*by, key], "left")
        for d, c in last:
            name, older = f"{d}{k}_{c}", (c if k == 2 else f"{d}{k - 2}_{c}")
            new = F.coalesce(F.col(name), F.lit(0.0))
            out = out.withColumn(name, new if k == 1 else 2 * new - F.col(older))
    return out


def packed_hops(rows: DataFrame, support: DataFrame, columns: Sequence[str], steps: int, key: str = "zone") -> DataFrame:
    """:func:`hops` forward and backward of rows that hold arrays: ``columns`` and the ``ids`` they stand for, a row per node.

    A step joins the arrays with the links and adds up those that meet in a node by their ids, so a row
    moves once per link and not once per link and sample.
    """
    weigh = [F.sum(F.when(F.col("direction") == DIRECTIONS[d], F.col("w"))).alias(f"_w_{d}") for d in "fb"]
    links = support.groupBy("row", "col").agg(*weigh)
    out = rows
    for k in range(1, steps + 1):
        last = [(d, c, c if k == 1 else f"{d}{k - 1}_{c}") for d in "fb" for c in columns]
        sources = sorted({src for _, _, src in last})
        out = pin(out, rows_per_file=PACKED_ROWS)
        own = out.withColumns({"_w_f": F.lit(None).cast("double"), "_w_b": F.lit(None).cast("double"), "_own": F.lit(True)})
        sent = out.select(F.col(key).alias("col"), "ids", *sources).join(links, "col").withColumnRenamed("row", key).drop("col")
        both = own.unionByName(sent.withColumn("_own", F.lit(False)), allowMissingColumns=True)
        terms = [(f"_w_{d}", src, f"{d}{k}_{c}", (c if k == 2 else f"{d}{k - 2}_{c}") if k > 1 else None) for d, c, src in last]
        schema = StructType([*out.schema])
        for _, _, name, _ in terms:
            schema = schema.add(name, ArrayType(DoubleType()))
        out = both.repartition(_packed_parts(out, links, len(sources)), key).groupBy(key).applyInArrow(_summed_arrays(out.columns, terms), schema)
    return out


def _packed_parts(rows: DataFrame, links: DataFrame, sent: int) -> int:
    """Parts for ``rows`` and what their links carry, ``ids`` and ``sent`` arrays a link."""
    held, met = rows.agg(F.sum(F.size("ids")).alias("ids"), F.count(F.lit(1)).alias("n")).first(), links.count()
    arrays = sum(kind.startswith("array") for _, kind in rows.dtypes)
    return parts_of(rows.sparkSession, 8 * (held["ids"] or 0) * (arrays + (1 + sent) * met / max(held["n"], 1)))


def _summed_arrays(kept: Sequence[str], terms: Sequence[tuple]):
    """Arrow function of a node's own row and the rows sent to it: its columns and the weighed sums."""

    def array(table, name, i):
        return table.column(name)[i].values.to_numpy(zero_copy_only=False)

    def summed(table):
        mine = np.flatnonzero(table.column("_own").to_numpy())
        one = table.slice(mine[0] if len(mine) else 0, min(len(mine), 1)).select(list(kept))
        ids = array(table, "ids", mine[0]) if len(mine) else np.zeros(0, dtype="int64")
        sums = {name: np.zeros(len(ids)) for _, _, name, _ in terms}
        for i in np.flatnonzero(~table.column("_own").to_numpy()) if len(mine) else ():
            theirs = array(table, "ids", i)
            here = there = slice(None)
            if not np.array_equal(ids, theirs):
                _, here, there = np.intersect1d(ids, theirs, assume_unique=True, return_indices=True)
            for weight, src, name, _ in terms:
                w = table.column(weight)[i].as_py()
                if w is not None:
                    sums[name][here] += w * array(table, src, i)[there]
        for _, _, name, older in terms:
            new = sums[name] if older is None else 2 * sums[name] - array(table, older, mine[0]) if len(mine) else sums[name]
            one = one.append_column(name, pa.array([new] if len(mine) else [], pa.list_(pa.float64())))
        return one

    return summed


def scaled(zones: DataFrame, columns: Sequence[str], flat: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """``zones`` with ``z_`` columns by population moments over the zones, and those moments in one row."""
    marks = pin(zones.agg(*[m for c in columns for m in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]))
    return zones.withColumns({f"z_{c}": at_scale(F.col(c), one_row(marks), c, flat) for c in columns}), marks


def at_scale(value: Column, marks: Column, name: str, flat: float = 1e-8) -> Column:
    return F.when(marks[f"s_{name}"] >= flat, (value - marks[f"m_{name}"]) / marks[f"s_{name}"]).otherwise(0.0)


class Design:
    """Which columns the forecaster reads."""

    def __init__(self, dynamic: Sequence[str], features: Sequence[str], coords: Sequence[str] = ("x", "y"), steps: int = 1, reach: int = 2):
        self.dynamic, self.features, self.coords, self.steps, self.reach = tuple(dynamic), tuple(features), tuple(coords), steps, reach

    @property
    def static(self) -> tuple[str, ...]:
        return (*self.features, *self.coords)

    @property
    def moving(self) -> list[str]:
        return [*self.dynamic, *[f"{d}{k}_{c}" for k in range(1, self.steps + 1) for d in "fb" for c in self.dynamic]]

    @property
    def standing(self) -> list[str]:
        return [*[f"z_{c}" for c in self.static], *[f"f{k}_z_{c}" for k in range(1, self.reach + 1) for c in self.features], *[f"{c}_{f}" for c in self.coords for f in self.features]]

    @property
    def columns(self) -> list[str]:
        return [*self.moving, *self.standing]

    def crossed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f"{c}_{f}": F.col(f"z_{c}") * F.col(f"z_{f}") for c in self.coords for f in self.features})

    def context(self, zones: DataFrame, support: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A row per zone with its standing columns, and the moments the features are scaled by."""
        own, marks = scaled(zones, self.static)
        carried = hops(own, support, [f"z_{c}" for c in self.features], self.reach, "f")
        return self.crossed(carried).select("zone", *self.standing), marks

    def moved(self, cells: DataFrame, support: DataFrame) -> DataFrame:
        """Cells (one per sample and zone) with the dynamic columns of their neighbours."""
        return hops(cells, support, self.dynamic, self.steps, "fb", ["sample_id"])

    def cells(self, panel: DataFrame, wins: DataFrame, lookback: int, support: DataFrame, context: DataFrame) -> DataFrame:
        """Cells of all windows with every column of the design, a row per sample and zone."""
        looks = packed_hops(windows.packed_looks(panel, wins, lookback), support, self.dynamic, self.steps)
        return windows.unpacked(looks.join(context, "zone"), wins, ["anchor", "y", *self.moving])
