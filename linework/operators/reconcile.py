"""Projections of players brought in line with totals of teams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType


def proportional(cells: np.ndarray, rows: np.ndarray, columns: np.ndarray, tolerance: float, most: int) -> tuple[np.ndarray, int, float]:
    """Cells scaled by row and column in turn until both margins hold: (cells, rounds, largest gap as a share of the total).

    A margin of NaN asks for nothing. Where all margins of both sides are given but sum to
    different totals, the columns are scaled to the rows' sum first. Zeros stay zero, so a margin over
    a row or column of zeros cannot be met; the gap says so.
    """
    out = cells.astype(float).copy()
    full = not (np.isnan(rows).any() or np.isnan(columns).any())
    if full and columns.sum() > 0:
        columns = columns * (rows.sum() / columns.sum())
    scale = max(1.0, np.nansum(np.abs(rows)), np.nansum(np.abs(columns)))

    def gap() -> float:
        off = np.concatenate([np.abs(out.sum(1) - rows), np.abs(out.sum(0) - columns)])
        return float(np.nanmax(off, initial=0.0) / scale) if np.isfinite(off).any() else 0.0

    def factor(want: np.ndarray, have: np.ndarray) -> np.ndarray:
        known = ~np.isnan(want) & (have > 0)
        return np.where(known, want / np.where(known, have, 1.0), 1.0)

    for k in range(most):
        if gap() <= tolerance:
            return out, k, gap()
        out *= factor(rows, out.sum(1))[:, None]
        out *= factor(columns, out.sum(0))[None, :]
    return out, most, gap()


def reconcile(cells: DataFrame, row_totals: DataFrame, column_totals: DataFrame, *, by: str, row: str, column: str, value: str = "value", total: str = "total", tolerance: float = 1e-9, most: int = 500) -> DataFrame:
    """``cells`` (by, row, column, value) with ``adjusted``, ``rounds`` and ``gap``, solved for each ``by`` on its own.

    ``row_totals`` is (by, row, total), ``column_totals`` (by, column, total). Null, negative and not
    finite values count as 0; a missing or null total asks for nothing; equal cells of one place are
    added first. A group is one game: as many rows as it has players.
    """
    clean = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(value) > 0), F.col(value).cast("double")).otherwise(0.0)
    own = cells.groupBy(by, row, column).agg(F.sum(clean).alias(value))
    goal = lambda df, key, name: df.groupBy(by, key).agg(F.max(F.col(total).cast("double")).alias(name))
    met = own.join(goal(row_totals, row, "_row_total"), [by, row], "left").join(goal(column_totals, column, "_column_total"), [by, column], "left")
    out = StructType([*[own.schema[c] for c in (by, row, column, value)], StructField("adjusted", DoubleType()), StructField("rounds", IntegerType()), StructField("gap", DoubleType())])

    def solve(game: pd.DataFrame) -> pd.DataFrame:
        i, rows = pd.factorize(game[row], use_na_sentinel=False)
        j, columns = pd.factorize(game[column], use_na_sentinel=False)
        table, want_rows, want_columns = np.zeros((len(rows), len(columns))), np.full(len(rows), np.nan), np.full(len(columns), np.nan)
        table[i, j] = game[value]
        want_rows[i], want_columns[j] = game["_row_total"].astype(float), game["_column_total"].astype(float)
        solved, rounds, off = proportional(table, want_rows, want_columns, tolerance, most)
        return game[[by, row, column, value]].assign(adjusted=solved[i, j], rounds=np.int32(rounds), gap=off)

    return met.groupBy(by).applyInPandas(solve, out)
