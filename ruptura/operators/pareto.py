"""Exact Pareto front of a large table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruptura.functions.numeric import finite
from ruptura.runtime import written

BLOCK = 5_000
CHUNK = 512
#: The first points of a front beat most others, so few of them go ahead.
FIRST = 16
#: A cell aims at this share of a block, and so many blocks of rows ahead meet it at once.
CELL_SHARE = 8
#: Most rows of a front that is broadcast.
SHORT_FRONT = 100_000
#: Most cells of the grid, and most tasks of the comparison.
MOST_CELLS, MOST_TASKS = 1 << 16, 4096


def undominated(points: np.ndarray) -> np.ndarray:
    """Mask of the points that no other point dominates; smaller is better.

    Points must be distinct and sorted so that none is dominated by a later one.
    """
    keep = np.ones(len(points), dtype=bool)
    for start in range(0, len(points), CHUNK):
        part = points[start:start + CHUNK]
        before = points[:start][keep[:start]]
        lost = _beaten_by(part, before)
        left = np.flatnonzero(~lost)
        lost[left] = _beaten_by(part[left], part[left])
        keep[start:start + CHUNK] = ~lost
    return keep


def _sorted(points: np.ndarray) -> np.ndarray:
    """Order in which a point can only be dominated by an earlier one."""
    return np.lexsort((*points.T[::-1], points.sum(axis=1)))


def pareto_front(df: DataFrame, objectives: dict[str, str], genes: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Rows no other row beats: at least as good everywhere and better somewhere.

    ``objectives`` maps columns to "min" or "max". Rows equal in objectives are
    all kept; with ``genes``, rows that also agree in those are kept once.
    Rows without a complete set of objectives are left out, unless no row has
    one: then all rows come back.
    """
    costs = [f"_o{i}" for i in range(len(objectives))]
    cells = {o: finite(F.col(c).cast("double")) * (1.0 if way == "min" else -1.0)
             for o, (c, way) in zip(costs, objectives.items())}
    if any(way not in ("min", "max") for way in objectives.values()):
        raise ValueError("objectives are 'min' or 'max'")
    scored = df.withColumns({o: e + F.lit(0.0) for o, e in cells.items()})  # -0.0 becomes 0.0
    front = _front(scored.select(*costs).na.drop(), costs, block)
    if front is None:
        return df
    # A front that is known to be short goes to the rows, which are many and wide.
    front = written(front, "front")
    if front.count() <= SHORT_FRONT:
        front = F.broadcast(front)
    rows = scored.join(front, costs, "left_semi").select(*df.columns)
    return rows.dropDuplicates([*genes, *objectives]) if genes else rows


def _front(points: DataFrame, costs: list[str], block: int) -> DataFrame | None:
    """Skyline per task, copies of one triple counting once, then a coarse grid whose occupied cells decide which points are compared.

    The cut points of the grid are quantiles of the survivors. A point beats every point of
    a cell that is higher in all axes, so such cells vanish by their occupancy alone. What
    is left of a cell meets only the cells that are nowhere higher than it; a large cell,
    or many points ahead of one, make several groups of about ``block`` rows each.
    """
    schema = points.schema

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: np.ndarray | None = None
        for pdf in batches:
            points = pdf[costs].to_numpy(dtype=float)
            points = points if best is None else np.vstack([best, points])
            points = points[_sorted(points)]
            points = points[np.append(True, (points[1:] != points[:-1]).any(axis=1))[:len(points)]]
            best = points[undominated(points)]
            if len(best) > block:  # keep memory and time bounded: the cells are compared below
                yield pd.DataFrame(best, columns=costs)
                best = None
        if best is not None:
            yield pd.DataFrame(best, columns=costs)

    left = written(points.mapInPandas(local, schema).distinct(), "skyline")
    n = left.count()
    if not n:
        return None
    grid = _Grid.over(left, costs, n, max(1, block // CELL_SHARE))
    celled = written(left.mapInPandas(grid.placed(costs), f"{schema.simpleString()[7:-1].replace(':', ' ')}, _cell int"), "cells")
    # At most MOST_CELLS short rows.
    sizes = {r["_cell"]: r["count"] for r in celled.groupBy("_cell").count().collect()}
    order = grid.surviving(np.array(list(sizes), dtype=np.int64))
    meet = _Meeting(grid.coordinates(order), np.array([sizes[c] for c in order]), {c: i for i, c in enumerate(order.tolist())}, block)

    fields = ", ".join(f"{c} double" for c in costs)
    both = celled.filter(F.col("_cell").isin(order.tolist()) if len(order) <= 1000 else F.lit(True)).mapInPandas(
        meet.dealt(costs), f"_target int, _part int, _chunk int, _ahead boolean, {fields}")

    def beaten(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.loc[~pdf["_ahead"], costs].to_numpy(dtype=float)
        ahead = pdf.loc[pdf["_ahead"], costs].to_numpy(dtype=float)
        lost = _beaten_by(points, ahead[_sorted(ahead)])
        return pd.DataFrame(points[lost], columns=costs)

    # Few bytes, much work: a stated number of partitions keeps adaptive execution from merging the tasks.
    tasks = max(1, min(MOST_TASKS, len(order)))
    lost = both.repartition(tasks, "_target", "_part", "_chunk").groupBy("_target", "_part", "_chunk").applyInPandas(beaten, schema).distinct()
    alive = celled.mapInPandas(meet.alive(costs), schema)
    return alive.join(lost, costs, "left_anti")


@dataclass(frozen=True)
class _Grid:
    """Cut points per axis; a cell is one number."""

    cuts: tuple[np.ndarray, ...]

    @staticmethod
    def over(points: DataFrame, costs: list[str], n: int, cell_rows: int) -> _Grid:
        """As many cells per axis as give about ``cell_rows`` rows to a cell of a front, at most MOST_CELLS in all."""
        d = len(costs)
        steps = int(min((n / cell_rows) ** (1 / max(1, d - 1)), MOST_CELLS ** (1 / d)))
        if steps < 2:
            return _Grid(tuple(np.zeros(0) for _ in costs))
        shares = [i / steps for i in range(1, steps)]
        cuts = points.stat.approxQuantile(costs, shares, 1 / (4 * steps))
        return _Grid(tuple(np.unique(c) for c in cuts))

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(c) + 1 for c in self.cuts)

    def cells(self, points: np.ndarray) -> np.ndarray:
        places = [np.searchsorted(c, points[:, k], side="right") for k, c in enumerate(self.cuts)]
        return np.ravel_multi_index(places, self.shape)

    def coordinates(self, cells: np.ndarray) -> np.ndarray:
        return np.stack(np.unravel_index(cells, self.shape), axis=1)

    def surviving(self, cells: np.ndarray) -> np.ndarray:
        """Cells without an occupied cell that is lower in every axis."""
        seen = np.zeros(self.shape, dtype=bool)
        seen[np.unravel_index(cells, self.shape)] = True
        for axis in range(len(self.shape)):
            seen = np.logical_or.accumulate(seen, axis=axis)
        lower = np.zeros(self.shape, dtype=bool)
        lower[(slice(1, None),) * len(self.shape)] = seen[(slice(None, -1),) * len(self.shape)]
        return cells[~lower[np.unravel_index(cells, self.shape)]]

    def placed(self, costs: list[str]):
        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(_cell=self.cells(pdf[costs].to_numpy(dtype=float)).astype("int32"))

        return apply


@dataclass(frozen=True)
class _Meeting:
    """Which rows of the surviving cells meet: coordinates and sizes by position, position by cell."""

    at: np.ndarray
    sizes: np.ndarray
    place: dict[int, int]
    block: int

    def parts(self, target: int) -> int:
        return -(-int(self.sizes[target]) // self.block)

    def chunks(self, target: int) -> int:
        """Groups that the rows ahead of a cell are dealt to."""
        ahead = int(self.sizes[(self.at <= self.at[target]).all(axis=1)].sum())
        return -(-ahead // (CELL_SHARE * self.block))

    def alive(self, costs: list[str]):
        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.loc[pdf["_cell"].isin(self.place), costs]

        return apply

    def dealt(self, costs: list[str]):
        """Each row as one to be judged in its own cell, and as one ahead in every cell it may beat a point of."""
        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            of: dict[int, tuple[int, int]] = {}

            def split(target: int) -> tuple[int, int]:
                if target not in of:
                    of[target] = self.parts(target), self.chunks(target)
                return of[target]

            def rows(pdf: pd.DataFrame, target: int, part, chunk, ahead: bool) -> pd.DataFrame:
                return pdf[costs].assign(_target=target, _part=part, _chunk=chunk, _ahead=ahead)[["_target", "_part", "_chunk", "_ahead", *costs]]

            for pdf in batches:
                for cell, own in pdf.groupby("_cell"):
                    if cell not in self.place:
                        continue
                    k = self.place[cell]
                    # A row's group follows from its values, so a lost task deals it likewise.
                    mixed = pd.util.hash_pandas_object(own[costs], index=False).to_numpy()
                    parts, chunks = split(k)
                    for chunk in range(chunks):
                        yield rows(own, k, (mixed % parts).astype("int32"), chunk, False)
                    for target in np.flatnonzero((self.at >= self.at[k]).all(axis=1)):
                        parts, chunks = split(int(target))
                        for part in range(parts):
                            yield rows(own, int(target), part, (mixed // 7919 % chunks).astype("int32"), True)

        return apply


def _beaten_by(points: np.ndarray, front: np.ndarray) -> np.ndarray:
    """Mask of the points that a point of ``front`` dominates."""
    out = np.zeros(len(points), dtype=bool)
    lead, step = 0, FIRST
    while lead < len(front):
        some = front[lead:lead + step]
        lead, step = lead + step, min(CHUNK, 4 * step)
        left = np.flatnonzero(~out)
        for start in range(0, len(left), CHUNK):
            at = left[start:start + CHUNK]
            better = np.ones((len(at), len(some)), dtype=bool)
            strict = np.zeros((len(at), len(some)), dtype=bool)
            for k in range(points.shape[1]):
                ours, theirs = points[at, k][:, None], some[:, k][None, :]
                better &= theirs <= ours
                strict |= theirs < ours
            out[at] = (better & strict).any(axis=1)
    return out
