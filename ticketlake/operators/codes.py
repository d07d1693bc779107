"""Vectors as one byte a number: an approximation that is read first, with a bound of its error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketlake.operators.sweep import Blocks, parts_for, sweep, visited
from ticketlake.operators.vector import BLOCK_ROWS, EXACT_AT_ONCE, PAIRS_AT_ONCE, TILE_ROWS, _measured, _Side, _vectors

_LEVELS = 127
_SLACK = 1e-9  # rounding of distances, relative


def encode(vectors: np.ndarray, centres: np.ndarray, cell: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Code, step and error of each vector: its difference to the centre of its cell in steps, and what is lost."""
    rest = vectors - centres[cell]
    step = np.abs(rest).max(1, initial=0.0) / _LEVELS
    code = np.rint(rest / np.where(step > 0, step, 1.0)[:, None]).astype(np.int8)
    lost = np.linalg.norm(rest - code * step[:, None], axis=1)
    return [row.tobytes() for row in code], step, lost


def decode(rows: pd.DataFrame, centre: np.ndarray) -> np.ndarray:
    """The approximate vectors of rows of one cell."""
    code = np.frombuffer(b"".join(rows["code"]), np.int8).reshape(len(rows), -1)
    return code * rows["step"].to_numpy()[:, None] + centre


class _Candidates:
    """For queries ``q`` the rows that may be among the k nearest, by the bounds of their distances.

    The true distance lies within ``lost`` of that to the approximation, so whoever is farther for certain than
    k others are at most is out.
    """

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.bound = np.full(len(q), np.inf)  # of the greatest distances the k-th, squared
        self.held: pa.Table | None = None
        self.new: list[pa.RecordBatch] = []

    def see(self, queries: np.ndarray, c: np.ndarray, lost: np.ndarray, rows: pa.RecordBatch, origin: np.ndarray) -> None:
        """Compare with the approximate vectors ``c``; ``rows`` has what is kept of each."""
        side, spare = _Side(c, origin), lost.max(initial=0.0) + _SLACK
        for start in range(0, len(queries), TILE_ROWS):
            some = queries[start : start + TILE_ROWS]
            row, col, self.bound[some] = side.near(self.q[some], self.bound[some], self.k, spare)
            row = some[row]
            away = np.sqrt(_measured(self.q, c, row, col))
            slack = _SLACK * (1.0 + away)
            low, high = np.maximum(away - lost[col] - slack, 0.0), away + lost[col] + slack
            inside = low * low <= self.bound[row]
            row, col, low, high = row[inside], col[inside], low[inside], high[inside]
            found = [pa.array(row.astype(np.int32)), pa.array(low), pa.array(high), *rows.take(pa.array(col)).columns]
            self.new.append(pa.record_batch(found, ["row", "low", "high", *rows.schema.names]))
            if sum(len(x) for x in self.new) > max(PAIRS_AT_ONCE, len(self.held or ())):
                self.merge()

    def merge(self) -> pa.Table | None:
        """Drop whoever is out by the rows seen so far; row by row."""
        if self.new:
            both = pa.concat_tables([*([self.held] if self.held else []), pa.Table.from_batches(self.new)]).combine_chunks()
            row, high = (both.column(name).to_numpy() for name in ("row", "high"))
            order = np.lexsort((high, row))
            both, row, high = both.take(pa.array(order)), row[order], high[order]
            last = np.arange(len(row)) - np.searchsorted(row, row, side="left") == self.k - 1
            self.bound[row[last]] = np.minimum(self.bound[row[last]], high[last] ** 2)
            self.held, self.new = both.filter(pa.array(both.column("low").to_numpy() ** 2 <= self.bound[row])), []
        return self.held


def near(q: np.ndarray, c: np.ndarray, lost: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row of ``q``, row of ``c``, least and greatest distance of all rows that may be among the k nearest.

    Compared ``TILE_ROWS`` rows of ``c`` at a time; who is out by the rows seen so far is dropped.
    """
    found = _Candidates(q, k)
    for start in range(0, len(c), TILE_ROWS):
        tile = c[start : start + TILE_ROWS]
        numbers = pa.record_batch([pa.array(np.arange(start, start + len(tile)))], ["col"])
        found.see(np.arange(len(q)), tile, lost[start : start + TILE_ROWS], numbers, tile[0])
    held = found.merge()
    if held is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    held = held.sort_by([("row", "ascending"), ("col", "ascending")])
    return tuple(held.column(name).to_numpy() for name in ("row", "col", "low", "high"))


def candidates(asked: DataFrame, codes: DataFrame, centres: np.ndarray, k: int, pairs: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, neighbour_id, cell`` of all rows that may be among the k nearest of the cells that a query visits.

    ``asked(query_id, vector, cells)`` is a written table, ``codes(neighbour_id, code, step, lost, digest, cell)``; only these are
    written once more and read. A little over k rows are left for each query; of copies of one vector no more than k from a task.
    """

    class Share:
        def __init__(self, share: pa.Table):
            self.ids, self.cells = share.column("query_id"), share.column("cells")
            self.seen = _Candidates(_vectors(share.column("vector").combine_chunks()), k)

        def see(self, cell: int, queries: np.ndarray, rows: pa.RecordBatch) -> None:
            c = decode(rows.select(["code", "step"]).to_pandas(), centres[cell])
            kept = pa.record_batch([rows.column("neighbour_id"), pa.array(np.full(len(rows), cell, np.int32))], ["neighbour_id", "cell"])
            self.seen.see(queries, c, rows.column("lost").to_numpy(), kept, centres[cell])

        def found(self) -> pa.Table | None:
            held = self.seen.merge()
            if held is None or not len(held):
                return None
            held = held.append_column("query_id", self.ids.take(pa.array(held.column("row").to_numpy())))
            return held.select(["query_id", "neighbour_id", "cell"])

    blocks = Blocks(codes.select("neighbour_id", "code", "step", "lost", "digest", "cell"), "digest", k, block_rows)
    blocks.add(visited(asked))
    ids = [asked.schema["query_id"].dataType.simpleString(), codes.schema["neighbour_id"].dataType.simpleString()]
    parts = parts_for(asked.sparkSession, len(asked.inputFiles()), pairs)
    return sweep(asked, blocks, Share, f"query_id {ids[0]}, neighbour_id {ids[1]}, cell int", parts)


def distances(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``distance`` in place of ``vector`` and ``asked``: squared, summed in the order of the numbers."""
    rest = [c for c in pairs.columns if c not in ("vector", "asked")]
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), EXACT_AT_ONCE):
                part = pdf.iloc[start : start + EXACT_AT_ONCE]
                a, b = (np.vstack(part[c].to_numpy()).astype(np.float64) for c in ("asked", "vector"))
                total = np.zeros(len(part))
                for i in range(a.shape[1]):
                    total += (a[:, i] - b[:, i]) ** 2
                yield part[rest].assign(distance=total)

    return pairs.mapInPandas(run, f"{schema}, distance double")
