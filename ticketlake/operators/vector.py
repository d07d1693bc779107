"""Nearest neighbours by squared Euclidean distance.

Corpus rows belong to cells and queries visit cells, as a list for each query. Exact search holds a share of the queries in a task
while the blocks of their cells come past, read from files (``sweep``). Where a query visits few buckets, visits and rows
are shuffled instead: a task holds one block of bounded rows while its visitors come past, and
returns at most ``k`` rows per query. Python holds a block, a share and a tile of pairs, never a row for each visit.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ticketlake.operators.sweep import Blocks, one_cell, one_length, parts_for, share_rows, sizes, sweep, unpacked, visited
from ticketlake.session import cut_lineage, drop_written, fresh_path, rows_per_file, shuffles_dropped

BLOCK_ROWS = 32_768  # corpus rows that a task holds
TILE_ROWS = 1024  # rows of either side in one matrix product
PAIRS_AT_ONCE = 1 << 18  # pairs kept before only the k nearest of each query stay, and cells planned at a time
EXACT_AT_ONCE = 1024  # pairs that are measured number by number at a time
_REACH_SLACK = 1e-6  # relative rounding of a distance in product form


def where_equal(corpus: DataFrame, where: dict | None) -> DataFrame:
    """Keep corpus rows whose metadata equals every given value."""
    for column, value in (where or {}).items():
        corpus = corpus.filter(F.col(column) == F.lit(value))
    return corpus


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.vstack(vectors.to_numpy()).astype(np.float64)


def _vectors(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    one_length(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    product = a @ b.T
    product *= 2.0
    size = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    return np.subtract(size, product, out=product)


def digests(vectors: Iterable[np.ndarray]) -> list[bytes]:
    """16 bytes for each vector, the same for copies."""
    return [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors]


def without_spare_copies(corpus: pd.DataFrame, k: int, copies: str | None = None) -> pd.DataFrame:
    """At most k rows of one vector, those with the smallest ids: more copies never make a list of k.

    ``copies`` is a column of ``digests``; without it they are made of the column ``vector``.
    """
    corpus = corpus.sort_values("neighbour_id", kind="stable", ignore_index=True)
    same = corpus[copies] if copies else pd.Series(digests(corpus["vector"]), dtype=object)
    return corpus[same.groupby(same).cumcount() < k]


def _measured(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Squared distance of each pair, summed in the order of the numbers."""
    distance = np.zeros(len(row))
    for at in range(0, len(row) if q.shape[1] else 0, EXACT_AT_ONCE):
        step = q[row[at : at + EXACT_AT_ONCE]] - c[col[at : at + EXACT_AT_ONCE]]
        distance[at : at + EXACT_AT_ONCE] = np.cumsum(step * step, axis=1)[:, -1]
    return distance


class _Side:
    """Rows of one side of a tile, moved by ``origin``, as factors of a product that is the squared distance less the query's size.

    Single precision does where the numbers are of a size for it; ``slack`` bounds what is lost.
    """

    def __init__(self, c: np.ndarray, origin: np.ndarray | float = 0.0):
        c = c - origin
        size = (c * c).sum(1)
        self.origin, self.largest = origin, size.max(initial=0.0)
        self.kind = np.float32 if self.largest < 1e30 else np.float64
        self.factors = np.concatenate([c, size[:, None]], axis=1).astype(self.kind)

    def rough(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries and all rows the squared distance less the query's size, the sizes and the slack."""
        q = q - self.origin
        size = (q * q).sum(1)
        kind = self.kind if size.max(initial=0.0) < 1e30 else np.float64
        slack = (q.shape[1] + 16) * float(np.finfo(kind).eps) * (size + 2.0 * self.largest)
        q = np.concatenate([-2.0 * q, np.ones((len(q), 1))], axis=1).astype(kind)
        return q @ self.factors.T, size, slack

    def near(
        self, q: np.ndarray, bound: np.ndarray, k: int, spare: float = 0.0, buckets: tuple[np.ndarray, np.ndarray] | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of ``q`` and of the rows for all pairs that may lie within ``bound``, and the bound, lowered where many do.

        ``spare`` is by how much a distance, not squared, may be off beside the rounding. With ``buckets``, those of either side
        by table, only pairs that share one count.
        """
        less, size, slack = self.rough(q)

        def inside() -> np.ndarray:
            reach = bound if not spare else (np.sqrt(bound) + spare) ** 2
            return less <= (reach + slack - size).astype(less.dtype)[:, None]

        mask, many = inside(), 2 * k * len(q)
        if buckets and np.count_nonzero(mask) > many:
            shared = np.zeros(less.shape, bool)
            for a, b in zip(buckets[0].T, buckets[1].T, strict=True):
                shared |= a[:, None] == b[None, :]
            less[~shared] = np.inf
            mask &= shared
        if less.shape[1] > k and np.count_nonzero(mask) > many:
            kth = np.maximum(np.partition(less, k - 1, axis=1)[:, k - 1] + size + slack, 0.0)
            bound = np.fmin(bound, kth if not spare else (np.sqrt(kth) + spare) ** 2)
            mask = inside() & (less < np.inf)
        at = np.flatnonzero(mask)
        row, col = at // max(less.shape[1], 1), at % max(less.shape[1], 1)
        if buckets:
            meet = (buckets[0][row] == buckets[1][col]).any(1)
            row, col = row[meet], col[meet]
        return row, col, bound


def _nearest_rows(
    q: np.ndarray,
    c: np.ndarray,
    k: int,
    reach: np.ndarray | None = None,
    order: np.ndarray | None = None,
    spans: list[tuple[np.ndarray, int, int]] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, row of ``c`` and distance of the k nearest; equal distances by ``order`` of ``c``.

    Rows beyond ``reach``, if it is given, are not wanted. ``spans`` says which rows of ``q`` are compared with
    which run of rows of ``c``; without it all are. No more than ``PAIRS_AT_ONCE`` pairs and those of a tile are held.
    """
    bound = np.full(len(q), np.inf) if reach is None else reach.copy()  # no more than k rows can be nearer than this
    order = np.arange(len(c)) if order is None else order
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    new: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col, distance = (np.concatenate(side) for side in zip(held, *new))
        by = np.lexsort((order[col], distance, row))
        row, col, distance = row[by], col[by], distance[by]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        last = place == k - 1
        bound[row[last]] = np.minimum(bound[row[last]], distance[last])
        keep = place < k
        return row[keep], col[keep], distance[keep]

    for asking, first, end in [(np.arange(len(q)), 0, len(c))] if spans is None else spans:
        some = q[asking]
        for start in range(first, end, TILE_ROWS):
            tile = c[start : min(start + TILE_ROWS, end)].astype(np.float64, copy=False)
            # the product form rounds differently, so keep near ties and measure again
            row, col, bound[asking] = _Side(tile, tile[0]).near(some, bound[asking], k)
            new.append((asking[row], col + start, _measured(some, tile, row, col)))
            if sum(len(x[0]) for x in new) > PAIRS_AT_ONCE:
                held, new = merged(), []
    return merged()


def _top_k_of_block(k: int, carry: list[str]):
    """Step of ``stream_blocks``: the k nearest rows of a block for each query."""

    def block(corpus: pd.DataFrame) -> tuple:
        corpus = without_spare_copies(corpus, k).reset_index(drop=True)
        order = np.arange(len(corpus))
        c = np.vstack(corpus["vector"].to_numpy())  # as stored; a tile at a time is made double
        return corpus.drop(columns="vector"), c, order

    def step(queries: pd.DataFrame, held: tuple) -> pd.DataFrame:
        corpus, c, order = held
        row, col, distance = _nearest_rows(_matrix(queries["vector"]), c, k, None, order)
        out = {
            "query_id": queries["query_id"].to_numpy()[row],
            "neighbour_id": corpus["neighbour_id"].to_numpy()[col],
            "distance": distance,
        }
        return pd.DataFrame(out | {name: corpus[name].to_numpy()[col] for name in carry})

    return block, step


def _frame(rows: pa.RecordBatch | pa.Table) -> pd.DataFrame:
    return rows.to_pandas(integer_object_nulls=True)  # long ids beside nulls stay whole


def stream_blocks(visits: DataFrame, corpus: DataFrame, block_rows: int, block, step, schema: str, shares: int = 1) -> DataFrame:
    """``step(queries, block(rows))`` for each block of corpus rows and the queries that visit its cell.

    ``visits(query_id, vector, cell)``; a corpus row lies in one block and is moved once, however many queries
    there are, or once for each of ``shares`` into which the queries are dealt where blocks are few. A task holds one
    block, and its visitors come past in batches, ``TILE_ROWS`` at a time. All columns of the rows reach ``block`` as a
    frame, all of the visitors reach ``step``.
    """
    sizes = corpus.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    grid = sizes.join(visits.select("cell").distinct(), "cell")  # one row per visited cell
    asked = [c for c in visits.columns if c != "cell"]
    share = F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int")
    slots = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda part: part * shares + share)
    left = visits.join(grid, "cell").select("cell", F.explode(slots).alias("part"), F.lit(True).alias("asks"), *asked)
    part = F.pmod(F.xxhash64("neighbour_id"), F.col("parts")).cast("int")
    slots = F.sequence(part * shares, part * shares + (shares - 1))
    own = [c for c in corpus.columns if c != "cell"]
    right = corpus.join(grid, "cell").select("cell", F.explode(slots).alias("part"), F.lit(False).alias("asks"), *own)
    both = right.unionByName(left, allowMissingColumns=True).select("cell", "part", "asks", *dict.fromkeys([*asked, *own]))
    both = both.repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            starts = np.flatnonzero(np.r_[True, (marks[:, 1:] != marks[:, :-1]).any(0)]) if batch.num_rows else []
            for first, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if tuple(marks[:2, first]) != key:
                    key, rows, held = tuple(marks[:2, first]), [], None
                some = batch.slice(first, end - first)
                if not marks[2, first]:
                    rows.append(some.select(own))
                    continue
                if held is None and rows:
                    held, rows = block(_frame(pa.Table.from_batches(rows))), []
                for tile in range(0, some.num_rows, TILE_ROWS) if held is not None else ():
                    found = step(_frame(some.slice(tile, TILE_ROWS).select(asked)), held)
                    yield pa.RecordBatch.from_pandas(found, fields, preserve_index=False)

    return both.mapInArrow(run, schema)


def _search(visits: DataFrame, corpus: DataFrame, k: int, carry: list[str], block_rows: int) -> DataFrame:
    """The k nearest per query and block; ``visits(query_id, vector, cell)``, ``corpus(neighbour_id, vector, cell, *carry)``."""
    schema = _hits_schema(visits, corpus, carry)
    rows = corpus.select("neighbour_id", "vector", "cell", *carry)
    return stream_blocks(visits.select("query_id", "vector", "cell"), rows, block_rows, *_top_k_of_block(k, carry), schema)


def _hits_schema(queries: DataFrame, corpus: DataFrame, carry: Sequence[str]) -> str:
    types = {"query_id": queries.schema["query_id"].dataType.simpleString()}
    types |= {"neighbour_id": corpus.schema["neighbour_id"].dataType.simpleString(), "distance": "double"}
    types |= {c: corpus.schema[c].dataType.simpleString() for c in carry}
    return ", ".join(f"`{c}` {t}" for c, t in types.items())


def _keep_k(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def first_of_each(hits: DataFrame, key: str, top_k: int) -> DataFrame:
    """Per query, the closest hit of each key, then the first ``top_k``, ranked again."""
    same = Window.partitionBy("query_id", key).orderBy("rank")
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        hits.withColumn("occurrence", F.row_number().over(same))
        .filter("occurrence = 1")
        .drop("occurrence")
        .withColumn("new_rank", F.row_number().over(order))
        .filter(F.col("new_rank") <= top_k)
        .drop("rank")
        .withColumnRenamed("new_rank", "rank")
    )


class _Share:
    """Queries of a task and the k nearest rows that they have found so far, for ``sweep``.

    ``reach`` of the queries bounds the distance from the start; with ``buckets`` only rows are found that share one.
    """

    def __init__(self, share: pa.Table, k: int, carry: list[str], pivots: np.ndarray, radius: np.ndarray):
        self.ids, self.vectors = share.column("query_id"), share.column("vector")
        self.cells = share.column("cells") if "cells" in share.column_names else one_cell(len(share))
        self.q = _vectors(self.vectors.combine_chunks())
        self.bound = np.full(len(share), np.inf)
        if "reach" in share.column_names:
            self.bound = share.column("reach").to_numpy().copy()
        self.k, self.carry, self.pivots, self.radius = k, carry, pivots, radius
        self.pivot_size = np.linalg.norm(pivots, axis=1).max()
        self.buckets = _lists(share.column("buckets").combine_chunks()) if "buckets" in share.column_names else None
        self.held: pa.Table | None = None
        self.new: list[pa.RecordBatch] = []

    def see(self, cell: int, queries: np.ndarray, rows: pa.RecordBatch) -> None:
        c = unpacked(rows.column("raw"), self.q.shape[1])
        side, theirs = _Side(c, self.pivots[cell]), None if self.buckets is None else _lists(rows.column("buckets"))
        for start in range(0, len(queries), TILE_ROWS):
            some = queries[start : start + TILE_ROWS]
            q = self.q[some]
            # the bound may be nearer by now than when the visits were planned
            away = np.linalg.norm(q - self.pivots[cell], axis=1) - self.radius[cell]
            slack = _REACH_SLACK * (1.0 + np.linalg.norm(q, axis=1) + self.pivot_size)
            some = some[away <= np.sqrt(self.bound[some]) + slack]
            if not len(some):
                continue
            buckets = None if theirs is None else (self.buckets[some], theirs)
            row, col, self.bound[some] = side.near(self.q[some], self.bound[some], self.k, buckets=buckets)
            row = some[row]
            distance = _measured(self.q, c, row, col)
            inside = distance <= self.bound[row]
            row, col, distance = row[inside], col[inside], distance[inside]
            found = [pa.array(row.astype(np.int32)), pa.array(distance)]
            found += [rows.column(name).take(pa.array(col)) for name in ("neighbour_id", *self.carry)]
            self.new.append(pa.record_batch(found, ["row", "distance", "neighbour_id", *self.carry]))
            if sum(len(x) for x in self.new) > max(PAIRS_AT_ONCE, len(self.held or ())):
                self.merge()

    def merge(self) -> pa.Table | None:
        """Only the k nearest of each query stay; equal distances by id."""
        if self.new:
            both = pa.concat_tables([*([self.held] if self.held else []), pa.Table.from_batches(self.new)]).combine_chunks()
            keys = [("row", "ascending"), ("distance", "ascending"), ("neighbour_id", "ascending")]
            both = both.take(pc.sort_indices(both, sort_keys=keys, null_placement="at_start"))
            row, distance = (both.column(name).to_numpy() for name in ("row", "distance"))
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            last = place == self.k - 1
            self.bound[row[last]] = np.minimum(self.bound[row[last]], distance[last])
            self.held, self.new = both.filter(pa.array(place < self.k)), []
        return self.held

    def ranked(self, distinct: tuple[str, int] | None) -> pa.Table:
        """What was found, with ranks; with ``distinct`` as ``first_of_each`` has it."""
        held = self.merge()
        if held is None:
            return pa.table({})
        if distinct:
            key = held.column(distinct[0]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            cells = held.column("row").to_numpy().astype(np.int64) * (int(key.max(initial=0)) + 1) + key
            held = held.take(pa.array(np.sort(np.unique(cells, return_index=True)[1])))
        row = held.column("row").to_numpy()
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left") + 1
        held = held.append_column("query_id", self.ids.take(pa.array(row))).append_column("rank", pa.array(rank.astype(np.int32)))
        return held.filter(pa.array(rank <= distinct[1])) if distinct else held


def _nearest_centres(vectors: np.ndarray, centres: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` nearest centres of each vector, nearest first, and how far they are away."""
    cells, away = [], []
    at_once = max(1, PAIRS_AT_ONCE // max(len(centres), 1))
    for start in range(0, len(vectors), at_once):
        squared = _squared_distances(vectors[start : start + at_once], centres)
        near = np.argsort(squared, axis=1, kind="stable")[:, :n]
        cells.append(near.astype(np.int32))
        away.append(np.sqrt(np.maximum(np.take_along_axis(squared, near, axis=1), 0.0)))
    return np.concatenate(cells), np.concatenate(away)


def _cells_near(vector: str, centres: np.ndarray, n_probe: int) -> Column:
    """``cell, centre_distance`` of the ``n_probe`` nearest centres, as a list: only the vectors pass through Python."""

    @F.arrow_udf("array<struct<cell:int,centre_distance:double>>")
    def probe(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.struct([("cell", pa.int32()), ("centre_distance", pa.float64())])))
        cells, away = _nearest_centres(_vectors(vectors), centres, n_probe)
        pairs = pa.StructArray.from_arrays([pa.array(cells.ravel()), pa.array(away.ravel())], ["cell", "centre_distance"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pairs)

    return probe(vector)


def _to_cells(df: DataFrame, centres: np.ndarray, n_probe: int) -> DataFrame:
    """One row per visited cell: the ``n_probe`` nearest centres, with the distance to the centre.

    No list is empty. Without ``outer`` Spark would find the centres twice, the first time to drop empty lists.
    """
    return df.withColumn("_near", _cells_near("vector", centres, n_probe)).select(*df.columns, F.inline_outer("_near"))


def cells_for(n_rows: int) -> int:
    """Cells of a corpus: they grow with the root of its rows, as does what is kept for each on the driver.

    Ten thousand million rows have 12,500 cells; cells of any size are searched in bounded blocks.
    """
    return 1 + math.isqrt(n_rows) // 8


def _pivots(corpus: DataFrame, n: int) -> np.ndarray:
    """Distinct vectors with the smallest id hashes; any choice gives the same neighbours."""
    rows = (
        corpus.select("vector", F.xxhash64("neighbour_id").alias("h")).orderBy("h").limit(2 * n).select("vector")
    )
    found = rows.toPandas()["vector"]
    if not len(found):
        return np.zeros((0, 0))
    vectors = _matrix(found)
    _, first = np.unique(vectors, axis=0, return_index=True)
    return vectors[np.sort(first)[:n]]


class Cells:
    """A corpus cut into cells around pivots, written once and searched exactly as often as needed.

    ``rows(neighbour_id, vector, ..., cell, centre_distance)`` is a written table; for each cell the driver
    keeps its pivot, its rows and how far the farthest one is away.
    """

    def __init__(self, rows: DataFrame, pivots: np.ndarray, n_in_cell: np.ndarray, radius: np.ndarray):
        self.rows, self.pivots, self.n_in_cell, self.radius = rows, pivots, n_in_cell, radius
        self._blocks: dict[tuple, Blocks] = {}

    @classmethod
    def build(cls, corpus: DataFrame, n_cells: int | None = None, path: str | None = None) -> "Cells":
        """Cuts ``corpus(neighbour_id, vector, ...)``; with ``path`` the cells stay there for ``open``."""
        spark = corpus.sparkSession
        path = path or fresh_path(spark, "cells")
        pivots = _pivots(corpus, n_cells or cells_for(corpus.count()))
        placed = _to_cells(corpus, pivots, 1) if len(pivots) else corpus.selectExpr("*", "0 AS cell", "0D AS centre_distance")
        return cls._write(placed, pivots, path)

    @classmethod
    def _write(cls, placed: DataFrame, pivots: np.ndarray, path: str) -> "Cells":
        spark = placed.sparkSession
        # few files a cell; adaptive execution splits the rows of a large one
        with shuffles_dropped(spark):
            placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        centres = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], "cell int, centre array<double>")
        centres.write.mode("overwrite").parquet(f"{path}/centres")
        return cls.open(spark, path, placed.schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema=None) -> "Cells":
        """Cells that ``build`` left; one folder for each, so those that no query visits are not read."""
        schema = schema or spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").schema
        rows = spark.read.schema(schema).parquet(f"{path}/rows")
        found = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres").collect()
        pivots = np.array([r["centre"] for r in sorted(found, key=lambda r: r["cell"])])
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("centre_distance").alias("radius")).toPandas()
        n_in_cell, radius = np.zeros(len(pivots)), np.full(len(pivots), -np.inf)
        if len(pivots):
            n_in_cell[sizes["cell"]], radius[sizes["cell"]] = sizes["n"], sizes["radius"]
        return cls(rows, pivots, n_in_cell, radius)

    def where(self, conditions: dict | None) -> "Cells":
        """Only rows whose columns equal the given values; the radii stay bounds."""
        if not conditions:
            return self
        rows = where_equal(self.rows, conditions)
        left = rows.groupBy("cell").agg(F.count("*").alias("n")).toPandas()
        n_in_cell = np.zeros(len(self.pivots))
        n_in_cell[left["cell"]] = left["n"]
        return Cells(rows, self.pivots, n_in_cell, self.radius)

    def search(
        self,
        queries: DataFrame,
        k: int,
        carry: Sequence[str] = (),
        block_rows: int = BLOCK_ROWS,
        distinct: tuple[str, int] | None = None,
    ) -> DataFrame:
        """The k nearest rows of every query, as ``knn_exact`` gives them; with ``distinct``, a column of ``carry`` and a
        number, what ``first_of_each`` leaves of them.

        Each query first visits the nearest cells that hold k rows between them; the k-th distance found there
        and the triangle inequality then name the cells that can still hold a nearer row, and only those are
        visited, and only rows within that distance compared.
        """
        carry, spark = list(carry), queries.sparkSession
        queries = queries.select("query_id", "vector")
        n, once = sizes(queries)
        if not self.n_in_cell.any() or not n:  # an empty corpus, or nobody asks
            return spark.createDataFrame([], f"{_hits_schema(queries, self.rows, carry)}, rank int")
        pivots, n_in_cell, radius = self.pivots, self.n_in_cell, self.radius
        pivot_size = np.linalg.norm(pivots, axis=1).max()

        def plan(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distances to all pivots and the cells of the first round."""
            away = np.sqrt(np.maximum(_squared_distances(vectors, pivots), 0.0))
            order = np.argsort(away, axis=1, kind="stable")
            before = np.cumsum(n_in_cell[order], axis=1) - n_in_cell[order]
            first = np.zeros_like(away, dtype=bool)
            np.put_along_axis(first, order, (before < k) & (n_in_cell[order] > 0), axis=1)
            return away, first

        def listed(masks: Iterator[np.ndarray]) -> pa.Array:
            """The cells of each query's mask: a list for each query, not a row for each visit."""
            n_cells, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for mask in masks:
                n_cells.append(mask.sum(1))
                cells.append(np.nonzero(mask)[1].astype(np.int32))
            offsets = np.r_[0, np.concatenate(n_cells).cumsum()].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(cells)))

        def tiles(n: int) -> list[slice]:
            at_once = max(1, PAIRS_AT_ONCE // len(pivots))
            return [slice(start, start + at_once) for start in range(0, n, at_once)]

        def first_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """All cells of the first round."""
            seen = np.zeros(len(pivots), bool)
            for batch in batches:
                for start in range(0, batch.num_rows, TILE_ROWS):
                    q = _vectors(batch.column(0).slice(start, TILE_ROWS))
                    for tile in tiles(len(q)):
                        seen |= plan(q[tile])[1].any(0)
            yield pa.record_batch([pa.array(np.flatnonzero(seen).astype(np.int32))], ["cell"])

        class FirstRound(_Share):
            """The queries with the distance of the k-th row found, and the cells that may hold a row as near."""

            def __init__(self, share: pa.Table):
                super().__init__(share, k, carry, pivots, radius)
                self.cells = listed(plan(self.q[tile])[1] for tile in tiles(len(self.q)))

            def found(self) -> pa.Table:
                held = self.merge()
                n = np.bincount(held.column("row").to_numpy(), minlength=len(self.q)) if held else np.zeros(len(self.q))
                reach = np.where(n >= k, self.bound, np.inf)  # with fewer than k rows found, every cell may hold one more

                def mask(tile: slice) -> np.ndarray:
                    away = plan(self.q[tile])[0]
                    size = np.linalg.norm(self.q[tile], axis=1)[:, None]
                    near = away - radius[None, :] <= np.sqrt(reach[tile, None]) + _REACH_SLACK * (1.0 + size + pivot_size)
                    return near & (n_in_cell > 0)[None, :]

                cells = listed(mask(tile) for tile in tiles(len(self.q)))
                return pa.table({"query_id": self.ids, "vector": self.vectors, "reach": pa.array(reach), "cells": cells})

        key = (k, block_rows, *carry)
        if key not in self._blocks:
            self._blocks[key] = Blocks(self.rows.select("neighbour_id", "vector", "cell", *carry), "vector", k, block_rows)
        blocks, ids = self._blocks[key], queries.schema["query_id"].dataType.simpleString()
        known = f"query_id {ids}, vector {queries.schema['vector'].dataType.simpleString()}, reach double, cells array<int>"
        with rows_per_file(spark, share_rows(spark, n)):
            asked = cut_lineage(queries, "visits")
            blocks.add(r["cell"] for r in asked.select("vector").mapInArrow(first_cells, "cell int").distinct().collect())
            more = cut_lineage(sweep(asked, blocks, FirstRound, known), "visits")
        drop_written(asked)
        blocks.add(visited(more))
        return _nearest(more, blocks, k, carry, pivots, radius, n * n_in_cell.sum(), once, distinct)


def _nearest(
    asked: DataFrame,
    blocks: Blocks,
    k: int,
    carry: list[str],
    pivots: np.ndarray,
    radius: np.ndarray,
    pairs: float,
    once: bool,
    distinct: tuple[str, int] | None = None,
) -> DataFrame:
    """The k nearest rows in the cells of each query, ranked; ``asked`` and ``blocks`` are written.

    ``once`` says that no id is asked twice; lists of one id are merged otherwise.
    """
    names = ["query_id", "neighbour_id", "distance", *carry, "rank"]
    schema = f"{_hits_schema(asked, blocks.rows, carry)}, rank int"
    parts = parts_for(asked.sparkSession, len(asked.inputFiles()), pairs)
    whole = once and parts == 1  # a list is whole where it is made

    class Nearest(_Share):
        def found(self) -> pa.Table | None:
            held = self.ranked(distinct if whole else None)
            return held.select(names) if len(held) else None

    found = sweep(asked, blocks, lambda share: Nearest(share, k, carry, pivots, radius), schema, parts)
    if whole:
        return found
    found = _keep_k(found.drop("rank"), k)
    return first_of_each(found, *distinct).select(*names) if distinct else found


def knn_exact(
    queries: DataFrame,
    corpus: DataFrame | Cells,
    k: int,
    carry: Sequence[str] = (),
    n_cells: int | None = None,
    block_rows: int = BLOCK_ROWS,
    distinct: tuple[str, int] | None = None,
) -> DataFrame:
    """The k nearest corpus rows of every query, ranked from 1; ties go to the smaller id.

    ``queries(query_id, vector)``, ``corpus(neighbour_id, vector, *carry)``; the result has
    ``query_id, neighbour_id, distance, *carry, rank``. A corpus that is searched more than once is given as
    ``Cells``, and is then not cut again.
    """
    if not isinstance(corpus, Cells):
        corpus = Cells.build(corpus.select("neighbour_id", "vector", *carry), n_cells)
    return corpus.search(queries, k, carry, block_rows, distinct)


def _fill_up(found: DataFrame, queries: DataFrame, corpus: DataFrame, k: int, carry: list[str], block_rows: int) -> DataFrame:
    """Queries whose visited cells held fewer than ``k`` rows are asked again, exactly."""
    found = cut_lineage(found, "found")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select("query_id")
    short = cut_lineage(queries.join(full, "query_id", "left_anti"), "short-queries")
    again = knn_exact(short, corpus, k, carry, block_rows=block_rows)
    return found.join(full, "query_id", "left_semi").unionByName(again)


def knn_cells(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    n_cells: int | None = None,
    n_probe: int = 4,
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    sample_rows: int = 100_000,
    seed: int = 7,
) -> DataFrame:
    """Approximate: k-means cells, each query searches its ``n_probe`` nearest cells.

    The centres are fitted on at most ``sample_rows`` rows, those of least hash; every row is indexed. All
    cells probed give the exact neighbours, and so does a query whose cells hold fewer than ``k`` rows.
    """
    from pyspark.ml.clustering import KMeans  # here, so that Python workers need not load it
    from pyspark.ml.functions import array_to_vector

    carry = list(carry)
    queries = queries.select("query_id", "vector")
    corpus = corpus.select("neighbour_id", "vector", *carry)
    sample = corpus.orderBy(F.xxhash64("neighbour_id")).limit(sample_rows)
    points = sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    n_rows = corpus.count()
    n_cells = max(2, n_cells or cells_for(n_rows))
    centres = np.array(KMeans(k=n_cells, seed=seed, maxIter=10).fit(points).clusterCenters())
    (n, once), spark = sizes(queries), queries.sparkSession
    if not n:
        return knn_exact(queries, corpus, k, carry, block_rows=block_rows)
    with rows_per_file(spark, share_rows(spark, n)):
        asked = cut_lineage(queries.withColumn("cells", _cells_near("vector", centres, n_probe)["cell"]), "visits")
    blocks = Blocks(_to_cells(corpus, centres, 1).drop("centre_distance"), "vector", k, block_rows)
    blocks.add(visited(asked))
    pairs = n * n_rows * min(1.0, n_probe / len(centres))
    found = _nearest(asked, blocks, k, carry, centres, np.full(len(centres), np.inf), pairs, once)
    return _fill_up(found, queries, corpus, k, carry, block_rows)


def knn_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    width: float,
    tables: int = 12,
    projections: int = 4,
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    seed: int = 7,
) -> DataFrame:
    """Approximate, for Euclidean distance: random projections with an offset, cut into steps of ``width``.

    Rows meet in a table where all its ``projections`` fall into the same steps; ``width`` is a few times the
    distance of the neighbours looked for. A query that meets fewer than ``k`` rows is asked again, exactly.
    """
    carry = list(carry)
    queries = queries.select("query_id", "vector")
    corpus = corpus.select("neighbour_id", "vector", *carry)

    @F.arrow_udf("array<long>")
    def hash_rows(vectors: pa.Array) -> pa.Array:
        made = [np.zeros(0, np.int64)]
        for start in range(0, len(vectors), TILE_ROWS):
            some = _vectors(vectors.slice(start, TILE_ROWS))
            draw = np.random.default_rng(seed)
            lines = draw.standard_normal((some.shape[1], tables * projections))
            steps = np.floor((some @ lines) / width + draw.random(tables * projections)).astype(np.int64)
            steps = steps.reshape(len(some), tables, projections)
            made.append((steps @ draw.integers(1, 2**40, projections) + np.arange(tables) * (1 << 58)).ravel())
        offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * tables)
        return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(made)))

    def counted(listed: DataFrame, name: str) -> DataFrame:
        return listed.select(F.explode("buckets").alias("cell")).groupBy("cell").agg(F.count("*").alias(name))

    def to_buckets(listed: DataFrame) -> DataFrame:
        """A row for each table."""
        return listed.withColumn("cell", F.explode("buckets")).drop("buckets")

    (n, once), spark = sizes(queries), queries.sparkSession
    n_rows, different = sizes(corpus.select(F.col("neighbour_id").alias("query_id")))
    with rows_per_file(spark, share_rows(spark, n)):  # the buckets are found once and written as lists
        asked = cut_lineage(queries.withColumn("buckets", hash_rows("vector")), "buckets")
    rows = cut_lineage(corpus.withColumn("buckets", hash_rows("vector")), "buckets")
    meetings = counted(asked, "asking").join(counted(rows, "held"), "cell").agg(F.sum(F.col("asking").cast("double") * F.col("held"))).first()[0]
    if (meetings or 0) <= n * n_rows or not different:
        found = _search(to_buckets(asked), to_buckets(rows), k, carry, block_rows)
        # one neighbour may share several buckets with the query
        merged = found.groupBy("query_id", "neighbour_id").agg(
            F.min("distance").alias("distance"), *[F.first(c).alias(c) for c in carry]
        )
        return _fill_up(_keep_k(merged, k), queries, corpus, k, carry, block_rows)
    # buckets are so large that a pair meets more than once: each pair is looked at once, no neighbour having several rows
    blocks = Blocks(rows.withColumn("cell", F.lit(0)), "vector", k, block_rows)
    blocks.add([0])
    middle = np.mean(_matrix(rows.limit(TILE_ROWS).select("vector").toPandas()["vector"]), axis=0)[None]
    found = _nearest(asked, blocks, k, carry, middle, np.full(1, np.inf), n * n_rows, once)
    return _fill_up(found, queries, corpus, k, carry, block_rows)


def recall_at_k(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    return (
        exact.select("query_id", "neighbour_id")
        .join(
            approximate.select("query_id", "neighbour_id", F.lit(1).alias("found")),
            ["query_id", "neighbour_id"],
            "left",
        )
        .agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"), F.count("*").alias("n_pairs"))
    )
