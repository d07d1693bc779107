"""Queries held in tasks while a corpus streams past them, both read from the files of written tables.

A task holds a share of the queries and what they have found so far; blocks of the corpus come past, only those of cells that
one of its queries visits. A list is whole where it is made: neither queries, corpus rows nor what is found are
shuffled, so a search takes no more disk than the tables it reads. These lie below the shared folder, which the tasks
reach through ``pyarrow.fs`` (a shared mount, ``s3://``, ``hdfs://``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ticketlake.session import cut_lineage, drop_folder, fresh_path, rows_per_file, shuffles_dropped

SHARE_ROWS = 4096  # queries that a task holds at a time
LEAST_SHARE = 512  # and no fewer, where tasks are few
READ_ROWS = 2048  # corpus rows read at a time
DOCUMENTS_READ = 8192  # and documents
PAIRS_OF_A_TASK = 1 << 27  # a share with more pairs is asked by several tasks, where tasks are few
ROWS_OUT = 8192  # rows given back at a time


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and path[5:7] != "//" else path)


def share_rows(spark: SparkSession, n: int) -> int:
    """Queries of a share: enough shares for the cluster, but no share so small that reading the corpus costs most."""
    wanted = 4 * spark.sparkContext.defaultParallelism
    return min(max(-(-n // wanted), LEAST_SHARE), SHARE_ROWS)


def parts_for(spark: SparkSession, n_shares: int, pairs: float) -> int:
    """Into how many parts the corpus is dealt for each share, where shares are few and pairs are many."""
    wanted = 4 * spark.sparkContext.defaultParallelism
    return int(max(1, min(wanted // max(n_shares, 1), pairs // PAIRS_OF_A_TASK)))


def one_length(column: pa.Array) -> None:
    if column.null_count or pc.count_distinct(column.value_lengths()).as_py() > 1:
        raise ValueError("a vector is null or vectors differ in length")


def packed(vectors: pa.Array) -> pa.Array:
    """Vectors as the bytes of their numbers, which are read without a copy."""
    one_length(vectors)
    numbers = np.ascontiguousarray(vectors.flatten().to_numpy(zero_copy_only=False))
    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * (numbers.nbytes // max(len(vectors), 1))
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(numbers)])


def unpacked(raw: pa.Array, dim: int) -> np.ndarray:
    """The rows of a matrix as ``packed`` left them."""
    data = b"".join(raw.to_pylist())
    return np.frombuffer(data, np.float32 if len(data) == 4 * dim * len(raw) else np.float64).reshape(len(raw), dim)


class Blocks:
    """Corpus rows as the sweep reads them: a folder for each cell, files of bounded rows, at most ``k`` copies of a vector from a task.

    ``rows(neighbour_id, cell, ...)``; ``same`` is equal for copies, ``vector`` or another column, which is not kept. A ``vector``
    is kept as ``raw`` bytes. Cells are written when they are first asked for.
    """

    def __init__(self, rows: DataFrame, same: str, k: int, block_rows: int):
        self.rows, self.same, self.k, self.block_rows = rows, same, k, block_rows
        self.folder_of: dict[int, str] = {}

    def add(self, cells: Iterable[int]) -> None:
        new = sorted(set(cells) - set(self.folder_of))
        if not new:
            return
        spark, path, k, same = self.rows.sparkSession, fresh_path(self.rows.sparkSession, "blocks"), self.k, self.same
        rows = self.rows.filter(F.col("cell").isin(new)).sortWithinPartitions("cell", F.xxhash64(same), "neighbour_id")

        def without_spare_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """At most ``k`` rows of one vector, those with the smallest ids: more copies never make a list of ``k``."""
            last, seen = None, 0
            for batch in batches:
                for start in range(0, batch.num_rows, READ_ROWS):
                    some = batch.slice(start, READ_ROWS)
                    column = packed(some.column(same)) if same == "vector" else some.column(same)
                    code = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                    at = np.arange(len(code)) - np.repeat(begin, np.diff(np.r_[begin, len(code)]))
                    if column[0].as_py() == last:
                        at[: begin[1] if len(begin) > 1 else len(code)] += seen
                    last, seen = column[-1].as_py(), int(at[-1]) + 1
                    some = some.drop_columns([same])
                    yield (some.append_column("raw", column) if same == "vector" else some).filter(pa.array(at < k))

        kept = rows.drop(same).schema
        thin = rows.mapInArrow(without_spare_copies, kept.add("raw", "binary") if same == "vector" else kept)
        with rows_per_file(spark, self.block_rows), shuffles_dropped(spark):
            thin.write.partitionBy("cell").parquet(path)
        self.folder_of |= dict.fromkeys(new, path)


class Documents:
    """Rows that stream past all queries, written once more; ``drop`` takes them away."""

    def __init__(self, rows: DataFrame):
        self.spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "documents")
        self.folder_of = {0: path}
        with rows_per_file(self.spark, DOCUMENTS_READ), shuffles_dropped(self.spark):
            rows.write.parquet(f"{path}/cell=0")

    def drop(self) -> None:
        drop_folder(self.spark, self.folder_of[0])


def sizes(queries: DataFrame) -> tuple[int, bool]:
    """How many there are, and whether each id comes once."""
    found = queries.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    return found["n"] or 0, found["most"] == 1


def with_candidates(pairs: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """``queries`` with the list ``ids`` of their candidates, written for a ``sweep`` of ``Documents``.

    ``n`` is how many queries there are. Neither texts nor terms of the documents are dealt out with the pairs.
    """
    ids = pairs.filter("ticket_id IS NOT NULL").groupBy("query_id").agg(F.collect_list("ticket_id").alias("ids"))
    asked = queries.join(ids, "query_id")
    with rows_per_file(queries.sparkSession, share_rows(queries.sparkSession, n)):
        return cut_lineage(asked, "candidate-lists")


def one_cell(n: int) -> pa.ListArray:
    """Lists by which ``n`` queries visit the cell 0, where there is no other."""
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(np.zeros(n, np.int32)))


class Candidates:
    """The candidates of a share: ``tickets``, each once, and the pairs ``row, ticket`` in the order of ``ticket``."""

    def __init__(self, share: pa.Table):
        lists = share.column("ids").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        ticket = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(ticket, kind="stable")
        self.tickets, self.row, self.ticket = coded.dictionary, row[order], ticket[order]
        self.cells = one_cell(len(lists))

    def met(self, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For documents the pairs they are in: number of the document and of the pair."""
        found = pc.index_in(ids, value_set=self.tickets, skip_nulls=True)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        ticket = found.take(pa.array(at)).to_numpy(zero_copy_only=False)
        first, end = np.searchsorted(self.ticket, ticket), np.searchsorted(self.ticket, ticket, side="right")
        n = end - first
        pair = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(first, n)
        return np.repeat(at, n), pair


def cell_files(folder_of: dict[int, str]) -> Callable[[int], list[str]]:
    """The files of a cell, looked up once in a task."""
    found: dict[int, list[str]] = {}

    def files(cell: int) -> list[str]:
        if cell not in found:
            store, folder = place(folder_of[cell])
            listed = store.get_file_info(fs.FileSelector(f"{folder}/cell={cell}", allow_not_found=True))
            found[cell] = sorted(x.path for x in listed if x.path.endswith(".parquet"))
        return found[cell]

    return files


def read(store: fs.FileSystem, path: str, rows: int) -> Iterator[pa.RecordBatch]:
    with store.open_input_file(path) as file:
        yield from pq.ParquetFile(file).iter_batches(rows, use_threads=False)


def by_cell(cells: pa.ListArray) -> Iterator[tuple[int, np.ndarray]]:
    """Each cell in the lists of the queries, and which queries visit it."""
    if isinstance(cells, pa.ChunkedArray):
        cells = cells.combine_chunks()
    flat = cells.flatten().to_numpy(zero_copy_only=False)
    if not len(flat):
        return
    row = np.repeat(np.arange(len(cells), dtype=np.int32), cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    for first, end in zip(starts, [*starts[1:], len(flat)], strict=True):
        yield int(flat[first]), row[first:end]


def visited(asked: DataFrame) -> list[int]:
    """The cells in the lists of the queries."""
    return [r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]


def sweep(
    asked: DataFrame,
    blocks: Blocks | Documents,
    hold: Callable[[pa.Table], object],
    schema: str,
    parts: int = 1,
    read_rows: int = READ_ROWS,
) -> DataFrame:
    """What the shares find, as ``hold`` gives it.

    ``asked`` is a written table; a file is a share. ``hold(share)`` has ``cells``, a list for each query, ``see(cell, queries, rows)``,
    for each run of rows of a cell and the numbers of the queries that visit it, and ``found()``. With ``parts`` each
    of so many tasks sees its part of the blocks.
    """
    spark, files, folder_of = asked.sparkSession, sorted(asked.inputFiles()), blocks.folder_of
    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_of = cell_files(folder_of)
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                store, path = place(files[unit // parts])
                with store.open_input_file(path) as file:
                    share = pq.ParquetFile(file).read(use_threads=False)
                if not len(share):
                    continue
                held, n = hold(share), 0
                for cell, queries in by_cell(held.cells):
                    for block in blocks_of(cell):
                        n += 1
                        if n % parts == unit % parts:
                            for rows in read(store, block, read_rows):
                                held.see(cell, queries, rows)
                found = held.found()
                for start in range(0, len(found or ()), ROWS_OUT):
                    some = found.slice(start, ROWS_OUT).combine_chunks()
                    for out in some.cast(fields).to_batches():
                        yield out

    n = len(files) * parts
    return spark.range(0, n, 1, max(1, min(n, 10_000))).mapInArrow(run, schema)
