"""A stored corpus of vectors that grows: cells of rows and codes, changed by small segments and published by version.

A segment is a folder of rows, cut into cells, and a list of the ids that it replaces. A version names the cells of
segments that count; it is written last, and readers take the last whole one, so none ever sees half a change.
Files are never changed: an update adds a segment, ``compact`` writes the cells anew that updates have touched most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketlake.operators import codes
from ticketlake.operators.sweep import share_rows
from ticketlake.operators.vector import (
    BLOCK_ROWS,
    TILE_ROWS,
    Cells,
    cells_for,
    digests,
    first_of_each,
    where_equal,
    _cells_near,
    _matrix,
    _nearest_centres,
    _squared_distances,
    _vectors,
)
from ticketlake.session import cut_lineage, drop_folder, drop_written, folders, rows_per_file, shuffles_dropped

SAMPLE_ROWS = 20_000  # rows, those of least hash, on which centres are trained
TRAINING_ROUNDS = 8
PROBES = 200  # rows, those of least hash, whose neighbours are looked up for the recall curve
TARGET = 0.95  # recall that the number of probed cells is chosen for
_MANIFEST = "kind string, cell int, segment int, n long, radius double, batch string, centres int"


def train_centres(sample: np.ndarray, n: int, rounds: int = TRAINING_ROUNDS) -> np.ndarray:
    """Centres of ``n`` cells by k-means from distinct rows of the sample, fewer if there are fewer."""
    centres = np.unique(sample, axis=0)
    centres = centres[np.random.default_rng(7).permutation(len(centres))[:n]]
    for _ in range(rounds if len(centres) else 0):
        nearest = _squared_distances(sample, centres).argmin(1)
        size = np.bincount(nearest, minlength=len(centres))
        total = np.zeros(centres.shape)
        np.add.at(total, nearest, sample)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


class CellStore:
    """One published version of a stored corpus."""

    def __init__(self, spark: SparkSession, path: str, version: int):
        self.spark, self.path, self.version = spark, path, version
        found = spark.read.schema(_MANIFEST).parquet(f"{path}/versions/v={version}").toPandas()
        self.manifest = found
        self.centre_set = int(found.loc[found["kind"] == "centres", "centres"].iloc[0])
        rows = spark.read.schema("cell int, centre array<double>").parquet(f"{path}/centres/set={self.centre_set}").collect()
        self.centres = np.array([r["centre"] for r in sorted(rows, key=lambda r: r["cell"])])
        self._cells: Cells | None = None

    # versions

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> list[int]:
        names = [n for n in folders(spark, f"{path}/versions") if n.startswith("v=")]
        return sorted(int(n[2:]) for n in names if "_SUCCESS" in folders(spark, f"{path}/versions/{n}"))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellStore:
        """The last version that is whole."""
        versions = cls._versions(spark, path)
        if not versions:
            raise ValueError(f"no version in {path}")
        return cls(spark, path, versions[-1])

    def _publish(self, manifest: pd.DataFrame) -> CellStore:
        return self._write_version(self.spark, self.path, self.version + 1, manifest)

    @classmethod
    def _write_version(cls, spark: SparkSession, path: str, version: int, manifest: pd.DataFrame) -> CellStore:
        names = [f.split()[0] for f in _MANIFEST.split(", ")]
        filled = manifest.reindex(columns=names).astype(object)
        rows = filled.where(filled.notna(), None).values.tolist()
        whole = lambda x: None if x is None else int(x)
        typed = [(kind, whole(cell), whole(segment), whole(n), radius, batch, whole(centres)) for kind, cell, segment, n, radius, batch, centres in rows]
        spark.createDataFrame(typed, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/v={version}")
        return cls(spark, path, version)

    # writing

    @classmethod
    def build(
        cls,
        corpus: DataFrame,
        path: str,
        n_cells: int | None = None,
        before_publishing: Callable[[int], None] | None = None,
    ) -> CellStore:
        """From ``corpus(neighbour_id, vector, ...)``, each id once; a store that is there gets a new version of everything.

        The centres are trained on at most ``SAMPLE_ROWS`` rows; every row is stored. ``before_publishing`` is called
        with the version's number, for what belongs to it.
        """
        spark = corpus.sparkSession
        version = max([*cls._versions(spark, path), -1]) + 1
        least = corpus.orderBy(F.xxhash64("neighbour_id"), "neighbour_id").limit(SAMPLE_ROWS).select("vector").toPandas()
        sample = _matrix(least["vector"]) if len(least) else np.zeros((0, 0))
        centres = train_centres(sample, n_cells or cells_for(corpus.count()))
        rows = [(i, c.tolist()) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres/set={version}")
        entries = cls._write_segment(corpus, path, centres, version)
        head = pd.DataFrame([{"kind": "centres", "centres": version}])
        if before_publishing:
            before_publishing(version)
        return cls._write_version(spark, path, version, pd.concat([head, entries], ignore_index=True))

    @staticmethod
    def _write_segment(rows: DataFrame, path: str, centres: np.ndarray, segment: int, batch: str | None = None) -> pd.DataFrame:
        """Rows with their cells and codes, written; the manifest's entries for them."""
        spark = rows.sparkSession
        place = f"{path}/rows/segment={segment}"
        if not len(centres):  # an empty corpus
            codes_ = "0D AS centre_distance", "binary('') AS code", "0D AS step", "0D AS lost", "binary('') AS digest"
            rows.limit(0).selectExpr("*", *codes_).write.mode("overwrite").parquet(f"{place}/cell=0")
            return pd.DataFrame(columns=["kind", "cell", "segment", "n", "radius", "batch"])

        @F.arrow_udf("struct<cell:int,centre_distance:double,code:binary,step:double,lost:double,digest:binary>")
        def code(vectors: pa.Array) -> pa.Array:
            made = []
            for start in range(0, len(vectors), TILE_ROWS):
                some = _vectors(vectors.slice(start, TILE_ROWS))
                cell, away = (found[:, 0] for found in _nearest_centres(some, centres, 1))
                made.append(pd.DataFrame({"cell": cell, "centre_distance": away}))
                made[-1]["code"], made[-1]["step"], made[-1]["lost"] = codes.encode(some, centres, cell)
                made[-1]["digest"] = digests(some)
            fields = [("cell", pa.int32()), ("centre_distance", pa.float64()), ("code", pa.binary()), ("step", pa.float64())]
            fields += [("lost", pa.float64()), ("digest", pa.binary())]
            values = pd.concat(made) if made else pd.DataFrame(columns=[name for name, _ in fields])
            columns = [pa.array(values[name], type_) for name, type_ in fields]
            return pa.StructArray.from_arrays(columns, [name for name, _ in fields])

        # only the vectors pass through Python, so a batch of long documents costs no more than others; a struct,
        # as Spark would call the function once more to find out which lists are empty
        coded = rows.withColumn("_code", code("vector")).select(*rows.columns, "_code.*")
        with shuffles_dropped(spark):
            coded.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(place)
        stored = spark.read.schema(coded.schema).parquet(place)
        sizes = stored.groupBy("cell").agg(F.count("*").alias("n"), F.max("centre_distance").alias("radius")).toPandas()
        return sizes.assign(kind="rows", segment=segment, batch=batch)

    def has(self, batch: str | None) -> bool:
        return batch is not None and bool((self.manifest["batch"] == batch).any())

    def upsert(self, updates: DataFrame, batch: str | None = None) -> CellStore:
        """The next version, with the rows of ``updates`` (the corpus' columns, each id once) in place of those of the same id.

        Only the updates are read and written. A ``batch`` that is in this version already changes nothing.
        """
        if self.has(batch):
            return self
        if not len(self.centres):
            return CellStore.build(updates, self.path)
        segment = self.version + 1
        entries = self._write_segment(updates, self.path, self.centres, segment, batch)
        updates.select("neighbour_id").write.mode("overwrite").parquet(f"{self.path}/dead/segment={segment}")
        dead = pd.DataFrame([{"kind": "dead", "segment": segment, "batch": batch}])
        return self._publish(pd.concat([self.manifest, entries, dead], ignore_index=True))

    def compact(self, share: float = 0.25) -> CellStore:
        """The next version, with the cells written anew of which updates make over ``share``; other files stay as they are."""
        live = self.manifest[self.manifest["kind"] == "rows"]
        parts = live.groupby("cell")["n"].agg(["sum", "first", "size"])
        cells = parts.index[(parts["size"] > 1) & (parts["sum"] - parts["first"] > share * parts["sum"])].tolist()
        if not cells:
            return self
        segment = self.version + 1
        rows = self.rows().filter(F.col("cell").isin([int(c) for c in cells]))
        kept = [c for c in rows.columns if c not in ("cell", "centre_distance", "code", "step", "lost", "digest", "segment")]
        entries = self._write_segment(rows.select(*kept), self.path, self.centres, segment)
        replaced = (self.manifest["kind"] == "rows") & self.manifest["cell"].isin(cells)
        rest = pd.concat([self.manifest[~replaced], entries], ignore_index=True)
        oldest = rest.loc[rest["kind"] == "rows", "segment"].min()
        done = (rest["kind"] == "dead") & (rest["segment"] <= oldest)  # no older row is left that they could replace
        return self._publish(rest[~done])

    def vacuum(self) -> None:
        """Drop versions before this one and cells of segments that it does not name. No reader may be left on them."""
        live = self.manifest[self.manifest["kind"] == "rows"]
        named = {(int(s), int(c)) for s, c in zip(live["segment"], live["cell"], strict=True)}
        dead = {int(s) for s in self.manifest.loc[self.manifest["kind"] == "dead", "segment"]}
        for v in self._versions(self.spark, self.path):
            if v < self.version:
                drop_folder(self.spark, f"{self.path}/versions/v={v}")
        for name in folders(self.spark, f"{self.path}/rows"):
            segment = int(name.removeprefix("segment="))
            for cell in folders(self.spark, f"{self.path}/rows/{name}"):
                if cell.startswith("cell=") and (segment, int(cell[5:])) not in named:
                    drop_folder(self.spark, f"{self.path}/rows/{name}/{cell}")
            if segment not in {s for s, _ in named}:
                drop_folder(self.spark, f"{self.path}/rows/{name}")
        for name in folders(self.spark, f"{self.path}/dead"):
            if int(name.removeprefix("segment=")) not in dead:
                drop_folder(self.spark, f"{self.path}/dead/{name}")

    # reading

    def _in_version(self) -> Column:
        live = self.manifest[self.manifest["kind"] == "rows"]
        named = [
            (F.col("segment") == int(s)) & F.col("cell").isin([int(c) for c in cells])
            for s, cells in live.groupby("segment")["cell"]
        ]
        return reduce(lambda a, b: a | b, named, F.lit(False))

    def rows(self) -> DataFrame:
        """The rows of this version: of the cells that it names, without what later segments replace."""
        stored = self.spark.read.option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        stored = stored.filter(self._in_version())
        replaced = [int(s) for s in self.manifest.loc[self.manifest["kind"] == "dead", "segment"]]
        if not replaced:
            return stored
        dead = self.spark.read.option("basePath", f"{self.path}/dead").parquet(*[f"{self.path}/dead/segment={s}" for s in replaced])
        last = dead.groupBy("neighbour_id").agg(F.max("segment").alias("_dead"))
        return stored.join(last, "neighbour_id", "left").filter("_dead IS NULL OR _dead <= segment").drop("_dead")

    def count(self) -> int:
        return self.rows().count()

    def cells(self) -> Cells:
        """For exact search. Sizes count replaced rows too, radii are bounds."""
        if self._cells:  # so that blocks that a search wrote serve the next one
            return self._cells
        n, radius = np.zeros(len(self.centres)), np.full(len(self.centres), -np.inf)
        live = self.manifest[self.manifest["kind"] == "rows"]
        np.add.at(n, live["cell"].astype(int), live["n"].astype(float))
        np.maximum.at(radius, live["cell"].astype(int), live["radius"].astype(float))
        self._cells = Cells(self.rows().drop("code", "step", "lost", "digest", "segment"), self.centres, n, radius)
        return self._cells

    def recall_curve(self, k: int = 10) -> pd.DataFrame:
        """For each number of probed cells, which share of the true neighbours they hold (``recall``) and of the rows (``rows``).

        ``sure`` is two standard errors below ``recall``, as other queries will not be those that were measured. Measured on ``PROBES`` rows of the corpus, each asked without itself.
        """
        rows = self.rows()
        asked = rows.orderBy(F.xxhash64("neighbour_id"), "neighbour_id").limit(PROBES)
        asked = cut_lineage(asked.select(F.col("neighbour_id").alias("query_id"), "vector"), "probes")
        cells = self.cells()
        named = Cells(cells.rows.withColumn("at", F.col("cell")), cells.pivots, cells.n_in_cell, cells.radius)
        hits = named.search(asked, k + 1, carry=("at",))
        hits = hits.filter("query_id <> neighbour_id").toPandas()
        probes = asked.toPandas().set_index("query_id")["vector"]
        if not len(hits):
            return pd.DataFrame({"n_probe": [1], "recall": [1.0], "sure": [1.0], "rows": [1.0]})
        order = np.argsort(_squared_distances(_matrix(probes), self.centres), axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
        place = pd.Series(np.arange(len(probes)), probes.index)
        at = rank[place[hits["query_id"]].to_numpy(), hits["at"].to_numpy()]
        share = cells.n_in_cell / max(cells.n_in_cell.sum(), 1)
        probed = np.arange(1, len(self.centres) + 1)
        each = pd.DataFrame(at[:, None] < probed[None, :]).groupby(hits["query_id"].to_numpy()).mean()
        recall = each.mean().to_numpy()
        sure = recall - 2 * each.std(ddof=0).to_numpy() / np.sqrt(len(each))
        seen = [np.take(share, order[:, :p]).sum(1).mean() for p in probed]
        return pd.DataFrame({"n_probe": probed, "recall": recall, "sure": sure, "rows": seen})

    def tune(self, k: int = 10, target: float = TARGET) -> int:
        """The least number of probed cells that surely reach ``target``; the curve is kept beside this version."""
        curve = self.recall_curve(k)
        enough = curve.loc[curve["sure"] >= target, "n_probe"]
        n_probe = int(enough.iloc[0]) if len(enough) else int(curve["n_probe"].iloc[-1])
        self.spark.createDataFrame(curve).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/curves/set={self.centre_set}")
        return n_probe

    def n_probe(self, target: float = TARGET) -> int:
        """As ``tune`` found it for these centres."""
        if f"set={self.centre_set}" not in folders(self.spark, f"{self.path}/curves"):
            return self.tune(target=target)
        curve = self.spark.read.parquet(f"{self.path}/curves/set={self.centre_set}").toPandas().sort_values("n_probe")
        enough = curve.loc[curve["sure"] >= target, "n_probe"]
        return int(enough.iloc[0]) if len(enough) else int(curve["n_probe"].iloc[-1])

    def search(
        self,
        queries: DataFrame,
        k: int,
        carry: Sequence[str] = (),
        where: dict | None = None,
        n_probe: int | None = None,
        block_rows: int = BLOCK_ROWS,
        distinct: tuple[str, int] | None = None,
    ) -> DataFrame:
        """The k nearest rows of every query (``query_id, vector``): ``query_id, neighbour_id, distance, *carry, rank``.

        With ``distinct``, a column of ``carry`` and a number, what ``first_of_each`` leaves of them.

        Exact without ``n_probe``. Else a query's nearest ``n_probe`` cells are asked: first the codes, a byte for each number, and then
        the vectors of those few rows that their error bounds leave. The answer is exact for these cells, and a query whose
        cells hold fewer than ``k`` rows has a shorter list.
        """
        if n_probe is None or not len(self.centres):
            return self.cells().where(where).search(queries, k, carry, block_rows, distinct)
        asked = queries.select("query_id", "vector")
        few, rows = self._survivors(asked, k, where, n_probe, block_rows)
        pairs = few.join(rows.select("neighbour_id", "cell", "vector", *carry), ["cell", "neighbour_id"]).drop("cell")
        pairs = pairs.join(asked.withColumnRenamed("vector", "asked"), "query_id")
        nearest = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
        ranked = codes.distances(pairs).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
        hits = ranked.select("query_id", "neighbour_id", "distance", *carry, "rank")
        return first_of_each(hits, *distinct).select(*hits.columns) if distinct else hits

    def _survivors(
        self, asked: DataFrame, k: int, where: dict | None, n_probe: int, block_rows: int = BLOCK_ROWS
    ) -> tuple[DataFrame, DataFrame]:
        """``query_id, neighbour_id, cell`` of the rows whose vectors are needed, by their codes, and the rows asked."""
        near = _cells_near("vector", self.centres, min(n_probe, len(self.centres)))
        n = asked.count()
        with rows_per_file(self.spark, share_rows(self.spark, n)):
            visits = cut_lineage(asked.withColumn("cells", near["cell"]), "visits")  # a list for each query
        rows = where_equal(self.rows(), where)
        pairs = n * self.cells().n_in_cell.sum() * min(n_probe / len(self.centres), 1.0)
        few = cut_lineage(codes.candidates(visits, rows, self.centres, k, pairs, block_rows), "survivors")
        drop_written(visits)
        return few, rows

    def measured(self, queries: DataFrame, k: int, n_probe: int) -> tuple[float, float]:
        """Recall of an approximate search, and the share of all pairs whose vectors it compares."""
        asked = cut_lineage(queries.select("query_id", "vector"), "asked")
        exact = cut_lineage(self.search(asked, k).select("query_id", "neighbour_id"), "exact")  # counted twice
        few, _rows = self._survivors(asked, k, None, n_probe)
        # codes lose no row of the cells that are asked, so the rows found are the true ones among the survivors
        found = exact.join(few.select("query_id", "neighbour_id"), ["query_id", "neighbour_id"], "left_semi").count()
        pairs = asked.count() * self.count()
        return found / max(exact.count(), 1), few.count() / max(pairs, 1)
