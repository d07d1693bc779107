"""The vector index: records of id, embedding, document and metadata, searched by text, and their upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.functions.domain import metadata_text
from ticketlake.functions.text import default_when_empty, strip
from ticketlake.operators.features import VECTOR_DIM, HashedTfidf
from ticketlake.operators.rerank import Postings
from ticketlake.schema import METADATA_FIELDS, QUERY_PREFIX
from ticketlake.session import cut_lineage, drop_folder, drop_written, folders
from ticketlake.sources.cellstore import CellStore


def to_records(df: DataFrame) -> DataFrame:
    """Index records of tickets with a ``vector``."""
    return df.select(
        F.col("ticket_id").alias("id"),
        F.col("vector").cast("array<float>").alias("embedding"),
        F.col("description").alias("document"),
        *[metadata_text(f).alias(f) for f in METADATA_FIELDS],
    )


def build_index(df: DataFrame, path: str) -> None:
    """Write the records, replacing an index that is already there."""
    to_records(df).write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class VectorIndex:
    """A stored index that is asked with texts: records in a store of cells, and the encoder that made their vectors.

    ``search`` and ``upsert`` work on the version that was opened; each change gives the next one.
    """

    def __init__(self, store: CellStore, encoder: HashedTfidf, path: str):
        self.store, self.encoder, self.path = store, encoder, path

    @property
    def postings(self) -> Postings:
        """Terms of the resolutions, for reranking: ``postings.score``."""
        return Postings(self.store.spark, f"{self.path}/postings", self.store.centre_set, self.store.version)

    @classmethod
    def build(cls, df: DataFrame, path: str, dim: int = VECTOR_DIM) -> VectorIndex:
        """From tickets, a written table; an index that is already there gets a new version of everything."""
        encoder = HashedTfidf.fit(df, "ticket_id", "description", dim)
        records = cut_lineage(cls._records(df, encoder), "records")

        def rest(version: int) -> None:
            encoder.frequencies.write.mode("overwrite").parquet(f"{path}/encoder/set={version}")
            documents = records.select(F.col("neighbour_id").alias("ticket_id"), "resolution")
            Postings(df.sparkSession, f"{path}/postings", version, version - 1).add(documents, "resolution", version)

        store = CellStore.build(records, f"{path}/cells", before_publishing=rest)
        drop_written(records)
        return cls(store, encoder, path)

    @staticmethod
    def _records(df: DataFrame, encoder: HashedTfidf) -> DataFrame:
        """Records with what searches carry: the digest of the resolution, and ``topic``, the sub-category or else the category."""
        records = to_records(df.withColumn("vector", encoder.column("description")))
        topic = default_when_empty("sub_category", "category")
        records = records.withColumns({"resolution_key": F.sha2(strip("resolution"), 256), "topic": topic})
        return records.withColumnsRenamed({"id": "neighbour_id", "embedding": "vector"})

    def upsert(self, df: DataFrame, batch: str | None = None) -> VectorIndex:
        """The next version, with new and changed tickets, each once: whole records, encoded as the others were.

        The records that are there are neither read nor written. A ``batch`` that is taken in already changes nothing.
        """
        if self.store.has(batch):
            return self
        records = cut_lineage(self._records(df, self.encoder), "records")
        documents = records.select(F.col("neighbour_id").alias("ticket_id"), "resolution")
        self.postings.add(documents, "resolution", self.store.version + 1)  # counts once the version is there
        store = self.store.upsert(records, batch)
        drop_written(records)
        return VectorIndex(store, self.encoder, self.path)

    def compact(self, share: float = 0.25) -> VectorIndex:
        """The next version, with the cells written anew that updates have touched most."""
        return VectorIndex(self.store.compact(share), self.encoder, self.path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, dim: int = VECTOR_DIM) -> VectorIndex:
        """The last version."""
        store = CellStore.open(spark, f"{path}/cells")
        return cls(store, HashedTfidf(spark.read.parquet(f"{path}/encoder/set={store.centre_set}"), dim), path)

    def encode(self, queries: DataFrame, prefix: str = QUERY_PREFIX) -> DataFrame:
        """``queries`` with the ``vector`` of each ``query``, which gets the prefix that records do not have.

        Searches write the vectors with what the queries visit; texts are not written once more.
        """
        asked = queries.withColumn("_asked", F.concat(F.lit(prefix), "query"))
        return asked.withColumn("vector", self.encoder.column("_asked").cast("array<float>")).drop("_asked")

    def search(
        self,
        queries: DataFrame,
        top_k: int = 5,
        where: dict | None = None,
        fields: tuple[str, ...] = ("subject",),
        approximate: bool = False,
    ) -> DataFrame:
        """The nearest records of each ``query`` (``query_id, query``): ``query_id, ticket_id, distance, *fields, rank``.

        ``where`` holds metadata values that records must equal. ``approximate`` asks as many cells as the measured
        recall curve calls for, codes first; else all that may hold a nearer record.
        """
        n_probe = self.store.n_probe() if approximate else None
        hits = self.store.search(self.encode(queries.select("query_id", "query")), top_k, fields, where, n_probe)
        return hits.withColumnRenamed("neighbour_id", "ticket_id")


def latest_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that comes last in ``order``.

    ``max_by`` combines on the map side, so an id updated very often costs one row per task.
    """
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(key, "row.*")


def upsert(index: DataFrame, updates: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Old and new rows by key, the highest version winning."""
    return latest_rows(index.unionByName(updates), key, version)


class UpsertLog:
    """Updates appended as one folder per batch, merged when read and by ``compact``.

    Writing a batch again replaces its folder, so a retried batch changes nothing. ``base=k`` holds everything up
    to batch k; older folders no longer count, and ``compact`` drops them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path, key

    def write(self, updates: DataFrame, batch_id: int) -> None:
        updates.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _numbers(self, kind: str) -> list[int]:
        names = folders(self.spark, self.path)
        return sorted(int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}="))

    def _live(self) -> tuple[int, list[int]]:
        """The last base that is whole, or -1, and the batches after it."""
        whole = [k for k in self._numbers("base") if "_SUCCESS" in folders(self.spark, f"{self.path}/base={k}")]
        base = max(whole, default=-1)
        return base, [k for k in self._numbers("batch") if k > base]

    def read(self) -> DataFrame:
        """The last row of each key; within a batch the highest version wins."""
        base, batches = self._live()
        parts = [("base", base)] * (base >= 0) + [("batch", k) for k in batches]
        if not parts:
            raise ValueError(f"no batches in {self.path}")
        rows = None
        for kind, k in parts:
            part = self.spark.read.parquet(f"{self.path}/{kind}={k}").withColumn("_batch", F.lit(k))
            rows = part if rows is None else rows.unionByName(part)
        return latest_rows(rows, self.key, "_batch", "version").drop("_batch")

    def compact(self) -> str:
        """Merge all batches into a new base, drop what it replaces and return its path. One writer at a time."""
        base, batches = self._live()
        if not batches:
            return f"{self.path}/base={base}"
        old = [("base", k) for k in self._numbers("base")] + [("batch", k) for k in batches]
        self.read().write.mode("overwrite").parquet(f"{self.path}/base={batches[-1]}")
        for kind, k in old:
            if (kind, k) != ("base", batches[-1]):
                drop_folder(self.spark, f"{self.path}/{kind}={k}")
        return f"{self.path}/base={batches[-1]}"
