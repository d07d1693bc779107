"""A sharded key index: a cuckoo filter and an exact table of reference counts for each shard.

State and changes are rows of one schema. A shard's state is one row with its filter and one row for each live
key; changes are rows that add to a key's count or take from it. Folding changes into a state gives the next
state, so the index can be written, read again, grown and shrunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage, parts_for
from ticketlake.llm.cuckoo import KeyIndex

FILTER, KEY, ADD, REMOVE = range(4)
SCHEMA = "shard long, kind int, key binary, n long, best_id long, best_row long, filter binary"
#: Keys of one shard: with their digests and counts some 100 MB of a Python worker.
KEYS_PER_SHARD = 200_000
_SHARDS_PER_PART = 4
_FLUSH = 100_000
_LEAST = -(2**63)


def changes(keys: DataFrame, kind: int, id_col: str | None = None, row_col: str | None = None) -> DataFrame:
    """Rows of ``key`` (repeats count), combined within each task before anything is shuffled.

    A key that a third of all rows share then costs one row for each task, or for each 100,000 distinct keys
    that a task meets.
    """
    columns = [F.col("key"), *(F.col(c).cast("long") for c in (id_col, row_col) if c)]
    out_schema = _arrow_schema()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def rows() -> pa.RecordBatch:
            n = len(held)
            best = [v[1] if len(v[1]) == 2 else (None, None) for v in held.values()]
            return pa.record_batch(
                [
                    pa.nulls(n, pa.int64()),
                    pa.array([kind] * n, pa.int32()),
                    pa.array(list(held), pa.binary()),
                    pa.array([v[0] for v in held.values()], pa.int64()),
                    pa.array([b[0] for b in best], pa.int64()),
                    pa.array([b[1] for b in best], pa.int64()),
                    pa.nulls(n, pa.binary()),
                ],
                schema=out_schema,
            )

        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            best = [(_LEAST if i is None else i, r) for i, r in zip(*lists[1:], strict=True)] if len(lists) == 3 else None
            for i, key in enumerate(lists[0]):
                v = held.get(key)
                if v is None:
                    held[key] = [1, best[i] if best else ()]
                else:
                    v[0] += 1
                    if best and best[i] > v[1]:
                        v[1] = best[i]
            if len(held) >= _FLUSH:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return keys.select(*columns).mapInArrow(combine, SCHEMA)


def _arrow_schema() -> pa.Schema:
    long, data = pa.int64(), pa.binary()
    kinds = [long, pa.int32(), data, long, long, long, data]
    return pa.schema(list(zip([c.split()[0] for c in SCHEMA.split(", ")], kinds, strict=True)))


def fold(rows: DataFrame, width: int, shards: int) -> DataFrame:
    """The next state from state and change rows, with the shard number set by ``shards``.

    ``width`` is the digest's length in bytes; ``shards`` stays the same for the life of an index. A shard is read as a stream: its filter, its keys, then what is
    added, then what is removed. After a removal ``best_id`` and ``best_row`` may name a row that is gone.
    """
    out_schema = _arrow_schema()

    def end(shard: int, index: KeyIndex) -> Iterator[pa.RecordBatch]:
        items = index.items()
        for at in range(0, len(items), _FLUSH):
            part = items[at : at + _FLUSH]
            n = len(part)
            best = [b if len(b) == 2 else (None, None) for _, _, b in part]
            yield pa.record_batch(
                [
                    pa.array([shard] * n, pa.int64()),
                    pa.array([KEY] * n, pa.int32()),
                    pa.array([k for k, _, _ in part], pa.binary()),
                    pa.array([c for _, c, _ in part], pa.int64()),
                    pa.array([None if b[0] == _LEAST else b[0] for b in best], pa.int64()),
                    pa.array([b[1] for b in best], pa.int64()),
                    pa.nulls(n, pa.binary()),
                ],
                schema=out_schema,
            )
        one = [[shard], [FILTER], [None], [len(items)], [None], [None], [index.filter.dump()]]
        yield pa.record_batch([pa.array(v, f.type) for v, f in zip(one, out_schema, strict=True)], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: int | None = None
        index = KeyIndex(width)
        for batch in batches:
            shards, kinds, keys, counts, ids, rows_, filters = (c.to_pylist() for c in batch.columns)
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and shards[to] == shards[at] and kinds[to] == kinds[at]:
                    to += 1
                if shards[at] != current:
                    if current is not None:
                        yield from end(current, index)
                    current, index = shards[at], KeyIndex(width)
                best = [(_LEAST if i is None else i, -1 if r is None else r) for i, r in zip(ids[at:to], rows_[at:to], strict=True)]
                if kinds[at] == FILTER:
                    index = KeyIndex(width, filters[at])
                elif kinds[at] == KEY:
                    index.restore(keys[at:to], counts[at:to], best)
                elif kinds[at] == ADD:
                    index.add(keys[at:to], counts[at:to], best)
                else:
                    index.remove(keys[at:to], counts[at:to])
                at = to
        if current is not None:
            yield from end(current, index)

    parts = max(1, shards // _SHARDS_PER_PART)
    numbered = rows.withColumn("shard", F.coalesce("shard", F.pmod(F.xxhash64("key"), F.lit(shards))))
    return numbered.repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, SCHEMA)


def shards_for(spark: SparkSession, rows: int) -> int:
    """Shards in proportion to the rows that may hold different keys; a few a partition keep partitions even."""
    return _SHARDS_PER_PART * parts_for(spark, rows, _SHARDS_PER_PART * KEYS_PER_SHARD)


def keys_of(state: DataFrame) -> DataFrame:
    return state.filter(F.col("kind") == KEY)


class ReversibleIndex:
    """Which document holds which keys, and the live keys with their exact counts.

    ``members`` has ``doc_id`` and ``key`` of each document, ``state`` the shards. A change gives a new index and
    writes what it changed below the shared folder; tables of older versions stay until they are removed.
    """

    def __init__(self, members: DataFrame, state: DataFrame, width: int, shards: int):
        self.members, self.state, self.width, self.shards = members, state, width, shards

    @classmethod
    def build(cls, members: DataFrame, width: int) -> ReversibleIndex:
        """From stored rows of ``doc_id`` and ``key``; a document's keys are different ones."""
        shards = shards_for(members.sparkSession, members.count())
        state = cut_lineage(fold(changes(members, ADD), width, shards), "key-index")
        return cls(members.select("doc_id", "key"), state, width, shards)

    def _changed(self, members: DataFrame, keys: DataFrame, kind: int) -> ReversibleIndex:
        rows = self.state.unionByName(changes(keys, kind))
        state = cut_lineage(fold(rows, self.width, self.shards), "key-index")
        return ReversibleIndex(members, state, self.width, self.shards)

    def insert(self, members: DataFrame) -> ReversibleIndex:
        new = cut_lineage(members.select("doc_id", "key"), "key-members")
        return self._changed(self.members.unionByName(new), new, ADD)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> ReversibleIndex:
        """Takes out all documents with these ids; ids that are not there change nothing."""
        ids = ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        rest = cut_lineage(self.members.join(ids, "doc_id", "left_anti"), "key-members")
        return self._changed(rest, self.members.join(ids, "doc_id", "left_semi"), REMOVE)

    def live(self) -> DataFrame:
        """``key`` and ``n``, the count of documents that hold it."""
        return keys_of(self.state).select("key", "n")
