"""Best-fit packing of token sequences by large-item matching on the histogram of their lengths."""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage, parts_for, small_batches, text_of

ROWS_PER_PART = 1_000_000
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def ranks_of(tokenizer_json: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes and ids of a byte-level BPE file of the tokenizers library, whose ids are its ranks, and its added tokens.

    Such files write each byte as a printable character: printable ones as themselves, the others, in order,
    from code point 256 on. Added tokens are not among the ranks: a text is cut where it has one of their strings.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    file = json.loads(tokenizer_json)
    special = {t["content"]: t["id"] for t in file.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ids are not ranks")
    return ranks, special


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` (and ``ids``) of every document's pieces.

    A document is its ids (of the whole text, cut by ``pattern``, an added token's string being that token) and ``end_id``; only longer ones than ``capacity`` are cut, their first piece being
    the shorter one. A null or empty text is one piece of length 1; repeated rows give repeated pieces.
    """
    with open(tokenizer_path, encoding="utf-8") as file:  # a fixed public vocabulary of a few MB
        ranks, special = ranks_of(file.read())
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        for batch in small_batches(batches, 1):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = encoding.encode(text, allowed_special="all") if any(s in text for s in special) else encoding.encode_ordinary(text)
                ids = np.array(found, "<u4").tobytes() + end
                total = len(ids) // 4
                start = 0
                for piece, to in enumerate(range((total - 1) % capacity + 1, total + 1, capacity)):
                    part = ids[4 * start : 4 * to]
                    rows.append((doc_id, piece, start, to - start, zlib.crc32(part)) + (part,) * with_ids)
                    start = to
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(run, schema)


class Run(NamedTuple):
    """``n`` items of one length, in order, ``per_bin`` to a bin, in the bins from ``sequence`` on, from ``offset`` on."""

    length: int
    n: int
    sequence: int
    per_bin: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Where items of each length go; the same plan as item by item, but in runs of equal bins.

    Items above a third of the capacity go first, at most two a bin: the largest one left takes the largest that
    still fits beside it. Smaller ones follow by falling length, each into the fullest bin that has room, and
    into a new bin where none has. Equal bins are one entry (gap, first bin, count), so time and memory depend on
    the number of lengths, of which there are ``capacity`` at most, and not on the number of items.
    """
    left = {length: n for length, n in sorted(histogram.items()) if n}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first bin, count)
    order: list[int] = []  # gaps that have bins, in order
    bins = 0

    def put(gap: int, first: int, count: int) -> None:
        if count and gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    large = [length for length in left if 3 * length > capacity]
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        if at >= 0 and large[at] == a and left[a] == 1:
            at -= 1
        b = large[at] if at >= 0 else 0
        n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        if a == b:
            runs.append(Run(a, 2 * n, bins, 2, 0))
        else:
            runs.append(Run(a, n, bins, 1, 0))
            if b:
                runs.append(Run(b, n, bins, 1, a))
                left[b] -= n
        left[a] -= n * (1 + (a == b))
        put(capacity - a - b, bins, n)
        bins += n
        large = [length for length in large if left[length]]

    for s in [length for length in reversed(left) if 3 * length <= capacity]:
        n = left[s]
        while n:
            at = bisect.bisect_left(order, s)
            if at < len(order):
                gap = order[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first, count = capacity, bins, -(-n // (capacity // s))
                bins += count
            per = gap // s
            full = min(count, n // per)
            if full:
                runs.append(Run(s, full * per, first, per, capacity - gap))
                put(gap - per * s, first, full)
                n -= full * per
            if full < count:
                rest = min(n, per)
                if rest:
                    runs.append(Run(s, rest, first + full, rest, capacity - gap))
                    put(gap - rest * s, first + full, 1)
                    n -= rest
                    full += 1
                put(gap, first + full, count - full)
    return runs


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """``items`` (with a ``length`` from 1 to ``capacity``) and where they go: ``sequence_id`` and ``offset``.

    Items are put in order of length by range partitions, which splits frequent lengths, and numbered there.
    The driver sees a count for each length and for each partition, and makes the plan (see ``plan``); every
    item then finds its run by its number. Rows are written before they are numbered, so a task that runs
    again numbers them alike.
    """
    spark = items.sparkSession
    names = items.columns
    stored = cut_lineage(items, "packing-items")
    keys = ["length", *(c for c, kind in stored.dtypes if c != "length" and kind in ("bigint", "int", "string"))]
    parts = parts_for(spark, stored.count(), ROWS_PER_PART)
    numbered = cut_lineage(
        stored.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
        "packing-order",
    )
    counts = numbered.groupBy("length").count().collect()
    sizes = numbered.groupBy(F.shiftright("_place", _ROW_BITS).alias("part")).count().orderBy("part").collect()
    runs = sorted(plan({r["length"]: r["count"] for r in counts}, capacity))
    table = np.array(runs, np.int64).reshape(-1, len(Run._fields))
    table = table[np.argsort(table[:, 0], kind="stable")]
    begin = np.cumsum(table[:, 1]) - table[:, 1]  # number of a run's first item
    before = dict(zip([r["part"] for r in sizes], np.cumsum([0, *(r["count"] for r in sizes)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column(len(names)).to_numpy()
            part, row = place >> _ROW_BITS, place & ((1 << _ROW_BITS) - 1)
            uniq, inverse = np.unique(part, return_inverse=True)
            number = np.array([before[p] for p in uniq.tolist()])[inverse] + row
            at = np.searchsorted(begin, number, side="right") - 1
            length, _, sequence, per_bin, offset = table[at].T
            k = number - begin[at]
            columns = [*batch.columns[: len(names)], pa.array(sequence + k // per_bin), pa.array(offset + k % per_bin * length)]
            yield pa.record_batch(columns, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in stored.dtypes) + ", sequence_id long, offset long"
    return numbered.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids`` (little-endian 32-bit integers) and ``doc_ids`` of packed pieces with ``ids``.

    A sequence has a bounded length, so its pieces are few.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return (
        packed.groupBy("sequence_id")
        .agg(inside.alias("inside"))
        .select(
            "sequence_id",
            F.expr("aggregate(inside.ids, X'', (a, x) -> concat(a, x))").alias("ids"),
            F.col("inside.doc_id").alias("doc_ids"),
        )
    )
