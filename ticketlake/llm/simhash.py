"""SimHash near-duplicates: pivot distance tables discard pairs of fingerprints, the rest are verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage, parts_for, stored_rows, text_of, with_row
from ticketlake.llm.components import components

SEED = 42
BLOCKS = 8  # bytes of a fingerprint
PIVOTS = 16  # reference fingerprints
ROWS_PER_PART = 1_000_000
_STEP = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits: a bit is set if it is in over half of the hashes of the text's word shingles, repeats included.

    Words are parted by ASCII white space, A-Z count as lower case. A shorter text is one shingle, and a text
    without words has fingerprint 0.
    """
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(parts) - words + 1)
    ends = ends[-n:] - 1
    take = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        spans = zip(starts[at : min(at + _STEP, n)].tolist(), ends[at : at + _STEP].tolist(), strict=True)
        hashes = np.array([take(line[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """``doc_id``, ``row`` and ``fp`` (the fingerprint's bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(t.as_buffer().to_pybytes(), words) for t in batch.column(2)]
            fp = pa.array(np.array(bits, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), fp], ["doc_id", "row", "fp"])

    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    columns = [F.col(id_col).cast("long"), row, text_of(text_col).cast("binary")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, row long, fp long")


class PivotTable:
    """Hamming distances of fingerprints to reference fingerprints, whole and byte by byte.

    The distances to all references differ by at most d where two fingerprints differ in at most d bits; so
    do the distances within a byte, and they are equal where the byte is equal.
    """

    def __init__(self, pivots: int = PIVOTS, seed: int = 7):
        references = np.random.default_rng(seed).integers(0, 256, (pivots, BLOCKS), np.uint8)
        values = np.arange(256, dtype=np.uint8)
        # of each byte, its value and each reference: 0 to 8
        self.by_byte = np.bitwise_count(values[None, :, None] ^ references.T[:, None, :]).astype(np.uint8)

    def _bytes(self, fp: np.ndarray) -> np.ndarray:
        return fp.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)

    def distances(self, fp: np.ndarray) -> np.ndarray:
        """A row of distances to the references for each fingerprint."""
        return self.by_byte[np.arange(BLOCKS), self._bytes(fp)].sum(1, dtype=np.int8)

    def keys(self, fp: np.ndarray, max_bits: int) -> np.ndarray:
        """Fingerprints within ``max_bits`` share a key: their distances agree in all but so many bytes.

        A column for each choice of bytes; a key is a hash of the choice and of the distances in its bytes.
        """
        weights = np.random.default_rng(11).integers(1, 2**63, (BLOCKS, self.by_byte.shape[2]), np.uint64) | np.uint64(1)
        codes = (self.by_byte.astype(np.uint64) * weights[:, None, :]).sum(2, dtype=np.uint64)  # of a byte's distances
        codes = (codes ^ (codes >> np.uint64(29))) * _MIX
        own = codes[np.arange(BLOCKS), self._bytes(fp)]
        choices = list(combinations(range(BLOCKS), BLOCKS - max_bits))
        return np.stack([own[:, c].sum(1, dtype=np.uint64) * _MIX + np.uint64(i) for i, c in enumerate(choices)], 1)


def links(fp: np.ndarray, table: PivotTable, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs among different fingerprints of one bucket.

    Ordered by their distance to the first reference, each is held against the next ones only while that
    distance is near enough; the largest difference to any reference then discards most, and the bits of the
    survivors are compared.
    """
    far = table.distances(fp)
    order = np.argsort(far[:, 0], kind="stable")
    fp, far = fp[order], far[order]
    upto = np.searchsorted(far[:, 0], far[:, 0] + max_bits, side="right")
    found = []
    step = max(1, 4_000_000 // len(fp))
    for at in range(0, len(fp), step):
        to = min(at + step, len(fp))
        a, b = slice(at, to), slice(at, int(upto[to - 1]))
        near = np.arange(b.start, b.stop)[None, :] > np.arange(at, to)[:, None]
        for p in range(far.shape[1]):
            near &= np.abs(far[b, p][None, :] - far[a, p][:, None]) <= max_bits
        i, j = np.nonzero(near)
        i, j = i + at, j + at
        same = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
        found.append((order[i[same]], order[j[same]]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of ``n`` places is linked with."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            return root


def fingerprint_links(classes: DataFrame, max_bits: int = 2, rows: int | None = None) -> DataFrame:
    """Links ``a``, ``b`` that connect all different ``fp`` of ``classes`` within ``max_bits`` bits.

    Not all pairs: within a bucket, each fingerprint is linked to the least one that it hangs together with.
    A bucket's fingerprints differ in ``max_bits`` bytes only, so it has at most 256 ** max_bits of them,
    however many rows there are; buckets are read one after the other from sorted partitions.
    """
    table = PivotTable()
    rows = classes.count() if rows is None else rows
    n_keys = len(list(combinations(range(BLOCKS), max_bits)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            keys = table.keys(fp.view(np.uint64), max_bits)
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(fp.repeat(n_keys))], ["key", "fp"])

    def bucket_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp = np.sort(fp.view(np.uint64))
        root = _roots(len(fp), *links(fp, table, max_bits))
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return fp[moved].view(np.int64), fp[root[moved]].view(np.int64)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_rest, fp_rest = np.array([], np.int64), np.array([], np.int64)

        def done(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            found = []
            two = first[size == 2]  # most buckets with company
            a, b = fp[two], fp[two + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits
            far = table.distances(np.r_[a, b].view(np.uint64))
            near &= np.abs(far[: len(a)] - far[len(a) :]).max(1, initial=0) <= max_bits
            found.append((a[near], b[near]))
            found += [bucket_links(fp[f : f + s]) for f, s in zip(first[size > 2], size[size > 2], strict=True)]
            columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            return pa.record_batch(columns, ["a", "b"])

        for batch in batches:
            key = np.concatenate([key_rest, batch.column(0).to_numpy()])
            fp = np.concatenate([fp_rest, batch.column(1).to_numpy()])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if last:
                yield done(key[:last], fp[:last])
            key_rest, fp_rest = key[last:], fp[last:]
        if len(key_rest):
            yield done(key_rest, fp_rest)

    parts = parts_for(classes.sparkSession, rows * n_keys, ROWS_PER_PART)
    return (
        classes.select("fp")
        .mapInArrow(spread, "key long, fp long")
        .repartition(parts, "key")
        .sortWithinPartitions("key")
        .mapInArrow(link, "a long, b long")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    words: int = 3,
    max_bits: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``row``, ``fp``, ``component_id`` and ``kept``.

    Fingerprints (see ``fingerprint``) within ``max_bits`` bits are linked; a component is all that hangs
    together, ``component_id`` its smallest ``doc_id`` and ``kept`` marks the first row with it. A null text is
    an empty one; a null ``doc_id`` comes after all others, so a component of such rows only has a null id.
    Rows of one fingerprint are one class from the start, however many they are. ``row`` is ``row_col``, or else
    a number given here; other columns are not read.
    """
    numbered, row = (docs, row_col) if row_col else with_row(docs)
    rows = cut_lineage(fingerprints(numbered, words, id_col, text_col, row), "simhash-rows")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row"))
    classes = cut_lineage(rows.groupBy("fp").agg(first.alias("first")), "simhash-classes")
    star = components(fingerprint_links(classes, max_bits))
    member = star.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    member = member.unionByName(star.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
    least = member.join(classes, "fp").groupBy("root").agg(F.min("first").alias("least"))
    labels = classes.join(member.join(least, "root"), "fp", "left").select(
        "fp", F.coalesce("least", "first").alias("least")
    )
    return rows.join(labels, "fp").select(
        "doc_id",
        "row",
        "fp",
        F.col("least.doc_id").alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("kept"),
    )


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    numbered, row = stored_rows(docs)
    kept = near_duplicates(numbered, words, max_bits, row_col=row).filter("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
