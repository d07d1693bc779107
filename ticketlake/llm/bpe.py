"""Byte-level BPE: every text is cut by the tokenizer's pattern, each distinct match is merged in numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.common import small_batches, text_of

_NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WAYS = 4
#: A space between two characters that no white space touches always starts a new match.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACE_BEHIND, _SPACE_BEFORE = re.compile(r" \s"), re.compile(r" (?<=\s )")
#: Longer matches are merged one by one with a heap; each round of a matrix costs its whole length.
LONG_MATCH = 256
#: Cells of one matrix, and matches that one cache holds before it starts anew.
MATRIX_CELLS = 1_000_000
CACHE = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a ``.tiktoken`` file in the order of their ranks, which are their ids.

    The file is a fixed public vocabulary of a few MB, read where the job starts and sent with its tasks.
    """
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks have gaps")
    return [token for _, token in pairs]


class PairTable:
    """Rank of the token that two neighbouring tokens make: a hash table of four slots a bucket."""

    def __init__(self, tokens: list[bytes]):
        ids = {t: i for i, t in enumerate(tokens)}
        found = [
            (ids[t[:cut]] << 32 | ids[t[cut:]], rank)
            for rank, t in enumerate(tokens)
            for cut in range(1, len(t))
            if t[:cut] in ids and t[cut:] in ids
        ]
        keys = np.array([k for k, _ in found], np.uint64)
        ranks = np.array([r for _, r in found], np.int32)
        self.bits = max(4, int(len(keys)).bit_length())
        while True:
            at = self._bucket(keys)
            order = np.argsort(at, kind="stable")
            first = np.r_[True, at[order][1:] != at[order][:-1]]
            slot = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            if slot.max(initial=0) < _WAYS:
                break
            self.bits += 1
        self.keys = np.full((1 << self.bits, _WAYS), np.uint64(2**64 - 1))
        self.ranks = np.full((1 << self.bits, _WAYS), _NONE, np.int32)
        self.keys[at[order], slot], self.ranks[at[order], slot] = keys[order], ranks[order]

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; the largest int where no token is made, as with padding (-1)."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._bucket(keys)
        out = np.full(keys.shape, _NONE, np.int32)
        for way in range(_WAYS):
            hit = self.keys[at, way] == keys
            out[hit] = self.ranks[at[hit], way]
        return out


def _cut(text: str) -> list[str]:
    """Chunks that the pattern treats alike wherever they stand; all but the first have lost the space before them."""
    if text[:1] == " " or text[-1:] == " " or _SPACE_BEHIND.search(text) or _SPACE_BEFORE.search(text):
        return _CUT.split(text)
    return text.split(" ")


class Codec:
    """Encodes and decodes by ranks; the same ids as the tiktoken library's ``encode_ordinary``.

    Each distinct chunk is encoded once; a cache of ``CACHE`` chunks bounds the memory.
    """

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(tokens)
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.first: dict[str, bytes] = {}  # ids of a text's first chunk
        self.after: dict[str, bytes] = {}  # ids of a chunk behind a space, the space included

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        cut = [_cut(t) for t in texts]
        if len(self.first) + len(self.after) > CACHE:
            self.first, self.after = {}, {}
        firsts = {c[0] for c in cut}.difference(self.first)
        afters = set().union(*(c[1:] for c in cut)).difference(self.after)
        ids = self._chunks([*firsts, *(" " + a for a in afters)])
        self.first.update(zip(firsts, ids, strict=False))
        self.after.update(zip(afters, ids[len(firsts) :], strict=True))
        after = self.after.__getitem__
        return [self.first[c[0]] + b"".join(map(after, c[1:])) for c in cut]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks: of their matches, one after the other."""
        findall = self.pattern.findall
        matches = [(c,) if (w := c[1:] or c).isascii() and w.isalpha() and c[0] != "'" else findall(c) for c in chunks]
        ids = self.merge({m for ms in matches for m in ms})
        return [ids[ms[0]] if len(ms) == 1 else b"".join([ids[m] for m in ms]) for ms in matches]

    def merge(self, matches: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct matches. Matches of like length share a matrix; padding never merges."""
        out: dict[str, bytes] = {}
        buckets: dict[int, list[str]] = {}
        for m in matches:
            size = len(m) if m.isascii() else len(m.encode())
            if size > LONG_MATCH:
                out[m] = np.array(self._merge_long(m.encode()), "<u4").tobytes()
            else:
                buckets.setdefault((size + 3) // 4, []).append(m)
        for quarter, rows in buckets.items():
            width = 4 * quarter
            step = max(1, MATRIX_CELLS // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                raw = [m.encode() for m in part]
                cells = np.array(raw, f"S{width}").view(np.uint8).reshape(-1, width)
                ids = self.byte_ids[cells]
                ids[np.arange(width) >= np.fromiter(map(len, raw), np.int64, len(raw))[:, None]] = -1
                out.update(zip(part, self._merge_matrix(ids), strict=True))
        return out

    def _merge_matrix(self, ids: np.ndarray) -> list[bytes]:
        """Each round every row merges its leftmost pair of least rank; rows without a pair leave the matrix."""
        out: list[bytes] = [b""] * len(ids)
        row = np.arange(len(ids))
        ranks = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while len(ids):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            least = ranks[np.arange(len(ids)), at] if ranks.shape[1] else np.full(len(ids), _NONE)
            done = least == _NONE
            if done.any():
                raw, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                ends = 4 * (ids[done] >= 0).sum(1) + np.arange(done.sum()) * step
                for i, (r, end) in enumerate(zip(row[done].tolist(), ends.tolist(), strict=True)):
                    out[r] = raw[i * step : end]
                keep = ~done
                ids, ranks, row, at, least = ids[keep], ranks[keep], row[keep], at[keep], least[keep]
                if not len(ids):
                    break
                width = max(2, int((ids >= 0).sum(1).max()))  # drop columns that only hold padding
                ids, ranks = ids[:, :width], ranks[:, : width - 1]
            n = np.arange(len(ids))
            ids[n, at] = least
            # the columns right of the merged pair move one to the left
            moved = np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1, np.int32)], 1)
            ids = np.where(np.arange(ids.shape[1]) > at[:, None], moved, ids)
            moved = np.concatenate([ranks[:, 1:], np.full((len(ids), 1), _NONE, np.int32)], 1)
            ranks = np.where(np.arange(ranks.shape[1]) > at[:, None], moved, ranks)
            right = at + 1 < ids.shape[1]
            ranks[n[right], at[right]] = self.pairs.rank(ids[n[right], at[right]], ids[n[right], at[right] + 1])
            left = at > 0
            ranks[n[left], at[left] - 1] = self.pairs.rank(ids[n[left], at[left] - 1], ids[n[left], at[left]])
        return out

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same merges for one very long match, by a heap of (rank, place), in time n log n."""
        size = len(raw)
        start = list(range(size + 1))
        nxt, prev = list(range(1, size + 2)), list(range(-1, size))
        end = {i: i + 1 for i in range(size)}  # where the token that starts at i ends, while it lives
        rank = self.ids.get
        longest = max(map(len, self.tokens))

        def pair(i: int) -> int | None:
            j = nxt[i]
            return rank(raw[i : end[j]]) if j < size and end[j] - i <= longest else None

        heap = [(r, i, i + 2) for i in start[:size] if i + 1 < size and (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, to = heapq.heappop(heap)
            if i not in end or (j := nxt[i]) >= size or end[j] != to or pair(i) != r:
                continue  # one of the two has merged since
            end[i] = to
            del end[j]
            nxt[i] = nxt[j]
            if nxt[i] < size:
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k, end[nxt[k]]))
        return [self.ids[raw[i : end[i]]] for i in sorted(end)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian 32-bit integers) of each row's whole text.

    Null and empty texts have no ids. Repeated rows and ids are encoded alike, an empty table gives no rows and
    other columns are not read. Work stays within tasks; a match of any length is encoded whole.
    """
    codec = Codec(read_ranks(ranks_path), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            ids = codec.encode(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long"), text_of(text_col)).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded``, the bytes that ``ids`` stand for; null ids give null."""
    tokens = read_ranks(ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = tokens.__getitem__
        for batch in small_batches(batches, 1):
            found = [
                None if i is None else b"".join(map(take, np.frombuffer(i, "<u4").tolist()))
                for i in batch.column(1).to_pylist()
            ]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of encoded and decoded rows."""
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
