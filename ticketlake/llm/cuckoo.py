"""Cuckoo filters over 64-bit hashes, and an exact key table behind one."""

from __future__ import annotations

import numpy as np

SLOTS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """16-bit fingerprints, each in one of two buckets of four slots; all operations take whole arrays.

    ``insert`` returns False on overflow: the filter is then to be rebuilt larger from the stored keys.
    """

    def __init__(self, buckets: int):
        self.buckets = 1 << max(4, int(buckets - 1).bit_length())
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.used = np.zeros(self.buckets, np.int8)  # the first slots of a bucket are the used ones
        self.size = 0

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fingerprint = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        return fingerprint, (hashes & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, fingerprint: np.ndarray, at: np.ndarray) -> np.ndarray:
        jump = (fingerprint.astype(np.uint64) * _MIX) >> np.uint64(32)
        return at ^ (jump & np.uint64(self.buckets - 1)).astype(np.int64)

    def insert(self, hashes: np.ndarray, rounds: int = 500) -> bool:
        """Every pending fingerprint tries its bucket; of those left, one a bucket evicts and the others move."""
        if self.size + len(hashes) > 0.9 * self.buckets * SLOTS:
            return False
        pick = np.random.default_rng(len(hashes))
        fingerprint, at = self._places(hashes)
        self.size += len(hashes)
        for turn in range(rounds):
            order = np.argsort(at, kind="stable")
            fingerprint, at = fingerprint[order], at[order]
            first = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            slot = self.used[at] + rank
            fits = slot < SLOTS
            self.table[at[fits], slot[fits]] = fingerprint[fits]
            self.used += np.bincount(at[fits], minlength=self.buckets).astype(np.int8)
            fingerprint, at = fingerprint[~fits], at[~fits]
            if not len(at):
                return True
            if turn:
                evict = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                slots = pick.integers(0, SLOTS, len(evict))
                victims = self.table[at[evict], slots]
                self.table[at[evict], slots] = fingerprint[evict]
                fingerprint[evict] = victims
            at = self._other(fingerprint, at)
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """False: surely not there. True: there, or one of a few false hits, which the caller verifies."""
        fingerprint, at = self._places(hashes)
        wanted = fingerprint[:, None]
        return (self.table[at] == wanted).any(1) | (self.table[self._other(fingerprint, at)] == wanted).any(1)

    def delete(self, hashes: np.ndarray) -> None:
        """Takes out one fingerprint for each hash; all of them must have been inserted."""
        fingerprint, at = self._places(hashes)
        while len(at):
            here = (self.table[at] == fingerprint[:, None]).any(1)
            at = np.where(here, at, self._other(fingerprint, at))
            _, now = np.unique(at, return_index=True)  # one a bucket at a time
            a, f = at[now], fingerprint[now]
            slot, last = (self.table[a] == f[:, None]).argmax(1), self.used[a] - 1
            self.table[a, slot] = self.table[a, last]
            self.table[a, last] = 0
            self.used[a] -= 1
            self.size -= len(a)
            rest = np.ones(len(at), bool)
            rest[now] = False
            fingerprint, at = fingerprint[rest], at[rest]

    def dump(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        out = cls(len(table))
        out.table, out.used = table, (table > 0).sum(1).astype(np.int8)
        out.size = int(out.used.sum())
        return out


class KeyIndex:
    """Exact counts and best values of the keys of one shard, behind a cuckoo filter.

    A key is a digest of fixed width. The filter answers for keys that were never seen; a hit is verified
    against the stored keys, so a false hit does no harm. On overflow the filter doubles and is filled again
    from the stored keys.
    """

    def __init__(self, width: int, filter_bytes: bytes | None = None, expected: int = 1024):
        self.width = width
        self.filter = CuckooFilter.load(filter_bytes) if filter_bytes else CuckooFilter(expected // 2)
        self.rows: dict[bytes, int] = {}
        self.count: list[int] = []
        self.best: list[tuple] = []

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        words = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, self.width // 8)
        return words[:, 0] ^ (words[:, 1] * _MIX)

    def restore(self, keys: list[bytes], counts: list[int], best: list[tuple] | None = None) -> None:
        """Stored keys of an earlier run, whose filter was given to the constructor; may be called again and again."""
        self.rows.update(zip(keys, range(len(self.count), len(self.count) + len(keys)), strict=True))
        self.count.extend(counts)
        self.best.extend(best or [()] * len(keys))

    def add(self, keys: list[bytes], counts: list[int], best: list[tuple] | None = None) -> None:
        best = best or [()] * len(keys)
        new: dict[bytes, int] = {}
        for i, hit in enumerate(self.filter.contains(self._hashes(keys)).tolist() if keys else []):
            key = keys[i]
            row = self.rows.get(key) if hit else new.get(key)
            if row is None:
                row = new.setdefault(key, len(self.count))  # a false hit may also repeat in this call
            if row == len(self.count):
                self.count.append(counts[i])
                self.best.append(best[i])
            else:
                self.count[row] += counts[i]
                self.best[row] = max(self.best[row], best[i])
        self.rows.update(new)
        if new and not self.filter.insert(self._hashes(list(new))):
            self._grow()

    def remove(self, keys: list[bytes], counts: list[int]) -> list[bytes]:
        """Takes counts away; keys whose count falls to 0 leave the filter and are returned."""
        gone = []
        for i, hit in enumerate(self.filter.contains(self._hashes(keys)).tolist() if keys else []):
            row = self.rows.get(keys[i]) if hit else None
            if row is not None:
                self.count[row] -= counts[i]
                if self.count[row] <= 0:
                    del self.rows[keys[i]]
                    gone.append(keys[i])
        if gone:
            self.filter.delete(self._hashes(gone))
        return gone

    def _grow(self) -> None:
        buckets = self.filter.buckets
        live = self._hashes(list(self.rows))
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            if self.filter.insert(live):
                return

    def items(self) -> list[tuple[bytes, int, tuple]]:
        return [(k, self.count[i], self.best[i]) for k, i in self.rows.items()]
