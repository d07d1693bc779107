"""Language identification by unigram pieces, summed over all segmentations of each word."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.bpe import read_ranks
from ticketlake.llm.common import small_batches

UNKNOWN = "und"
WORD = regex.compile(r"[\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
CACHE = 300_000  # words whose scores a task holds
_WAYS = 4
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary's byte strings, found by hash; all single bytes are among them."""

    def __init__(self, tokens: list[bytes]):
        tokens = sorted(set(tokens) | {bytes([b]) for b in range(256)})
        self.n = len(tokens)
        self.lengths = {len(t) for t in tokens}
        keys = np.array([self._hash(t) for t in tokens], np.uint64)
        self.bits = int(self.n).bit_length()
        while True:
            at = self._bucket(keys)
            order = np.argsort(at, kind="stable")
            first = np.r_[True, at[order][1:] != at[order][:-1]]
            slot = np.arange(self.n) - np.flatnonzero(first)[np.cumsum(first) - 1]
            if slot.max() < _WAYS:
                break
            self.bits += 1
        self.keys = np.zeros((1 << self.bits, _WAYS), np.uint64)
        self.ids = np.full((1 << self.bits, _WAYS), self.n, np.int32)
        self.keys[at[order], slot], self.ids[at[order], slot] = keys[order], order

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for byte in piece:
            h = (h * int(_BASE) + byte + 1) % 2**64
        return h

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Ids; ``n`` where there is no such piece."""
        at = self._bucket(keys)
        out = np.full(keys.shape, self.n, np.int32)
        for way in range(_WAYS):
            hit = self.keys[at, way] == keys
            out[hit] = self.ids[at[hit], way]
        return out

    def spans(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each length that a piece may have, from 1, the ids of the pieces that start at each place of equally long words."""
        size = words.shape[1]
        out, h = [], np.zeros(words.shape, np.uint64)
        for k in range(1, min(max(self.lengths), size) + 1):
            h = h[:, : size - k + 1] * _BASE + words[:, k - 1 :].astype(np.uint64) + np.uint64(1)
            if k in self.lengths:
                out.append((k, self.find(h)))
        return out


def _by_length(words: list[bytes], cells: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and bytes of equally long words, in blocks of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == size)
        step = max(1, cells // size)
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield some, np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(-1, size)


def forward(spans: list[tuple[int, np.ndarray]], p: np.ndarray) -> np.ndarray:
    """Logarithms of the forward sums (n, size + 1, languages) of words over all segmentations.

    ``p`` holds a row of probabilities for each piece and a last row of zeros. The sums that a step needs are
    kept relative to the latest one, so words of any length stay within a double.
    """
    n, size = spans[0][1].shape
    reach = spans[-1][0]
    logs = np.zeros((n, size + 1, p.shape[1]))
    near = [np.ones((n, p.shape[1]))]  # the sums at the last places, the latest one last
    for i in range(1, size + 1):
        total = sum(near[-k] * p[ids[:, i - k]] for k, ids in spans if k <= i)
        logs[:, i] = logs[:, i - 1] + np.log(total)
        near = [x / total for x in near[-reach + 1 :]] if reach > 1 else []
        near.append(np.ones((n, p.shape[1])))
    return logs


def log_scores(words: list[bytes], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    for places, block in _by_length(words):
        out[places] = forward(pieces.spans(block), p)[:, -1]
    return out


def expected_counts(words: list[bytes], weights: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """How often each piece is used by each language, over all segmentations by their probability."""
    counts = np.zeros(p.shape)
    for places, block in _by_length(words, 100_000):
        spans = pieces.spans(block)
        ahead = forward(spans, p)
        size = block.shape[1]
        behind = np.zeros(ahead.shape)
        for i in range(size - 1, -1, -1):
            total = sum(p[ids[:, i]] * np.exp(behind[:, i + k] - behind[:, i + 1]) for k, ids in spans if k <= size - i)
            behind[:, i] = behind[:, i + 1] + np.log(total)
        for i in range(size):
            for k, starts in spans:
                if k > size - i:
                    break
                ids = starts[:, i]
                used = np.exp(ahead[:, i] + behind[:, i + k] - ahead[:, -1]) * p[ids] * weights[places]
                for lang in range(p.shape[1]):
                    counts[:, lang] += np.bincount(ids, used[:, lang], minlength=len(p))
    return counts


class LanguageModel:
    """Piece probabilities of each language, learned by expectation-maximisation from word counts."""

    def __init__(self, tokens: list[bytes], counts: dict[tuple[str, str], int], rounds: int = 4, smoothing: float = 0.5):
        self.languages = sorted({lang for lang, _ in counts})
        self.pieces = Pieces(tokens)
        words = {w: i for i, w in enumerate(sorted({w for _, w in counts}))}
        weights = np.zeros((len(words), len(self.languages)))
        for (lang, word), n in counts.items():
            weights[words[word], self.languages.index(lang)] += n
        raw = [b" " + w.encode() for w in words]
        self.p = np.full((self.pieces.n + 1, len(self.languages)), 1 / self.pieces.n)
        self.p[-1] = 0
        for _ in range(rounds if words else 0):
            used = expected_counts(raw, weights, self.pieces, self.p) + smoothing
            used[-1] = 0
            self.p = used / used.sum(0)
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior probability, all languages being as likely beforehand."""
        found = [WORD.findall(t.lower()) if t else [] for t in texts]
        found = [ws if ws and LETTER.search(t) else [] for ws, t in zip(found, texts, strict=True)]
        if len(self.cache) > CACHE:
            self.cache, self.scores = {}, self.scores[:0]
        new = list(set().union(*found).difference(self.cache))
        self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new)), strict=True))
        self.scores = np.concatenate([self.scores, log_scores([b" " + w.encode() for w in new], self.pieces, self.p)])
        out = []
        for words in found:
            if not words or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.scores[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit(
    docs: DataFrame, train: Column, vocabulary_path: str, docs_per_language: int = 400, text_col: str = "text"
) -> LanguageModel:
    """A model of the languages named in ``lang`` of the rows where ``train`` holds.

    It learns from a sample of about ``docs_per_language`` rows of each language, drawn by a hash of
    ``doc_id``; only its word counts reach the driver. Rows with a null ``lang`` or text are left out. Without
    any rows the model knows no language.
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col(text_col).isNotNull()).select("doc_id", "lang", text_col)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel(read_ranks(vocabulary_path), {})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, docs_per_language / n)])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter(drawn < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            counts: Counter = Counter()
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update((lang, w) for w in WORD.findall(text.lower()))
            langs, words = zip(*counts, strict=True) if counts else ([], [])
            yield pa.record_batch(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    counted = sample.select("lang", text_col).mapInArrow(count, "lang string, word string, n long")
    rows_ = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()
    return LanguageModel(read_ranks(vocabulary_path), {(r["lang"], r["word"]): r["n"] for r in rows_})


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1) of each row, from its whole text alone.

    Words are runs of letters and marks in lower case. A null text, one without a letter and any text under a
    model without languages is ``und`` with score 0; of equally likely languages the first by name is taken.
    Repeated rows are scored alike, an empty table gives no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            found = model.predict(batch.column(1).to_pylist())
            langs, scores = zip(*found, strict=True) if found else ([], [])
            yield pa.record_batch(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: LanguageModel, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found with ``min_score`` or more."""
    names = docs.columns
    text = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            found = model.predict(batch.column(text).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
