"""N-gram scoring by deleted interpolation over counts of the whole corpus."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage, parts_for, small_batches, text_of

#: Tokens of a block and n-grams of a shard: some 100 MB of a Python worker each.
BLOCK_TOKENS = 2_000_000
SHARD_KEYS = 3_000_000
#: Buckets of how often a context was seen: never, once, 2-3, 4-7 and so on.
BUCKETS = 44
_END = b""  # no word is empty
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = "block long, doc_ids array<long>, train array<boolean>, sizes array<long>, words binary, tokens binary, n_keys long"
_RESOLVED = "doc_ids array<long>, train array<boolean>, sizes array<long>, of_word binary, of_pair binary, bins binary"


def _pack(a: np.ndarray) -> bytes:
    """A compressed array; bytes of the same weight stand together, which suits small and sorted numbers."""
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.copy()
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return planes.T.copy().view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


def tokens(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case; the end of the text is a token too (see ``blocks``)."""
    return text.lower().split()


def blocks(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The corpus as blocks of about ``BLOCK_TOKENS`` tokens, so that whole arrays are counted and scored.

    A row has the block's documents, the hashes of its different words and its tokens as places in them; place
    0 is the end of a document. Words are known by 64-bit hashes. A longer document is a block of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        number = 0

        def start() -> tuple[dict[bytes, int], list, list, list, list, int]:
            places: defaultdict[bytes, int] = defaultdict()
            places.default_factory = places.__len__
            return places, [], [], [], [np.zeros(0, np.int32)], int(places[_END])

        places, ids, flags, sizes, parts, end = start()
        held = 0

        def row() -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh64_intdigest(w, 1) for w in places], np.uint64)
            place = np.concatenate(parts)
            n_keys = len(hashes) + len(np.unique(_pairs(place, np.array(sizes), len(hashes))))
            columns = [[first + number], [ids], [flags], [sizes], [_pack(hashes)], [_pack(place)], [n_keys]]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _schema(_BLOCK), strict=True)], schema=_schema(_BLOCK))

        for batch in small_batches(batches, 2):
            for doc_id, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = tokens(text.as_buffer().to_pybytes())
                ids.append(doc_id)
                flags.append(flag)
                sizes.append(len(words) + 1)
                parts.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                parts.append(np.array([end], np.int32))
                held += len(words) + 1
                if held >= BLOCK_TOKENS:
                    yield row()
                    places, ids, flags, sizes, parts, end = start()
                    held, number = 0, number + 1
        if ids:
            yield row()

    columns = [F.col(id_col).cast("long"), train, text_of(text_col).cast("binary")]
    return docs.select(*columns).mapInArrow(run, _BLOCK)


def _schema(ddl: str) -> pa.Schema:
    kinds = {
        "long": pa.int64(),
        "binary": pa.binary(),
        "array<long>": pa.list_(pa.int64()),
        "array<boolean>": pa.list_(pa.bool_()),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _pairs(place: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """A number for each token and the one before it; before a document's first token stands an end."""
    before = np.concatenate([[0], place[:-1]]).astype(np.int64)
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    return before * words + place


def _keys(hashes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Keys of all words (even) and of the given pairs (odd)."""
    words = len(hashes)
    first, second = hashes[pairs // words], hashes[pairs % words]
    mixed = (first * _MIX) ^ (second + (first >> np.uint64(31)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    one = np.uint64(1)
    return np.concatenate([hashes & ~one, mixed | one])


def _spread(key: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys: their answers, in order of shards, are in order of keys."""
    return ((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def counts(corpus: DataFrame, shards: int) -> DataFrame:
    """``block``, ``shard``, ``answer``: in order of the block's keys in the shard, their counts in training rows.

    A block asks for each n-gram once, with its own count, so frequent ones weigh no more than others. Rows with
    a null ``block`` have ``n_words`` and ``n_tokens``, the shard's different words and their counts.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, train, sizes, words, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, place, sizes = _unpack(words, np.uint64), _unpack(place, np.int32), np.array(sizes)
                pairs = _pairs(place, sizes, len(hashes))
                uniq, inverse = np.unique(pairs, return_inverse=True)
                learn = np.repeat(np.array(train, bool), sizes)
                n = np.concatenate([np.bincount(place[learn], minlength=len(hashes)), np.bincount(inverse[learn], minlength=len(uniq))])
                del inverse, pairs, learn
                key = _keys(hashes, uniq)
                order = np.argsort(key, kind="stable")
                key, n = key[order], n[order]
                bounds = np.searchsorted(_spread(key, shards), np.arange(shards + 1))
                for shard, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    if b > a:
                        columns = [[shard], [block], [_pack_sorted(key[a:b])], [_pack(n[a:b].astype(np.int64))]]
                        yield pa.record_batch([pa.array(c) for c in columns], ["shard", "block", "keys", "n"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, keys, ns = [], [], []
        for batch in batches:
            for block, k, n in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                asked.append((batch.column(0)[0].as_py(), block))
                keys.append(_unpack_sorted(k))
                ns.append(_unpack(n, np.int64))
        if not asked:
            return
        uniq, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(ns), minlength=len(uniq)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        names = ["block", "shard", "answer", "n_words", "n_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        for (shard, block), k, end in zip(asked, keys, ends.tolist(), strict=True):
            got = total[inverse[end - len(k) : end]]
            columns = [[block], [shard], [_pack(got)], [None], [None]]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        word = total[(uniq & np.uint64(1)) == 0]
        columns = [[None], [asked[0][0]], [None], [int((word > 0).sum())], [int(word.sum())]]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    asked = corpus.select("block", "train", "sizes", "words", "tokens").mapInArrow(
        ask, "shard long, block long, keys binary, n binary"
    )
    return (
        asked.repartitionById(shards, F.col("shard").cast("int"))
        .mapInArrow(answer, "block long, shard long, answer binary, n_words long, n_tokens long")
    )


def bucket(n: np.ndarray) -> np.ndarray:
    """The bucket of a context that was seen ``n`` times."""
    return np.minimum(np.ceil(np.log2(np.maximum(n, 0) + 1)).astype(np.int64), BUCKETS - 1)


_FINE = 8  # steps for each doubling


def _level(x: np.ndarray) -> np.ndarray:
    """A small number for a count or share: 0 for 0, else its logarithm in eighths."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.round(np.log2(np.where(x > 0, x, 1)) * _FINE).astype(np.int64) + 512, 0)


def _value(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** ((level - 512) / _FINE), 0.0)


def resolve(corpus: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with the training counts of every token's word and pair, and its held-out counts by bin.

    Held-out counts are deleted ones: a training token is taken out of the counts it is scored by. A bin holds
    tokens of like context count, word count and share of the pair in its context.
    """
    both = answers.filter("block IS NOT NULL").select(
        "block", "shard", "answer", *(F.lit(None).cast(kind).alias(c) for c, kind in _parts(_BLOCK))
    )
    own = corpus.select("block", F.lit(-1).cast("long").alias("shard"), F.lit(None).cast("binary").alias("answer"), *(c for c, _ in _parts(_BLOCK)))

    def one(held: dict, answer: list[bytes]) -> pa.RecordBatch:
        hashes, place, sizes = _unpack(held["words"], np.uint64), _unpack(held["tokens"], np.int32), np.array(held["sizes"])
        pairs = _pairs(place, sizes, len(hashes))
        uniq, inverse = np.unique(pairs, return_inverse=True)
        key = _keys(hashes, uniq)
        n = np.empty(len(key), np.int64)
        n[np.argsort(key, kind="stable")] = np.concatenate([_unpack(a, np.int64) for a in answer])
        del key
        of_word, of_pair = n[: len(hashes)][place], n[len(hashes) :][inverse]
        learn = np.repeat(np.array(held["train"], bool), sizes)
        context = n[: len(hashes)][pairs[learn] // len(hashes)] - 1
        share = np.where(context > 0, (of_pair[learn] - 1) / np.maximum(context, 1), 0.0)
        bins = (bucket(context) * 1024 + _level(of_word[learn] - 1)) * 1024 + _level(share)
        bins, size = np.unique(bins, return_counts=True)
        columns = [held["doc_ids"], held["train"], held["sizes"], _pack(of_word), _pack(of_pair), _pack(np.concatenate([bins, size]))]
        return pa.record_batch([pa.array([c], f.type) for c, f in zip(columns, _schema(_RESOLVED), strict=True)], schema=_schema(_RESOLVED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        answer: list[bytes] = []
        for batch in batches:
            for at in range(batch.num_rows):
                if batch.column(1)[at].as_py() < 0:  # the block comes before its answers
                    if held:
                        yield one(held, answer)
                    held, answer = {c: batch.column(c)[at].as_py() for c, _ in _parts(_BLOCK)}, []
                else:
                    answer.append(batch.column(2)[at].as_py())
        if held:
            yield one(held, answer)

    parts = parts_for(corpus.sparkSession, corpus.count(), 1)  # a block or two each
    rows = own.unionByName(both).repartition(parts, "block").sortWithinPartitions("block", "shard")
    return rows.mapInArrow(run, _RESOLVED)


def _parts(ddl: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in ddl.split(", ") if c.split()[0] not in ("block", "n_keys")]


@dataclass
class Mixture:
    """Weights of a uniform, a word and a pair estimate for each bucket of the context's count."""

    weights: np.ndarray
    n_words: int
    n_tokens: int

    def log10(self, of_word: np.ndarray, of_pair: np.ndarray, of_context: np.ndarray) -> np.ndarray:
        w = self.weights[bucket(of_context)]
        p = w[:, 0] / (self.n_words + 1)
        p += w[:, 1] * of_word / max(self.n_tokens, 1)
        p += w[:, 2] * of_pair / np.maximum(of_context, 1)
        return np.log10(p)


def fit_mixture(bins: Iterable[tuple[int, int]], n_words: int, n_tokens: int, rounds: int = 60) -> Mixture:
    """Expectation-maximisation on the held-out counts; a bucket without any relies on the words alone.

    The uniform estimate keeps a little weight, so that no text is impossible.
    """
    weights = np.tile([0.1, 0.9 if n_tokens else 0.0, 0.0], (BUCKETS, 1))
    weights /= weights.sum(1, keepdims=True)
    code, n = (np.array(x, np.int64) for x in (zip(*bins, strict=True) if bins else ([], [])))
    of, word, share = code >> 20, (code >> 10) & 1023, code & 1023
    p = np.stack([np.full(len(code), 1 / (n_words + 1)), _value(word) / max(n_tokens - 1, 1), _value(share)], 1)
    seen = np.unique(of)
    weights[seen] = 1 / 3
    for _ in range(rounds):
        part = weights[of] * p
        part *= (n / part.sum(1))[:, None]
        for k in range(3):
            weights[seen, k] = np.bincount(of, part[:, k], minlength=BUCKETS)[seen]
        weights[seen] /= weights[seen].sum(1, keepdims=True)
        weights[seen] = 0.9999 * weights[seen] + 0.0001 / 3
    weights[0, 2] = 0  # a context that was never seen has no pairs
    weights /= weights.sum(1, keepdims=True)
    return Mixture(weights, n_words, n_tokens)


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``train``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``.

    ``base_score`` is the add-one word model of the rows where ``train`` holds, ``score`` mixes word and pair
    estimates of the same rows; both are sums of log10 over the whole text and its end. A null text is its end
    alone; repeated rows count and are scored each; without training rows both scores are those of a uniform
    model over one token; an empty table gives no rows. Other columns are not read.

    Texts are read once. Blocks ask shards for the counts of their n-grams, combined within the block, and are
    scored as arrays; the driver sees two numbers, one row for each bin (a bounded grid) and the weights.
    """
    corpus = cut_lineage(blocks(docs, train, id_col, text_col), "lm-blocks")
    keys = corpus.agg(F.sum("n_keys")).first()[0] or 0
    shards = parts_for(docs.sparkSession, keys, SHARD_KEYS)
    answers = cut_lineage(counts(corpus, shards), "lm-answers")
    size = answers.filter("block IS NULL").agg(F.sum("n_words"), F.sum("n_tokens")).first()
    n_words, n_tokens = size[0] or 0, size[1] or 0
    resolved = cut_lineage(resolve(corpus, answers), "lm-resolved")

    def unbin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                code, n = _unpack(packed, np.int64).reshape(2, -1)
                yield pa.record_batch([pa.array(code), pa.array(n)], ["code", "n"])

    bins = resolved.select("bins").mapInArrow(unbin, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    mixture = fit_mixture(sorted((r["code"], r["n"]) for r in bins.collect()), n_words, n_tokens)
    names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, flags, sizes, of_word, of_pair in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                of_word, of_pair, sizes = _unpack(of_word, np.int64), _unpack(of_pair, np.int64), np.array(sizes)
                starts = np.cumsum(sizes) - sizes
                of_context = np.concatenate([[0], of_word[:-1]])
                of_context[starts] = of_word[np.cumsum(sizes) - 1][0]  # every document ends with the same token
                base = np.log10((of_word + 1) / (n_tokens + n_words + 1))
                model = mixture.log10(of_word, of_pair, of_context)
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array(flags, pa.bool_()),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((of_word > 0).astype(np.int64), starts)),
                    pa.array(np.full(len(sizes), n_tokens)),
                    pa.array(np.add.reduceat(base, starts)),
                    pa.array(np.add.reduceat(model, starts)),
                ]
                yield pa.record_batch(columns, names)

    schema = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return resolved.select("doc_ids", "train", "sizes", "of_word", "of_pair").mapInArrow(run, schema)
