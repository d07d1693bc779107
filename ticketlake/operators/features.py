"""TF-IDF features, made row by row where the texts are."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake.functions.text import tokens
from ticketlake.schema import VOCABULARY_SIZE
from ticketlake.session import cut_lineage, fresh_path


WORDS_AT_ONCE = 1 << 18
TEXTS_AT_ONCE = 1024  # texts whose buckets are counted at a time


def word_runs(words: pa.ListArray, texts: int | None = None) -> Iterator[tuple[int, int]]:
    """First and end of runs of texts that hold about ``WORDS_AT_ONCE`` words; one longer text is a run of its own.

    With ``texts`` a run has no more than so many.
    """
    ends = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    first = 0
    while first < len(words):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, "right")))
        last = min(last, first + (texts or len(words)))
        yield first, last
        first = last


def term_cells(words: pa.ListArray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Terms of texts given as word lists: each word and each pair of neighbours, counted within their text.

    Yields ``first, terms, row, term, tf`` for runs of texts that begin at ``first`` and hold about
    ``WORDS_AT_ONCE`` words (one longer text is a run of its own): the run's different terms, and a cell for
    each text and term, in that order. A null list has no words.
    """
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for first, last in word_runs(words):
        coded = words.slice(first, last - first).flatten().dictionary_encode()
        n, names = len(coded.dictionary), coded.dictionary
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(last - first), sizes[first:last])
        inside = row[1:] == row[:-1]
        pairs, pair = np.unique((code[:-1] * n + code[1:])[inside], return_inverse=True)
        joined = pc.binary_join_element_wise(names.take(pa.array(pairs // max(n, 1))), names.take(pa.array(pairs % max(n, 1))), " ")
        terms = pa.concat_arrays([names, joined])
        cells = np.concatenate([row, row[1:][inside]]) * len(terms) + np.concatenate([code, pair + n])
        cells, tf = np.unique(cells, return_counts=True)
        yield first, terms, cells // max(len(terms), 1), cells % max(len(terms), 1), tf


def term_totals(df: DataFrame, text: str) -> DataFrame:
    """``term, total, df`` of every term: how often it occurs and in how many rows.

    Texts are counted where they are and merged by term; neither texts nor counts by row are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _first, terms, _row, term, tf in term_cells(batch.column(0)):
                total = np.bincount(term, weights=tf, minlength=len(terms)).astype(np.int64)
                used = np.bincount(term, minlength=len(terms))
                yield pa.record_batch([terms, pa.array(total), pa.array(used)], ["term", "total", "df"])

    counted = df.select(tokens(text).alias("words")).mapInArrow(count, "term string, total long, df long")
    return counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n + 1.0) / (df + 1.0)) + 1.0


def vocabulary(totals: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """The ``size`` most frequent terms with total and document counts; ties by term."""
    return totals.orderBy(F.desc("total"), "term").limit(size)


class TfidfVocabulary:
    """Terms of the training texts with their index and idf, at most ``size`` of them."""

    def __init__(self, terms: DataFrame, size: int):
        self.terms, self.size = terms, size

    @classmethod
    def fit(cls, df: DataFrame, text: str, size: int = VOCABULARY_SIZE) -> "TfidfVocabulary":
        n = F.lit(df.count())
        chosen = vocabulary(term_totals(df, text), size)
        # at most ``size`` rows, so numbering them in one task is fine
        numbered = chosen.withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)
        terms = cut_lineage(numbered.select("term", "idx", smooth_idf(n, F.col("df")).alias("idf")), "vocabulary")
        return cls(terms, terms.count())

    @cached_property
    def _known(self) -> tuple[list[str], np.ndarray]:
        rows = self.terms.orderBy("idx").collect()  # at most ``size`` rows
        return [r["term"] for r in rows], np.array([r["idf"] for r in rows], float)

    def column(self, text: str) -> Column:
        """``indices`` and ``values`` of a text's known terms: (1 + ln tf) * idf, scaled to length 1.

        A pass over the rows where they are; without known terms both are empty.
        """
        known, idf = self._known

        @F.arrow_udf("struct<indices:array<int>,values:array<double>>")
        def weigh(words: pa.Array) -> pa.Array:
            sizes, indices, values = np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], [np.zeros(0)]
            for first, terms, row, term, tf in term_cells(words):
                index = pc.index_in(terms, value_set=pa.array(known, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)[term]
                row, index, tf = row[index >= 0], index[index >= 0], tf[index >= 0]
                order = np.lexsort((index, row))
                row, index, tf = row[order], index[order], tf[order]
                weight = (1.0 + np.log(tf)) * idf[index]
                values.append(weight / np.sqrt(np.bincount(row, weights=weight * weight))[row] if len(row) else weight)
                indices.append(index.astype(np.int32))
                np.add.at(sizes, row + first, 1)
            offsets = pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (indices, values)]
            return pa.StructArray.from_arrays(lists, ["indices", "values"])

        return weigh(tokens(text))

    def weights(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``key, term, weight`` with one row per known term of a row."""
        cells = df.select(key, self.column(text).alias("cells"))
        cells = cells.select(key, F.inline(F.arrays_zip(F.col("cells.indices").alias("idx"), F.col("cells.values").alias("weight"))))
        return cells.join(F.broadcast(self.terms.select("idx", "term")), "idx").select(key, "term", "weight")

    def vectors(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with a sparse ``features`` vector in place of the text, written once for the training passes."""
        rest = df.drop(text)
        rows = df.withColumn("cells", self.column(text)).select(
            *rest.columns,
            F.struct(
                F.lit(0).cast("tinyint").alias("type"),
                F.lit(self.size).alias("size"),
                F.col("cells.indices").alias("indices"),
                F.col("cells.values").alias("values"),
            ).alias("features"),
        )
        path = fresh_path(df.sparkSession, "features")
        rows.write.parquet(path)
        schema = T.StructType([*rest.schema.fields, T.StructField("features", VectorUDT())])
        return df.sparkSession.read.schema(schema).parquet(path)


VECTOR_DIM = 256


def bucket_counts(words: pa.ListArray, dim: int) -> np.ndarray:
    """How many words of each text fall into each of ``dim`` buckets; a word is hashed once for all texts."""
    coded = words.flatten().dictionary_encode()
    starts = (hashlib.md5(word.encode()).digest()[:4] for word in coded.dictionary.to_pylist())
    bucket = np.fromiter((int.from_bytes(start, "big") % dim for start in starts), np.int64, len(coded.dictionary))
    row = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    cells = row * dim + bucket[coded.indices.to_numpy(zero_copy_only=False)]
    return np.bincount(cells, minlength=len(words) * dim).reshape(len(words), dim)


class HashedTfidf:
    """Default encoder: TF-IDF of hashed words, ``dim`` numbers of length 1 per text, to six places.

    A text's vector hangs on its own words and ``dim`` numbers, so encoding is a pass over the rows where they are.
    """

    def __init__(self, frequencies: DataFrame, dim: int):
        self.frequencies, self.dim = frequencies, dim

    @classmethod
    def fit(cls, df: DataFrame, key: str, text: str, dim: int = VECTOR_DIM) -> "HashedTfidf":
        """Document counts of the buckets: summed within batches, then over them."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(0)
                used = sum((bucket_counts(words.slice(a, b - a), dim) > 0).sum(0) for a, b in word_runs(words, TEXTS_AT_ONCE)) + np.zeros(dim, np.int64)
                yield pa.record_batch([pa.array([[*used.tolist(), batch.num_rows]], pa.list_(pa.int64()))], ["used"])

        used = df.select(tokens(text).alias("words")).mapInArrow(count, "used array<long>")
        totals = used.select(F.posexplode("used").alias("term", "df")).groupBy("term").agg(F.sum("df").alias("df"))
        found = dict(map(tuple, totals.collect()))  # ``dim`` rows and one for the number of texts
        n = found.pop(dim, 0)
        idf = [(term, math.log((n + 1.0) / (df + 1.0)) + 1.0) for term, df in sorted(found.items()) if df]
        return cls(df.sparkSession.createDataFrame(idf, "term int, idf double"), dim)

    @cached_property
    def _idf(self) -> np.ndarray:
        idf = np.zeros(self.dim)
        for row in self.frequencies.collect():
            idf[row["term"]] = row["idf"]
        return idf

    def column(self, text: str) -> Column:
        """The vector of a text as doubles; without known words it is the zero vector."""
        idf, dim = self._idf, self.dim

        @F.arrow_udf("array<double>")
        def vector(words: pa.Array) -> pa.Array:
            weights = np.zeros((len(words), dim))
            for first, last in word_runs(words, TEXTS_AT_ONCE):
                tf = bucket_counts(words.slice(first, last - first), dim)
                some = np.where(tf > 0, 1.0 + np.log(np.maximum(tf, 1)), 0.0) * idf
                norms = np.sqrt((some * some).sum(1, keepdims=True))
                weights[first:last] = np.round(some / np.where(norms > 0, norms, 1.0), 6)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dim), pa.array(weights.ravel()))

        return vector(tokens(text))

    def weights(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``key, term, weight`` with one row per bucket in use."""
        cells = df.select(key, F.posexplode_outer(self.column(text)).alias("term", "weight"))
        return cells.filter("weight > 0")

    def encode(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``key, vector`` of every text."""
        return df.select(key, self.column(text).cast("array<float>").alias("vector"))


def with_vectors(df: DataFrame, key: str = "ticket_id", text: str = "description", dim: int = VECTOR_DIM) -> DataFrame:
    """Every row of ``df``, a written table, with the default encoder's ``vector`` of its text, the encoder being fitted on them."""
    encoder = HashedTfidf.fit(df, key, text, dim)
    return df.withColumn("vector", encoder.column(text).cast("array<float>"))
