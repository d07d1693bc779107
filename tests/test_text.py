import itertools
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from ticketlake.functions import domain
from ticketlake.functions import text as tx
from ticketlake.operators import features
from ticketlake.operators.features import (
    HashedTfidf,
    TfidfVocabulary,
    term_totals,
    vocabulary,
    with_vectors,
)
from ticketlake.schema import DATE_FORMAT, URGENCY_PHRASES


def one(df, column):
    return df.select(column.alias("x")).first()["x"]


def test_clean_text(spark):
    rows = [(None,), ("",), ("  a \t\n b ",), ("a b",), ("a\x0bb",), ("a\x85b",), (" Keep, Case! ",)]
    out = spark.createDataFrame(rows, "t string").select(tx.clean_text("t").alias("x")).collect()
    assert [r["x"] for r in out] == ["", "", "a b", "a b", "a b", "a b", "Keep, Case!"]


def test_strip_and_blank(spark):
    df = spark.createDataFrame([("  a b\n",)], "t string")
    assert one(df, tx.strip("t")) == "a b"
    assert one(spark.createDataFrame([("  \n",)], "t string"), tx.is_blank("t"))


def test_default_and_parts(spark):
    df = spark.createDataFrame([("", "b", None)], "a string, b string, c string")
    assert one(df, tx.default_when_empty("a", "b")) == "b"
    assert one(df, tx.default_when_empty("c", "b")) == "b"
    assert one(df, tx.join_parts("a", "b", "c", "b")) == "b b"


def test_tokens_ngrams_truncate(spark):
    df = spark.createDataFrame([("A VPN-Clienté x is down",), ("",), ("one",), (None,)], "t string")
    grams = [r["x"] for r in df.select(tx.ngrams(tx.tokens("t")).alias("x")).collect()]
    assert grams[0] == ["vpn", "clienté", "is", "down", "vpn clienté", "clienté is", "is down"]
    assert grams[1:] == [[], ["one"], []]
    assert one(df, tx.truncate(tx.tokens("t"), 2)) == ["vpn", "clienté"]


def test_template_fills_in_key_order(spark):
    df = spark.createDataFrame([("{a} and {b} and {c}", "{b}", "x")], "t string, a string, b string")
    values = F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))
    assert one(df, tx.fill_template("t", values)) == "x and x and {c}"


def test_scores_sorted(spark):
    df = spark.createDataFrame([({"a": 0.2, "c": 0.4, "b": 0.4},)], "m map<string,double>")
    assert [(e["key"], e["value"]) for e in one(df, tx.sort_scores("m"))] == [("b", 0.4), ("c", 0.4), ("a", 0.2)]


def test_percent(spark):
    assert one(spark.range(1), tx.percent(F.lit(0.1234))) == "12.3%"


def test_domain(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-31 00:00:00' c, 24.5D h, 'Low' p, 'Other' o, CAST(NULL AS double) r")
    assert one(df, F.date_format(domain.resolved_at("c", "h"), DATE_FORMAT)) == "2024-02-01 00:30"
    assert one(df, domain.speed_band("h", "p")) == "fast"
    assert one(df, domain.speed_band("h", "o")) is None
    assert one(df, domain.lookup(F.col("o"), {"Low": "x"}, "none")) == "none"
    assert one(df.withColumn("satisfaction_rating", F.col("r")), domain.metadata_text("satisfaction_rating")) == "nan"


def test_phrases(spark):
    df = spark.createDataFrame([("Hello. No rush on this — just flagging it when you have time.",)], "t string")
    assert one(df, domain.phrase_classes("t", URGENCY_PHRASES)) == ["Low"]


DOCS = [("a", "apple pie apple"), ("b", "pie and cake"), ("c", "?"), ("d", "pie")]


def test_vocabulary_ties_and_weights(spark):
    df = spark.createDataFrame(DOCS, "id string, t string")
    totals = term_totals(df, "t")
    assert {(r["term"], r["total"], r["df"]) for r in vocabulary(totals, 3).collect()} == {
        ("pie", 3, 3),
        ("apple", 2, 1),
        ("and", 1, 1),
    }
    norms = TfidfVocabulary.fit(df, "t", 3).weights(df, "id", "t").groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert {r["id"] for r in norms} == {"a", "b", "d"}
    assert all(abs(r["n"] - 1) < 1e-12 for r in norms)


def tx_words(text):
    return [w for w in (text or "").replace("?", " ").split() if len(w) > 1]


def test_counting_by_runs_of_texts_equals_counting_by_hand(spark, monkeypatch):
    texts = ["", None, "ab cd ab cd ab", "cd", "ab " * 9, "?", "ef ab cd ef", "x y"]  # one-letter words are none
    words = [tx_words(t) for t in texts]
    expected = [Counter(w + [" ".join(p) for p in itertools.pairwise(w)]) for w in words]
    for at_once in (1, 4, 1000):
        monkeypatch.setattr(features, "WORDS_AT_ONCE", at_once)
        found = [Counter() for _ in texts]
        for first, terms, row, term, tf in features.term_cells(pa.array([w or None for w in words], pa.list_(pa.string()))):
            for r, t, n in zip(row, term, tf, strict=True):
                found[first + r][terms[int(t)].as_py()] += int(n)
        assert found == expected
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    totals = {r["term"]: (r["total"], r["df"]) for r in term_totals(df, "t").collect()}
    assert totals == {t: (sum(c[t] for c in expected), sum(t in c for c in expected)) for t in set().union(*expected)}
    assert term_totals(df.filter("false"), "t").count() == 0


def test_texts_are_not_shuffled_for_terms(spark):
    df = spark.createDataFrame(DOCS, "id string, t string")
    plan = term_totals(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(term" in plan
    words = TfidfVocabulary.fit(df, "t", 4)
    assert "Exchange" not in df.select(words.column("t"))._jdf.queryExecution().executedPlan().toString()


def test_vectors_keep_documents_without_terms(spark):
    df = spark.createDataFrame([*DOCS, ("e", None), ("a", "pie")], "id string, t string")  # an id may repeat
    words = TfidfVocabulary.fit(df, "t", 4)
    vectors = [(r["id"], r["features"]) for r in words.vectors(df, "t").collect()]
    assert words.size == 4 and sorted(i for i, _ in vectors) == ["a", "a", "b", "c", "d", "e"]
    assert all(abs(v.norm(2) - (i not in "ce")) < 1e-12 for i, v in vectors)
    assert sorted(v.numNonzeros() for i, v in vectors if i == "a") == [1, 2]  # pie, apple; pie
    assert words.vectors(df.filter("false"), "t").count() == 0


def test_default_encoder(spark):
    df = spark.createDataFrame(DOCS, "id string, t string")
    encoder = HashedTfidf.fit(df, "id", "t", 16)
    vectors = {r["id"]: r["vector"] for r in encoder.encode(df, "id", "t").collect()}
    assert all(len(v) == 16 for v in vectors.values())
    assert sum(x * x for x in vectors["c"]) == 0 and abs(sum(x * x for x in vectors["b"]) - 1) < 1e-5
    assert {r["id"]: r["vector"] for r in with_vectors(df, "id", "t", 16).collect()} == vectors
