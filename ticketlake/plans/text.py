"""Queries of text features, hooks and classification."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.functions import text as tx
from ticketlake.operators import assemble, hooks, metrics, profile, sampling
from ticketlake.operators import rerank as rr
from ticketlake.operators import retrieve as rt
from ticketlake.operators.classify import TicketClassifier, class_weights, label_encode
from ticketlake.operators.clean import clean_tickets
from ticketlake.operators.features import (
    VECTOR_DIM,
    HashedTfidf,
    TfidfVocabulary,
    term_totals,
    vocabulary,
)
from ticketlake.plans.columns import request_bodies
from ticketlake.plans.profiling import CLEAN_CTE
from ticketlake.plans.registry import TICKETS, WS_SQL, query, tokens_sql
from ticketlake.plans.retrieval import (
    PROMPT_SQL,
    SOURCES,
    VECTORS,
    bm25_sql,
    encode_sql,
    knn_sql,
    open_tickets,
    retrieve_sql,
    stored_tickets,
    ticket_index,
)
from ticketlake.schema import MAX_TOKENS, METADATA_FIELDS, MISSING_DESCRIPTION, OPEN_STATUSES, QUERY_PREFIX
from ticketlake.session import cut_lineage, fresh_path
from ticketlake.sources import requests
from ticketlake.sources.index import VectorIndex
from ticketlake.sources.tickets import load_corpus, tickets

# Tokens and TF-IDF over descriptions.

WORDS_CTE = f""", w AS (SELECT ticket_id, {tokens_sql('description')} AS words FROM tickets)
"""
GRAMS_CTE = (
    WORDS_CTE
    + """, g AS (SELECT ticket_id, list_concat(words, list_transform(range(1, len(words)),
      lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w),
    counts AS (SELECT ticket_id, term, count(*) AS tf FROM (SELECT ticket_id, unnest(grams) AS term FROM g)
      GROUP BY ticket_id, term),
    vocab AS (SELECT term, cast(sum(tf) AS bigint) AS total, count(*) AS df FROM counts GROUP BY term
      ORDER BY total DESC, term LIMIT 10000)
    """
)


def descriptions(spark, d) -> DataFrame:
    return tickets(spark, d, "ticket_id", "description")


@query("tokenize", TICKETS + WORDS_CTE + "SELECT ticket_id, len(words) AS n_tokens, array_to_string(words, ' ') AS tokens FROM w")
def _(spark, d):
    df = descriptions(spark, d).select("ticket_id", tx.tokens("description").alias("words"))
    return df.select(
        "ticket_id", F.size("words").cast("bigint").alias("n_tokens"), F.array_join("words", " ").alias("tokens")
    )


@query(
    "ngrams",
    TICKETS + GRAMS_CTE + "SELECT ticket_id, len(grams) AS n_grams, array_to_string(grams, '|') AS grams FROM g",
)
def _(spark, d):
    df = descriptions(spark, d).select("ticket_id", tx.ngrams(tx.tokens("description")).alias("grams"))
    return df.select(
        "ticket_id", F.size("grams").cast("bigint").alias("n_grams"), F.array_join("grams", "|").alias("grams")
    )


@query(
    "truncate_tokens",
    TICKETS
    + WORDS_CTE
    + f"""SELECT ticket_id, least(len(words), {MAX_TOKENS}) AS n_kept,
    array_to_string(words[1:{MAX_TOKENS}], ' ') AS kept FROM w""",
)
def _(spark, d):
    kept = tx.truncate(tx.tokens("description"), MAX_TOKENS)
    df = descriptions(spark, d).select("ticket_id", kept.alias("words"))
    return df.select(
        "ticket_id", F.size("words").cast("bigint").alias("n_kept"), F.array_join("words", " ").alias("kept")
    )


@query("vocabulary", TICKETS + GRAMS_CTE + "SELECT term, total, df FROM vocab")
def _(spark, d):
    return vocabulary(term_totals(descriptions(spark, d), "description"))


@query(
    "tfidf_weights",
    TICKETS
    + GRAMS_CTE
    + """, weights AS (SELECT c.ticket_id, c.term,
      (1 + ln(c.tf)) * (ln((1e0 + (SELECT count(*) FROM tickets)) / (1e0 + v.df)) + 1) AS w
      FROM counts c JOIN vocab v ON v.term = c.term),
    norms AS (SELECT ticket_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ticket_id)
    SELECT w.ticket_id, w.term, round(w.w / n.norm, 6) AS weight FROM weights w JOIN norms n ON n.ticket_id = w.ticket_id""",
)
def _(spark, d):
    df = cut_lineage(descriptions(spark, d), "descriptions")
    weights = TfidfVocabulary.fit(df, "description").weights(df, "ticket_id", "description")
    return weights.withColumn("weight", F.round("weight", 6))


DIM = VECTOR_DIM


@query(
    "embed_default",
    TICKETS
    + WORDS_CTE
    + f""", counts AS (SELECT ticket_id, cast(('0x' || left(md5(term), 8))::bigint % {DIM} AS integer) AS bucket,
      count(*) AS tf FROM (SELECT ticket_id, unnest(words) AS term FROM w) GROUP BY ALL),
    freq AS (SELECT bucket, count(*) AS df FROM counts GROUP BY bucket),
    weights AS (SELECT c.ticket_id, c.bucket,
      (1 + ln(c.tf)) * (ln((1e0 + (SELECT count(*) FROM tickets)) / (1e0 + f.df)) + 1) AS w
      FROM counts c JOIN freq f ON f.bucket = c.bucket),
    norms AS (SELECT ticket_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY ticket_id)
    SELECT w.ticket_id, w.bucket, round(w.w / n.norm, 6) AS weight
    FROM weights w JOIN norms n ON n.ticket_id = w.ticket_id""",
)
def _(spark, d):
    df = descriptions(spark, d)
    encoder = HashedTfidf.fit(df, "ticket_id", "description", DIM)
    return encoder.weights(df, "ticket_id", "description").select(
        "ticket_id", F.col("term").alias("bucket"), F.round("weight", 6).alias("weight")
    )


ASKED_SQL = (
    TICKETS
    + encode_sql("c", "SELECT ticket_id, description FROM tickets WHERE status IN ('Closed', 'Resolved')")
    + encode_sql(
        "o",
        f"SELECT ticket_id, '{QUERY_PREFIX}' || description AS description FROM tickets "
        "WHERE status IN ('Open', 'In Progress', 'Pending')",
        fitted="c",
    )
)


@query(
    "index_search",
    ASKED_SQL
    + ", part AS (SELECT c.* FROM c JOIN tickets t ON t.ticket_id = c.ticket_id WHERE t.department = 'BUILDING')"
    + knn_sql("h", "o", "part", 5)
    + """SELECT h.query_id, h.rank, h.ticket_id, t.subject, round(h.distance, 6) AS distance
    FROM h JOIN tickets t ON t.ticket_id = h.ticket_id""",
)
def _(spark, d):
    """An index is built, opened again and asked with the texts of open tickets, for one department."""
    rows = cut_lineage(tickets(spark, d, "description", *METADATA_FIELDS), "tickets")
    path = fresh_path(spark, "vector-index")
    VectorIndex.build(load_corpus(rows), path)
    asked = rows.filter(F.col("status").isin(OPEN_STATUSES))
    queries = asked.select(F.col("ticket_id").alias("query_id"), F.col("description").alias("query"))
    hits = VectorIndex.open(spark, path).search(queries, 5, where={"department": "BUILDING"})
    return hits.select("query_id", "rank", "ticket_id", "subject", F.round("distance", 6).alias("distance"))


@query(
    "index_upsert_records",
    TICKETS
    + encode_sql("c", "SELECT ticket_id, description FROM tickets WHERE status = 'Closed'")
    + encode_sql(
        "f",
        """SELECT ticket_id, CASE WHEN status = 'Closed' AND category = 'de' THEN 'revised ' || description
        ELSE description END AS description FROM tickets WHERE status IN ('Closed', 'Resolved')""",
        fitted="c",
    )
    + encode_sql(
        "o",
        f"SELECT ticket_id, '{QUERY_PREFIX}' || description AS description FROM tickets "
        "WHERE status IN ('Open', 'In Progress', 'Pending')",
        fitted="c",
    )
    + knn_sql("h", "o", "f", 3)
    + """SELECT h.query_id, h.rank, h.ticket_id, t.subject, coalesce(t.resolution, '') AS resolution,
      t.status, round(h.distance, 6) AS distance FROM h JOIN tickets t ON t.ticket_id = h.ticket_id""",
)
def _(spark, d):
    """An index of closed tickets takes in the resolved ones and new texts of some closed ones; a search sees both."""
    rows = cut_lineage(tickets(spark, d, "description", *METADATA_FIELDS), "tickets")
    closed = rows.filter("status = 'Closed'")
    path = fresh_path(spark, "vector-index")
    index = VectorIndex.build(closed, path)
    revised = closed.filter("category = 'de'").withColumn("description", F.concat(F.lit("revised "), "description"))
    updates = cut_lineage(rows.filter("status = 'Resolved'").unionByName(revised), "updates")
    index.upsert(updates)
    asked = rows.filter(F.col("status").isin(OPEN_STATUSES))
    queries = asked.select(F.col("ticket_id").alias("query_id"), F.col("description").alias("query"))
    hits = VectorIndex.open(spark, path).search(queries, 3, fields=("subject", "resolution", "status"))
    return hits.select(
        "query_id", "rank", "ticket_id", "subject", "resolution", "status", F.round("distance", 6).alias("distance")
    )


@query(
    "embed_search",
    ASKED_SQL
    + knn_sql("h", "o", "c", 5)
    + "SELECT query_id, rank, ticket_id AS neighbour_id, round(distance, 6) AS distance FROM h",
)
def _(spark, d):
    """Open tickets against resolved ones with the default encoder's own vectors, prefix on queries only."""
    rows = cut_lineage(tickets(spark, d, "ticket_id", "status", "description"), "tickets")
    corpus = load_corpus(rows)
    encoder = HashedTfidf.fit(corpus, "ticket_id", "description", DIM)
    asked = rows.filter(F.col("status").isin(OPEN_STATUSES)).select(
        F.col("ticket_id").alias("query_id"), F.concat(F.lit(QUERY_PREFIX), "description").alias("query")
    )
    vectors = encoder.encode(corpus, "ticket_id", "description").withColumnRenamed("ticket_id", "neighbour_id")
    hits = rt.knn_exact(
        cut_lineage(encoder.encode(asked, "query_id", "query"), "query-vectors"),
        cut_lineage(vectors, "corpus-vectors"),
        5,
    )
    return hits.select("query_id", "rank", "neighbour_id", F.round("distance", 6).alias("distance"))


# Hooks, each with a small model that SQL can repeat.


def load_letter_counter():
    letters = "abcdefghijklmnopqrstuvwxyz"

    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(c) for c in letters] for t in texts])

    return encode


@query(
    "hook_encoder",
    TICKETS
    + """SELECT ticket_id, cast(i AS integer) AS dimension,
    cast(length(lower(description)) - length(replace(lower(description), chr(cast(97 + i AS integer)), '')) AS double)
    AS value FROM tickets, (SELECT unnest(range(0, 26)) AS i)""",
)
def _(spark, d):
    vectors = hooks.encode(descriptions(spark, d), "ticket_id", "description", load_letter_counter)
    return vectors.select("ticket_id", F.posexplode("vector").alias("dimension", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def load_overlap_scorer():
    def words(text: str) -> set[str]:
        return set(re.split(" ", text.lower()))

    def score(queries: list[str], documents: list[str]) -> np.ndarray:
        pairs = [(words(q), words(x)) for q, x in zip(queries, documents)]
        return np.array([len(a & b) / len(a | b) for a, b in pairs])

    return score


@query(
    "hook_scorer",
    VECTORS
    + retrieve_sql("h", "opened", "corpus", 20)
    + """, sets AS (SELECT h.query_id, h.ticket_id, h.rank, list_distinct(string_split(lower(q.description), ' ')) AS a,
      list_distinct(string_split(lower(coalesce(c.resolution, '')), ' ')) AS b
      FROM h JOIN opened q ON q.ticket_id = h.query_id JOIN corpus c ON c.ticket_id = h.ticket_id),
    scored AS (SELECT query_id, ticket_id, rank AS retrieval_rank,
      len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS rerank_score FROM sets),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retrieval_rank) AS rank
      FROM scored)
    SELECT query_id, ticket_id, retrieval_rank, round(rerank_score, 6) AS rerank_score, rank FROM ranked WHERE rank <= 5""",
)
def _(spark, d):
    asked, corpus, index = open_tickets(spark, d)
    scorer = hooks.pair_scorer(load_overlap_scorer)
    best = rr.rerank(rt.retrieve_ids(asked, index, 20), asked, corpus, 5, scorer=scorer)
    score = F.round("rerank_score", 6).alias("rerank_score")
    return best.select("query_id", "ticket_id", "retrieval_rank", score, "rank")


def load_confidence_writer():
    def answer(prompts: list[str]) -> list[str]:
        return [f"Confidence: {'high' if 'Ticket 5:' in p else 'low'} ({len(p)} characters)" for p in prompts]

    return answer


@query(
    "hook_generator",
    SOURCES
    + PROMPT_SQL
    + """SELECT query_id, 'Confidence: ' || CASE WHEN contains(prompt, 'Ticket 5:') THEN 'high' ELSE 'low' END
    || ' (' || length(prompt) || ' characters)' AS response FROM prompts""",
)
def _(spark, d):
    asked, corpus, index = open_tickets(spark, d)
    generate = hooks.text_generator(load_confidence_writer)
    return assemble.resolve(asked, corpus, generate=generate, index=index).select("query_id", "response")


# Labels and predictions.


@query("label_encode", TICKETS + "SELECT ticket_id, priority, cast(dense_rank() OVER (ORDER BY priority) - 1 AS integer) AS code FROM tickets")
def _(spark, d):
    return label_encode(tickets(spark, d, "ticket_id", "priority"), "priority")


@query(
    "class_weights",
    TICKETS
    + """, c AS (SELECT priority, count(*) AS n FROM tickets GROUP BY priority)
    SELECT priority, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c""",
)
def _(spark, d):
    weights = class_weights(tickets(spark, d, "priority"), "priority")
    return weights.select("priority", "n", F.round("weight", 6).alias("weight"))


# A rule on hours as a model: urgent tickets are closed fast; open tickets get the usual class.
RULE_SQL = """, predictions AS (SELECT ticket_id, priority AS truth,
      CASE WHEN time_to_resolution_hours < 8 THEN 'Critical' WHEN time_to_resolution_hours < 24 THEN 'High'
        WHEN time_to_resolution_hours < 72 OR time_to_resolution_hours IS NULL THEN 'Medium' ELSE 'Low' END AS prediction
      FROM tickets)
    """


def rule_predictions(spark, d) -> DataFrame:
    hours = F.col("time_to_resolution_hours")
    rule = (
        F.when(hours < 8, "Critical").when(hours < 24, "High").when((hours < 72) | hours.isNull(), "Medium").otherwise("Low")
    )
    return tickets(spark, d, "ticket_id", "priority", "category", "time_to_resolution_hours").select(
        "ticket_id", "category", F.col("priority").alias("truth"), rule.alias("prediction")
    )


@query("clf_accuracy", TICKETS + RULE_SQL + "SELECT round(avg(cast(truth = prediction AS integer)), 6) AS accuracy, count(*) AS n FROM predictions")
def _(spark, d):
    return metrics.accuracy(rule_predictions(spark, d))


SCORES_CTE = """, labels_seen AS (SELECT truth AS label FROM predictions UNION SELECT prediction FROM predictions),
    per AS (SELECT l.label, count(*) FILTER (p.truth = l.label AND p.prediction = l.label) AS tp,
      count(*) FILTER (p.prediction = l.label) AS predicted, count(*) FILTER (p.truth = l.label) AS support
      FROM labels_seen l CROSS JOIN predictions p GROUP BY l.label),
    class_scores AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
      CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
      CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM per)
    """


@query(
    "clf_f1_weighted",
    TICKETS + RULE_SQL + SCORES_CTE + "SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM class_scores",
)
def _(spark, d):
    return metrics.weighted_f1(rule_predictions(spark, d))


@query(
    "clf_report",
    TICKETS
    + RULE_SQL
    + SCORES_CTE
    + """, a AS (SELECT sum(tp) / sum(support) AS accuracy FROM class_scores)
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      cast(support AS bigint) AS support FROM class_scores
    UNION ALL SELECT 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6),
      (SELECT cast(sum(support) AS bigint) FROM class_scores) FROM a
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
      cast(sum(support) AS bigint) FROM class_scores
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
      round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
      cast(sum(support) AS bigint) FROM class_scores""",
)
def _(spark, d):
    return metrics.report(rule_predictions(spark, d))


@query("confusion_matrix", TICKETS + RULE_SQL + "SELECT truth, prediction, count(*) AS n FROM predictions GROUP BY truth, prediction")
def _(spark, d):
    return metrics.confusion(rule_predictions(spark, d))


def _compare_sql() -> str:
    parts, names = "", []
    for model, target, prediction in (
        ("majority", "priority", "(SELECT priority FROM tickets GROUP BY priority ORDER BY count(*) DESC, priority DESC LIMIT 1)"),
        ("hours rule", "priority", None),
        ("majority", "category", "(SELECT category FROM tickets GROUP BY category ORDER BY count(*) DESC, category DESC LIMIT 1)"),
    ):
        i = len(names)
        source = "predictions" if prediction is None else f"(SELECT {target} AS truth, {prediction} AS prediction FROM tickets)"
        parts += f""", p{i} AS (SELECT truth, prediction FROM {source}),
    l{i} AS (SELECT truth AS label FROM p{i} UNION SELECT prediction FROM p{i}),
    s{i} AS (SELECT l.label, count(*) FILTER (p.truth = l.label AND p.prediction = l.label) AS tp,
      count(*) FILTER (p.prediction = l.label) AS predicted, count(*) FILTER (p.truth = l.label) AS support
      FROM l{i} l CROSS JOIN p{i} p GROUP BY l.label),
    m{i} AS (SELECT '{model}' AS model, '{target}' AS target, round(sum(tp) / sum(support), 6) AS accuracy,
      round(sum(2 * tp / (predicted + support) * support) / sum(support), 6) AS f1_weighted FROM s{i})"""
        names.append(f"SELECT * FROM m{i}")
    return (
        parts
        + f", models AS ({' UNION ALL '.join(names)}) "
        + "SELECT *, round(f1_weighted - min(f1_weighted) OVER (PARTITION BY target), 6) AS f1_lead FROM models"
    )


@query("model_comparison", TICKETS + RULE_SQL + _compare_sql())
def _(spark, d):
    rows = cut_lineage(rule_predictions(spark, d), "predictions")

    def named(df, model, target):
        return df.select(F.lit(model).alias("model"), F.lit(target).alias("target"), "truth", "prediction")

    def majority(target, column):
        usual = profile.majority_baseline(rows, column).select("label").scalar()
        return named(rows.select(F.col(column).alias("truth"), usual.alias("prediction")), "majority", target)

    runs = named(rows, "hours rule", "priority").unionByName(majority("priority", "truth"))
    return metrics.compare_models(runs.unionByName(majority("category", "category")))


# Trained models. They match in objective, not in bits, so these queries have no SQL.


LABELS = ("category", "priority")


def training_tables(spark, d) -> tuple[DataFrame, DataFrame, TfidfVocabulary]:
    """Clean tickets split 80/20, with features from the training words only."""
    rows = clean_tickets(tickets(spark, d, "doc_id", "ticket_id", "description", "category", "priority", "status", "subject", "resolution"))
    rows = cut_lineage(rows.select("ticket_id", "description", "category", "priority", "status"), "clean-tickets")
    split = sampling.split(rows)  # a comparison with the cut, row by row, so the texts are not written again
    words = TfidfVocabulary.fit(split.filter("NOT is_test"), "description")
    features = words.vectors(split, "description")
    return features.filter("NOT is_test"), features, words


def fit(train: DataFrame, words: TfidfVocabulary, label: str, balanced: bool = False) -> TicketClassifier:
    return TicketClassifier.fit(train, label, features=train, words=words, balanced=balanced)


def fit_all(train: DataFrame, words: TfidfVocabulary, *targets: tuple[str, bool]) -> list[TicketClassifier]:
    """One model per ``(label, balanced)``, trained side by side: their many short jobs leave cores idle."""
    with ThreadPoolExecutor(len(targets)) as pool:
        return list(pool.map(lambda target: fit(train, words, *target), targets))


def quality(model: TicketClassifier, rows: DataFrame, label: str, name: str) -> DataFrame:
    predicted = model.score(rows, "guess").select(F.col(label).alias("truth"), F.col("guess").alias("prediction"))
    return predicted.select(F.lit(name).alias("model"), F.lit(label).alias("target"), "truth", "prediction")


_TRAINED: dict[tuple[str, str], tuple[DataFrame, TfidfVocabulary, dict[str, str]]] = {}


def trained(spark, d) -> tuple[DataFrame, TfidfVocabulary, dict[str, str]]:
    """Features of all clean tickets, the vocabulary and the folders of both saved models.

    Trained once for a session and data folder; whoever scores loads the saved models.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _TRAINED:
        train, rows, words = training_tables(spark, d)
        paths = {}
        for label, model in zip(LABELS, fit_all(train, words, *[(label, False) for label in LABELS])):
            paths[label] = fresh_path(spark, f"model-{label}")
            model.save(paths[label])
        _TRAINED[key] = rows, words, paths
    return _TRAINED[key]


def saved_models(spark, d) -> tuple[DataFrame, list[TicketClassifier]]:
    rows, _words, paths = trained(spark, d)
    return rows, [TicketClassifier.load(spark, paths[label]) for label in LABELS]


def majority_runs(rows: DataFrame, label: str) -> DataFrame:
    usual = profile.majority_baseline(rows.filter("NOT is_test"), label).select("label").scalar()
    named = [F.lit("majority").alias("model"), F.lit(label).alias("target")]
    return rows.filter("is_test").select(*named, F.col(label).alias("truth"), usual.alias("prediction"))


def runs_of(spark, d, labels) -> DataFrame:
    """Predictions of the saved models and of the majority on the held-out tickets."""
    rows, models = saved_models(spark, d)
    out = None
    for label, model in zip(LABELS, models):
        if label in labels:
            run = quality(model, rows.filter("is_test"), label, "tfidf logistic").unionByName(majority_runs(rows, label))
            out = run if out is None else out.unionByName(run)
    return out


@query("classify_fit_eval")
def _(spark, d):
    return metrics.compare_models(runs_of(spark, d, LABELS))


@query(
    "classify_gain",
    TICKETS + CLEAN_CTE + "SELECT 'category' AS target, cast(ceil(0.2e0 * count(*)) AS bigint) AS n, true AS above_majority FROM clean",
)
def _(spark, d):
    """What SQL can say of the category model: how many tickets it is tested on, and that it beats the majority."""
    right = F.avg((F.col("truth") == F.col("prediction")).cast("int"))
    by_model = runs_of(spark, d, ["category"]).groupBy("model", "target").agg(right.alias("accuracy"), F.count("*").alias("n"))
    best = F.max_by("model", "accuracy") == "tfidf logistic"
    return by_model.groupBy("target").agg(F.max("n").alias("n"), best.alias("above_majority"))


@query("classify_weighted")
def _(spark, d):
    rows, words, paths = trained(spark, d)
    train, test = rows.filter("NOT is_test"), rows.filter("is_test")
    plain, balanced = TicketClassifier.load(spark, paths["priority"]), fit(train, words, "priority", balanced=True)
    runs = quality(plain, test, "priority", "plain").unionByName(quality(balanced, test, "priority", "balanced"))
    return metrics.compare_models(runs)


def score_both(features: DataFrame, category: TicketClassifier, priority: TicketClassifier) -> DataFrame:
    """Label, confidence and scores for both targets."""
    return priority.score(category.score(features.select("ticket_id", "features"), "category"), "priority")


def classify_both(features: DataFrame, category: TicketClassifier, priority: TicketClassifier) -> DataFrame:
    """The same with the scores as JSON text."""
    return score_both(features, category, priority).select(
        "ticket_id",
        "category",
        "priority",
        "category_confidence",
        "priority_confidence",
        F.to_json("category_scores").alias("category_scores"),
        F.to_json("priority_scores").alias("priority_scores"),
    )


@query("classify_batch")
def _(spark, d):
    rows, models = saved_models(spark, d)
    return classify_both(rows, *models)


@query(
    "classify_checks",
    TICKETS
    + CLEAN_CTE
    + """SELECT ticket_id, label, true AS known, true AS adds_up, true AS is_largest
    FROM clean CROSS JOIN (VALUES ('category'), ('priority')) AS l(label)""",
)
def _(spark, d):
    """What SQL can say of every score: a known class, probabilities that add up, the largest one as confidence."""
    rows, models = saved_models(spark, d)
    scored = score_both(rows, *models)
    parts = []
    for label, model in zip(LABELS, models):
        scores = F.map_values(f"{label}_scores")
        total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
        parts.append(
            F.struct(
                F.lit(label).alias("label"),
                F.col(label).isin(model.labels).alias("known"),
                (F.abs(total - 1) <= 0.0005 * len(model.labels) + 1e-9).alias("adds_up"),
                (F.col(f"{label}_confidence") == F.array_max(scores)).alias("is_largest"),
            )
        )
    return scored.select("ticket_id", F.inline(F.array(*parts)))


# Requests in, results out.


def asked_requests(spark, d) -> DataFrame:
    """Conversation turns as parsed request bodies, with an id and an error where there is no description."""
    parsed = requests.parse_requests(request_bodies(spark, d))
    request_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return cut_lineage(parsed.select(request_id.alias("request_id"), "description", "error"), "requests")


def classify_requests(asked: DataFrame, words: TfidfVocabulary, models: list[TicketClassifier]) -> DataFrame:
    """``request_id, description, error`` with both labels and ``result``: scores as JSON, or the error as JSON."""
    texts = asked.filter("error IS NULL").select(F.col("request_id").alias("ticket_id"), tx.clean_text("description").alias("description"))
    found = score_both(words.vectors(texts, "description"), *models).withColumnRenamed("ticket_id", "request_id")
    joined = asked.join(found.drop("features"), "request_id", "left")
    return requests.render_results(joined, *[f"{label}{part}" for label in LABELS for part in ("", "_confidence", "_scores")])


REQUESTS_SQL = f""", turns AS (SELECT conv_id || '-' || turn AS request_id, CASE WHEN role <> 'system' THEN text END AS t
      FROM conversations),
    parsed AS (SELECT request_id, t AS description, CASE WHEN t IS NULL
      OR length(regexp_replace(t, '^{WS_SQL}|{WS_SQL}$', '', 'g')) = 0 THEN '{MISSING_DESCRIPTION.replace("'", "''")}' END AS error
      FROM turns)
    """


@query(
    "classify_requests",
    TICKETS + REQUESTS_SQL + "SELECT request_id, error, error IS NULL AS answered, error IS NULL AS known FROM parsed",
)
def _(spark, d):
    """One result for each request; ``known`` if its JSON names a class of both models."""
    _rows, words, _paths = trained(spark, d)
    _rows, models = saved_models(spark, d)
    out = classify_requests(asked_requests(spark, d), words, models)
    named = [F.get_json_object("result", f"$.{label}").isin(m.labels) for label, m in zip(LABELS, models)]
    answered = F.get_json_object("result", "$.error").isNull()
    return out.select("request_id", "error", answered.alias("answered"), F.coalesce(named[0] & named[1], F.lit(False)).alias("known"))


@query(
    "resolve_requests",
    VECTORS
    + REQUESTS_SQL
    + encode_sql(
        "rq", f"SELECT request_id AS ticket_id, '{QUERY_PREFIX}' || description AS description FROM parsed WHERE error IS NULL", fitted="enc"
    )
    + """, rqv AS (SELECT r.ticket_id, r.vector, p.description FROM rq r JOIN parsed p ON p.request_id = r.ticket_id)"""
    + retrieve_sql("h", "rqv", "corpus", 20)
    + bm25_sql("h", "rqv", 5)
    + """, best AS (SELECT r.query_id, r.rank, coalesce(c.resolution, '') AS resolution, r.ticket_id
      FROM reranked r JOIN corpus c ON c.ticket_id = r.ticket_id)
    SELECT p.request_id, p.error, CASE WHEN p.error IS NULL THEN coalesce(max(b.resolution) FILTER (b.rank = 1), '') END
      AS response, CASE WHEN p.error IS NULL THEN count(b.rank) END AS n_sources,
      CASE WHEN p.error IS NULL THEN coalesce(string_agg(b.ticket_id, ',' ORDER BY b.rank), '') END AS source_ids
    FROM parsed p LEFT JOIN best b ON b.query_id = p.request_id GROUP BY p.request_id, p.error""",
)
def _(spark, d):
    """Every request answered from the index of the resolved tickets, asked with the request's prefixed text."""
    index = ticket_index(spark, d)
    asked = asked_requests(spark, d)
    texts = asked.filter("error IS NULL").select(F.col("request_id").alias("query_id"), F.col("description").alias("query"))
    corpus = load_corpus(stored_tickets(spark, d))
    answers = assemble.resolve(index.encode(texts), corpus, index=index.store, scorer=index.postings.score).select(
        F.col("query_id").alias("request_id"),
        "response",
        F.size("sources").alias("n_sources"),
        F.array_join(F.transform("sources", lambda s: s["ticket_id"]), ",").alias("source_ids"),
    )
    result = requests.render_results(asked.join(answers, "request_id", "left"), "response", "source_ids")
    shown = lambda name: F.get_json_object("result", f"$.{name}").alias(name)
    return result.select("request_id", "error", shown("response"), "n_sources", shown("source_ids"))
