import json

from pyspark.sql import functions as F

from __spark_entry__ import queries
from ticketlake import session
from ticketlake.operators import metrics
from ticketlake.operators.classify import TicketClassifier, class_weights, label_encode
from ticketlake.plans import text
from ticketlake.plans.text import classify_requests


def rows(spark):
    texts = {"net": "vpn router link drops {}", "mail": "mail inbox outlook sync {}", "print": "printer paper tray jam {}"}
    data = [(f"T{i}{k}", t.format(i % 5), k) for k, t in texts.items() for i in range(12 if k == "net" else 6)]
    return spark.createDataFrame(data, "ticket_id string, description string, category string")


def test_fit_predict_save_load(spark):
    df = rows(spark)
    model = TicketClassifier.fit(df, "category", c=10.0, max_iter=50)
    assert model.labels == ["mail", "net", "print"]
    out = model.predict(df.withColumnRenamed("category", "truth"), "label_")
    assert metrics.accuracy(out.select("truth", F.col("label_").alias("prediction"))).first()["accuracy"] == 1.0
    row = out.first()
    assert abs(sum(row["label__scores"].values()) - 1) < 0.01
    assert row["label__confidence"] == max(row["label__scores"].values())
    path = session.fresh_path(spark, "model-test")
    model.save(path)
    again = TicketClassifier.load(spark, path).predict(df.drop("category"), "p").collect()
    assert {r["ticket_id"]: r["p"] for r in again} == {r["ticket_id"]: r["label_"] for r in out.collect()}


def test_texts_are_written_once_for_training(spark, monkeypatch):
    made = [(i, f"T{i}", f"printer {i} prints no page of {'tray ' * 20}", "print", "Low", "Open", "s", "r") for i in range(23)]
    names = "doc_id long, ticket_id string, description string, category string, priority string, status string, subject string, resolution string"
    written = []

    def noted(df, name):
        written.extend([name] * ("description" in df.columns))
        return session.cut_lineage(df, name)

    monkeypatch.setattr(text, "tickets", lambda spark, d, *columns: spark.createDataFrame(made, names))
    monkeypatch.setattr(text, "cut_lineage", noted)
    train, features, _words = text.training_tables(spark, "nowhere")
    assert written == ["clean-tickets"]
    assert (features.count(), train.count()) == (23, 18)  # ceil(4.6) are for the test
    assert {r["ticket_id"] for r in train.collect()} == {r["ticket_id"] for r in features.filter("NOT is_test").collect()}


def test_unknown_words_still_get_a_class(spark):
    model = TicketClassifier.fit(rows(spark), "category", max_iter=20)
    odd = spark.createDataFrame([("X", "zzz qqq"), ("Y", "")], "ticket_id string, description string")
    assert {r["p"] for r in model.predict(odd, "p").collect()} == {"net"}  # the largest class


def test_weights_and_codes(spark):
    df = rows(spark)
    weights = {r["category"]: r["weight"] for r in class_weights(df, "category").collect()}
    assert weights == {"net": 24 / 36, "mail": 24 / 18, "print": 24 / 18}
    codes = {r["category"]: r["code"] for r in label_encode(df, "category").collect()}
    assert codes == {"mail": 0, "net": 1, "print": 2}
    balanced = TicketClassifier.fit(df, "category", max_iter=20, balanced=True)
    assert balanced.labels == ["mail", "net", "print"]


def test_classification_queries(spark, sf_dir):
    """The queries that SQL cannot state, on the smallest tables: whole tables, known classes, sound scores."""
    named = queries()
    tickets = {r["ticket_id"] for r in named["clean_tickets"](spark, sf_dir).collect()}
    batch = named["classify_batch"](spark, sf_dir).collect()
    assert {r["ticket_id"] for r in batch} == tickets and len(batch) == len(tickets)
    for r in batch:
        for label in ("category", "priority"):
            scores = json.loads(r[f"{label}_scores"])
            assert r[label] in scores and r[f"{label}_confidence"] == max(scores.values())
    stream = {r["ticket_id"]: r for r in named["stream_classify"](spark, sf_dir).collect()}
    opened = {r["ticket_id"] for r in named["filter_open_tickets"](spark, sf_dir).collect()}
    assert set(stream) == opened
    same = [r for r in batch if r["ticket_id"] in stream]
    assert same and all(stream[r["ticket_id"]]["category"] == r["category"] for r in same)
    runs = {(r["model"], r["target"]): r for r in named["classify_fit_eval"](spark, sf_dir).collect()}
    assert runs["tfidf logistic", "category"]["accuracy"] > runs["majority", "category"]["accuracy"]
    assert {r["model"] for r in named["classify_weighted"](spark, sf_dir).collect()} == {"plain", "balanced"}


def test_requests_keep_errors(spark):
    model = TicketClassifier.fit(rows(spark), "category", max_iter=20)
    asked = spark.createDataFrame(
        [("1", "printer  paper jam", None), ("2", None, "missing")], "request_id string, description string, error string"
    )
    out = {r["request_id"]: json.loads(r["result"]) for r in classify_requests(asked, model.words, [model, model]).collect()}
    assert out["1"]["category"] == "print" and out["2"] == {"error": "missing"}
