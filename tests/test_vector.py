import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import retrieve as rt
from ticketlake.operators import vector
from ticketlake.plans import QUERIES
from ticketlake.session import cut_lineage, drop_folder, fresh_path
from ticketlake.sources.index import VectorIndex


def make(spark, matrix, name):
    rows = [(f"{name[0]}{i:04d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} string, vector array<float>")


def brute(queries, corpus, k):
    out = []
    for qi, q in enumerate(queries.astype(np.float32).astype(float)):
        d = ((corpus.astype(np.float32).astype(float) - q) ** 2).sum(1)
        for rank, ci in enumerate(np.lexsort((np.arange(len(d)), d))[:k], 1):
            out.append((f"q{qi:04d}", rank, f"n{ci:04d}", round(float(d[ci]), 6)))
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["neighbour_id"], round(r["distance"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 4
    corpus = np.vstack([centres[rng.integers(6, size=400)] + rng.normal(size=(400, 8)), np.tile(centres[0], (200, 1))])
    return centres[rng.integers(6, size=60)] + rng.normal(size=(60, 8)), corpus


@pytest.mark.parametrize("n_cells, block_rows", [(None, 4096), (1, 4096), (1, 37), (10, 4096), (10, 23), (120, 11)])
def test_exact_equals_brute_force(spark, points, n_cells, block_rows):
    """One cell or many, small blocks, and a third of the corpus being copies of one vector."""
    queries, corpus = points
    hits = vector.knn_exact(
        make(spark, queries, "query_id"), make(spark, corpus, "neighbour_id"), 7, n_cells=n_cells, block_rows=block_rows
    )
    assert got(hits) == brute(queries, corpus, 7)


def test_tiles_within_a_block(spark, points, monkeypatch):
    monkeypatch.setattr(vector, "TILE_ROWS", 16)
    queries, corpus = points
    hits = vector.knn_exact(make(spark, queries, "query_id"), make(spark, corpus, "neighbour_id"), 7)
    assert got(hits) == brute(queries, corpus, 7)


def test_fewer_rows_than_k(spark, points):
    queries, corpus = points
    for n_cells in (1, 3):
        hits = vector.knn_exact(
            make(spark, queries[:5], "query_id"), make(spark, corpus[:6], "neighbour_id"), 9, n_cells=n_cells
        )
        assert got(hits) == brute(queries[:5], corpus[:6], 9)


def test_empty_corpus(spark, points):
    empty = make(spark, points[1], "neighbour_id").filter("false")
    assert vector.knn_exact(make(spark, points[0], "query_id"), empty, 3).count() == 0


def test_self_query_is_first(spark, points):
    corpus = points[1][:300]
    hits = vector.knn_exact(make(spark, corpus, "query_id"), make(spark, corpus, "neighbour_id"), 1)
    assert all(r["query_id"][1:] == r["neighbour_id"][1:] and r["distance"] == 0 for r in hits.collect())


def test_recall_of_approximations(spark, points):
    queries, corpus = make(spark, points[0], "query_id"), make(spark, points[1][:400], "neighbour_id")
    exact = vector.knn_exact(queries, corpus, 5).persist()
    cells = vector.knn_cells(queries, corpus, 5, n_cells=6, n_probe=3, block_rows=50)
    lsh = vector.knn_lsh(queries, corpus, 5, width=8.0, tables=16, projections=3, block_rows=50)
    for found in (cells, lsh):
        assert vector.recall_at_k(found, exact).first()["recall"] > 0.9
        assert found.groupBy("query_id", "neighbour_id").count().filter("count > 1").count() == 0
        assert found.count() == exact.count()


def test_short_lists_are_filled_up(spark, points):
    """One probed cell, and steps so narrow that nothing meets, still give k rows each."""
    queries, corpus = points[0][:20], points[1]
    q, c = make(spark, queries, "query_id"), make(spark, corpus, "neighbour_id")
    assert got(vector.knn_lsh(q, c, 7, width=1e-6)) == brute(queries, corpus, 7)
    assert vector.knn_cells(q, c, 300, n_cells=30, n_probe=1).count() == 20 * 300
    assert got(vector.knn_cells(q, c, 7, n_cells=9, n_probe=9)) == brute(queries, corpus, 7)


def test_stored_cells_are_opened_and_read_in_part(spark):
    """Three far groups: a query near one gets its exact neighbours although the other groups' cells are gone."""
    rng = np.random.default_rng(5)
    corpus = np.vstack([rng.normal(size=(80, 8)) + 1000 * i for i in range(3)])
    path = fresh_path(spark, "cells-test")
    vector.Cells.build(make(spark, corpus, "neighbour_id"), 12, path)
    cells = vector.Cells.open(spark, path)
    queries = rng.normal(size=(5, 8))
    near = {r["cell"] for r in cells.rows.filter("neighbour_id < 'n0080'").select("cell").distinct().collect()}
    every = {r["cell"] for r in cells.rows.select("cell").distinct().collect()}
    assert len(near) < len(every)
    for cell in every - near:
        drop_folder(spark, f"{path}/rows/cell={cell}")
    for _ in range(2):
        assert got(cells.search(make(spark, queries, "query_id"), 7)) == brute(queries, corpus, 7)


def test_index_is_asked_with_texts_and_filters(spark):
    rows = tickets(spark).drop("vector").withColumn("description", F.concat(F.lit("vpn printer mail "), "ticket_id"))
    rows = rows.withColumn("status", F.lit("Closed")).withColumn("satisfaction_rating", F.lit(None).cast("double"))
    path = fresh_path(spark, "index-test")
    VectorIndex.build(cut_lineage(rows, "rows"), path)
    asked = spark.createDataFrame([("q", "mail T4"), ("none", "")], "query_id string, query string")
    index = VectorIndex.open(spark, path)
    hits = index.search(asked, 3, where={"department": "IT"}).collect()
    assert {r["ticket_id"] for r in hits if r["query_id"] == "q"} == {"T3", "T4", "T5"} and len(hits) == 6
    assert min((r for r in hits if r["query_id"] == "q"), key=lambda r: r["rank"])["ticket_id"] == "T4"
    assert index.search(asked, 3, where={"department": "nobody"}).count() == 0


def test_cells_grow_with_the_corpus():
    assert [vector.cells_for(n) for n in (0, 500, 10**6, 10**10)] == [1, 3, 126, 12501]


def tickets(spark):
    rows = [
        ("T1", [0.0], " same ", "HR"),
        ("T2", [1.0], "same", "HR"),
        ("T3", [2.0], None, "IT"),
        ("T4", [3.0], "", "IT"),
        ("T5", [4.0], "other", "IT"),
    ]
    df = spark.createDataFrame(rows, "ticket_id string, vector array<float>, resolution string, department string")
    for c in ("subject", "category", "sub_category", "priority"):
        df = df.withColumn(c, F.lit(c))
    return df


def test_retrieve_dedupes_after_overfetch(spark):
    asked = spark.createDataFrame([("q", [0.0])], "query_id string, vector array<float>")
    hits = rt.retrieve(asked, tickets(spark), 3).orderBy("rank").collect()
    assert [(r["rank"], r["ticket_id"]) for r in hits] == [(1, "T1"), (2, "T3"), (3, "T5")]
    assert hits[1]["resolution"] == ""
    # three over-fetched rows hold only two distinct resolutions
    assert rt.retrieve(asked, tickets(spark), 1).count() == 1
    assert rt.retrieve(asked, tickets(spark), 3, where={"department": "HR"}).count() == 1
    assert rt.retrieve(asked, tickets(spark), 3, where={"department": "none"}).count() == 0


def test_hot_keys_are_split_by_adaptive_execution(spark):
    """A ticket that is close to very many queries: the final plan splits its rows, and they stay the same."""
    hits = spark.range(200_000).select(
        F.col("id").alias("query_id"),
        F.when(F.col("id") % 3 > 0, "T1").otherwise(F.concat(F.lit("T"), F.col("id") % 50)).alias("ticket_id"),
    )
    fields = ["subject", "category"]
    corpus = spark.createDataFrame([(f"T{i}", f"T{i}", "c") for i in range(50)], "ticket_id string, subject string, category string")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = rt.attach_fields(hits, corpus, fields)
        counts = {r["ticket_id"]: r["n"] for r in joined.groupBy("ticket_id", "subject").agg(F.count("*").alias("n")).collect()}
        joined.write.format("noop").mode("overwrite").save()
        plain = joined.select("query_id", "subject")
        plain.collect()
        assert "skew=true" in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(counts.values()) == 200_000 and counts["T1"] > 130_000


def test_visits_are_a_list_for_each_query(spark, points, monkeypatch):
    """A query that may visit every cell is written once, not once for each cell."""
    rows = {}

    def counted(df, name):
        written = cut_lineage(df, name)
        rows.setdefault(name, []).append(written.count())
        return written

    monkeypatch.setattr(vector, "cut_lineage", counted)
    queries, corpus = points
    hits = vector.knn_exact(make(spark, queries, "query_id"), make(spark, corpus, "neighbour_id"), 7, n_cells=40)
    assert got(hits) == brute(queries, corpus, 7)
    assert rows["visits"] == [len(queries)] * 2


def test_rows_are_placed_in_one_pass(spark, points):
    """Looking for the nearest centres is one Python step, though every row becomes several."""
    queries, _corpus = points
    placed = vector._to_cells(make(spark, queries, "query_id"), queries[:5], 3)
    assert placed.count() == 3 * len(queries)
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize("spans", [None, [(0, 0, 900), (1, 900, 1500)]])
def test_nearest_rows_by_runs_and_few_pairs_at_once(points, monkeypatch, spans):
    """Ties, runs of rows that not all are compared with, and pruning after every tile give the same rows."""
    rng = np.random.default_rng(5)
    q, c = rng.integers(0, 3, (30, 4)).astype(float), rng.integers(0, 3, (1500, 4)).astype(float)
    monkeypatch.setattr(vector, "TILE_ROWS", 64)
    monkeypatch.setattr(vector, "PAIRS_AT_ONCE", 50)
    order = rng.permutation(1500)
    # the first run is asked by the even rows, the second by all but row 0
    asking = None if spans is None else [(np.arange(first, 30, 2 - first), a, b) for first, a, b in spans]
    row, col, distance = vector._nearest_rows(q, c, 9, None, order, asking)
    away = ((q[:, None, :] - c[None, :, :]) ** 2).sum(2)
    if spans is not None:
        away[1::2, :900] = away[0, 900:] = np.inf
    for i in range(30):
        best = np.lexsort((order, away[i]))[:9]
        assert col[row == i].tolist() == best.tolist() and distance[row == i].tolist() == away[i][best].tolist()


def test_pairs_are_measured_in_small_runs():
    q, c = np.random.default_rng(0).normal(size=(2, 64, 256))
    row, col = (x.ravel() for x in np.indices((64, 64)))
    tracemalloc.start()
    found = vector._measured(q, c, np.tile(row, 4), np.tile(col, 4))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    assert (found.reshape(4, 64, 64) == np.cumsum((q[:, None] - c[None]) ** 2, axis=2)[:, :, -1]).all()


def test_lsh_is_asked_by_every_row_over_all_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 64))
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    points[1::20] = points[::20]  # copies that ask as well
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)] + [(None, points[0].tolist(), 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    hits = QUERIES["knn_lsh"](spark, str(tmp_path)).collect()
    asked = [-1 if r["query_id"] is None else r["query_id"] for r in hits]
    assert sorted(asked) == sorted(list(range(-1, 400)) * 10)
    copies = {(i, i + 1) for i in range(0, 400, 20)}
    assert {(r["query_id"], r["neighbour_id"]) for r in hits if r["distance"] == 0} >= copies | {(b, a) for a, b in copies}


def test_search_shuffles_neither_vectors_nor_hits(spark, points, monkeypatch):
    """Exact search reads written tables only; what it finds needs no exchange, and distinct hits need none either."""
    queries, corpus = points
    rows = make(spark, corpus, "neighbour_id").withColumn("key", F.substring("neighbour_id", -1, 1))
    cells = vector.Cells.build(rows, 10)
    asked = make(spark, queries, "query_id")
    hits = cells.search(asked, 30, ("key",), distinct=("key", 4))
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString()
    plain = cells.search(asked, 30, ("key",))
    want = vector.first_of_each(plain, "key", 4)
    assert got(hits) == got(want) and got(plain) == brute(queries, corpus, 30)


def test_parts_of_a_corpus_and_repeated_queries(spark, points, monkeypatch):
    """Few queries over many rows are asked in parts; a repeated id has one list."""
    monkeypatch.setattr(vector, "parts_for", lambda *_: 3)
    queries, corpus = points
    rows, asked = make(spark, corpus, "neighbour_id"), make(spark, queries, "query_id")
    assert got(vector.knn_exact(asked, rows, 7, n_cells=10, block_rows=11)) == brute(queries, corpus, 7)
    monkeypatch.undo()
    twice = got(vector.knn_exact(asked.unionByName(asked), rows, 8, n_cells=10))
    assert [x[1] for x in twice] == [x[1] for x in brute(queries, corpus, 8)]
    assert {(x[0], x[2]) for x in twice} == {(x[0], x[2]) for x in brute(queries, corpus, 4)}


@pytest.mark.parametrize("width", [0.5, 30.0])
def test_lsh_in_small_and_in_large_buckets(spark, points, width):
    """Rows of a query's buckets, by distance, whether buckets are dealt out or each pair is looked at once."""
    queries, corpus = points
    rows, asked = make(spark, corpus, "neighbour_id"), make(spark, queries, "query_id")
    hits = got(vector.knn_lsh(asked, rows, 5, width, tables=3, projections=2))
    draw = np.random.default_rng(7)
    lines, shift = draw.standard_normal((8, 6)), draw.random(6)
    steps = [np.floor((x.astype(np.float32).astype(float) @ lines) / width + shift).reshape(-1, 3, 2) for x in (queries, corpus)]
    meet = (steps[0][:, None] == steps[1][None]).all(3).any(2)
    exact = brute(queries, corpus, len(corpus))
    for i in range(len(queries)):
        mine = [x for x in exact if x[0] == f"q{i:04d}"]
        met = [x for x in mine if meet[i, int(x[2][1:])]][:5]
        want = met if len(met) == 5 else mine[:5]
        assert [(x[2], x[3]) for x in hits if x[0] == f"q{i:04d}"] == [(x[2], x[3]) for x in want]


@pytest.mark.parametrize("scale, kind", [(1.0, np.float32), (1e3, np.float32), (1e20, np.float64)])
def test_rough_distances_drop_no_near_row(scale, kind):
    """Far from the origin and beyond what single precision holds, all rows within the bound are among the pairs."""
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(2, 300, 16)) * scale + 50 * scale
    side = vector._Side(c, c[0])
    assert side.kind == kind
    away = ((q[:, None] - c[None]) ** 2).sum(2)
    bound = np.sort(away, axis=1)[:, 9]
    row, col, _bound = side.near(q, bound, 10)
    assert set(zip(*np.nonzero(away <= bound[:, None]))) <= set(zip(row, col)) and len(row) < 3200
