"""The stored corpus: codes, versions, updates that leave other files alone, and what it is asked for."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import codes
from ticketlake.operators.vector import knn_exact, recall_at_k
from ticketlake.session import cut_lineage, folders, fresh_path
from ticketlake.sources.cellstore import CellStore, train_centres

from test_vector import got, make


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16)) * 3
    corpus = np.vstack([centres[rng.integers(12, size=1500)] + rng.normal(size=(1500, 16)), np.tile(centres[0], (100, 1))])
    return centres[rng.integers(12, size=80)] + rng.normal(size=(80, 16)), corpus


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rebuilt(spark, rows, queries, k):
    return got(knn_exact(make(spark, queries, "query_id"), rows, k))


def test_codes_bound_the_distance():
    rng = np.random.default_rng(1)
    c = np.vstack([rng.normal(size=(300, 24)), np.zeros((3, 24)), np.tile(rng.normal(size=24), (20, 1)), 1e6 + rng.normal(size=(5, 24))])
    q = np.vstack([c[:20], rng.normal(size=(20, 24)), np.zeros((1, 24)), c[-1:]])
    centres = train_centres(c, 7)
    cell = ((c[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    code, step, lost = codes.encode(c, centres, cell)
    back = np.stack([np.frombuffer(b, np.int8) for b in code]) * step[:, None] + centres[cell]
    assert (np.linalg.norm(back - c, axis=1) <= lost * (1 + 1e-9) + 1e-9).all()
    true = np.sqrt(((q[:, None] - c[None]) ** 2).sum(2))
    for k in (1, 5, 40, 1000):
        row, col, low, high = codes.near(q, back, lost, k)
        assert (low <= true[row, col] + 1e-9).all() and (true[row, col] <= high + 1e-9).all()
        found = set(zip(row.tolist(), col.tolist(), strict=True))
        assert all((i, j) in found for i in range(len(q)) for j in np.argsort(true[i], kind="stable")[:k])


def test_rows_are_coded_once(spark, points, tmp_path, monkeypatch):
    """Spark does not call the coding a second time to find out which rows have none."""

    def counted(vectors, centres, cell, encode=codes.encode):
        with open(tmp_path / "coded", "a") as log:
            log.write("x" * len(vectors))
        return encode(vectors, centres, cell)

    monkeypatch.setattr(codes, "encode", counted)
    store = CellStore.build(make(spark, points[1], "neighbour_id"), fresh_path(spark, "coded-once"))
    assert store.count() == len(points[1])
    assert (tmp_path / "coded").stat().st_size == len(points[1])


def test_few_pairs_are_left_on_ticket_vectors(spark, sf_dir):
    """High-dimensional vectors, where no cell can be ruled out: the codes leave under a tenth of the pairs."""
    from ticketlake.operators.features import with_vectors

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    v = np.array([r["vector"] for r in with_vectors(docs, "doc_id", "text").collect()], dtype=np.float64)
    centres = v.mean(0)[None]
    code, step, lost = codes.encode(v, centres, np.zeros(len(v), int))
    back = np.stack([np.frombuffer(b, np.int8) for b in code]) * step[:, None] + centres[0]
    row, col, _, _ = codes.near(v, back, lost, 10)
    assert len(row) < 0.1 * len(v) ** 2


@pytest.mark.parametrize("block_rows", [4096, 37])
def test_all_cells_probed_are_exact(spark, points, block_rows):
    queries, corpus = points
    rows = make(spark, corpus, "neighbour_id")
    store = CellStore.build(rows, fresh_path(spark, "store"), 9)
    asked = make(spark, queries, "query_id")
    want = rebuilt(spark, rows, queries, 7)
    assert got(store.search(asked, 7, n_probe=9, block_rows=block_rows)) == want
    assert got(store.search(asked, 7, block_rows=block_rows)) == want
    assert store.count() == 1600


def test_probes_come_from_the_measured_curve(spark, points):
    queries, corpus = points
    rows = make(spark, corpus, "neighbour_id")
    store = CellStore.build(rows, fresh_path(spark, "store"), 12)
    n_probe = store.tune()
    curve = store.recall_curve()
    assert (curve["recall"].diff().dropna() >= 0).all() and curve["recall"].iloc[-1] == 1
    assert curve.loc[n_probe - 1, "sure"] >= 0.95 and (n_probe == 1 or curve.loc[n_probe - 2, "sure"] < 0.95)
    assert curve.loc[n_probe - 1, "rows"] <= 0.3
    again = CellStore.open(spark, store.path)
    assert again.n_probe() == n_probe
    asked = make(spark, queries, "query_id")
    recall = recall_at_k(again.search(asked, 10, n_probe=n_probe), knn_exact(asked, rows, 10)).first()["recall"]
    assert recall >= 0.9


def test_updates_leave_other_files_alone(spark, points):
    """Searches after updates equal those of a store built anew; old versions go on answering."""
    queries, corpus = points
    rows = make(spark, corpus, "neighbour_id").withColumn("label", F.lit("old"))
    asked = make(spark, queries, "query_id")
    first = CellStore.build(rows, fresh_path(spark, "store"), 9)
    base = files(first.path)
    moved = make(spark, corpus[::-1][:40] + 0.5, "neighbour_id").withColumn("label", F.lit("new"))  # ids n0000 to n0039
    fresh = make(spark, corpus[:30] * 1.01, "neighbour_id").withColumn("label", F.lit("new")).withColumn("neighbour_id", F.concat(F.lit("x"), "neighbour_id"))
    second = first.upsert(moved.unionByName(fresh), batch="s:0")
    assert second.upsert(moved, batch="s:0") is second  # the batch again
    third = second.upsert(moved.filter("neighbour_id < 'n0010'").withColumn("label", F.lit("newest")), batch="s:1")
    now = files(first.path)
    assert all(now[f] == t for f, t in base.items())

    kept = rows.join(moved.select("neighbour_id"), "neighbour_id", "left_anti").unionByName(moved).unionByName(fresh)
    kept = kept.withColumn("label", F.when(F.col("neighbour_id") < "n0010", "newest").otherwise(F.col("label")))
    want = rebuilt(spark, kept, queries, 7)
    assert got(third.search(asked, 7)) == want == got(third.search(asked, 7, n_probe=9))
    assert got(first.search(asked, 7)) == rebuilt(spark, rows, queries, 7)
    labels = {r["neighbour_id"]: r["label"] for r in third.rows().collect()}
    assert labels == {r["neighbour_id"]: r["label"] for r in kept.collect()} and third.count() == 1630
    hits = third.search(asked, 3, carry=("label",), where={"label": "newest"}).collect()
    assert len(hits) == 240 and all(r["label"] == "newest" and "n0000" <= r["neighbour_id"] < "n0010" for r in hits)

    touched = set(third.manifest.loc[(third.manifest["kind"] == "rows") & (third.manifest["segment"] > 0), "cell"])
    small = third.compact(share=0.9)
    assert small is third or small.count() == 1630
    whole = third.compact(share=0.0)
    written = {c for c in folders(spark, f"{first.path}/rows/segment={whole.version}") if c.startswith("cell=")}
    assert written == {f"cell={int(c)}" for c in touched}
    assert got(whole.search(asked, 7)) == want
    whole.vacuum()
    left = files(first.path)
    assert all(left[f] == t for f, t in base.items() if f in left) and len(left) < len(now)
    assert got(CellStore.open(spark, first.path).search(asked, 7)) == want


def test_a_change_that_breaks_off_is_not_seen(spark, points, monkeypatch):
    queries, corpus = points
    rows = make(spark, corpus[:200], "neighbour_id")
    store = CellStore.build(rows, fresh_path(spark, "store"), 4)
    monkeypatch.setattr(CellStore, "_publish", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.upsert(make(spark, corpus[:50] + 9, "neighbour_id"))
    monkeypatch.undo()
    asked = make(spark, queries, "query_id")
    assert got(CellStore.open(spark, store.path).search(asked, 5)) == rebuilt(spark, rows, queries, 5)
    after = CellStore.open(spark, store.path).upsert(make(spark, corpus[:50] + 9, "neighbour_id"))
    assert after.version == 1 and after.count() == 200


def test_empty_store_and_first_rows(spark, points):
    rows = make(spark, points[1][:20], "neighbour_id")
    store = CellStore.build(rows.filter("false"), fresh_path(spark, "store"))
    asked = make(spark, points[0][:5], "query_id")
    assert store.count() == 0 and store.search(asked, 3).count() == 0
    filled = store.upsert(rows)
    assert got(filled.search(asked, 3)) == rebuilt(spark, rows, points[0][:5], 3)
    assert CellStore.open(spark, store.path).count() == 20
    with pytest.raises(ValueError):
        CellStore.open(spark, fresh_path(spark, "nothing"))


def test_postings_follow_the_index(spark):
    """Scores from stored postings, also after updates, equal those of the texts."""
    from ticketlake.operators.rerank import bm25
    from ticketlake.schema import METADATA_FIELDS
    from ticketlake.sources.index import VectorIndex

    words = "reset the router cable then restart mail client and check vpn".split()
    rng = np.random.default_rng(3)

    def tickets(ids):
        rows = [(f"T{i}", " ".join(rng.choice(words, 6)), " ".join(rng.choice(words, rng.integers(0, 9)))) for i in ids]
        df = spark.createDataFrame(rows, "ticket_id string, description string, resolution string")
        for c in METADATA_FIELDS:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(1.0) if c == "satisfaction_rating" else F.lit(c))
        return cut_lineage(df, "tickets")

    first, second, third = tickets(range(40)), tickets([*range(5, 15), 50, 51]), tickets([6, 50, 60])
    index = VectorIndex.build(first, fresh_path(spark, "postings-index"))
    pairs = spark.createDataFrame([(q, f"T{i}") for q in "ab" for i in range(70)], "query_id string, ticket_id string")
    queries = spark.createDataFrame([("a", "reset the mail client"), ("b", "vpn vpn nothing")], "query_id string, query string")
    same = lambda index, rows: sorted(index.postings.score(pairs, queries, None).collect()) == sorted(bm25(pairs, queries, rows).collect())
    assert same(index, first)
    now = first
    for n, updates in enumerate((second, third)):
        now = now.join(updates.select("ticket_id"), "ticket_id", "left_anti").unionByName(updates)
        before, index = index, index.upsert(updates, batch=f"s:{n}")
        assert same(VectorIndex.open(spark, index.path), now)
        assert index.upsert(updates, batch=f"s:{n}") is index
    assert same(before, first.join(second.select("ticket_id"), "ticket_id", "left_anti").unionByName(second))
    assert same(index.compact(share=0.0), now)


def test_codes_are_compared_in_tiles():
    """A block of any size costs the memory of a tile, not a matrix of all pairs."""
    rng = np.random.default_rng(4)
    q, c, lost = rng.normal(size=(256, 8)), rng.normal(size=(codes.BLOCK_ROWS, 8)), rng.random(codes.BLOCK_ROWS) * 0.01
    tracemalloc.start()
    row, col, _low, _high = codes.near(q, c, lost, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak
    away = np.linalg.norm(q[:5, None, :] - c[None, :, :], axis=2)
    for i in range(5):
        bound = np.sort(away[i] + lost)[9]
        assert set(np.flatnonzero(away[i] - lost <= bound - 1e-6)) <= set(col[row == i].tolist())
        assert set(col[row == i].tolist()) <= set(np.flatnonzero(away[i] - lost <= bound + 1e-6))


def test_copies_of_a_vector_leave_few_pairs(spark):
    """Rows of one text ask and are asked: no more than k of them are left for each, not all."""
    rng = np.random.default_rng(3)
    one = rng.normal(size=16)
    corpus = np.vstack([rng.normal(size=(200, 16)) + 9, np.tile(one, (600, 1)), one + rng.normal(size=(5, 16)) * 1e-4])
    queries = np.vstack([np.tile(one, (40, 1)), rng.normal(size=(10, 16)) + 9])
    rows = make(spark, corpus, "neighbour_id")
    store = CellStore.build(rows, fresh_path(spark, "copies-store"), n_cells=4)
    asked, n = make(spark, queries, "query_id"), len(store.centres)
    few, _rows = store._survivors(asked, 7, None, n)
    assert few.count() <= 50 * 20
    assert got(store.search(asked, 7, n_probe=n)) == rebuilt(spark, rows, queries, 7)
