import csv
import datetime
import gzip
import io
import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlake import session
from ticketlake.plans.text import DIM  # noqa: F401  (the plans import without a session)
from ticketlake.schema import MISSING_DESCRIPTION, TICKET
from ticketlake.sources import csvfiles, index, requests
from ticketlake.streaming import jobs


def test_csv_keeps_quotes_breaks_and_blanks_and_reads_empty_as_null(spark):
    when = datetime.datetime(2024, 2, 29, 0, 0)
    text = ' say "hi",\r\nthen leave '
    row = ("T1", when, None, "c", "s", "Low", "Open", "", text, None, "p", "d", None, 1.5)
    path = session.fresh_path(spark, "csv-test")
    csvfiles.write_tickets(spark.createDataFrame([row], TICKET), path)
    assert tuple(csvfiles.read_tickets(spark, path).first()) == (*row[:7], None, *row[8:])


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.text('a",\n\r é', max_size=9), min_size=2, max_size=2), max_size=6),
    st.integers(1, 40),
    st.sampled_from(["\n", "\r\n"]),
    st.booleans(),
)
def test_csv_ranges_hold_each_record_once(tmp_path_factory, rows, step, line_end, closed):
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator=line_end).writerows([["h", "i"], *rows])
    data = out.getvalue().encode()
    data = data if closed else data.removesuffix(line_end.encode())
    path = tmp_path_factory.mktemp("csv") / "with a blank.csv"
    path.write_bytes(data)
    ranges = [
        {"path": f"file://{path}", "size": len(data), "first": i, "last": min(i + step, len(data)), "quoted": data[:i].count(b'"') % 2 == 1}
        for i in range(0, len(data), step)
    ]
    chunk, csvfiles._CHUNK = csvfiles._CHUNK, 7
    try:
        cut = [r for b in csvfiles._cut_records(iter([pa.RecordBatch.from_pylist(ranges)])) for r in b.column(0).to_pylist()]
    finally:
        csvfiles._CHUNK = chunk
    assert [next(csv.reader(io.StringIO(r, newline=""))) for r in cut] == rows


def test_one_large_quoted_file_is_read_in_many_tasks(spark, tmp_path):
    schema = T.StructType.fromDDL("id int, t string")
    texts = [f'line {i}\nsaid ""x, y""\r\n' * (i % 7) + "end" * (400 if i == 30 else 1) for i in range(60)]
    body = "id,t\r\n" + "".join(f'{i},"{t}"\r\n' for i, t in enumerate(texts))
    (tmp_path / "a file.csv").write_bytes(body.encode())
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "head.csv").write_bytes(b"id,t\n")
    with gzip.open(tmp_path / "b.csv.gz", "wb") as packed:
        packed.write(b'id,t\n100,"x\ny"\n\n101,\nbad,z')
    rows = [(i, t.replace('""', '"')) for i, t in enumerate(texts)]  # line breaks of a field stay as they are
    expected = sorted([*rows, (100, "x\ny"), (101, None), (None, "z")], key=str)
    for range_bytes in (97, 1000, 1 << 20):
        found = csvfiles.read_csv(spark, str(tmp_path), schema, range_bytes)
        assert sorted(map(tuple, found.collect()), key=str) == expected
    counted = csvfiles.read_csv(spark, str(tmp_path / "a file.csv"), schema, 500).groupBy(F.spark_partition_id()).count().collect()
    assert len(counted) > len(body) // 500 // 2 and max(r["count"] for r in counted) < 40


def test_requests(spark):
    bodies = ['{"description": "vpn"}', '{"text": "vpn"}', '{"description": " \\n"}', "not json", None, '{"description": null}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    out = requests.render_results(requests.parse_requests(df), "description").orderBy("i").collect()
    assert [r["error"] for r in out] == [None] + [MISSING_DESCRIPTION] * 5
    assert json.loads(out[0]["result"]) == {"description": "vpn"}
    assert json.loads(out[3]["result"]) == {"error": MISSING_DESCRIPTION}


def test_upsert_last_version_wins(spark):
    schema = "id string, text string, version int"
    old = spark.createDataFrame([("a", "old", 0), ("b", "old", 0)], schema)
    new = spark.createDataFrame([("b", "second", 2), ("b", "first", 1), ("c", "new", 1)], schema)
    out = {r["id"]: r["text"] for r in index.upsert(old, new).collect()}
    assert out == {"a": "old", "b": "second", "c": "new"}


def test_upsert_log_is_idempotent(spark):
    log = index.UpsertLog(spark, session.fresh_path(spark, "log-test"))
    schema = "id string, text string, version int"
    log.write(spark.createDataFrame([("a", "one", 5), ("b", "one", 1)], schema), 0)
    for _ in range(2):  # the second write stands for a retried batch
        log.write(spark.createDataFrame([("a", "two", 1)], schema), 1)
    assert {r["id"]: r["text"] for r in log.read().collect()} == {"a": "two", "b": "one"}
    assert spark.read.parquet(log.compact()).count() == 2


def test_rebuilt_index_replaces_the_old_one(spark):
    from ticketlake.schema import METADATA_FIELDS

    df = spark.createDataFrame([("T1", "d", [1.0]), ("T2", "d", [1.0])], "ticket_id string, description string, vector array<float>")
    for f in METADATA_FIELDS[1:]:
        df = df.withColumn(f, F.lit(None).cast("double" if f == "satisfaction_rating" else "string"))
    path = session.fresh_path(spark, "index-test")
    index.build_index(df, path)
    index.build_index(df.filter("ticket_id = 'T2'"), path)
    row = index.open_index(spark, path).first()
    assert index.open_index(spark, path).count() == 1
    assert (row["id"], row["resolution"], row["satisfaction_rating"]) == ("T2", "", "nan")


def test_stream_equals_batch(spark):
    path = session.fresh_path(spark, "stream-test")
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    df.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = jobs.apply_stream(stream, lambda batch: batch.withColumn("y", F.col("x") * 2), session.fresh_path(spark, "stream-test-out"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.withColumn("y", F.col("x") * 2).collect()))

    empty = session.fresh_path(spark, "stream-empty")
    df.limit(0).write.parquet(empty)
    nothing = jobs.apply_stream(spark.readStream.schema(df.schema).parquet(empty), lambda batch: batch, session.fresh_path(spark, "empty-out"))
    assert nothing.count() == 0 and nothing.columns == df.columns


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get(session.CHECKPOINT_CONF, None) or session.shared_dir(spark)
    assert session.fresh_path(spark, "x").startswith(base)
    assert session.fresh_path(spark, "x") != session.fresh_path(spark, "x")
    with pytest.raises(ValueError):
        session.shared_dir(_Cluster())


class _Cluster:
    """A cluster session that names no shared folder."""

    class conf:
        @staticmethod
        def get(_key, default=None):
            return default

    class sparkContext:
        master = "spark://somewhere:7077"


def test_streams_go_on_where_they_stopped(spark):
    source, place = session.fresh_path(spark, "stream-source"), session.fresh_path(spark, "stream-place")
    seen = []

    def step(batch):
        seen.append(batch.count())
        return batch.withColumn("y", F.col("id") * 2)

    for start in (0, 100):
        spark.range(start, start + 50).write.mode("append").parquet(source)
        out = jobs.apply_stream(spark.readStream.schema("id long").parquet(source), step, place)
    assert sum(seen) == 100 and sorted(r["id"] for r in out.collect()) == [*range(50), *range(100, 150)]


def test_upsert_stream_goes_on_and_compacts(spark):
    source, place = session.fresh_path(spark, "upsert-source"), session.fresh_path(spark, "upsert-place")
    schema = "id string, v string, version int"
    for rows in ([("a", "1", 0), ("b", "1", 0)], [("a", "2", 1)], [("c", "3", 0), ("b", "4", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        out = jobs.upsert_stream(spark.readStream.schema(schema).parquet(source), "id", place)
    log = index.UpsertLog(spark, f"{place}/rows")
    want = {("a", "2"), ("b", "4"), ("c", "3")}
    assert {(r["id"], r["v"]) for r in out.collect()} == want
    assert len(session.folders(spark, f"{place}/rows")) == 3
    log.compact()
    assert session.folders(spark, f"{place}/rows") == ["base=2"]
    assert {(r["id"], r["v"]) for r in log.read().collect()} == want
    log.write(spark.createDataFrame([("a", "5", 0)], schema), 3)
    assert {(r["id"], r["v"]) for r in log.read().collect()} == {("a", "5"), ("b", "4"), ("c", "3")}


def test_late_rows_stay_out_of_closed_windows(spark):
    source, place = session.fresh_path(spark, "late-source"), session.fresh_path(spark, "late-place")
    for stamps in (["2024-01-01 10:00", "2024-01-02 09:00"], ["2024-01-01 11:00", "2024-01-03 12:00"], ["2024-01-05 00:00"]):
        df = spark.createDataFrame([(t,) for t in stamps], "t string").select(F.col("t").cast("timestamp").alias("ts"), F.lit("k").alias("k"))
        df.coalesce(1).write.mode("append").parquet(source)
        counts = jobs.windowed_counts(spark.readStream.schema(df.schema).parquet(source), "ts", "k", "1 day", "2 hours")
        out = jobs.closed_counts(counts, place)
    days = {str(r["window_start"])[:10]: r["n"] for r in out.collect()}
    assert days == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-03": 1}


def test_release_drops_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _spark: str(tmp_path))
    session.cut_lineage(spark.range(3), "x")
    (run,) = session.folders(spark, f"{tmp_path}/ticketlake")
    assert session.folders(spark, f"{tmp_path}/ticketlake/{run}")
    session.release(spark)
    assert session.folders(spark, f"{tmp_path}/ticketlake") == []


def test_ticket_view_with_fewer_columns(spark, sf_dir):
    from ticketlake.sources.tickets import tickets

    lean = tickets(spark, sf_dir, "ticket_id", "status", "resolution")
    full = tickets(spark, sf_dir).select("ticket_id", "status", "resolution")
    assert lean.exceptAll(full).count() == full.exceptAll(lean).count() == 0
