"""Extraction on pages of known parts, and archives that read back what was written."""

import base64
import hashlib
import html
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketlake.llm import extraction, warc
from ticketlake.llm.dom import N_FEATURES, NUMBERS, features, parse
from ticketlake.llm.layouts import MARK, Layout
from ticketlake.llm.trees import BoostedTrees
from ticketlake.session import fresh_path


def texts(page):
    return [t for n in parse(page) for t in n.texts]


def test_parser():
    assert texts("<p>a &amp; b&nbsp;&lt;\n c<br>d<p>e") == ["a & b < c d", "e"]
    assert texts("<p><b>one<br><p>two</b> three</div></p>x") == ["one", "two three", "x"]
    assert texts("<script>var t='</p>';</script><style>p{}</style><!-- no --><p>yes</p><!-- open <p>no") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>d<td>e<tr><td>f</table>") == ["a", "b", "c", "d", "e", "f"]
    assert texts("a < b and c<d>e</d> <P CLASS='x>y'>f") == ["a < b and ce", "f"]
    assert texts("<head><title>t</title><p>x") == texts("<head><title>t</title></head><p>x") == ["x"]
    assert texts("") == texts("<!doctype html>") == texts("<div><p></p></div>") == []
    assert texts("<button>b</button><noscript><p>n</p></noscript>ok") == ["ok"]
    (node,) = [n for n in parse('<div class="postBody main-text" id=x1></div>') if n.tag == "div"]
    assert node.words == ("post", "body", "main", "text", "x")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <div> </div> <b> </b> <li> <ul> </ul> <a href='x'> </a> <td> <table> <script> </script> <!-- --> < > & text &amp; <br/> <x/ </head> <head>".split(" ")), max_size=30))
def test_any_markup_gives_a_tree(parts):
    nodes = parse("".join(parts))
    assert all(0 <= n.parent < i for i, n in enumerate(nodes[1:], 1))
    x = features(nodes)
    assert x.shape == (len(nodes), N_FEATURES) and np.isfinite(x).all()
    stays = extraction.decode(nodes, np.linspace(-3, 3, len(nodes)))
    assert all(stays[n.parent] for n, stay in zip(nodes[1:], stays[1:], strict=True) if stay)


def test_sibling_statistics_of_a_wide_page():
    page = "<body>" + "<nav>menu</nav>" * 80 + "<p>text</p>own" * 300 + "<footer>end</footer>" * 20
    nodes = parse(page)
    brothers = next(node.children for node in nodes if len(node.children) == 700)
    x = {name: features(nodes)[:, NUMBERS.index(name)] for name in ("place", "like_siblings", "own_run")}
    assert np.allclose(x["place"][brothers], np.arange(700) / 700)
    share = {"nav": 80 / 700, "p": 300 / 700, "#run": 300 / 700, "footer": 20 / 700}
    assert np.allclose(x["like_siblings"][brothers], [share[nodes[b].tag] for b in brothers])
    assert x["own_run"][nodes[brothers[0]].parent] == 300


def test_deep_and_wide_pages():
    assert texts("<div>" * 20_000 + "x") == ["x"]
    assert len(texts("<li>x" * 20_000)) == 20_000
    assert texts("<p>" * 20_000 + "</b>" * 20_000 + "x") == ["x"]


def test_decoding_is_the_most_likely_choice():
    nodes = parse("<div><p>a</p><p>b</p></div><div>c<p>d</p></div>")
    r = np.random.default_rng(1)
    for _ in range(50):
        logits = r.normal(0, 2, len(nodes))
        best, want = -np.inf, None
        for code in range(2 ** (len(nodes) - 1)):
            stays = [True] + [bool(code >> i & 1) for i in range(len(nodes) - 1)]
            if any(s and not stays[n.parent] for n, s in zip(nodes[1:], stays[1:], strict=True)):
                continue
            asked = [i for i in range(1, len(nodes)) if stays[nodes[i].parent]]
            worth = sum(-np.logaddexp(0, -logits[i] if stays[i] else logits[i]) for i in asked)
            if worth > best:
                best, want = worth, stays
        assert extraction.decode(nodes, logits).tolist() == want


def test_trees_learn_an_interaction():
    r = np.random.default_rng(4)
    x = np.column_stack([r.random(4000), r.integers(0, 2, 4000), r.random(4000)]).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    trees = BoostedTrees(rounds=40).fit(x[:3000], y[:3000])
    assert ((trees.logit(x[3000:]) > 0) == y[3000:]).mean() > 0.98
    assert (BoostedTrees(rounds=2).fit(x, np.ones(4000)).logit(x) > 0).all()


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def trees(pages):
    return extraction.fit(pages)


def article(page):
    """The blocks of a supplied page's article, by its plain layout."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [re.sub(r"<[^>]*>", "", x.replace("<br>", " ")) for x in re.split(r"</?(?:p|h1|h2|ul|li)>", inside)]
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_supplied_pages(pages, trees):
    rows = extraction.extract(pages, trees).collect()
    source = {r.page_id: r for r in pages.collect()}
    assert len(rows) == len(source)
    for r in rows:
        assert r.url == source[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == article(source[r.page_id].html)


def test_unseen_layouts(pages, trees):
    sentences = [s for r in pages.limit(50).collect() for t in texts(r.html) for s in t.split(". ") if s]
    right = found = wanted = 0
    for seed in range(10_000, 10_200):
        raw = Layout(seed, sentences).page()
        want = Counter(t.replace(MARK, "") for t in texts(raw) if MARK in t)
        got = Counter(extraction.main_text([raw.replace(MARK, "")], trees)[0].split("\n"))
        right += sum((want & got).values())
        found += sum(got.values())
        wanted += sum(want.values())
    assert right / found > 0.95 and right / wanted > 0.93


def test_edge_pages(stored, trees, empty):
    rows = [(1, None), (2, ""), (3, "<p>"), (4, "plain text only"), (4, "plain text only"), (None, "<body>x"), (5, "<div>" * 3000 + "deep")]
    table = stored([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in extraction.extract(table, trees).collect())
    assert got[1, None, "", 0] == got[2, None, "", 0] == got[3, None, "", 0] == 1
    assert got[4, None, "plain text only", 15] == 2 and got[None, None, "x", 1] == 1
    none = empty.selectExpr("doc_id AS page_id", "text AS url", "text AS html")
    assert extraction.extract(none, extraction.fit(none, layouts=5)).count() == 0


ROWS = [
    (1, "http://a", "same"),
    (2, None, "same"),
    (3, "http://b\r\nX: y", "same"),
    (3, "http://b", "same"),
    (None, "http://c", None),
    (4, "http://d", ""),
    (5, "http://e", "b\r\n\r\nWARC/1.1\r\n"),
    (6, "http://é", "ü" * 400_000),
    (7, "", "x" * 3),
]


@pytest.fixture(scope="module")
def crawl(stored):
    return stored(ROWS, "page_id long, url string, html string")


def test_archives_read_back(crawl, empty):
    got = Counter(tuple(r) for r in warc.archive_pages(crawl).collect())
    keeper = {}
    for i, _, h in ROWS:
        keeper[h or ""] = max(keeper.get(h or "", -1), -1 if i is None else i)
    expected, done = Counter(), set()
    for i, _, h in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0], reverse=True):
        data = (h or "").encode()
        first = i == keeper[h or ""] and data not in done
        done.add(data)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected[i, len(data), digest, "response" if first else "revisit", None if first else keeper[h or ""]] += 1
    assert got == expected
    assert warc.archive_pages(empty.selectExpr("doc_id AS page_id", "text AS url", "text AS html")).count() == 0


def test_bundles_are_seekable_and_records_are_found(spark, crawl, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 600)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 500)
    path = fresh_path(spark, "test-warc")
    index = warc.write_archives(crawl.coalesce(1), path)
    assert index.count() == len(ROWS) and index.select("bundle").distinct().count() > 1
    records = {r.record_id: bytes(r.record) for r in warc.fetch(index, path).collect()}
    for r in warc.read_archives(spark, path).collect():
        ((headers, block),) = warc.read_records(records[r.record_id])
        assert headers["WARC-Type"] == r.record_type and "X" not in headers
        assert (block.partition(b"\r\n\r\n")[2] or b"") == bytes(r.payload or b"")
    files = spark.read.format("binaryFile").load(path).collect()
    for f in files:
        data, frames = bytes(f.content), warc.seek_table(bytes(f.content))
        plain = b"".join(zstandard.ZstdDecompressor().decompress(data[a : a + n], max_output_size=size) for a, n, size in frames)
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == plain
        assert sum(1 for _ in warc.read_records(plain)) == index.filter(F.col("bundle") == f.path.rpartition("/")[2]).count()


def test_records_keep_their_texts_when_splits_change(spark, stored, other_splits, monkeypatch):
    pages = stored([(i, f"http://{i}", f"page {i // 2}") for i in range(60)], "page_id long, url string, html string", files=6)
    before = warc.roles

    def roles(*args):
        out = before(*args)
        other_splits()
        return out

    monkeypatch.setattr(warc, "roles", roles)
    path = fresh_path(spark, "test-warc")
    assert warc.write_archives(pages, path).count() == 60
    rows = warc.read_archives(spark, path).collect()
    assert Counter((r.url, r.record_type) for r in rows) == {(f"http://{i}", "response" if i % 2 else "revisit"): 1 for i in range(60)}


def test_small_payloads_may_all_be_responses(crawl):
    roles = warc.roles(crawl.withColumn("at", F.monotonically_increasing_id()), "at", min_bytes=4).collect()
    assert {r.page_id for r in roles if r.revisits} == {1, 2, 3}
    assert sum(r.revisits is None for r in roles) == len(ROWS) - 3
