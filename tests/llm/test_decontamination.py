"""Decontamination against plain windows over the words."""

import hashlib
import random
import re

import pytest

from ticketlake.llm import decontamination, queries

from .conftest import EDGE_TEXTS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_scan(docs, items, window=10):
    """doc_id, words, hit places and ids of the items with an occurring window, for each row."""
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (here := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= {str(x) for x in here if x is not None}
        yield doc, len(w), hit, sorted(found)


def as_sets(rows):
    out = []
    for r in rows:
        assert r.n_hit == sum(s.upto - s.at for s in r.spans)
        assert all(a.upto < b.at for a, b in zip(r.spans, r.spans[1:], strict=False))
        out.append((r.doc_id, r.n_words, {p for s in r.spans for p in range(s.at, s.upto)}, r.items))
    return sorted(out, key=repr)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river"),  # edge texts repeat it
    (2, "one"),
    (2, "Hello, world!"),
    (3, "Text number 3 of"),
    (30, "number 3 of the many"),
    (4, None),
    (5, "... !"),
    (6, "straße ÄÖ é 日本語"),
    (7, "near the old river bank today the quick brown fox jumps over"),
    (7, "near the old river bank today the quick brown fox jumps over"),
    (None, "don't we'll"),
    (8, "w " * 40),
]
TEXTS = [(50, "W" + " w" * 25), (51, "hello-world hello world one"), (52, "x " * 9 + "w. " * 12 + "y"), *EDGE_TEXTS]


@pytest.fixture(scope="module")
def items(stored):
    return stored(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("max_broadcast", [decontamination.MAX_BROADCAST, 2000])
def test_edge_rows(stored, items, max_broadcast):
    """Also with a set that comes in several parts."""
    rows = decontamination.scan(stored(TEXTS), items, max_broadcast=max_broadcast).collect()
    assert as_sets(rows) == sorted(brute_scan(TEXTS, ITEMS), key=repr)


def test_random_words(stored):
    """Few words, so that windows of all sizes meet, overlap and repeat."""
    r = random.Random(4)
    text = lambda n: " ".join(r.choices("abc", weights=(8, 1, 1), k=n))
    items = [(i, text(r.randint(1, 14))) for i in range(60) if i % 7]
    docs = [(i, text(r.randint(0, 120))) for i in range(150)]
    rows = decontamination.scan(stored(docs), stored(items, "item_id long, text string"), window=6).collect()
    assert as_sets(rows) == sorted(brute_scan(docs, items, 6), key=repr)


def test_empty_tables(stored, empty, items):
    assert decontamination.scan(empty, items).collect() == []
    rows = decontamination.scan(stored(TEXTS), stored([], "item_id long, text string")).collect()
    assert as_sets(rows) == sorted(brute_scan(TEXTS, []), key=repr)


def test_documents_and_spans_are_taken_out(stored, items):
    docs = stored(TEXTS)
    hits = {repr((d, n, t)): hit for (d, t), (_, n, hit, _) in zip(TEXTS, brute_scan(TEXTS, ITEMS), strict=True)}
    clean = decontamination.drop_documents(docs, items)
    assert clean.columns == docs.columns
    expected = [(d, t) for d, t in TEXTS if not hits[repr((d, len(words(t)), t))]]
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=repr) == sorted(expected, key=repr)

    def without(doc, text):
        hit = hits[repr((doc, len(words(text)), text))]
        if not hit:
            return text
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        ends = [a for a, _ in spans[1:]] + [len(text)]
        return text[: spans[0][0]] + "".join(text[spans[i][0] : ends[i]] for i in range(len(spans)) if i not in hit)

    cleaned = decontamination.remove_spans(docs, items)
    assert cleaned.columns == docs.columns
    assert sorted([(r.doc_id, r.text) for r in cleaned.collect()], key=repr) == sorted(((d, without(d, t)) for d, t in TEXTS), key=repr)


def test_query_against_plain_windows(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    df = queries.QUERIES["op13_decontamination"](spark, sf_dir)
    assert df.columns == "doc_id n_words n_hit n_items items_sha256 contaminated".split()
    expected = [
        (d, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit))
        for d, n, hit, found in brute_scan(docs, items)
    ]
    assert sorted(map(tuple, df.collect())) == sorted(expected)
