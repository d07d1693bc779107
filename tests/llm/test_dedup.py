"""Exact, line and near deduplication against brute force, and the index that takes documents out again."""

import hashlib
from collections import Counter

import numpy as np
import xxhash

import corpus_pipeline
from ticketlake.llm import exact_dedup, line_dedup, simhash
from ticketlake.llm.components import components
from ticketlake.llm.cuckoo import CuckooFilter, KeyIndex

from .conftest import EDGE_TEXTS


def lower(text):
    return (text or "").encode().lower()


def test_filter_holds_what_is_in_it_and_forgets_what_is_taken_out():
    keys = np.random.default_rng(1).integers(0, 2**64, 50_000, np.uint64)
    f = CuckooFilter(20_000)
    assert f.insert(keys[:40_000])
    assert f.contains(keys[:40_000]).all()
    assert f.contains(keys[40_000:]).mean() < 0.01
    f.delete(keys[:20_000])
    assert f.contains(keys[20_000:40_000]).all()
    assert f.contains(keys[:20_000]).mean() < 0.01
    again = CuckooFilter.load(f.dump())
    assert again.size == f.size == 20_000 and again.contains(keys[20_000:40_000]).all()


def test_filter_overflows_and_the_index_grows():
    assert not CuckooFilter(16).insert(np.random.default_rng(2).integers(0, 2**64, 100, np.uint64))
    assert not CuckooFilter(64).insert(np.full(9, 7, np.uint64))  # two buckets hold eight copies
    keys = [i.to_bytes(8, "little") * 2 for i in range(1, 5000)]
    index = KeyIndex(16, expected=8)
    index.add(keys, [1] * len(keys))
    index.add(keys[:10], [5] * 10)
    assert dict((k, n) for k, n, _ in index.items()) == {k: 6 if i < 10 else 1 for i, k in enumerate(keys)}
    assert set(index.remove(keys[5:20], [1] * 15)) == set(keys[10:20])
    assert len(index.items()) == len(keys) - 10 == index.filter.size


def test_exact_dedup_of_edge_rows(edge):
    rows = exact_dedup.exact_dedup(edge).collect()
    groups = {}
    for i, t in EDGE_TEXTS:
        groups.setdefault(lower(t), []).append(i)
    assert Counter((r.doc_id, r.text_sha256, r.keep_id, r.group_size) for r in rows) == Counter(
        (i, hashlib.sha256(lower(t)).hexdigest(), max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]))
        for i, t in EDGE_TEXTS
    )
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter({r.text_sha256: 1 for r in rows})
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact_dedup_stage_keeps_rows_and_columns(edge, empty):
    kept = exact_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    assert Counter(lower(r.text) for r in kept.collect()) == Counter({lower(t): 1 for _, t in EDGE_TEXTS})
    assert exact_dedup.exact_dedup(empty).count() == exact_dedup.keep_one(empty).count() == 0


def test_index_is_reversible(spark, stored):
    docs = stored([(i, f"text {i % 7}") for i in range(40)])
    more = stored([(i, f"text {i % 9}") for i in range(40, 60)])
    whole = exact_dedup.build_index(docs)
    grown = whole.insert(exact_dedup.digests(more))
    ids = spark.createDataFrame([(i,) for i in range(40, 60)] + [(999,)], "doc_id long")
    back = grown.delete(ids)
    counts = lambda index: {bytes(r.key): r.n for r in index.live().collect()}
    expected = Counter(hashlib.sha256(f"text {i % 7}".encode()).digest() for i in range(40))
    assert counts(whole) == counts(back) == expected
    expected.update(hashlib.sha256(f"text {i % 9}".encode()).digest() for i in range(40, 60))
    assert counts(grown) == expected
    assert {r.keep_id for r in exact_dedup.keepers(back).collect()} == {33, 34, 35, 36, 37, 38, 39}


def brute_lines(texts, min_docs, min_chars=1):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    docs = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k.decode()) >= min_chars)
    for t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if docs[key(x)] < min_docs]
        yield "\n".join(stay), len(lines), len(lines) - len(stay)


def test_line_dedup_of_edge_rows(edge, empty):
    for min_docs, min_chars in ((2, 1), (10, 1), (2, 12), (100, 1)):
        rows = line_dedup.line_dedup(edge, min_docs, min_chars).collect()
        expected = brute_lines([t for _, t in EDGE_TEXTS], min_docs, min_chars)
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows) == Counter(
            (i, *e) for (i, _), e in zip(EDGE_TEXTS, expected, strict=True)
        )
    assert line_dedup.line_dedup(empty).count() == 0


def test_lines_come_back_when_documents_go(spark, stored):
    docs = stored([(i, f"shared\nown {i}") for i in range(10)])
    index = line_dedup.build_index(docs)
    members = line_dedup.line_keys(docs)
    assert {r.n_dropped for r in line_dedup.drop_lines(docs, members, index, 10).collect()} == {1}
    fewer = index.delete(spark.createDataFrame([(3,)], "doc_id long"))
    assert {r.n_dropped for r in line_dedup.drop_lines(docs, members, fewer, 10).collect()} == {0}
    assert {r.n for r in fewer.live().collect()} == {1, 9}
    again = fewer.insert(members.filter("doc_id = 3"))
    assert {r.n_dropped for r in line_dedup.drop_lines(docs, members, again, 10).collect()} == {1}


def brute_fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(parts[i : i + words]), 42) for i in range(max(1, len(parts) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, max_bits):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_that_of_sparks_hash(spark):
    text = "Some Words of a text, repeated words of a text, repeated words"
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n") == 0
    assert spark.sql("SELECT xxhash64('one')").first()[0] % 2**64 == simhash.fingerprint(b"ONE") == brute_fingerprint("one")


def test_near_duplicates_of_edge_rows(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    fps = [brute_fingerprint(t) for _, t in EDGE_TEXTS]
    roots = brute_components(fps, 2)
    least = {r: min((i for (i, _), x in zip(EDGE_TEXTS, roots, strict=True) if x == r and i is not None), default=None) for r in roots}
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in rows) == Counter(
        (i, fp, least[r]) for (i, _), fp, r in zip(EDGE_TEXTS, fps, roots, strict=True)
    )
    assert sum(r.kept for r in rows) == len(set(roots))
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(set(roots))
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_chains_and_crowds(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 2**64, 30, np.uint64)
    fps = set(r.integers(0, 2**64, 300, np.uint64).tolist())
    for c in centres[:20]:  # crowds around a centre and chains away from it
        for _ in range(12):
            fps.add(int(c) ^ (1 << int(r.integers(64))) ^ (1 << int(r.integers(64))))
        for bit in range(0, 40, 2):
            c ^= np.uint64(3) << np.uint64(bit)
            fps.add(int(c))
    fps = sorted(fps)
    classes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    star = {r.a % 2**64: r.b % 2**64 for r in components(simhash.fingerprint_links(classes, 2)).collect()}
    got = [star.get(f, f) for f in fps]
    want = brute_components(fps, 2)
    pairs = set(zip(got, want, strict=True))
    assert len(pairs) == len(set(got)) == len(set(want))


def test_pivot_distances_bound_bit_distances():
    table = simhash.PivotTable()
    r = np.random.default_rng(8)
    a = r.integers(0, 2**64, 500, np.uint64)
    b = a.copy()
    for i in range(500):
        for _ in range(i % 3):
            b[i] ^= np.uint64(1) << np.uint64(r.integers(64))
    bits = np.bitwise_count(a ^ b)
    far = np.abs(table.distances(a).astype(int) - table.distances(b)).max(1)
    assert (far <= bits).all()
    assert ((table.keys(a, 2) == table.keys(b, 2)).any(1)).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (400, 400), (7, 3)], "a long, b long")
    got = {(r.a, r.b) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(1, 101)} | {(500, 400)}


def test_rows_keep_their_numbers_when_splits_change(stored, other_splits):
    docs = stored([(i, f"shared\ntext number {i // 2} of many, with words of its own: {'ab' * (i // 2)}") for i in range(60)], files=6)
    exact, near, lines = exact_dedup.keep_one(docs), simhash.keep_one(docs), line_dedup.line_dedup(docs, min_docs=10)
    near_before = sorted(r.doc_id for r in simhash.near_duplicates(docs).filter("kept").collect())
    other_splits()
    assert sorted(r.doc_id for r in exact.collect()) == list(range(1, 60, 2))
    assert sorted(r.doc_id for r in near.collect()) == near_before
    assert Counter((r.n_lines, r.n_dropped) for r in lines.collect()) == {(2, 1): 60}


def test_near_duplicate_stage_of_edge_rows(spark, edge, empty):
    stays = corpus_pipeline.near_duplicates(spark, edge, "")
    assert stays.columns == edge.columns
    fps = [brute_fingerprint(t) for _, t in EDGE_TEXTS]
    assert stays.count() == len(set(brute_components(fps, 2)))
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0
