"""The Merkle manifest against a plain tree, level by level."""

import hashlib
import zlib

from pyspark.sql import functions as F

from ticketlake.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(*fields):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def brute_tree(nodes):
    """Root, and for each leaf its levels of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i - i % 3
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute_manifest(rows, tamper):
    """A tuple for each row: doc_id, leaf, subroot, root, digest of the siblings, folded root, verified."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, brute_leaf(*r), r))
    trees = []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        leaves = sorted(by_source[source], key=lambda x: x[:3])
        trees.append((leaves, *brute_tree([x[2] for x in leaves])))
    if not trees:
        return []
    root, tops = brute_tree([t[1] for t in trees])
    out = []
    for (leaves, subroot, paths), top in zip(trees, tops, strict=True):
        for (_, _, leaf, r), path in zip(leaves, paths, strict=True):
            node = brute_leaf(*r[:4], tamper(r[0], r[4]))
            for left, right in path + top:
                node = h(left, node, right)
            proof = h(*(a + b for a, b in path + top))
            out.append((r[0], leaf, subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def tamper(doc_id, text):
    even = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
    return text.replace("\n", "") if even and text is not None else text


def as_tuples(df):
    rows = df.select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof"),
        merkle.folded(F.col("row.now"), F.col("path")).alias("folded"),
    ).collect()
    return sorted([(*r, r.folded == r.root) for r in rows], key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_query_against_plain_trees(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*merkle.FIELDS).collect()]
    df = queries.QUERIES["op12_merkle"](spark, sf_dir)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute_manifest(rows, tamper)


def test_trees_of_many_sizes_nulls_and_ties(stored):
    """Sizes around the powers of the fan-out, so that last runs are short on every level."""
    rows, sizes = [], (1, 2, 3, 4, 9, 10, 26, 27, 28, 55, 81, 82, 244)
    for k, size in enumerate(sizes):
        source = None if k == 0 else f"s{k}é" if k % 2 else f"S{k}"
        rows += [(1000 * k + i * 7 % size, source, "en", i, f"line {i}\nline {k}") for i in range(size)]
    rows += [(5, "ties", "en", 1, "b"), (5, "ties", "en", 1, "a"), (None, "ties", None, None, None), (5, "ties", "en", 1, "b")]
    rows += [(6, "", "", 0, ""), (7, "long", "x", 1, "long\n" * 50_000)]
    docs = stored(rows, SCHEMA)
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    changed = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    expected = brute_manifest(rows, tamper)
    assert as_tuples(merkle.manifest(docs, changed)) == expected
    assert as_tuples(merkle.manifest(docs, changed, every=2)) == expected  # stored levels do not show in the result


def test_small_tables(stored):
    assert as_tuples(merkle.manifest(stored([], SCHEMA))) == []
    rows = [(1, "a", "en", 3, "x\ny")]
    assert as_tuples(merkle.manifest(stored(rows, SCHEMA))) == brute_manifest(rows, lambda i, t: t)
