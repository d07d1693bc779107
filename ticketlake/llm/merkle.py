"""Merkle manifest of a dataset: a tree for each group of rows, and one over the groups.

A node is the SHA-256 of its children's digests as hexadecimal text. Only every few levels are stored: what lies
between, in the aligned subtree of a stored node, is made again from its stored descendants whenever a proof
needs it, and not kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import cut_lineage, parts_for

FAN = 3  # children of a node
EVERY = 3  # levels from one stored level to the next
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_PART = 200_000
_PATH = "array<struct<left: string, right: string>>"


def leaf_of(*fields: Column) -> Column:
    """Digest of a row: each field as its UTF-8 bytes' number, ``:`` and itself, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def tree_key(group: Column) -> Column:
    """A text that is never null and sorts as ``group`` does: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a proof in one text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``idx``, the place in its tree by ``key`` and ``hash``, and ``n``, the tree's number of leaves.

    The rows are sorted over all tasks, so a tree of any size is cut across them; a tree's rows in one task
    are counted, and the counts before it summed. Equal rows are told apart by a number of no meaning.
    """
    parts = parts_for(leaves.sparkSession, leaves.count(), ROWS_PER_PART)
    order = ("tree", "key", "hash", "salt")
    salted = leaves.withColumn("salt", F.monotonically_increasing_id())
    spread = salted.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    at = F.monotonically_increasing_id()
    ordered = cut_lineage(spread.withColumn("part", F.spark_partition_id()).withColumn("at", at), "merkle-leaves")
    runs = ordered.groupBy("tree", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("here").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    joined = ordered.join(runs, ["tree", "part"])
    return joined.select("tree", (F.col("at") + F.col("shift")).alias("idx"), "n", "hash", "row")


def _above(nodes: Column) -> Column:
    """The digests one level up: a run of ``FAN`` nodes, the last one maybe shorter, becomes one."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FAN).cast("int") - 1)
    return F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(nodes, j * FAN + 1, FAN), ""), 256))


@dataclass
class Forest:
    """Trees over placed leaves, with one stored level out of ``every``.

    ``stored`` are tables of ``tree``, ``idx``, ``n`` (the tree's nodes on this level), ``hash`` and, for leaves, ``row``;
    a tree is in no table above the one in which it has one node. ``roots`` are ``tree`` and ``hash``.
    """

    stored: list[DataFrame]
    roots: DataFrame
    every: int

    @classmethod
    def grow(cls, leaves: DataFrame, every: int = EVERY) -> Forest:
        """``leaves``: ``tree``, ``key`` (what orders them), ``hash``, and ``row``, a struct that comes back with proofs."""
        placed = cut_lineage(_placed(leaves), "merkle-placed")
        largest = placed.agg(F.max("n")).first()[0] or 0
        forest = cls([placed], placed.filter("n = 1").select("tree", "hash"), every)
        span = FAN**every
        while largest > 1:
            groups = forest._subtrees(forest.stored[-1].filter("n > 1"))
            top = F.coalesce(*(F.col(f"level{s}") for s in range(every, 0, -1)))
            n = F.expr(f"(n + {span - 1}) div {span}")
            nodes = groups.select("tree", F.col("subtree").alias("idx"), n.alias("n"), F.get(top, F.lit(0)).alias("hash"))
            nodes = cut_lineage(nodes, "merkle-level")
            forest.stored.append(nodes)
            forest.roots = forest.roots.unionByName(nodes.filter("n = 1").select("tree", "hash"))
            largest = -(-largest // span)
        return forest

    def _subtrees(self, nodes: DataFrame) -> DataFrame:
        """One row for each aligned subtree of ``every`` levels: its stored nodes, and the levels made from them.

        It has ``FAN ** every`` stored nodes at most. Small trees have fewer levels left; the others are null.
        """
        members = F.struct(*(c for c in ("idx", "hash", "row") if c in nodes.columns))
        of = F.expr(f"idx div {FAN**self.every}").alias("subtree")
        groups = nodes.groupBy("tree", "n", of).agg(F.collect_list(members).alias("members"))
        pairs = F.array_sort(F.transform("members", lambda m: F.struct(m["idx"], m["hash"])))
        groups = groups.withColumn("level0", F.transform(pairs, lambda m: m["hash"]))
        for s in range(1, self.every + 1):
            groups = groups.withColumn(f"level{s}", F.when(F.col("n") > FAN ** (s - 1), _above(F.col(f"level{s - 1}"))))
        return groups

    def _segment(self) -> Column:
        """The part of a member's path that lies in its subtree."""
        levels = []
        for s in range(self.every):
            place = F.expr(f"cast(idx div {FAN**s} % {FAN ** (self.every - s)} as int)")
            own = place % FAN  # in its run
            level = F.col(f"level{s}")
            left = F.array_join(F.slice(level, place - own + 1, own), "")
            right = F.array_join(F.slice(level, place + 2, F.lit(FAN - 1) - own), "")
            one = F.array(F.struct(left.alias("left"), right.alias("right")))
            levels.append(F.when(F.col(f"level{s + 1}").isNotNull(), one).otherwise(F.array().cast(_PATH)))
        return F.concat(*levels)

    def proofs(self, outer: DataFrame) -> DataFrame:
        """``tree``, ``hash``, ``row`` and ``path`` of each leaf, and the other columns of ``outer``.

        ``outer`` has for each ``tree`` a ``path``: how it goes on above the tree's root. A path holds the digests left
        and right of the way up, level by level.
        """
        rest = [c for c in outer.columns if c != "tree"]
        span = FAN**self.every
        above = None  # tree, idx, path: of the stored level above
        for nodes in reversed(self.stored[:-1]):
            found = self._subtrees(nodes.filter(f"n > 1 AND n <= {span}")).join(outer, "tree")
            if above is not None:
                deeper = self._subtrees(nodes.filter(f"n > {span}"))
                found = found.unionByName(deeper.join(above.withColumnRenamed("idx", "subtree"), ["tree", "subtree"]))
            # "outer": a plain one would make the members a second time, to ask whether there are any
            each = found.select("tree", *(f"level{s}" for s in range(self.every + 1)), *rest, F.inline_outer("members"))
            path = F.concat(self._segment(), F.col("path")).alias("path")
            above = each.select(*(path if c == "path" else c for c in each.columns if not c.startswith("level")))
            if nodes is not self.stored[0]:
                above = above.drop("hash")
        lone = self.stored[0].filter("n = 1").join(outer, "tree").drop("n")
        return lone if above is None else lone.unionByName(above)


def proofs(docs: DataFrame, leaf: Column, group: Column, key: Column, row: Column, every: int = EVERY) -> DataFrame:
    """``row``, ``leaf``, ``subroot``, ``root`` and ``path`` of each row of ``docs``.

    Rows of a ``group`` are the leaves of its tree, by ``key`` (null first), then by digest; ``FAN`` consecutive
    nodes become one while there are several, and a lone leaf is its tree's root. The roots of the trees, by group
    (null first, then bytewise), give ``root`` in the same way. ``row`` is a struct of what else is to be kept of a
    row. An empty table has no rows. Repeated rows have equal leaves side by side, each with a proof of its own.
    """
    leaves = docs.select(tree_key(group).alias("tree"), key.alias("key"), leaf.alias("hash"), row.alias("row"))
    forest = Forest.grow(cut_lineage(leaves, "merkle-rows"), every)
    trees = forest.roots.select(
        F.lit("").alias("tree"), F.col("tree").alias("key"), "hash", F.struct("tree").alias("row")
    )
    top = Forest.grow(trees, every)
    root = top.roots.first()
    start = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path"))
    outer = top.proofs(start).select(
        F.col("row.tree").alias("tree"), F.col("hash").alias("subroot"), F.lit(root and root.hash).alias("root"), "path"
    )
    rows = forest.proofs(cut_lineage(outer, "merkle-groups"))
    return rows.select("row", F.col("hash").alias("leaf"), "subroot", "root", "path")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, every: int = EVERY) -> DataFrame:
    """The manifest of a table like ``documents``: ``proofs`` by source, of leaves over ``FIELDS``, by ``doc_id``.

    ``row`` holds ``doc_id`` and ``now``, the leaf that the row has with the columns of ``changed`` in place of its
    own: ``folded("now", path)`` is the root only where nothing differs.
    """
    leaf = leaf_of(*(F.col(c) for c in FIELDS))
    now = leaf_of(*((changed or {}).get(c, F.col(c)) for c in FIELDS)) if changed else leaf
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id"), now.alias("now"))
    return proofs(docs, leaf, F.col("source"), F.col("doc_id").cast("long"), row, every)
