"""Main text of web pages: boosted trees over DOM nodes, decoded from the top so that choices agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import small_batches
from ticketlake.llm.dom import Node, features, parse
from ticketlake.llm.layouts import MARK, Layout
from ticketlake.llm.trees import BoostedTrees

_MARKED = frozenset(["article", "main"])
_ASIDE = frozenset(["nav", "aside", "footer", "form"])


def _marked_labels(nodes: list[Node]) -> np.ndarray | None:
    """Labels of a page that marks its article by the elements that HTML has for that; None for other pages."""
    inside, found = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes[1:], 1):
        inside[i] = (inside[node.parent] or node.tag in _MARKED) and node.tag not in _ASIDE
        found[i] = inside[i] and bool(node.texts)
    return _upwards(nodes, found) if found.any() else None


def _layout_labels(nodes: list[Node]) -> np.ndarray:
    """Labels of a training layout; takes its marks out of the texts."""
    found = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes):
        found[i] = any(MARK in t for t in node.texts)
        node.texts = [t.replace(MARK, "") for t in node.texts]
    return _upwards(nodes, found)


def _upwards(nodes: list[Node], found: np.ndarray) -> np.ndarray:
    """A node is wanted if it holds wanted text."""
    for i in range(len(nodes) - 1, 0, -1):
        found[nodes[i].parent] |= found[i]
    return found


def _choices(nodes: list[Node], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes that a decision is about: those whose parent is wanted."""
    asked = np.array([labels[n.parent] for n in nodes[1:]], bool)
    return features(nodes)[1:][asked], labels[1:][asked]


def fit(pages: DataFrame, max_pages: int = 200, layouts: int = 700, id_col: str = "page_id", text_col: str = "html") -> BoostedTrees:
    """Trees learned from at most ``max_pages`` pages that mark their article, those of least hash, and from
    ``layouts`` made pages, filled with the sentences of those pages.

    Only the sampled pages reach the driver. Without pages the layouts are filled with a few words.
    """
    ids = pages.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("page_id"))
    ids = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(max_pages).dropDuplicates()
    sample = pages.select(F.col(id_col).alias("page_id"), F.col(text_col).alias("html")).join(F.broadcast(ids), "page_id")
    texts = sorted(r["html"] for r in sample.filter("html IS NOT NULL").collect())[:max_pages]
    xs, ys, sentences = [], [], []
    for text in texts:
        nodes = parse(text)
        sentences += [s for n in nodes for t in n.texts for s in t.split(". ") if s]
        if (labels := _marked_labels(nodes)) is not None:
            x, y = _choices(nodes, labels)
            xs.append(x)
            ys.append(y)
    sentences = sentences or ["some words of text to fill a page", "and a few others"]
    for seed in range(layouts):
        nodes = parse(Layout(seed, sentences).page())
        x, y = _choices(nodes, _layout_labels(nodes))
        xs.append(x)
        ys.append(y)
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def decode(nodes: list[Node], logits: np.ndarray) -> np.ndarray:
    """Which nodes stay, by the most likely choice that leaves nothing below a dropped node.

    ``logits`` are for keeping a node whose parent is kept. Below a dropped node there is nothing to choose, so
    the worth of a choice is summed from the leaves up and the choice made from the root down. The page's root
    and body are not choices.
    """
    keep, drop = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
    fixed = np.array([n.tag in ("#root", "html", "body") for n in nodes])
    keep[fixed] = 0
    drop[fixed] = -np.inf
    for i in range(len(nodes) - 1, 0, -1):
        keep[nodes[i].parent] += max(keep[i], drop[i])
    stays = np.zeros(len(nodes), bool)
    stays[0] = True
    for i, node in enumerate(nodes[1:], 1):
        stays[i] = stays[node.parent] and keep[i] >= drop[i]
    return stays


def main_text(pages: list[str], trees: BoostedTrees) -> list[str]:
    """The kept blocks of each page in page order, a line each."""
    parsed = [parse(p) for p in pages]
    if not parsed:
        return []
    logits = trees.logit(np.concatenate([features(nodes) for nodes in parsed]))
    out, at = [], 0
    for nodes in parsed:
        stays = decode(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(t for n, stay in zip(nodes, stays, strict=True) if stay for t in n.texts))
    return out


def extract(
    pages: DataFrame, trees: BoostedTrees, id_col: str = "page_id", url_col: str = "url", text_col: str = "html"
) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each row, from its whole HTML.

    A null or empty page and one without kept text have an empty text. Broken markup is read as far as it
    goes; repeated rows are read alike, an empty table gives no rows and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, 1 << 20):
            found = main_text(batch.column(2).to_pylist(), trees)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    columns = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit(""))]
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
