import itertools

import pytest

from ticketlake.session import fresh_path

SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank today. "

# nulls, empty texts, ties, repeated rows, a long text, a long word, line ends and white space of all kinds
EDGE_TEXTS = [
    (1, "Hello World\nsame line\n"),
    (2, "hello WORLD\nsame line\n"),
    (3, None),
    (4, ""),
    (4, ""),
    (5, "Straße ÄÖ é 日本語 🙂 don't  we'll\t12345 !!\r\n\x0b\x0c x"),
    (6, SENTENCE * 3000),
    (7, "a" * 5000),
    (8, SENTENCE * 4),
    (9, SENTENCE * 4),
    (None, "null id"),
    (None, "null id"),
    (11, "   \n\t "),
    (12, "one"),
    (13, "\n\n\n"),
    (14, "12 34 ## $$"),
    *((20 + i, f"Shared Line\nown text number {i} of the many\n  shared line \n") for i in range(12)),
]
# names that the operators use themselves
CLASHING = ("_row", "row", "key", "kept", "fp", "n", "length", "n_words", "_text", "shard", "offset", "keep_id")

_number = itertools.count()


@pytest.fixture(scope="session")
def stored(spark):
    """Writes rows as a table with clashing extra columns and reads it."""

    def write(rows, schema="doc_id long, text string", files=3):
        df = spark.createDataFrame(rows, schema)
        for name in CLASHING:
            df = df.selectExpr("*", f"'x' AS `{name}`")
        path = fresh_path(spark, f"test-{next(_number)}")
        df.repartition(files).write.parquet(path)
        return spark.read.parquet(path)

    return write


@pytest.fixture(scope="session")
def edge(stored):
    return stored(EDGE_TEXTS)


@pytest.fixture(scope="session")
def empty(stored):
    return stored([])


@pytest.fixture
def other_splits(spark):
    """From its call on, files are read in other splits than before, as when executors come or go."""
    names = ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")

    def change():
        for name, value in zip(names, ("1", "0"), strict=True):
            spark.conf.set(name, value)

    yield change
    for name in names:
        spark.conf.unset(name)
