"""The stages in order: each against a plain version on its own input."""

import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from ticketlake.llm import queries
from ticketlake.session import fresh_path

from .test_dedup import brute_components, brute_fingerprint, lower
from .test_text_models import brute_counts


def test_stages_on_supplied_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, f"test-{name}")
        stage(spark, tables[-1], sf_dir).write.parquet(path)
        tables.append(spark.read.parquet(path))
    assert all(t.columns == docs.columns for t in tables[:-1])
    rows = [t.collect() for t in tables]
    texts = [{r.doc_id: r.text for r in t} for t in rows[:-1]]

    assert {i for i, t in texts[0].items() if any(c.isalpha() for c in t)} == set(texts[1])
    base = {i for i, t in texts[1].items() if not brute_counts(t)[-1]}
    assert set(texts[2]) <= base
    good = {i for i in base if i in labels and labels[i].quality == 1}
    assert len(good & set(texts[2])) >= 0.97 * len(good)  # clean documents stay
    assert Counter(lower(t) for t in texts[3].values()) == Counter({lower(t): 1 for t in texts[2].values()})
    fps = [brute_fingerprint(t) for t in texts[3].values()]
    roots = dict(zip(texts[3], brute_components(fps, 2), strict=True))
    assert sorted(roots[i] for i in texts[4]) == sorted(set(roots.values()))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts[4].items()}
    packed = Counter()
    for r in rows[5]:
        packed[r.doc_id] += r.length
    assert packed == sizes
    held = Counter()
    for r in rows[5]:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 2048 and len(held) <= 1.05 * sum(sizes.values()) / 2048 + 1


def test_queries_follow_their_contracts(spark, sf_dir):
    """Columns and rows of the thin queries; their values are tested with the operators."""
    columns = {
        "op1_packing": "doc_id piece start length ids_crc32 sequence_id offset",
        "op4_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op7_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op10_langid": "doc_id held_out lang_pred score",
    }
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name, expected in columns.items():
        df = queries.QUERIES[name](spark, sf_dir)
        rows = df.collect()
        assert df.columns == expected.split()
        assert len({r.doc_id for r in rows}) == docs
        for modulus, rest in ((7, 2), (3, 1)):
            if name == {7: "op7_lm", 3: "op10_langid"}[modulus]:
                assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)


def test_languages_of_held_out_documents(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in queries.QUERIES["op10_langid"](spark, sf_dir).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
