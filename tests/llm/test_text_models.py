"""Encoding, packing, quality rules, language identification and scoring against libraries and brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketlake.llm import bpe, langid, lm, packing, quality
from ticketlake.llm.common import fold

from .conftest import EDGE_TEXTS, SENTENCE

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(" \n\t'sdlre a1é²\x1c\x85  !=ab日🙂\x0b́ſ", max_size=40)))
def test_ids_are_those_of_the_library(codec, library, text):
    (ids,) = codec.encode([text])
    assert ids_of(ids) == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_long_matches(codec, library):
    r = random.Random(4)
    texts = ["a" * 3000, "ab" * 2000, "=" * 5000, " " * 3000, "日本" * 900, "".join(r.choice("etaoinsh") for _ in range(4000))]
    texts += ["".join(r.choice("ab") for _ in range(n)) for n in (255, 256, 257, 300)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids_of(ids) == library.encode_ordinary(text)


def test_encoding_of_edge_rows(edge, empty, library):
    rows = bpe.digest(bpe.decode(bpe.encode(edge, RANKS, PATTERN), RANKS)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for i, t in EDGE_TEXTS:
        ids = library.encode_ordinary(t or "")
        expected[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected
    assert bpe.decode(bpe.encode(empty, RANKS, PATTERN), RANKS).count() == 0


def item_by_item(histogram, capacity):
    """The rule of the plan, one item at a time: how many bins it opens."""
    items = sorted((n for n, k in histogram.items() for _ in range(k)), reverse=True)
    large, small, gaps = [n for n in items if 3 * n > capacity], [n for n in items if 3 * n <= capacity], []
    while large:
        a = large.pop(0)
        at = next((i for i, b in enumerate(large) if a + b <= capacity), None)
        gaps.append(capacity - a - (0 if at is None else large.pop(at)))
    for s in small:
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps[gaps.index(min(fits))] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from((5, 12, 30, 64)).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(0, 12), max_size=10))))
def test_plan_is_that_of_single_items(case):
    capacity, histogram = case
    bins, items = defaultdict(list), Counter()
    for run in packing.plan(histogram, capacity):
        items[run.length] += run.n
        for k in range(run.n):
            bins[run.sequence + k // run.per_bin].append((run.offset + k % run.per_bin * run.length, run.length))
    assert items == Counter({n: k for n, k in histogram.items() if k})
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == item_by_item(histogram, capacity)


def test_packing_of_added_tokens(stored):
    """Their strings in a text are these tokens, as in the tokenizers library's plain call."""
    tokenizer = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x\n<|endoftext|", "<|ENDOFTEXT|> a<|endoftext|>b "]
    rows = packing.pieces(stored(list(enumerate(texts))), JSON, PATTERN, with_ids=True).collect()
    assert {r.doc_id: ids_of(r.ids) for r in rows} == {
        i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)
    }
    assert [64, 220, 50256, 275, 0] in [ids_of(r.ids) for r in rows]


def test_packing_of_edge_rows(edge, empty):
    tokenizer = Tokenizer.from_file(JSON)
    packed = packing.pack(packing.pieces(edge, JSON, PATTERN, 64, with_ids=True), 64).cache()
    rows = packed.collect()
    expected = Counter()
    for i, t in EDGE_TEXTS:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected[i, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length, r.ids))
    whole = {r.sequence_id: ids_of(r.ids) for r in packing.sequences(packed).collect()}
    for sequence, held in places.items():
        held.sort()
        assert [o for o, _, _ in held] == np.cumsum([0] + [n for _, n, _ in held])[:-1].tolist()
        assert whole[sequence] == [i for _, _, ids in held for i in ids_of(ids)] and len(whole[sequence]) <= 64
    lengths = Counter(r.length for r in rows)
    assert len(places) == item_by_item(lengths, 64)
    assert packing.pack(packing.pieces(empty, JSON, PATTERN)).count() == 0


def brute_counts(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    n, repeated = len(words), len(covered)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        repeated,
        n < 20 or 100 * repeated > 30 * n,
    )


def test_counts_of_edge_rows(edge, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    rows = quality.judged(edge, []).collect()
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in rows) == Counter((i, *brute_counts(t)) for i, t in EDGE_TEXTS)
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert quality.judged(empty, []).count() == 0


def test_counts_of_random_texts(stored):
    r = random.Random(6)
    texts = [(i, " ".join(r.choice("a b c# d| <e>\nf \ng\t".split(" ")) for _ in range(r.randint(0, 60)))) for i in range(200)]
    rows = quality.judged(stored(texts), []).collect()
    for row in rows:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == brute_counts(texts[row.doc_id][1])


def test_rules_find_what_was_planted():
    r = np.random.default_rng(3)
    values = {"symbols": r.random(3000) * 0.1, "capitals": r.random(3000) * 0.2, "noise": r.random(3000)}
    bad = np.zeros(3000, bool)
    bad[:300] = bad[2000:2200] = True
    values["symbols"][:300] += 0.5
    values["capitals"][2000:2200] += 0.6
    order = r.permutation(3000)
    rules = quality.learn({k: v[order] for k, v in values.items()}, bad[order])
    found = {c.statistic for rule in rules for c in rule}
    assert found == {"symbols", "capitals"} and len(rules) == 2
    covered = np.zeros(3000, bool)
    for rule in rules:
        covered |= np.logical_and.reduce([c.holds(values) for c in rule])
    assert (covered == bad).mean() > 0.995
    assert quality.learn({"x": np.zeros(0)}, np.zeros(0, bool)) == []
    assert quality.learn({"x": np.zeros(50)}, np.zeros(50, bool)) == []


def test_quality_stage_runs_no_python_and_keeps_columns(spark, stored, empty):
    r = random.Random(9)
    say = lambda mark: " ".join(r.choice("the of and to in is was for on as with by at from it an be this".split()) + str(r.randint(0, 999)) + mark for _ in range(60))
    docs = stored([(i, say("##" if i % 4 == 0 else "")) for i in range(400)])
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(None, 0), (3, None)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    kept = quality.keep_good(docs, rules)
    assert "Python" not in kept._jdf.queryExecution().toString() and kept.columns == docs.columns
    assert {row.doc_id for row in kept.collect()} == {i for i in range(400) if i % 4}
    judged = quality.judged(docs, rules).filter("kept")  # a filter on the verdict is planned in no time
    assert judged.count() == 300
    assert quality.fit(docs, labels.limit(0)) == [] and quality.keep_good(empty, rules).count() == 0


def brute_word(word, p, ids):
    return 1.0 if not word else sum(p[ids[word[:k]]] * brute_word(word[k:], p, ids) for k in range(1, len(word) + 1) if word[:k] in ids)


def test_words_are_summed_over_all_segmentations():
    tokens = [b"th", b"the", b"he", b"e ", b" t", b" th"]
    pieces = langid.Pieces(tokens)
    ids = {t: i for i, t in enumerate(sorted({*tokens} | {bytes([b]) for b in range(256)}))}
    r = np.random.default_rng(2)
    p = np.vstack([r.random((pieces.n, 2)), np.zeros(2)])
    p /= p.sum(0)
    words = [b" the", b" thethe", b"x", b"\xc3\xa9the", b" thhe"]
    got = langid.log_scores(words, pieces, p)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(np.exp(row), [brute_word(w, p[:, lang], ids) for lang in (0, 1)])
    assert np.isfinite(langid.log_scores([b"the" * 5000], pieces, p)).all()


def test_every_token_is_a_piece():
    tokens = list(bpe.read_ranks(RANKS))
    pieces = langid.Pieces(tokens)
    ids = {t: i for i, t in enumerate(sorted({*tokens} | {bytes([b]) for b in range(256)}))}
    assert pieces.n == len(ids) >= len(tokens)
    for size in {len(t) for t in tokens}:
        some = [t for t in tokens if len(t) == size]
        words = np.frombuffer(b"".join(some), np.uint8).reshape(-1, size)
        length, starts = pieces.spans(words)[-1]
        assert length == size and starts[:, 0].tolist() == [ids[t] for t in some]


def test_expected_counts_add_up_to_the_words():
    tokens = [b"ab", b"abc", b"bc", b"a", b"c"]
    pieces = langid.Pieces(tokens)
    names = sorted({*tokens} | {bytes([b]) for b in range(256)})
    p = np.full((pieces.n + 1, 2), 1 / pieces.n)
    p[-1] = 0
    words, weights = [b"abc", b"cab", b"zz"], np.array([[2.0, 0], [1, 3], [0, 5]])
    used = langid.expected_counts(words, weights, pieces, p)
    sizes = np.array([len(n) for n in names])
    assert np.allclose(sizes @ used[:-1], np.array([3, 3, 2]) @ weights)


@pytest.fixture(scope="module")
def speakers(spark):
    r = random.Random(1)
    syllables = {"xx": "ka ro mi tu sen".split(), "yy": "öl sch ung ber tz".split(), "zz": "eau ille oux que ré".split()}
    word = lambda lang: "".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(30)), lang) for i, lang in enumerate(["xx", "yy", "zz"] * 60)]


def test_languages_are_told_apart(spark, stored, speakers, empty):
    docs = stored(speakers, "doc_id long, text string, lang string")
    model = langid.fit(docs, fold(3) != 1, RANKS, docs_per_language=20)
    rows = langid.predict(docs.drop("lang"), model).collect()
    truth = {i: lang for i, _, lang in speakers}
    assert model.languages == ["xx", "yy", "zz"] and all(r.lang_pred == truth[r.doc_id] for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    edge = {r.doc_id: r for r in langid.predict(stored([(1, None), (2, ""), (3, "12 !!"), (4, "ka" * 5000), (5, "kamiro")]), model).collect()}
    assert [edge[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and edge[1].score == 0
    assert edge[4].lang_pred == edge[5].lang_pred == "xx"
    kept = langid.identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(speakers)
    assert langid.predict(empty, model).count() == 0
    nothing = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), fold(3) != 1, RANKS)
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def brute_scores(texts, train):
    """Counts, base scores, and each token's word, pair and context count."""
    words = [[w for w in regex.split(r"[\x20\x09-\x0D]+", (t or "").encode().lower().decode()) if w] + [None] for t in texts]
    one, two = Counter(), Counter()
    for ws, learn in zip(words, train, strict=True):
        if learn:
            one.update(ws)
            two.update(zip([None, *ws[:-1]], ws, strict=True))
    n, v = sum(one.values()), len(one)
    for ws in words:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws)
        triples = [(one[w], two[p, w], one[p]) for p, w in zip([None, *ws[:-1]], ws, strict=True)]
        yield len(ws), sum(one[w] > 0 for w in ws), n, base, triples


def test_scores_against_plain_counting(spark, stored, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 300)  # many blocks and shards
    monkeypatch.setattr(lm, "SHARD_KEYS", 50)
    r = random.Random(2)
    texts = [t for _, t in EDGE_TEXTS if t is None or len(t) < 1000]
    texts += [" ".join(r.choice("the cat sat on a mat and The dog".split()) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += [SENTENCE * 20]
    docs = stored(list(enumerate(texts)))
    train = [i % 4 != 1 for i in range(len(texts))]
    taken = {}
    fit = lm.fit_mixture
    monkeypatch.setattr(lm, "fit_mixture", lambda *a: taken.setdefault("mixture", fit(*a)))
    rows = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") % 4 != 1).collect()}
    mixture = taken["mixture"]
    assert np.allclose(mixture.weights.sum(1), 1) and (mixture.weights >= 0).all()
    assert len(rows) == len(texts)
    for i, (tokens, known, n, base, triples) in enumerate(brute_scores(texts, train)):
        row = rows[i]
        assert (row.n_tokens, row.n_known, row.train_tokens, row.train) == (tokens, known, n, train[i])
        assert row.base_score == pytest.approx(base)
        assert row.score == pytest.approx(float(mixture.log10(*np.array(triples, float).T).sum()))
    held = [i for i, learn in enumerate(train) if not learn and i >= len(texts) - 61]
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)


def test_mixture_finds_the_weights():
    """Held-out counts of a context whose pairs tell everything, and of one whose pairs tell nothing."""
    code = lambda context, word, share: int((lm.bucket(np.array([context]))[0] * 1024 + lm._level(np.array([word]))[0]) * 1024 + lm._level(np.array([share]))[0])
    mixture = lm.fit_mixture([(code(100, 3, 1.0), 50), (code(3, 200, 0.0), 50)], 1000, 10_000)
    assert mixture.weights[lm.bucket(np.array([100]))[0]].argmax() == 2
    assert mixture.weights[lm.bucket(np.array([3]))[0]].argmax() == 1


def test_scoring_without_rows_or_training_rows(stored, empty):
    assert lm.score(empty, F.lit(True)).count() == 0
    rows = lm.score(stored([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(1, 3, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)}
