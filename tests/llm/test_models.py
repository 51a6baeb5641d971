"""Operators 3, 5 and 6: brute force where there is one right answer, held-out quality elsewhere."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from changesync.llm import maxent_lm, tokens, toxicity, viterbi_count
from changesync.llm.counters import tree_sum
from changesync.storage import Scratch

PIECES = tokens.public_path("piece_bpe_32k.model")


def all_maximal(scores):
    """Maximal scoring segments by their definition: best segment, then the same left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2] or (s == best[2] and b - a < best[1] - best[0])):
                best = (a, b, s)
    if best is None:
        return []
    a, b, _ = best
    return all_maximal(scores[:a]) + [best] + [(x + b, y + b, s) for x, y, s in all_maximal(scores[b:])]


def test_segments_are_all_maximal_ones():
    rng = random.Random(4)
    for _ in range(400):
        scores = [rng.uniform(-3, 2) for _ in range(rng.randrange(14))]
        got = toxicity.segments(np.array(scores))
        want = all_maximal(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    hit = sum(r.score >= 0.7 and r.toxic == 1 for r in rows)
    assert hit >= 0.7 * sum(r.toxic for r in rows)
    assert hit >= 0.8 * sum(r.score >= 0.7 for r in rows)
    # Labels of held-out rows change nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert (again.weights == model.weights).all() and again.coef == model.coef


def test_toxicity_of_awkward_tables(spark, awkward, nothing, clash):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (4, 0), (4, None), (None, 1), (99, 1)], "doc_id LONG, toxic INT")
    model = toxicity.fit(awkward, labels)
    got = toxicity.score(clash(awkward), model)
    assert "kept" in got.columns and got.count() == awkward.count()
    scores = {}
    for r in got.collect():
        assert 0 <= r.score <= 1 and scores.setdefault((r.text or ""), r.score) == r.score
    assert toxicity.score(nothing, model).collect() == []
    assert toxicity.fit(nothing, labels) is None and toxicity.fit(awkward, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.score(awkward, None).collect()} == {0.0}


def test_common_words_keep_their_evidence(spark):
    """A word in hundreds of clean contexts, and in many more toxic ones for their number, counts."""
    rng = random.Random(8)
    some = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(8))
    rows = [(i, f"{some()} zorgle {some()}" if i % 14 == 0 or (i % 2 and i % 3) else some(), i % 2) for i in range(12_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id LONG, text STRING")
    how = toxicity.Settings()
    clean = {t for i, t, k in rows if not k and "zorgle" in t and zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(clean) > 500
    model = toxicity.fit(docs, spark.createDataFrame([(i, k) for i, _, k in rows], "doc_id LONG, toxic INT"), how)
    assert model.weights[toxicity.xxhash.xxh3_64_intdigest("zorgle", 0) & ((1 << how.buckets_log2) - 1)] > 0.5
    # The counts are exact, whatever their size: against plain sets.
    training = spark.createDataFrame([(t, k) for _, t, k in rows], "text STRING, toxic INT")
    counts = toxicity._counted(training, how)
    seen = {(k, ws[j - 1] if j else None, ws[j + 1] if j + 1 < len(ws) else None) for _, t, k in rows for ws in [t.split()] for j, w in enumerate(ws) if w == "zorgle"}
    at = toxicity.xxhash.xxh3_64_intdigest("zorgle", 0) & ((1 << how.buckets_log2) - 1)
    for kind in (0, 1):
        assert counts[kind * (1 << how.buckets_log2) + at] == sum(s[0] == kind for s in seen) > 200


def lm_words(text):
    return [*(text or "").encode().lower().split(), None]


def check_lm(docs):
    rows = docs.collect()
    got = maxent_lm.score(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for r in rows if not held(r.doc_id) for w in lm_words(r.text))
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(r.doc_id), held(r.doc_id), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5))
        for r in rows for ws in [lm_words(r.text)]
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    return got


def test_language_model(spark, awkward, small, nothing, clash):
    check_lm(clash(awkward))
    assert check_lm(nothing) == []
    check_lm(small)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    got = maxent_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(r.score <= 0 for r in got)


def plain_model(texts, how):
    """(training texts, model) by loops over tokens: the log10 probability of a text's words."""
    full = 2**32

    def tokens_of(words):
        short = [xxhash.xxh3_64_intdigest(w.encode()) >> 32 for w in words]
        kinds = [maxent_lm._kind(w.encode(), how.classes) for w in words] + [how.classes - 1]
        for i, kind in enumerate(kinds):
            one = short[i - 1] if i else 2
            two = short[i - 2] if i > 1 else 3
            pair = ((one * 0xC2B2AE3D % full) ^ (two * 0x27D4EB2F % full) ^ (one >> 15)) * 0x165667B1 % full
            yield kind, [x >> (32 - how.features_log2) for x in (one * 0x9E3779B1 % full, (two * 0x85EBCA77 + 0x51ED270B) % full, pair)]

    def chosen(features):
        z = [bias[k] + sum(weight[f][k] for f in features) for k in range(how.classes)]
        total = sum(math.exp(x) for x in z)
        return [math.exp(x) / total for x in z]

    seen = [[0] * how.classes for _ in range(how.cells)]
    by_kind, counts = [0] * how.classes, [Counter() for _ in range(how.classes)]
    for words in texts:
        for (kind, features), word in zip(tokens_of(words), [*words, None]):
            by_kind[kind] += 1
            counts[kind][word] += 1
            for f in features:
                seen[f][kind] += 1
    share = [(n + 1) / (sum(by_kind) + how.classes) for n in by_kind]
    bias = [math.log(s) for s in share]
    weight = [[how.start * math.log((n + how.smooth * s) / (sum(row) + how.smooth) / s) for n, s in zip(row, share)] for row in seen]
    for _ in range(how.updates):
        expected, modelled = [[0.0] * how.classes for _ in range(how.cells)], [0.0] * how.classes
        for words in texts:
            for _, features in tokens_of(words):
                for k, p in enumerate(chosen(features)):
                    modelled[k] += p
                    for f in features:
                        expected[f][k] += p
        weight = [[w + how.rate * (n - e - how.decay * w) / ((n + e) / 2 + how.smooth) for w, n, e in zip(*rows)] for rows in zip(weight, seen, expected)]
        bias = [b + how.rate * (n - m) / ((n + m) / 2 + 1) for b, n, m in zip(bias, by_kind, modelled)]

    def score(words):
        total = 0.0
        for (kind, features), word in zip(tokens_of(words), [*words, None]):
            total += math.log10(chosen(features)[kind]) + math.log10((counts[kind][word] + 1) / (by_kind[kind] + len(counts[kind]) + 1))
        return total

    return score


@pytest.mark.parametrize("parts", [1, 5])
def test_language_model_equals_plain_training(spark, parts):
    rng = random.Random(11)
    vocabulary = ["a", "ing", "going", "doing,", "the", "cathe", "x" * 40, "ünder", "zz1", "zz2"]
    rows = [(i, " ".join(rng.choice(vocabulary[: 3 + i % 8]) for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, None), (61, ""), (61, "a going")]
    how = maxent_lm.Settings(classes=5, features_log2=5, updates=2, smooth=2.0, decay=0.5, batch=7, block_bytes=400)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = [((t or "").split()) for _, t in rows]
    score = plain_model([w for (i, _), w in zip(rows, words) if not held(i)], how)
    got = maxent_lm.score(spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(parts), how).collect()
    assert sorted((r.doc_id, round(r.score, 3)) for r in got) == sorted((i, round(score(w), 3)) for (i, _), w in zip(rows, words))


def test_language_model_training_comes_near_its_end(spark):
    """The gradient that training leaves is less than half of what it starts with."""
    how, scratch = maxent_lm.Settings(), Scratch(spark)
    blocks = scratch.keep(maxent_lm.coded(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), how), "blocks")
    weights, bias, _ = maxent_lm.train(blocks, how)
    rows = [r.asDict() for r in blocks.collect()]
    scratch.delete()
    seen = maxent_lm._counts(rows, how)

    def gradient(weights, bias):
        return np.abs(seen - maxent_lm._expected(rows, weights, bias, how) - how.decay * weights).sum()

    assert gradient(weights, bias) < 0.5 * gradient(*maxent_lm.first_weights(seen, how))


def test_logits_beyond_the_range_of_exp():
    weights, bias = np.array([[200, 0], [-200, -190]], np.float32), np.zeros(2, np.float32)
    p = maxent_lm._softmax(maxent_lm._logits([np.array([0, 1])] * 3, weights, bias))
    assert np.allclose(p, [[1, 0], [0, 1]], atol=1e-6)


def test_language_model_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    two, many = ({r.doc_id: r for r in maxent_lm.score(docs.repartition(n)).collect()} for n in (2, 16))
    assert two.keys() == many.keys()
    for i, r in two.items():
        assert (r.n_known, r.train_tokens) == (many[i].n_known, many[i].train_tokens)
        assert math.isclose(r.score, many[i].score, rel_tol=1e-5) and math.isclose(r.base_score, many[i].base_score, rel_tol=1e-9)


@pytest.mark.parametrize("wrong", [{"classes": 33}, {"classes": 1}, {"features_log2": 17}, {"features_log2": 0}])
def test_language_model_settings_are_checked(wrong):
    with pytest.raises(ValueError, match="must be"):
        maxent_lm.Settings(**wrong)


def test_language_model_has_its_classes(spark):
    how = maxent_lm.Settings()
    blocks = maxent_lm.coded(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), how).select("kinds").collect()
    assert len({k for r in blocks for k in r.kinds}) == how.classes - 1 >= 31


def test_classes_and_words_make_a_distribution():
    how = maxent_lm.Settings(classes=6, features_log2=4)
    rng = np.random.default_rng(0)
    weights, bias = rng.normal(size=(16, 6)).astype(np.float32), rng.normal(size=6).astype(np.float32)
    z = maxent_lm._logits(list(rng.integers(0, 16, (3, 20))), weights, bias)
    p = maxent_lm._softmax(z)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5) and how.cells == 16
    assert np.allclose(maxent_lm._log_chosen(z, np.full(20, 2)), np.log(p[:, 2]), atol=1e-5)
    counts = np.array([5, 1, 2])  # of the known words of a class: with one unit for the unknown they sum to 1
    assert math.isclose(((counts + 1) / (counts.sum() + 3 + 1)).sum() + 1 / (counts.sum() + 4), 1)


def test_counts_equal_the_unigram_tokenizer(spark, awkward, small):
    pieces = viterbi_count.vocabulary(PIECES)
    rng = random.Random(6)
    tied = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -2.0), ("abab", -4.5)]
    cases = [
        (pieces, [w for r in (*small.collect(), *awkward.collect()) for w in (r.text or "").split() if len(w) < 3000][:30_000]),
        (tied, ["".join(rng.choice("abx") for _ in range(rng.randrange(1, 12))) for _ in range(2000)]),
    ]
    for vocabulary, words in cases:
        exact = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0))
        # The unknown piece must not lower the smallest score.
        lowest = min(s for _, s in vocabulary)
        exact = Tokenizer(models.Unigram([("<unk>", lowest), *vocabulary], unk_id=0))
        mine = viterbi_count.Counter(vocabulary)
        for w in set(words):
            assert mine.segment("▁" + w)[1] == len(exact.encode("▁" + w).ids), w


def test_count_tokens_adds_up(spark, awkward, nothing, clash):
    counter = viterbi_count.Counter(viterbi_count.vocabulary(PIECES))
    got = viterbi_count.count_tokens(clash(awkward), PIECES).collect()
    want = sorted((str(r.doc_id), sum(counter.segment("▁" + w.decode())[1] for w in (r.text or "").encode().split())) for r in awkward.collect())
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == want
    assert viterbi_count.count_tokens(nothing, PIECES).collect() == []


def test_sums_reach_the_driver_as_one_array(spark, monkeypatch):
    """Whatever the number of tasks; an array of each of several tasks did before, through an RDD."""
    for size, dtype, parts in ((1000, "<i8", 40), (7, "<f4", 3), (1, "<i4", 1)):
        arrays = np.random.default_rng(size).integers(0, 100, (parts, size)).astype(dtype)
        rows = spark.createDataFrame([(a.tobytes(),) for a in arrays], "sums BINARY").repartition(parts)
        with monkeypatch.context() as m:
            m.setattr(type(rows), "rdd", property(lambda _: pytest.fail("an RDD")))
            assert (tree_sum(rows, dtype) == arrays.sum(axis=0)).all()
            assert tree_sum(rows.filter("false"), dtype) is None
