"""Operators 2 and 8 against plain use of the tokenizer."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changesync.llm import best_fit, token_files, tokens
from changesync.storage import Scratch

PATH = tokens.public_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_memory_equals_whole_text_encoding(tokenizer):
    texts = [
        "  a b  ÀÉ İ ﬁ é ́x Σας ΣΑΣ don't I'LL <|endoftext|>x y<|startoftext|> <|ENDOFTEXT|>", "", None, "x\x1cy \x85z w", "ab.c, d.,!? é., 5.",
        "ÅB　C", "word, word. word! Word 'S x's", "́, ั.",
    ]
    for part in (texts, texts[1:], texts[:1] * 3):
        array = pa.array(["pad", *part]).slice(1)
        ids, offsets = tokens.encoder(PATH).ids(array)
        got = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]


def files(spark, docs):
    path = f"{Scratch(spark).root}/tokens"
    token_files.write_tokens(docs, path, PATH, 2)
    rows = token_files.global_starts(token_files.checksums(token_files.read_tokens(spark, path)))
    return path, rows.collect()


def test_files_round_trip(spark, awkward, small, nothing, tokenizer, clash):
    for docs in (awkward, clash(awkward), small, nothing):
        path, got = files(spark, docs)
        want = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
        start, expected = 0, []
        for known, doc_id, text in want:
            ids = ids_of(tokenizer, text, 2)
            expected.append((doc_id if known else None, start, len(ids), crc(ids)))
            start += len(ids)
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected
        whole = token_files.read_tokens(spark, path)
        assert "ids" not in whole.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
        assert whole.filter("doc_id = 3").select("ids").count() == sum(r[0] == 3 for r in expected)


def check_packing(rows, how):
    where = defaultdict(list)
    for r in rows:
        where[r.sequence_id].append((r.offset, r.length))
    for places in where.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        cap = how.capacities()
        assert sum(n for _, n in places) <= cap[0] and len(places) <= cap[1] and sum(n * n for _, n in places) <= cap[2]
    return where


@pytest.mark.parametrize("how", [best_fit.Packing(), best_fit.Packing(tokens=64, shard_pieces=16), best_fit.Packing(256, 3, 256 * 256, rule="dot")])
def test_packing_holds_every_piece(spark, awkward, small, nothing, tokenizer, clash, how):
    for docs in (awkward, clash(awkward), small, nothing):
        rows = best_fit.packed(docs, PATH, 0, how).collect()
        where = check_packing(rows, how)
        want = sorted(
            (r.doc_id is None, r.doc_id or 0, i // how.tokens, i, len(ids[i : i + how.tokens]), crc(ids[i : i + how.tokens]))
            for r in docs.collect() for ids in [ids_of(tokenizer, r.text, 0)] for i in range(0, len(ids), how.tokens)
        )
        assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        if docs is small and how == best_fit.Packing():
            assert len(where) <= 1.02 * sum(r.length for r in rows) / how.tokens + 1


def test_fit_chooses_the_tightest():
    how = best_fit.Packing(tokens=10)
    assert best_fit.fit(np.array([7, 5, 3, 3, 2]), how).tolist() == [0, 1, 0, 1, 1]
    assert best_fit.fit(np.array([], np.int64), how).tolist() == []


def test_sequences_hold_the_ids(spark, awkward, tokenizer):
    how = best_fit.Packing(tokens=64)
    with_ids = Scratch(spark).keep(best_fit.pieces(awkward, PATH, 0, how.tokens, with_ids=True), "pieces")
    placed = best_fit.pack(with_ids.drop("ids"), how, with_ids.count())
    lists = {r.sequence_id: list(r.ids) for r in best_fit.sequences(placed, with_ids).collect()}
    for r in placed.collect():
        assert crc(lists[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32
    assert placed.agg(F.sum("length")).first()[0] == sum(map(len, lists.values()))


def test_word_memory_is_bounded(monkeypatch, tokenizer):
    """It was cut at a million words only; what is met again stays, through any number of batches."""
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    encoder, batch = tokens.Encoder(PATH), 30
    for at in range(0, 1_000, batch):
        texts = [f"often, often w{i}x w{i}x." for i in range(at, at + batch)]
        ids, offsets = encoder.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) + len(encoder.older) <= 2 * (50 + 2 * batch + 4) and "often," in encoder.known


def test_query_reads_the_ids_once(spark, small, tmp_path):
    from changesync.llm import queries

    small.write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op2_token_files(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
