"""Operator 11 against plain use of the tokenizer, and the rules of its classes."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changesync.llm import harmonic, tokens
from changesync.storage import Scratch

PATH = tokens.public_path("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("slack", [0, 4, 16])
def test_classes_fill_and_cuts_are_the_fewest(slack):
    how = harmonic.Harmonic(256, slack)
    for k, n in how.classes().items():
        assert 0 <= how.tokens - k * n <= slack
    lengths = set(how.classes().values())
    fewest = [0] + [None] * how.tokens
    for n in range(1, how.tokens + 1):
        fewest[n] = 1 + min(fewest[n - x] for x in lengths if x <= n)
    for n, cut in enumerate(harmonic.cuts(how)):
        assert cut.sum() == n and set(cut.tolist()) <= lengths and len(cut) == fewest[n] and sorted(cut, reverse=True) == cut.tolist()


def check(rows, docs, how):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(
        (r.doc_id is None, r.doc_id or 0, len(ids), crc(ids)) for r in docs.collect()
        for ids in [[*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]]
    )
    texts = defaultdict(list)
    for r in docs.collect():
        texts[(r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1)].append(r.text or "")
    per_doc, where = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[(r.row, r.doc_id, r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
        where[r.sequence_id].append((r.offset, r.length))
    assert sorted((d is None, d or 0, n) for _, d, n in per_doc) == [w[:3] for w in want]
    for (_, doc_id, n), cut in per_doc.items():
        cut.sort()
        assert [s for s, _, _ in cut] == [sum(x for _, x, _ in cut[:i]) for i in range(len(cut))] and sum(x for _, x, _ in cut) == n
        made = []
        for text in texts[(doc_id, n)]:
            ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
            made.append([crc(ids[s : s + x]) for s, x, _ in cut])
        assert [c for _, _, c in cut] in made
    padding = 0
    for places in where.values():
        places.sort()
        size = sum(n for _, n in places)
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and size <= how.tokens
        padding += 0 if size & (size - 1) == 0 else how.tokens - size
    assert padding <= how.slack * len(where)


@pytest.mark.parametrize("how", [harmonic.Harmonic(), harmonic.Harmonic(64, 0), harmonic.Harmonic(256, 16)])
def test_packing_holds_every_id(spark, awkward, small, nothing, clash, how):
    for docs in (awkward, clash(awkward), small.repartition(5), nothing):
        check(harmonic.packed(docs, PATH, 2, how).collect(), docs, how)


def test_sequences_hold_the_ids(spark, small):
    how, scratch = harmonic.Harmonic(128, 2), Scratch(spark)
    cut = scratch.keep(harmonic.pieces(small.repartition(3), PATH, 2, how), "pieces")
    places, again = harmonic.pack(cut, how, scratch)
    lists = {r.sequence_id: list(r.ids) for r in harmonic.sequences(places, cut, again).collect()}
    for r in places.collect():
        assert crc(lists[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32
    assert places.agg(F.sum("length")).first()[0] == sum(map(len, lists.values()))


def test_capacity_must_be_a_power_of_two():
    with pytest.raises(ValueError):
        harmonic.Harmonic(100)
