"""Operator 4 against plain Python; its query is also held against SQL."""

import hashlib
import re
from collections import defaultdict

from changesync.llm import mixing
from pyspark.sql import functions as F


def share(family, budget):
    """Water-filling of {name: (weight, cap)} by filling up one child after another."""
    out, left, open_ = {}, budget, dict(family)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [n for n, (w, cap) in open_.items() if cap * weight <= left * w]
        if not full:
            return out | {n: min(cap, left * w // weight) for n, (w, cap) in open_.items()}
        for n in sorted(full, key=lambda n: (open_[n][1] / open_[n][0], n))[:1]:
            out[n] = open_.pop(n)[1]
            left -= out[n]
    return out


def expected(rows, mix):
    tokens = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    place = []
    for r in rows:
        source = r.source if r.source is not None else "unknown"
        place.append(("domain%d" % (int(hashlib.md5(source.encode()).hexdigest()[0], 16) % 4), r.lang if r.lang is not None else "unknown", source))
    size = defaultdict(int)
    for p, n in zip(place, tokens):
        for depth in (0, 1, 2, 3):
            size[p[:depth]] += n
    budgets = {(): min(size[()] * mix.budget_percent // 100, size[()] * mix.max_epochs)}
    for depth, names in enumerate((mix.domains, mix.langs, mix.sources)):
        for parent in [k for k in list(budgets) if len(k) == depth]:
            family = {k[-1]: (names.get(k[-1], mix.other), size[k] * mix.max_epochs) for k in size if len(k) == depth + 1 and k[:-1] == parent}
            budgets |= {(*parent, n): b for n, b in share(family, budgets[parent]).items()}
    out = []
    for i, (r, p, n) in enumerate(zip(rows, place, tokens)):
        if not size[p]:
            out.append((r.doc_id, *p, n, 0, 0))
            continue
        copies, rest = divmod(budgets[p], size[p])
        key = lambda d: hashlib.md5(f"{mix.seed}|{copies + 1}|{'null' if d is None else d}".encode()).hexdigest()  # noqa: E731, B023
        start = sum(m for q, m, o in zip(place, tokens, rows) if q == p and key(o.doc_id) < key(r.doc_id))
        out.append((r.doc_id, *p, n, copies, min(n, max(0, rest - start))))
    return out


def rows_of(docs, mix):
    taken = mixing.select(docs, mix).withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("lang", "source")})
    return [tuple(r) for r in taken.select("doc_id", "domain", "lang", "source", "tokens", "whole_copies", "extra_tokens").collect()]


def test_shares_and_prefixes(awkward, small, nothing, clash):
    plain = mixing.Mix()
    for docs, mix in ((awkward, plain), (clash(awkward), plain), (nothing, plain), (small, plain), (small, mixing.Mix(budget_percent=250, max_epochs=4)),
                      (small, mixing.Mix(sources={"src1": 900}, budget_percent=10))):
        assert sorted(rows_of(docs, mix), key=str) == sorted(expected(docs.collect(), mix), key=str)


def test_mixture_repeats_rows(small):
    mix = mixing.Mix(budget_percent=250, max_epochs=4)
    copies = {r[0]: r[5] + (r[6] > 0) for r in rows_of(small, mix)}
    out = mixing.mixed(small, mix)
    assert out.columns == small.columns
    got = defaultdict(int)
    for r in out.select("doc_id").collect():
        got[r.doc_id] += 1
    assert got == {i: c for i, c in copies.items() if c}


def test_ties_and_columns_named_like_the_operators_own(spark):
    """Rows without an id, and rows that share one, meet the budget to the token of one document."""
    for doc_id in (None, 7):
        docs = spark.range(1000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit("a b c d e f g h i j").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
        taken = mixing.select(docs).agg(F.sum(F.col("tokens") * F.col("whole_copies") + F.col("extra_tokens")).alias("n")).first()["n"]
        assert taken == 8000
    named = docs.limit(5).selectExpr("*", "'MY-9' AS Domain", "'t' AS tokens", "'w' AS whole_copies", "'x' AS extra_tokens", "'c' AS _copy", "'h' AS _held")
    rows = mixing.mixed(named).collect()
    assert rows and all(tuple(r)[4:] == ("MY-9", "t", "w", "x", "c", "h") for r in rows) and list(rows[0].asDict()) == named.columns
