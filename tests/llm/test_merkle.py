"""Operator 12 against a plain tree over lists."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from changesync.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fan):
    """(root, siblings of each leaf as (left, right) per level)."""
    paths = [[] for _ in nodes]
    level, under = list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        for at, leaves in enumerate(under):
            first = at // fan * fan
            for i in leaves:
                paths[i].append(("".join(level[first:at]), "".join(level[at + 1 : first + fan])))
        cuts = range(0, len(level), fan)
        level, under = [digest(*level[c : c + fan]) for c in cuts], [sum(under[c : c + fan], []) for c in cuts]
    return level[0], paths


def plainly(rows, fan):
    groups = defaultdict(list)
    for r in rows:
        values = [r[f] for f in merkle.FIELDS]
        claimed = leaf(values)
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text is not None:
            low = r.text.translate({ord(c): c.lower() for c in merkle.CAPITALS})
            claimed = leaf([*values[:-1], low])
        groups[r.source].append(((r.doc_id is not None, r.doc_id or 0, leaf(values)), r.doc_id, claimed))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in names:
        groups[s].sort(key=lambda x: x[0])
        inner[s] = tree([x[0][2] for x in groups[s]], fan)
    if not names:
        return []
    root, upper = tree([inner[s][0] for s in names], fan)
    out = []
    for s, above in zip(names, upper):
        for ((_, _, own), doc_id, claimed), path in zip(groups[s], inner[s][1]):
            node = claimed
            for left, right in path + above:
                node = digest(left, node, right)
            proof = digest(*[a + b for a, b in path + above])
            out.append((doc_id, own, inner[s][0], root, proof, node, node == root))
    return out


@pytest.mark.parametrize("how", [merkle.Tree(), merkle.Tree(fan=2, levels=2), merkle.Tree(fan=3, levels=1)])
def test_equals_plain_tree(spark, awkward, small, nothing, clash, how):
    many = spark.range(700).selectExpr(
        "id % 690 AS doc_id", "'Text ' || id % 680 AS text", "'en' AS lang", "CASE WHEN id < 600 THEN 'é' WHEN id < 617 THEN 'z' WHEN id < 618 THEN 'one' END AS source", "id % 7 AS n_chars"
    )
    named = spark.range(40).selectExpr("id AS doc_id", "'T' || id AS text", "'x' AS lang", "'s' || id AS source", "1L AS n_chars")
    for docs in (awkward, clash(awkward), small, nothing, many, named) if how == merkle.Tree() else (many,):
        got = merkle.manifest(docs, merkle.FIELDS, merkle.lowered_leaf(), tree=how).collect()
        want = plainly(docs.collect(), how.fan)
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_single_row_and_the_siblings(spark):
    one = spark.createDataFrame([(1, "a", "en", None, 1)], "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    row = merkle.manifest(one, merkle.FIELDS, with_path=True).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.path == [] and row.verified
    assert row.proof_sha256 == digest("") and row.leaf == leaf([1, None, "en", 1, "a"])
    two = one.union(one.withColumn("text", F.lit("b")))
    rows = merkle.manifest(two, merkle.FIELDS, claimed=F.lit("0" * 64), with_path=True).collect()
    assert not any(r.verified for r in rows) and all(len(r.path) == 1 for r in rows)
