"""Operator 1 against brute force."""

import random

from changesync.llm import line_dedup


def words(line):
    return tuple(line.encode().lower().split())


def distance(a, b):
    """Plain edit distance on words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def expected(rows):
    places = sorted(
        ((r.doc_id is None, r.doc_id or 0, i, words(line)) for r in rows for i, line in enumerate((r.text or "").split("\n"))),
    )
    out = []
    for at, (null, doc_id, i, w) in enumerate(places):
        best = (null, doc_id, i)
        if w:
            for null2, doc2, j, v in places[:at]:
                if v == w or (min(len(v), len(w)) >= 5 and abs(len(v) - len(w)) < 2 and len(set(v) ^ set(w)) < 3 and distance(v, w) == 1):
                    best = (null2, doc2, j)
                    break
        first = best == (null, doc_id, i)
        out.append((None if null else doc_id, i, None if best[0] else best[1], best[2], first))
    return out


def check(docs):
    got = sorted(((r.doc_id, r.line, r.keep_doc_id, r.keep_line) for r in line_dedup.dedup(docs).collect()), key=str)
    want = expected(docs.collect())
    assert got == sorted((w[:4] for w in want), key=str)


def test_awkward(awkward, nothing, clash):
    check(clash(awkward))
    check(nothing)


def test_near_lines(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    lines = []
    for _ in range(40):
        line = [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(1, 5)):
            edited = list(line)
            for _ in range(rng.randint(0, 2)):
                kind, at = rng.randrange(3), rng.randrange(len(edited)) if edited else 0
                if kind == 0:
                    edited.insert(at, rng.choice(vocabulary))
                elif edited:
                    edited[at : at + 1] = [rng.choice(vocabulary)] if kind == 1 else []
            lines.append(" ".join(edited))
    rng.shuffle(lines)
    docs = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3 + 1)]
    check(spark.createDataFrame(docs, "doc_id LONG, text STRING"))


def test_repeated_rows_keep_one_line(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d f")], "doc_id LONG, text STRING")
    got = line_dedup.dedup(docs).collect()
    assert sum(r.kept for r in got) == 1 and all((r.keep_doc_id, r.keep_line) == (1, 0) for r in got)


def test_cleaned(spark):
    docs = spark.createDataFrame([(1, "x\none two three four five\n\ny"), (2, "one two three four six\nz\nx"), (3, "x")], "doc_id LONG, text STRING")
    got = {r.doc_id: r.text for r in line_dedup.cleaned(docs, line_dedup.dedup(docs)).collect()}
    assert got == {1: "x\none two three four five\n\ny", 2: "z", 3: ""}


def test_one_edit():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(5))] for _ in range(2))
        assert line_dedup.one_edit(a, b) == (distance(a, b) <= 1)
