"""Operator 13 against plain Python on the code points, words and lines of each text."""

import hashlib
import re

import pytest

from changesync.llm import fill_in_middle as fim

UNITS = {"char": r"(?s:.)", "word": r"(?:[\x20\x09-\x0D]+|^)[^\x20\x09-\x0D]*", "line": r"[^\n]*\n|[^\n]+"}


def plainly(doc_id, text, how):
    text = text or ""
    units = [u for u in re.findall(UNITS[how.unit], text) if u]
    assert "".join(units) == text
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n, (p, s, m) = len(units), how.marks
    if not text or any(mark in text for mark in how.marks) or h[2] % 100 >= 100 - how.plain_percent:
        return (doc_id, n, "plain", None, None, text, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < how.spm_percent:
        return (doc_id, n, "spm", a, b - a, s + suffix + p + prefix + m + middle, text)
    return (doc_id, n, "psm", a, b - a, p + prefix + s + suffix + m + middle, text)


@pytest.mark.parametrize("how", [
    fim.Middle(), fim.Middle(unit="word", spm_percent=50, seed="x"), fim.Middle(unit="line", plain_percent=0), fim.Middle(marks=("«p", "»", "§mid")),
])
def test_equals_plain_python(spark, awkward, small, nothing, clash, how):
    marked = spark.createDataFrame(
        [(100 + i, t) for i, t in enumerate(["a<P>b", "<S>", "x <M", "<", "<S", "P>S>M>", "<<<", " \n lead", "tail \n\n", "😀é<P", "a b  c\r\n\td"])], "doc_id LONG, text STRING"
    )
    for docs in (awkward, clash(awkward), small, nothing, marked):
        got = fim.restore(fim.transform(docs, how), how).collect()
        want = [plainly(r.doc_id, r.text, how) for r in docs.collect()]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_shares_and_marks():
    assert fim.Middle().marks == ("<P>", "<S>", "<M>")
    for bad in (dict(unit="token"), dict(marks=("<P>", "P", "<M>")), dict(marks=("a", "a", "b")), dict(marks=("", "x", "y"))):
        with pytest.raises(ValueError):
            fim.Middle(**bad)
