"""Operators 9 and 10 against plain Python."""

import hashlib
import re
from collections import defaultdict

import pyarrow as pa

from changesync.llm import bottom_k, grace_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_dedup(docs, got):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[normal(r.text)].append(r.doc_id)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for i in sorted(ids, key=lambda i: (i is None, i)):
            want.append((i, keep, len(ids), i == keep and left > 0, sha))
            left -= i == keep
    key = str
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=key) == sorted(want, key=key)


def test_dedup(awkward, small, nothing, clash):
    for docs in (awkward, clash(awkward), small, nothing):
        check_dedup(docs, grace_dedup.dedup(docs).collect())


def test_dedup_recurses_when_a_table_is_full(awkward, small):
    check_dedup(awkward, grace_dedup.dedup(awkward, most=300).collect())
    check_dedup(small, grace_dedup.dedup(small, most=20_000).collect())


def test_open_addressing_compares_contents():
    table = grace_dedup.Table(1 << 20)
    sha = bytes(32)  # one hash for all
    for i in range(3000):
        assert table.add(sha if i < 50 else hashlib.sha256(b"%d" % (i % 700)).digest(), b"%d" % (i % 700), (False, i, i), 1)
    assert sum(table.size) == 3000 and len({k[2] for k in table.keys}) == 700


def test_bytes_normalise_like_the_pattern():
    for t in ("", " ", "a", " a", "a ", "a \t\r\n\x0b\x0c b", "\x1c a\x85 \xa0b"):
        assert grace_dedup.normal(t.encode()).decode() == normal(t)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_against_next(awkward, small, nothing, clash):
    for docs in (awkward, clash(awkward), small, nothing, small.limit(1)):
        for partitions in (1, 5):
            got = bottom_k.against_next(docs, partitions=partitions).collect()
            rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
            want = {}
            for i, (doc_id, text) in enumerate(rows):
                following = rows[(i + 1) % len(rows)][1]
                third = len(text) // 3
                edited = text[: len(text) - third] + following[:third]
                want.setdefault(doc_id, []).append((len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
            assert len(got) == len(rows)
            for r in got:
                match = [w for w in want[r.doc_id] if w[:2] == (r.n_chars, r.edited_sha256)]
                assert match
                text, edited, following = match[0][2:]
                own, other, after = map(shingle_set, (text, edited, following))
                if len(own | other) <= bottom_k.K:
                    assert r.near_edited == (len(own & other) / len(own | other) if own | other else 1.0)
                else:
                    assert abs(r.near_edited - len(own & other) / len(own | other)) < 0.2
                if len(own | after) <= bottom_k.K and len(match) == 1:
                    assert r.near_next == (len(own & after) / len(own | after) if own | after else 1.0)


def test_estimates_and_merge(spark):
    words = [f"w{i}" for i in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:6000])
    sa, sb, whole = bottom_k.sketches(pa.array([a, b, " ".join(words)]))
    assert abs(bottom_k.resemblance(sa, sb) - 1996 / 5996) < 0.12
    assert abs(bottom_k.containment(sa, sb) - 0.5) < 0.2
    assert abs(bottom_k.distinct_count(whole) / 5996 - 1) < 0.3
    assert bottom_k.merge(sa, sb)[: bottom_k.K // 2].tolist() and set(bottom_k.merge(sa, sb)) <= set(sa) | set(sb)
    parts = spark.createDataFrame([("x", bottom_k.pack(sa)), ("x", bottom_k.pack(sb)), ("y", ""), ("y", None)], "key STRING, fingerprint STRING")
    got = {r.key: r.fingerprint for r in bottom_k.merged(parts, "key").collect()}
    assert got == {"x": bottom_k.pack(bottom_k.merge(sa, sb)), "y": ""}
