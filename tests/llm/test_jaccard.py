"""Operator 7 and the components against brute force."""

import random
from itertools import combinations

from changesync.llm import jaccard_join
from changesync.llm.components import TASKS, components, spanning_forest
from changesync.storage import Scratch


def shingle_set(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def roots_of(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def expected(rows):
    sets = [shingle_set(r.text) for r in rows]
    links = [
        (i, j) for i, j in combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    ]
    root = roots_of(range(len(rows)), links)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[root[i]] = min(low.get(root[i], r.doc_id), r.doc_id)
    return sorted(((r.doc_id, len(sets[i]), low.get(root[i])) for i, r in enumerate(rows)), key=str)


def check(docs, how=jaccard_join.Join()):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(docs, how).collect()]
    assert sorted(got, key=str) == expected(docs.collect())


def near_copies(spark):
    """Families of edited copies around the threshold, shared passages, and a chain."""
    rng, words = random.Random(5), [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    texts = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(30, 160))] + (passage if family % 2 else [])
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    chain = [rng.choice(words) for _ in range(120)]
    for _ in range(25):
        chain = chain[2:] + [rng.choice(words), rng.choice(words)]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")


def test_near_copies(spark):
    docs = near_copies(spark)
    check(docs)
    check(docs, jaccard_join.Join(centres=1, block=4, sketch_bits=4, map_bits=64))


def test_links_of_each_set(spark):
    """Every link between different sets counts, in large groups and over blocks of a class."""
    docs = near_copies(spark)
    rows = docs.collect()
    sets = [frozenset(shingle_set(r.text)) for r in rows]
    different = set(sets)
    want = {r.doc_id: sum(s != t and 100 * len(s & t) >= 85 * len(s | t) for t in different) for r, s in zip(rows, sets)}
    assert max(want.values()) > 10
    for how in (jaccard_join.Join(), jaccard_join.Join(centres=1, block=4, sketch_bits=4, map_bits=64), jaccard_join.Join(block_elements=500)):
        assert {r.doc_id: r.n_links for r in jaccard_join.classes(docs, how).collect()} == want


def test_sets_of_many_classes_meet_a_few_at_a_time(spark):
    """Sixty sets of a list, all alike and none in a class yet: some pairs each, and word that there are more."""
    n, how = 60, jaccard_join.Join()
    reps = spark.createDataFrame([(i, 100, bytes(16)) for i in range(n)], "rep LONG, n LONG, bits BINARY")
    lists = spark.createDataFrame([(7, i, 100, 100, n) for i in range(n)], "token LONG, rep LONG, n LONG, left LONG, members LONG")
    roots, known = spark.createDataFrame([], "node LONG, root LONG"), spark.createDataFrame([], "a LONG, b LONG, overlap LONG, n LONG, m LONG")
    few, every = (jaccard_join.leftovers(lists, roots, reps, known, how, most, Scratch(spark)).collect() for most in (1, 8))
    assert n <= len(few) <= jaccard_join.CLASSES_EACH * n and any(r.more for r in few)
    assert {(r.a, r.b) for r in every} == set(combinations(range(n), 2)) and not any(r.more for r in every)


def test_awkward(awkward, clash, nothing):
    check(clash(awkward))
    check(nothing)


def test_whole_table(small):
    check(small)


def test_components(spark):
    rng = random.Random(3)
    for nodes, n in ((200, 120), (60, 200)):
        links = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)] + [(1000 + i, 1001 + i) for i in range(40)]
        got = components(spark.createDataFrame(links, "a LONG, b LONG"), Scratch(spark)).collect()
        linked = {x for a, b in links if a != b for x in (a, b)}
        assert sorted((r.node, r.root) for r in got) == sorted(roots_of(linked, [(a, b) for a, b in links if a != b]).items())
    assert components(spark.createDataFrame([], "a LONG, b LONG"), Scratch(spark)).collect() == []


def test_links_of_a_large_group_are_thinned(spark):
    """Every two of 300 nodes linked: joins see a few links a node, not all 44,850."""
    links = spark.createDataFrame(list(combinations(range(300), 2)), "a LONG, b LONG")
    thin = [(r.a, r.b) for r in spanning_forest(links).collect()]
    assert len(thin) <= TASKS * 299 and set(thin) <= set(combinations(range(300), 2))
    assert set(roots_of(range(300), thin).values()) == {0}
    assert spanning_forest(links.filter("false")).collect() == []
