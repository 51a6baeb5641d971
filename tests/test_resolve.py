"""Outcome resolution against the plain replay, in one piece and cut into small chunks."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from changesync.operators import prefix, resolve
from changesync.schema import SYNC_STATE
from changesync.storage import Scratch
from replay import canonical_hash, replay

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)

SCHEMA = (
    "link_key STRING, arrival_seq BIGINT, map_name STRING, source_system STRING, target_system STRING, operation STRING, "
    "occurred_at TIMESTAMP, data MAP<STRING,STRING>, mapped MAP<STRING,STRING>, identity_echo BOOLEAN, system_error STRING, "
    f"map_error STRING, key_error STRING, has BOOLEAN, state {SYNC_STATE}"
)


def sample(seed: int, n: int, groups: int, hot: bool, echoes: float):
    """Random events on links; with `hot`, one link holds most of them."""
    rnd = random.Random(seed)
    links, rows = {}, []
    for g in range(groups):
        kind = rnd.choice(["none", "bare", "state", "tomb"])
        fields = {"k": str(rnd.randrange(3))}
        state = None
        if kind in ("state", "tomb"):
            state = {"written_to": rnd.choice("ab"), "fields": [] if kind == "tomb" else ["k"],
                     "hash": "" if kind == "tomb" else canonical_hash(fields), "at": rnd.randrange(50)}
        links[f"g{g}"] = (kind != "none", state)
    for i in range(n):
        g = 0 if hot and rnd.random() < 0.8 else rnd.randrange(groups)
        source = "b" if rnd.random() < echoes else "a"
        body = {"k": str(rnd.randrange(3))}
        if rnd.random() < 0.2:
            body["x"] = "null"
        bad = rnd.random() < 0.1
        rows.append(dict(
            group=f"g{g}", arrival_seq=i, map_name="ab" if source == "a" else "ba", source=source, target="b" if source == "a" else "a",
            operation=rnd.choice(["Create", "Update", "Update", "Delete"]), at=i // 2 + rnd.randrange(40), ours=rnd.random() < 0.1,
            data=body, mapped={} if bad else {"k": body["k"]}, map_error="bad" if bad else None,
            key_error="no key" if rnd.random() < 0.3 else None,
        ))
    return rows, links


def frame(spark, rows, links):
    def state(g):
        s = links[g][1]
        return s and (s["written_to"], s["fields"], s["hash"], "a", T0 + timedelta(seconds=s["at"]))

    data = [(
        r["group"], r["arrival_seq"], r["map_name"], r["source"], r["target"], r["operation"], T0 + timedelta(seconds=r["at"]), r["data"],
        None if r["map_error"] else r["mapped"], r["ours"], None, r["map_error"], r["key_error"], links[r["group"]][0], state(r["group"]),
    ) for r in rows]
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumn("link", F.when(F.col("has"), F.struct("state"))).drop("has", "state")


@pytest.mark.parametrize("seed, n, groups, hot, echoes, span, fold_rows", [
    (1, 300, 12, False, 0.4, 1000, 500_000),
    (2, 300, 12, False, 0.0, 40, 500_000),
    (3, 400, 6, True, 0.3, 25, 30),
    (4, 400, 3, True, 0.6, 10, 10),
    (5, 500, 20, True, 0.05, 50, 60),
])
def test_settle_equals_replay(spark, seed, n, groups, hot, echoes, span, fold_rows):
    rows, links = sample(seed, n, groups, hot, echoes)
    ready = prefix.with_bucket(frame(spark, rows, links), rows=span)
    got = {
        (r["arrival_seq"], r["map_name"]): (r["verdict"], r["has_link"])
        for r in resolve.settle(ready, fold_rows).select("arrival_seq", "map_name", "verdict", "has_link").collect()
    }
    assert got == replay(rows, links)


def test_far_future_write_blocks_every_later_chunk(spark):
    """One early event dated far ahead: all later chunks must see it."""
    rows, links = sample(9, 200, 1, True, 0.5)
    links["g0"] = (True, None)
    rows[0].update(at=10_000, ours=False, map_error=None, mapped={"k": "9"}, data={"k": "9"}, operation="Update", source="a", target="b", map_name="ab")
    ready = prefix.with_bucket(frame(spark, rows, links), rows=10)
    got = {(r["arrival_seq"], r["map_name"]): (r["verdict"], r["has_link"])
           for r in resolve.settle(ready, 10).select("arrival_seq", "map_name", "verdict", "has_link").collect()}
    assert got == replay(rows, links)


def test_echo_chain_across_chunks(spark):
    """Every event after the first repeats what was written: the state has to travel through
    chunks that never change it."""
    rows, links = sample(11, 60, 1, True, 1.0)
    links["g0"] = (True, None)
    for i, r in enumerate(rows):
        r.update(ours=False, map_error=None, key_error=None, data={"k": "1"}, mapped={"k": "1"}, operation="Update", at=i,
                 source="b" if i else "a", target="a" if i else "b", map_name="ba" if i else "ab")
    rows[-1].update(data={"k": "2"}, mapped={"k": "2"})
    ready = prefix.with_bucket(frame(spark, rows, links), rows=5)
    got = {(r["arrival_seq"], r["map_name"]): (r["verdict"], r["has_link"])
           for r in resolve.settle(ready, 5).select("arrival_seq", "map_name", "verdict", "has_link").collect()}
    want = replay(rows, links)
    assert got == want
    assert [v for v, _ in want.values()].count("EchoSuppressed") == 58


def test_running_before_equals_window(spark):
    df = prefix.with_bucket(spark.range(500).selectExpr("id AS arrival_seq", "id % 3 AS g", "(id * 37) % 101 AS v"), rows=17)
    got = prefix.running_before(df, ["g"], ["arrival_seq"], {"m": ("max", F.col("v")), "s": ("sum", F.col("v"))})
    seen = {}
    for r in sorted(got.collect(), key=lambda r: r["arrival_seq"]):
        before = seen.setdefault(r["g"], [])
        assert r["m"] == (max(before) if before else None)
        assert r["s"] == sum(before)
        before.append(r["v"])


def test_steps_do_not_grow_with_an_echo_only_link(spark):
    """The state functions of a link's chunks are applied in one step: as many tables for 12 chunks as for 60."""
    kept = []
    for n in (60, 300):
        rows, links = sample(11, n, 1, True, 1.0)
        links["g0"] = (True, None)
        for i, r in enumerate(rows):
            r.update(ours=False, map_error=None, key_error=None, data={"k": "1"}, mapped={"k": "1"}, operation="Update", at=i,
                     source="b" if i else "a", target="a" if i else "b", map_name="ba" if i else "ab")
        scratch = Scratch(spark)
        found = resolve.settle(prefix.with_bucket(frame(spark, rows, links), rows=1000), 5, scratch=scratch)
        assert found.filter("verdict = 'EchoSuppressed'").count() == n - 1
        assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()
        kept.append(scratch._count)
    assert kept[0] == kept[1]


def test_bodies_are_read_apart(spark):
    """Verdicts from rows without their bodies, which stand in a table of their own: the facts that are shuffled stay narrow."""
    rows, links = sample(4, 300, 3, True, 0.6)
    scratch = Scratch(spark)
    ready = prefix.with_bucket(frame(spark, rows, links), rows=10).withColumn("_at", F.monotonically_increasing_id())
    wide = scratch.keep(ready.withColumn("_row", F.col("_at") + 7), "wide")
    found = resolve.verdicts(wide.drop("data", "mapped"), scratch, 10, bodies=wide)
    got = {(r["arrival_seq"], r["map_name"]): (r["verdict"], r["has_link"]) for r in found.join(wide.select("_row", *resolve.ORDER), "_row").collect()}
    assert got == replay(rows, links)
    written = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(f"{scratch.root}/2-chunked")
    assert not {"data", "mapped", "fields", "hash"} & set(written.columns)
