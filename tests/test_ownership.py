"""Who owns a shared record: only accepted writes move a link, so batches may be cut anywhere."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from changesync.operators import xref
from changesync.plans.sync import SyncConfig, apply_result, sync_batch
from changesync.schema import BUS_COLUMNS, CHANGE_EVENT, TARGET_ROW, XREF_LINK
from changesync.sources.maps import parse_maps
from replay import canonical_hash, replay_sides

NOW = datetime(2024, 7, 1, tzinfo=timezone.utc)
PAIR = "crm:account|erp:customers"
THERE = {"name": "there", "sourceSystem": "erp", "sourceEntity": "Customers", "targetSystem": "crm", "targetEntity": "account",
         "fields": [{"source": "Code", "target": "code"}, {"source": "V", "target": "v"}], "integrationKey": ["code"]}
BACK = {"name": "back", "sourceSystem": "crm", "sourceEntity": "account", "targetSystem": "erp", "targetEntity": "Customers",
        "fields": [{"source": "code", "target": "Code"}, {"source": "v", "target": "V"}], "integrationKey": ["Code"]}


def batches(spark, events, links, target, cuts):
    """(correlation, outcome, record) of all events, run in as many batches as the cuts make."""
    docs = parse_maps(spark.createDataFrame([(json.dumps(m),) for m in (THERE, BACK)], "document STRING"))
    table = xref.mirrors(spark.createDataFrame(links, XREF_LINK).withColumn("version", F.lit(1).cast("bigint")))
    snapshot = spark.createDataFrame(target, TARGET_ROW)
    users = spark.createDataFrame([("svc",)], "user_id STRING")
    out, config = [], SyncConfig({"erp": "by_id", "crm": "by_id"})
    for a, b in zip([0, *cuts], [*cuts, len(events)]):
        part = spark.createDataFrame(events[a:b], f"{CHANGE_EVENT}, {BUS_COLUMNS}")
        result = sync_batch(part, docs, table, snapshot, users, config, F.lit(NOW))
        out += [(int(r.correlation_id), r.outcome, r.target_record_id) for r in result.history.collect()]
        if b < len(events):
            links_after, target_after = apply_result(result, table, snapshot)
            table = spark.createDataFrame(links_after.collect(), links_after.schema)
            snapshot = spark.createDataFrame(target_after.collect(), TARGET_ROW)
    return sorted(out)


def event(seq, system, record, minutes, code, value, ours=False):
    names = ("Code", "V") if system == "erp" else ("code", "v")
    data = {names[0]: f'"{code}"', names[1]: str(value)}
    entity, at = ("Customers" if system == "erp" else "account"), NOW + timedelta(minutes=minutes)
    return (system, entity, record, "Update", at, None, data, "svc" if ours else "u", str(seq), seq, at, 1)


def plainly(events, links, resolve):
    steps = [dict(
        system=e[0], record=e[2], other="crm" if e[0] == "erp" else "erp", at=e[4], ours=e[7] == "svc", data=e[6],
        mapped={(k.lower() if e[0] == "erp" else k.capitalize()): v for k, v in e[6].items()},
    ) for e in events]
    stored = [((s1, r1), (s2, r2), state and {"written_to": state[0], "fields": state[1], "hash": state[2], "at": state[4]}) for _, s1, r1, s2, r2, state in links]
    return [(i, o, r) for i, (o, r) in enumerate(replay_sides(steps, stored, resolve))]


TARGET = [("crm", "account", "T0", {"code": '"c0"'}), ("erp", "Customers", "R0", {"Code": '"c0"'})]


def test_a_discarded_event_moves_no_link(spark):
    """A creates the link, B takes the record over, A's late event is discarded, and the record's own
    change, older than B's write, meets B's link."""
    events = [event(0, "erp", "A", 0, "c0", 1), event(1, "erp", "B", 10, "c0", 2), event(2, "erp", "A", -5, "c0", 3), event(3, "crm", "T0", 5, "c0", 4)]
    want = [(0, "Updated", "T0"), (1, "Updated", "T0"), (2, "DiscardedByLastWriterWins", "T0"), (3, "DiscardedByLastWriterWins", "B")]
    for cuts in ([], [3]):
        assert batches(spark, events, [], TARGET, cuts) == want


@pytest.mark.parametrize("seed", [1])
def test_random_cuts_agree_with_one_batch_and_with_the_store(spark, seed):
    rnd = random.Random(seed)
    code = {"R0": "c0", "R1": "c1", "A": "c0", "B": "c0", "C": "c1", "D": "c0", "T0": "c0", "T1": "c1"}
    target = [(s, e, r, {f: f'"{code[r]}"'}) for s, e, r, f in (
        ("crm", "account", "T0", "code"), ("crm", "account", "T1", "code"), ("erp", "Customers", "R0", "Code"), ("erp", "Customers", "R1", "Code"))]
    resolve = {("erp", r): "T" + c[1] for r, c in code.items() if r[0] != "T"} | {("crm", r): "R" + c[1] for r, c in code.items() if r[0] == "T"}
    written = {"code": '"c0"', "v": "1"}
    links = [(PAIR, "erp", "D", "crm", "T0", ("crm", sorted(written), canonical_hash(written), "erp", NOW + timedelta(minutes=3)))] if seed != 2 else []
    events = []
    for i in range(40):
        record = rnd.choice(list(code))
        events.append(event(i, "crm" if record[0] == "T" else "erp", record, i // 2 + rnd.randrange(-8, 9), code[record], rnd.randrange(3), rnd.random() < 0.1))
    want = plainly(events, links, resolve)
    assert {o for _, o, _ in want} == {"Updated", "EchoSuppressed", "DiscardedByLastWriterWins"}
    for cuts in ([], [rnd.randrange(1, 40)]):
        assert batches(spark, events, links, target, cuts) == want, cuts
