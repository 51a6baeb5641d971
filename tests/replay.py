"""One event after the other in plain Python: what the set-wise pipeline must agree with."""

import hashlib
import json


def canonical_hash(fields: dict) -> str:
    text = "{" + ",".join(f"{json.dumps(k)}:{fields[k]}" for k in sorted(fields)) + "}"
    return hashlib.sha256(text.encode()).hexdigest().upper()


def replay(rows: list[dict], links: dict) -> dict:
    """`rows` in arrival order with group, map_name, source, target, operation, at, ours, mapped,
    data, map_error, key_error; `links` group → (exists, state or None). Returns
    (id, map_name) → (verdict, had_link)."""
    live, out = dict(links), {}
    for r in rows:
        exists, state = live.get(r["group"], (False, None))
        echo = r["ours"]
        if not echo and state and state["written_to"] == r["source"]:
            seen = {f: r["data"].get(f, "null") for f in state["fields"]}
            echo = canonical_hash(seen) == state["hash"]
        if echo:
            verdict = "EchoSuppressed"
        elif state and r["at"] < state["at"]:
            verdict = "DiscardedByLastWriterWins"
        elif r["map_error"] or (not exists and r["key_error"]):
            verdict = "Failed"
        elif r["operation"] == "Delete":
            verdict = "Deleted"
            if exists:
                live[r["group"]] = (True, {"written_to": r["target"], "fields": [], "hash": "", "at": r["at"]})
        else:
            verdict = "Upserted"
            live[r["group"]] = (True, {
                "written_to": r["target"], "fields": sorted(r["mapped"]), "hash": canonical_hash(r["mapped"]), "at": r["at"],
            })
        out[(r["arrival_seq"], r["map_name"])] = (verdict, exists)
    return out


def replay_sides(events: list[dict], links: list[tuple], resolve: dict, pair: str = "") -> list[tuple]:
    """The store as it lies: every link under both sides, each save overwriting both. `events` in arrival
    order with system, record, at, ours, data (own names), mapped (the other side's), other; `links`
    as (side, side, state); `resolve` side → the record its key leads to. Returns (outcome, record written)."""
    store, out = {}, []

    def save(one, two, state):
        store[one] = store[two] = (one, two, state)

    for one, two, state in links:
        save(one, two, state)
    for e in events:
        side = (e["system"], e["record"])
        link = store.get(side)
        state = link and link[2]
        far = None
        if link:
            far = link[1] if link[0] == side else link[0]
        echo = e["ours"]
        if not echo and state and state["hash"] and state["written_to"] == e["system"]:
            echo = canonical_hash({f: e["data"].get(f, "null") for f in state["fields"]}) == state["hash"]
        if echo:
            out.append(("EchoSuppressed", far and far[1]))
        elif state and e["at"] < state["at"]:
            out.append(("DiscardedByLastWriterWins", far and far[1]))
        else:
            far = far or (e["other"], resolve[side])
            save(side, far, {"written_to": e["other"], "fields": sorted(e["mapped"]), "hash": canonical_hash(e["mapped"]), "at": e["at"]})
            out.append(("Updated", far[1]))
    return out
