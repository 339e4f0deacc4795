"""Replays, branches and nested changes: by hand, and against plain code on made data."""

import json
import random

import pytest

from trajecta.operators import branches as B
from trajecta.operators import verify

STEP = "task long, rep long, t long, failure string"
ATTEMPT = "task long, rep long, seq long, step long, type string, same boolean"


def plain(n, failures, attempts):
    """The record of one execution, attempt by attempt: (kept decisions, states, branches, statuses, failures)."""
    upto, first = n, None
    for t in range(n):
        if failures.get(t):
            first = failures[t]
            upto = {B.TOO_EARLY: t + 1, B.NO_START: -1}.get(first, t)
            break
    cut, statuses, differ = upto, [], 0
    for step, kind, same in attempts:
        if kind == "accepted":
            continue
        prefix = step - 1
        if prefix < 0 or prefix > cut:
            statuses.append((prefix, B.OUTSIDE))
        elif kind == "format_invalid":
            statuses.append((prefix, B.FORMAT))
        elif kind != "environment_rejection":
            statuses.append((prefix, B.UNKNOWN_TYPE))
            cut = min(cut, prefix)
        elif same:
            statuses.append((prefix, B.BRANCH))
        else:
            statuses.append((prefix, B.DIFFERS))
            differ += 1
            cut = min(cut, prefix)
    kept = [p for p, s in statuses if s in (B.FORMAT, B.BRANCH) and p <= cut]
    bad = (first is not None) + differ
    return max(cut, 0), cut + 1, len(kept), [s for _, s in statuses], bad, cut == n and not bad


@pytest.mark.parametrize("seed", range(3))
def test_records_equal_attempt_by_attempt(spark, seed):
    r = random.Random(seed)
    steps, tried, want, statuses = [], [], {}, {}
    for rep in range(60):
        n = r.randint(1, 6)
        failures = {t: r.choice(["committed_step_mismatch", B.TOO_EARLY] + [B.NO_START] * (t == 0)) for t in range(n) if r.random() < 0.12}
        attempts = [(r.randint(0, n + 1), r.choice(["accepted", "format_invalid", "environment_rejection", "environment_rejection", "lost"]), r.random() < 0.7) for _ in range(r.randint(0, 7))]
        steps += [(1, rep, t, failures.get(t)) for t in range(n)]
        tried += [(1, rep, k, *a) for k, a in enumerate(attempts)]
        *want[rep], statuses[rep], bad, whole = [x for k, x in enumerate(plain(n, failures, attempts)) if k != 3][:3] + [plain(n, failures, attempts)[3], *plain(n, failures, attempts)[4:]]
        want[rep] = (*want[rep], bad, whole)
    s, a = spark.createDataFrame(steps, STEP).repartition(3), spark.createDataFrame(tried, ATTEMPT).repartition(3)
    got = {r["rep"]: (r["n_steps"], r["n_states"], r["n_branches"], r["n_failures"], r["trusted_complete"]) for r in B.records(s, a).collect()}
    assert got == want
    audit = B.audited(s, a).orderBy("rep", "seq").collect()
    assert {rep: [r["status"] for r in audit if r["rep"] == rep] for rep in statuses} == statuses


def test_cuts_at_the_start_in_the_middle_and_at_the_end(spark):
    steps = spark.createDataFrame([(1, rep, t, None) for rep in range(4) for t in range(3)], STEP)
    tried = [(1, rep, 10 * p + k, p + 1, "format_invalid", True) for rep in range(4) for p in range(4) for k in (0, 2)]
    tried += [(1, rep, 10 * at + 1, at + 1, "environment_rejection", False) for rep, at in ((1, 0), (2, 2), (3, 3))]
    got = {r["rep"]: (r["n_steps"], r["n_branches"], r["n_outside"], r["trusted_complete"]) for r in B.records(steps, spark.createDataFrame(tried, ATTEMPT)).collect()}
    assert got == {0: (3, 8, 0, True), 1: (0, 2, 6, False), 2: (2, 6, 2, False), 3: (3, 8, 0, False)}
    assert B.records(steps, spark.createDataFrame([], ATTEMPT)).where("trusted_complete").count() == 4
    assert B.records(steps.limit(0), spark.createDataFrame([], ATTEMPT)).count() == 0


def plain_changes(before, after):
    """The changes of two states, object by object and key by key."""

    def signature(p):
        m, life = p.get("propMaterial") or {}, p.get("propLife") or {}
        t = m.get("temperatureC")
        if not isinstance(t, (int, float)) or isinstance(t, bool):
            return None
        limits = {k: v[k] for v, names in ((m, ("meltingPoint", "boilingPoint")), (life, ("minTemp", "maxTemp"))) for k in names if isinstance(v.get(k), (int, float))}
        return int((t + 0.5) // 1), {k: (t > v) - (t < v) for k, v in limits.items()}

    out = []
    for i in sorted(set(before) | set(after), key=int):
        a, b = before.get(i), after.get(i)
        if a is None or b is None:
            out.append((i, (a or b)["name"], verify.EXISTS, str(a is not None).lower(), str(b is not None).lower()))
            continue

        def diff(x, y, path, i=i, a=a, b=b):
            if isinstance(x, dict) and isinstance(y, dict):
                for k in sorted(set(x) | set(y)):
                    diff(x.get(k), y.get(k), [*path, k])
            elif x != y:
                field = ".".join(path)
                if field != verify.TEMPERATURE or signature(a["properties"]) != signature(b["properties"]):
                    out.append((i, b["name"], field, x, y))

        diff(a, b, [])
    return out


def said(x):
    return x if x is None or isinstance(x, str) else json.dumps(x, sort_keys=True, separators=(",", ":"))


def test_nested_changes_equal_plain_ones(spark):
    r = random.Random(5)

    def value(depth):
        k = r.random()
        if k < 0.4 and depth:
            return {x: value(depth - 1) for x in r.sample("abcd", r.randint(0, 3))}
        return r.choice([None, 1, 2, 1.5, "x", "1", True, [1, "a"], [], {}, "{}", "null"])

    def thing(k):
        return {"name": f"n{k}", "parent": r.choice([None, "1", "12"]), "room": None, "properties": {"v": value(4), "propMaterial": r.choice([{"temperatureC": r.choice([9.6, 10.2, 10.4, None, "hot"]), "meltingPoint": 10}, {}, None])}}

    states = [({str(k): thing(k) for k in r.sample(range(1, 14), 5)}, {str(k): thing(k) for k in r.sample(range(1, 14), 5)}) for _ in range(40)]
    sides = [spark.createDataFrame([(n, i, json.dumps(o)) for n, pair in enumerate(states) for i, o in pair[side].items()], "state long, id string, object string") for side in (0, 1)]
    rows = verify.nested_changes(*sides, ["state"]).orderBy("state", "place").collect()
    for n, (before, after) in enumerate(states):
        own = [r for r in rows if r["state"] == n]
        want = plain_changes(before, after)
        assert [(r["id"], r["object"], r["field"], r["before"], r["after"]) for r in own] == [(i, o, f, said(x), said(y)) for i, o, f, x, y in want]
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        for x in own:
            if x["field"] == "parent":
                assert x["before_label"] == before.get(x["before"], {}).get("name", x["before"]) and x["after_label"] == after.get(x["after"], {}).get("name", x["after"])
            assert (x["after_bin"] is None and x["before_bin"] is None) or x["field"] == verify.TEMPERATURE


def test_numbers_are_compared_by_value_and_depth_is_not_bounded(spark):
    deep, other = "1", "2"
    for _ in range(150):
        deep, other = f'{{"k": {deep}}}', f'{{"k": {other}}}'
    pairs = [('{"name": "a", "properties": {"x": 1e2, "y": 1}}', '{"name": "a", "properties": {"x": 100.0, "y": "1"}}'), (f'{{"name": "a", "properties": {deep}}}', f'{{"name": "a", "properties": {other}}}')]
    sides = [spark.createDataFrame([(k, "7", p[side]) for k, p in enumerate(pairs)], "state long, id string, object string") for side in (0, 1)]
    got = {r["state"]: (r["field"], r["before"], r["after"]) for r in verify.nested_changes(*sides, ["state"]).collect()}
    assert got[0] == ("properties.y", "1", "1") and got[1] == ("properties" + ".k" * 150, "1", "2") and len(got) == 2


def test_node_numbers_follow_first_appearance(spark):
    columns = "task long, rep long, t long, n long, won boolean, complete boolean, student boolean, positive boolean, key_before string, key_after string, loc_before string, loc_after string"
    steps = spark.createDataFrame([(1, rep, t, 2, True, True, False, True, k[t], k[t + 1], None, None) for rep, k in ((2, "abc"), (1, "bcb")) for t in (0, 1)], columns)
    hung = spark.createDataFrame([(1, 2, 5, "b", "z")], "task long, rep long, seq long, source string, target string")
    lone = spark.createDataFrame([(1, 9, "q")], "task long, rep long, key string")
    rows = {r["key"]: r for r in B.nodes(steps, lone, hung).collect()}
    assert {k: r["id"] for k, r in rows.items()} == {"b": "N0", "c": "N1", "a": "N2", "q": "N3", "z": "N4"}
    assert (rows["z"]["is_start"], rows["q"]["is_start"], rows["b"]["n_visits"], rows["b"]["n_rolled_back"], rows["c"]["is_won"]) == (False, True, 3, 1, True)
    pages = {(r["key"], r["page"]): r["members"] for r in B.member_pages(steps, lone, hung).collect()}
    assert pages["b", 0] == ["1:t0", "1:t2", "2:t1", "2:a5-"] and pages["z", 0] == ["2:a5+"]

