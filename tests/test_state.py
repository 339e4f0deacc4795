"""Identity of states, attempts, object trees, catalogs and their guards, by hand and against brute force."""

import hashlib
import json
import math
import subprocess

import pytest
from pyspark.sql import functions as F

from trajecta.functions import identity as I
from trajecta.operators import attempts as A
from trajecta.operators import objects, records, render
from trajecta.plans import registry, state_queries
from trajecta.sources import catalogs


@pytest.mark.parametrize("mode, options, signature", [("normal", {}, '["normal",[]]'), ("normal", {"0": "a"}, None), ("pending_menu", {}, None), ("pending_menu", {"1": " b  c", "0": "a"}, '["pending_menu",[["0","a"],["1","b c"]]]'), ("unknown", {}, None), ("normal", None, None), (None, {}, None)])
def test_signature(spark, mode, options, signature):
    rows = spark.createDataFrame([(mode, options)], "mode string, options map<string,string>")
    assert rows.select(I.signature(F.col("mode"), F.col("options"))).first()[0] == signature


@pytest.mark.parametrize("key, node_key, ok, matchable, found", [("k", None, True, True, "k"), (None, "n", True, True, "n"), ("k", "n", None, True, None), ("k", "n", True, None, None), ("k", "n", True, False, None), (None, None, True, True, None), ("", "n", True, True, None)])
def test_locator_needs_a_captured_state(spark, key, node_key, ok, matchable, found):
    rows = spark.createDataFrame([(key, node_key, ok, matchable)], "key string, node_key string, ok boolean, matchable boolean")
    got = rows.select(I.locator(F.col("key"), F.col("node_key"), F.col("ok"), F.col("matchable"), F.lit("normal"), F.create_map().cast("map<string,string>")).alias("l")).first()["l"]
    assert (got and got["key"]) == found


def test_trust_by_cases(spark):
    cases = [(None, True, None, None, (False, False, False)), (True, True, None, None, (True, True, False)), (True, True, False, None, (True, False, False)), (True, False, None, None, (True, False, True)), (True, False, None, True, (True, False, False)), (True, None, None, None, (True, False, False)), (False, False, None, False, (False, False, False))]
    rows = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "k int, complete boolean, won boolean, trusted_success boolean, source_won boolean")
    got = {r["k"]: r["x"] for r in rows.select("k", A.trust(F.col("complete"), F.col("won"), F.col("trusted_success"), F.col("source_won")).alias("x")).collect()}
    assert all((got[k]["trusted"], got[k]["successful"], got[k]["failed"]) == c[4] and got[k]["score"] == float(c[4][1]) for k, c in enumerate(cases))


STEP, TRY = "task long, rep long, t long, action string, observation string, feedback string", "task long, rep long, seq long, step long, type string, action string, raw_output string, feedback string, reason string"


@pytest.mark.parametrize("tries, error", [([(0, 1, "accepted"), (1, 2, "accepted")], None), ([(0, None, "accepted"), (1, 2, "accepted")], A.NO_SLOT), ([(0, 1, "accepted"), (1, 3, "accepted")], A.OUTSIDE), ([(0, 1, "accepted"), (1, 1, "not_executable")], A.NOT_COVERED), ([(0, 0, "accepted"), (1, 2, "accepted")], A.OUTSIDE)])
def test_merge_finds_unsound_sources(spark, tries, error):
    steps = spark.createDataFrame([(1, 1, t, f"a{t}", f"o{t}", f"f{t}") for t in range(2)], STEP)
    attempts = spark.createDataFrame([(1, 1, seq, step, kind, None, "<action>x</action>", None, None) for seq, step, kind in tries], TRY)
    rows = A.merged(steps, attempts).collect()
    assert len(rows) == len(tries) and {r["error"] for r in rows} == {error}


@pytest.mark.parametrize("action, raw, shown", [("go", "x", "go"), ("<action>", "x", None), (None, "<action> Go On </action>", "Go On"), (None, "<action></action>", ""), (None, "no", None), (None, "<action>a</action><action>b</action>", None)])
def test_proposed_action(spark, action, raw, shown):
    assert spark.createDataFrame([(action, raw)], "a string, r string").select(I.proposed_action(F.col("a"), F.col("r"))).first()[0] == shown


def test_blob_ids_are_those_of_version_control(spark):
    for text in ("", "x\n", "é" * 1000):
        made = subprocess.run(["git", "hash-object", "--stdin"], input=text.encode(), capture_output=True, check=True).stdout.decode().strip()
        assert spark.createDataFrame([(text,)], "t string").select(I.blob_id(F.col("t"))).first()[0] == made


def test_history_of_terminal_notes(spark):
    steps = spark.createDataFrame([(1, 1, 0, "look", 0.0), (1, 1, 1, "eat it", -100.0), (1, 2, 0, "go", 5.0)], "task long, rep long, t long, action string, score double")
    ends = [(1, 1, True, False, -100.0, False, 2, False), (1, 2, True, False, float("nan"), False, 1, False)]
    rows = A.terminal_failure(steps, spark.createDataFrame(ends, "task long, rep long, done boolean, limit_reached boolean, final_score double, won boolean, decision_count long, technical_incomplete boolean")).collect()
    by = {r["rep"]: r for r in rows}
    assert by[1]["note"].endswith('The recorded action "eat it" immediately ended this task with FAILURE (score -100).') and by[1]["error"] is None
    assert by[2]["note"] is None and "finite" in by[2]["error"]


def nested(objects_, parent=None):
    """The plain recursion: nodes as dicts, contents in the order of their JSON."""
    out = []
    for o in objects_:
        if o["parent"] == parent:
            p = json.loads(o["properties"])
            m = p["propMaterial"]
            m["temperatureC"] = {"bin": math.floor(m["temperatureC"] + 0.5), "threshold_sides": {"meltingPoint": (m["temperatureC"] > 1500.0) - (m["temperatureC"] < 1500.0)}}
            out.append({"name": o["name"], "properties": p, "contents": nested(objects_, o["id"])})
    return sorted(out, key=lambda x: json.dumps(x, sort_keys=True))


def test_snapshot_keys_equal_a_plain_recursion(spark, data):
    rows = state_queries.parts_as_objects(spark, data).collect()
    got = {r["state"]: r for r in state_queries.snapshot_keys(spark, data).collect()}
    assert len(got) == 50
    for state, r in got.items():
        own = [o.asDict() for o in rows if o["state"] == state]
        if state % 7 == 3:
            assert (r["key"], r["physical_hash"], r["capture_ok"]) == (None, None, False)
            continue
        physical = hashlib.sha256(json.dumps(nested(own), sort_keys=True).encode()).hexdigest()
        focus = min(o["name"] for o in own) if state % 2 == 0 else None
        key = hashlib.sha256(json.dumps([physical, {"focus_reference": focus, "goal_flags": [["0", "true"]]}], sort_keys=True).encode()).hexdigest()
        assert (r["physical_hash"], r["key"], r["object_count"]) == (physical, key, len(own))


def test_unreadable_trees_have_no_key(spark):
    own = spark.createDataFrame([(1, 1, None, "a", "{"), (2, 1, None, "a", None)], "state long, id long, parent long, name string, properties string")
    control = spark.createDataFrame([(k, None, [], None) for k in (1, 2, 3)], "state long, focus string, goal_flags array<array<string>>, error string")
    assert {r["state"]: r["capture_ok"] for r in objects.state_keys(own, control).collect()} == {1: False, 2: True, 3: False}


@pytest.mark.parametrize("text, found", [("[3, 1, 2]", [3, 1, 2]), ('{"tasks": [{"goal": 5}, {"goal": 0}]}', [5, 0]), ('{"tasks": [7]}', [7])])
def test_goals(spark, tmp_path, text, found):
    (tmp_path / "g.json").write_text(text)
    assert [r["goal"] for r in catalogs.goals(spark, str(tmp_path / "g.json")).orderBy("ord").collect()] == found


@pytest.mark.parametrize("text", ["[]", "[1, 1]", "[-1]", '["x"]', "[1.5]", "[null]"])
def test_bad_goals(spark, tmp_path, text):
    (tmp_path / "g.json").write_text(text)
    with pytest.raises(ValueError):
        catalogs.goals(spark, str(tmp_path / "g.json"))


def test_training_takes_its_own_split_only(spark):
    rows = spark.createDataFrame([(0, 4, "train"), (1, 5, "dev")], "ord long, goal long, split string")
    with pytest.raises(ValueError):
        catalogs.training_tasks(rows)
    assert [tuple(r) for r in catalogs.training_tasks(rows.where("goal = 4")).collect()] == [("goal4", 4, 0, "train")]
    with pytest.raises(ValueError):
        catalogs.refinement(rows, rows.select("goal", F.lit(False).alias("solved")), spark.createDataFrame([(9,)], "goal long"))


def test_strict_documents(spark):
    schema = "path string, sha256 string, actual string, won boolean, source_won boolean, source_kind string, runs array<struct<won:boolean,source_won:boolean,source_kind:string>>"
    good = [("a", None, "x", True, None, "k", None), ("b", "x", "x", None, None, None, [(None, True, None)]), ("c", "x", "x", None, None, "planner_z", [(False, True, "other")])]
    rows = {r["path"]: (r["won"], r["source_kind"]) for r in catalogs.strict_documents(spark.createDataFrame(good, schema)).collect()}
    assert rows == {"a": (True, "k"), "b": (True, "planner_actual_replay"), "c": (False, "planner_z")}
    for bad in (("d", "y", "x", True, None, None, None), ("e", "x", "x", None, None, None, [(True, True, None)] * 2)):
        with pytest.raises(Exception, match="recorded digest|expected one run"):
            catalogs.strict_documents(spark.createDataFrame([bad], schema)).collect()


def test_json_arrays_and_audits(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r["a"] for r in catalogs.json_array(spark, str(tmp_path / "a.json"), "a int").collect()] == [1, 2]
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a"')
    with pytest.raises(Exception):
        catalogs.json_array(spark, str(tmp_path / "b.json"), "a int").collect()
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "task long, s string")
    catalogs.write_audit(rows, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2 and list((tmp_path / "audit").rglob("*.json.gz"))
    with pytest.raises(Exception):
        catalogs.write_audit(rows, str(tmp_path / "audit"))


def test_settings_and_resources(spark):
    old = {"a": {"b": {"c": 1}, "d": 2}}
    assert catalogs.settings_with(old, "a.b.c", 5) == {"a": {"b": {"c": 5}, "d": 2}} and catalogs.settings_with(old, "x.y", 1)["x"] == {"y": 1} and old["a"]["b"]["c"] == 1
    rows = spark.sql("SELECT named_struct('a', named_struct('b', 1, 'c', 2)) AS s")
    assert rows.select(catalogs.with_nested("s", "a.b", F.lit(9)).alias("s")).first()["s"]["a"]["b"] == 9
    assert catalogs.check_resources((1, 4), (2, 4), 2, 12) == {"student": 4, "teacher": 8, "replicas": 4}
    for bad in (((1, 4), (1, 3), 2, None), ((0, 4), (1, 4), 2, None), ((1, 4), (1, 4), 2, 7), ((1, True), (1, 4), 1, None)):
        with pytest.raises(ValueError):
            catalogs.check_resources(*bad)
    catalogs.check_inference(10, 100, 5, True)
    for bad in ((10, 100, 5), (4, 4, 5), (0, 1, 1)):
        with pytest.raises(ValueError):
            catalogs.check_inference(*bad)


def by_hand(run, t, packed):
    """The record of one execution, line after line."""
    seen = {}

    def show(text, owner):
        if not packed or text is None:
            return text or records.NOTHING
        if text in seen:
            return f"[Exact same recorded observation text as OBS{seen[text][0]} ({seen[text][1]}) above; no state identity or shared knowledge is implied.]"
        seen[text] = (len(seen), owner)
        return f"[OBS{len(seen) - 1}: {owner}]\n{text}"

    won = run[0]["won"]
    out = [records.STUDENT_HEAD, records.STUDENT_WON if won else records.STUDENT_LOST, f"Actual student events: {len(run)}; current scored decision: {t + 1}.", records.STUDENT_NOTE, "Student initial observation:", show(run[0]["observation"], "student initial")]
    for i, r in enumerate(run):
        out.append(f"Student event {i + 1}" + (records.SCORED if i == t else ""))
        if i == 0 or r["observation"] != run[i - 1]["feedback"]:
            out += ["Actual input observation:", show(r["observation"], f"student event {i + 1} before")]
        out.append(f"Recorded action: {r['action']}")
        if r["semantic_action"] != r["action"]:
            out.append(f"Recorded action binding: {r['semantic_action']}")
        if r["format_error"]:
            out.append(f"Actual format failure: {r['format_error']}")
        if r["rejection"]:
            out.append(f"Actual environment rejection: {r['rejection']}")
        out += ["Actual feedback:", show(r["feedback"], f"student event {i + 1} feedback")]
    return "\n".join([*out, "END OF COMPLETE STUDENT EXECUTION: " + ("SUCCESS" if won else "FAILURE")])


def test_student_records_by_hand(spark, data):
    rows = state_queries.written(spark, data).where("student").collect()
    runs = {}
    for r in sorted(rows, key=lambda r: r["t"]):
        runs.setdefault((r["task"], r["rep"]), []).append(r)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    got = {(r["task"], r["rep"], r["t"]): (r["plain"], r["packed"]) for r in registry.QUERIES["student_records"](spark, data).collect()}
    assert got == {(*k, t): (md5(by_hand(run, t, False)), md5(by_hand(run, t, True))) for k, run in runs.items() for t in range(len(run))}


def test_source_record_by_hand(spark):
    schema = "task long, rep long, seq long, source_step long, kind_of_event string, committed boolean, action string, observation_before string, feedback string, reason string"
    events = spark.createDataFrame([(1, 2, 0, 0, "not_executable", False, None, None, None, "no"), (1, 2, 1, 0, "committed", True, "go", "hall", "room", None), (1, 2, 2, 1, "committed", True, "look", "room", "room", None)], schema)
    source = spark.createDataFrame([(1, 2, "planner_x", "2.json", "selected", True, True, 1, 2, "hall")], "task long, rep long, kind string, file string, role string, won boolean, trusted boolean, anchor long, n_steps long, initial string")
    sid = "planner_actual_replay:2"
    want = ["COMPLETE SOURCE ACTION/OBSERVATION EXECUTION: " + sid, "Original file: 2.json; role: selected.", records.SOURCE_WON, "Complete source replay trusted: True. Displaying ALL 3 recorded events and all 2 committed steps.", records.SOURCE_NOTE, "Source anchor: before zero-based committed step 1. Its COMPLETE prefix and COMPLETE remaining recorded execution are both retained.", "Source initial observation:", f"[OBS0: {sid} initial]\nhall"]
    want += ["Source event 1; committed-step slot 0 [source prefix; not_executable]", "Recorded action: [no valid source action recorded]", records.NOT_COMMITTED, "Recorded event status: no", "Recorded feedback:", records.NOTHING]
    want += ["Source event 2; committed-step slot 0 [source prefix; committed]", "Actual source input observation:", f"[Exact same recorded observation text as OBS0 ({sid} initial) above; no state identity or shared knowledge is implied.]", "Recorded action: go", "Recorded feedback:", f"[OBS1: {sid} event 2 feedback]\nroom"]
    want += ["Source event 3; committed-step slot 1 [source anchor; committed]", "Recorded action: look", "Recorded feedback:", f"[Exact same recorded observation text as OBS1 ({sid} event 2 feedback) above; no state identity or shared knowledge is implied.]", f"END OF COMPLETE SOURCE {sid}: SUCCESS", records.SOURCE_TAIL]
    assert records.source_records(events, source, True).first()["text"].split("\n") == "\n".join(want).split("\n")


def test_a_strict_budget_raises(spark):
    long, short = (spark.createDataFrame([(1, t)], "k int, text string") for t in ("a b c d", "a b c"))
    assert render.budgeted(long, short, 3, ["k"], strict=True).first()["form"] == "compressed"
    assert render.budgeted(long, short, 4, ["k"], size=F.length).first()["over"]
    with pytest.raises(Exception, match="needs 3, budget 2"):
        render.budgeted(long, short, 2, ["k"], strict=True).collect()


def test_prompts_equal_formatted_templates(spark):
    from trajecta.operators import prompts

    rows = [(1, rep, t, f"task {rep}", f"  seen [SEP] task {rep} [SEP] page {t} \n" if t % 2 else f" room {t}", ["take", None, "go"][t % 3], ["help", f"go {t}", "look"], ["a", "b"], t % 2 == 0, ["Buy Now", "x"]) for rep in (1, 2) for t in range(8)]
    steps = spark.createDataFrame(rows, "task long, rep long, t long, instruction string, observation string, action string, commands array<string>, objects array<string>, search boolean, clickables array<string>").repartition(3)
    for environment, first, later, most in (("science", prompts.SCIENCE_FIRST, prompts.SCIENCE_LATER, 5), ("household", prompts.HOUSEHOLD_FIRST, prompts.HOUSEHOLD_LATER, 5), ("shop", prompts.SHOP_FIRST, prompts.SHOP_LATER, 2)):
        got = {(r["rep"], r["t"]): r["prompt"] for r in prompts.prompts(steps, environment).collect()}
        for _, rep, t, instruction, observation, _, commands, objects, search, clickables in rows:
            past = [r for r in rows if r[1] == rep and r[2] < t]
            entries = [f"[Observation {k + 1}: '{r[4] if environment == 'shop' else r[4].strip()}', Action {k + 1}: '{r[5]}']" for k, r in enumerate(past)]
            offered = [f"'{c}'" for c in commands if c != "help"]
            parts = observation.split(" [SEP] ")
            page = " [SEP] ".join(f"'{p}'" for p in parts[parts.index(instruction) + 1 :]) if instruction in parts else observation
            actions = (["search[<your query>]"] if search else []) + [f"click[{c}]" for c in clickables]
            fields = {"task_description": instruction, "current_observation": page if environment == "shop" else observation.strip(), "action_templates": ", ".join(offered), "objects": ", ".join(f"'{o}'" for o in objects), "admissible_actions": "\n ".join(offered), "available_actions": "\n".join(f"'{a}'," for a in actions)}
            fields |= {"step_count": t, "current_step": t + 1, "history_length": min(most, t), "action_history": "\n".join(entries[-most:])}
            assert got[rep, t] == (later if past else first).format(**fields)


def test_advantages_of_groups_with_one_and_without_a_name(spark):
    from trajecta.operators import batching

    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 1.0), ("b", 2.0), (None, 1.0), (None, 3.0)], "g string, r double")
    got = sorted(((r["g"] or "", r["r"], round(r["advantage"], 5)) for r in batching.group_advantage(rows, "g", "r").collect()))
    assert got == [("", 1.0, -0.70711), ("", 3.0, 0.70711), ("a", 0.0, -1.1547), ("a", 1.0, 0.57735), ("a", 1.0, 0.57735), ("b", 2.0, 2.0)]


def test_given_widths_hold_or_raise(spark):
    from trajecta.operators import batching

    turns = spark.createDataFrame([(1, 0, "user", [1, 2]), (1, 1, "assistant", [3]), (1, 2, "user", [4]), (1, 3, "assistant", [5, 6])], "episode long, step int, role string, ids array<int>")
    rows = batching.expand(turns, 4, (6, 3)).collect()
    assert len(rows) == 4 and {(len(r["prompts"]), len(r["responses"]), len(r["attention_mask"])) for r in rows} == {(6, 3, 9)}
    with pytest.raises(Exception, match="longer than the given widths"):
        batching.expand(turns, 4, (3, 3)).collect()


def test_micro_batches_keep_the_budget_and_the_balance(spark):
    from trajecta.operators import batching
    from trajecta.plans import registry

    root = "/root/testdata/sf0.001"
    rows = registry.QUERIES["microbatch_partitions"](spark, root).collect()
    assert rows
    made = spark.createDataFrame([(b, k, 50 + (k * 37 + b * 11) % 400 if k else 1500) for b in range(3) for k in range(40)], "block long, row long, n long")
    size = {(r["block"], r["row"]): r["n"] for r in made.collect()}
    batches = {}
    for r in batching.micro_batches(made, 1000).collect():
        batches.setdefault((r["block"], r["batch"]), []).append(size[r["block"], r["row"]])
    assert sum(map(len, batches.values())) == 120
    for (block, _), own in batches.items():
        assert sum(own) <= 1000 or own == [1500]
    for block in range(3):
        work = [sum(24576 * n + n * n for n in own) for (b, _), own in batches.items() if b == block and own != [1500]]
        heaviest = max(24576 * n + n * n for n in size.values() if n <= 1000)
        assert max(work) - min(work) <= 2 * heaviest and len(work) <= -(-sum(n for (b, _), n in size.items() if b == block and n <= 1000) // 1000) + 1


def test_trees_deeper_than_a_hundred_levels(spark):
    from trajecta.operators import objects

    rows = [(1, 0, None, "root")] + [(1, k, k - 1, f"o{k}") for k in range(1, 130)]
    got = {r["id"]: r["room"] for r in objects.rooms(spark, spark.createDataFrame(rows, "state long, id long, parent long, name string")).collect()}
    assert got == {0: None} | {k: "o1" for k in range(1, 130)}


def test_prompts_equal_formatted_templates(spark):
    from trajecta.operators import prompts

    rows = [(1, rep, t, f"task {rep}", f"  seen [SEP] task {rep} [SEP] page {t} \n" if t % 2 else f" room {t}", ["take", None, "go"][t % 3], ["help", f"go {t}", "look"], ["a", "b"], t % 2 == 0, ["Buy Now", "x"]) for rep in (1, 2) for t in range(8)]
    steps = spark.createDataFrame(rows, "task long, rep long, t long, instruction string, observation string, action string, commands array<string>, objects array<string>, search boolean, clickables array<string>").repartition(3)
    for environment, first, later, most in (("science", prompts.SCIENCE_FIRST, prompts.SCIENCE_LATER, 5), ("household", prompts.HOUSEHOLD_FIRST, prompts.HOUSEHOLD_LATER, 5), ("shop", prompts.SHOP_FIRST, prompts.SHOP_LATER, 2)):
        got = {(r["rep"], r["t"]): r["prompt"] for r in prompts.prompts(steps, environment).collect()}
        for _, rep, t, instruction, observation, _, commands, objects_, search, clickables in rows:
            past = [r for r in rows if r[1] == rep and r[2] < t]
            entries = [f"[Observation {k + 1}: '{r[4] if environment == 'shop' else r[4].strip()}', Action {k + 1}: '{r[5]}']" for k, r in enumerate(past)]
            offered = [f"'{c}'" for c in commands if c != "help"]
            parts = observation.split(" [SEP] ")
            page = " [SEP] ".join(f"'{p}'" for p in parts[parts.index(instruction) + 1 :]) if instruction in parts else observation
            actions = (["search[<your query>]"] if search else []) + [f"click[{c}]" for c in clickables]
            fields = {"task_description": instruction, "current_observation": page if environment == "shop" else observation.strip(), "action_templates": ", ".join(offered), "objects": ", ".join(f"'{o}'" for o in objects_), "admissible_actions": "\n ".join(offered), "available_actions": "\n".join(f"'{a}'," for a in actions)}
            fields |= {"step_count": t, "current_step": t + 1, "history_length": min(most, t), "action_history": "\n".join(entries[-most:])}
            assert got[rep, t] == (later if past else first).format(**fields)


def test_advantages_of_groups_with_one_and_without_a_name(spark):
    from trajecta.operators import batching

    rows = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 1.0), ("b", 2.0), (None, 1.0), (None, 3.0)], "g string, r double")
    got = sorted((r["g"] or "", r["r"], round(r["advantage"], 4)) for r in batching.group_advantage(rows, "g", "r").collect())
    assert got == [("", 1.0, -0.7071), ("", 3.0, 0.7071), ("a", 0.0, -1.1547), ("a", 1.0, 0.5773), ("a", 1.0, 0.5773), ("b", 2.0, 2.0)]


def test_given_widths_hold_or_raise(spark):
    from trajecta.operators import batching

    turns = spark.createDataFrame([(1, 0, "user", [1, 2]), (1, 1, "assistant", [3]), (1, 2, "user", [4]), (1, 3, "assistant", [5, 6])], "episode long, step int, role string, ids array<int>")
    rows = batching.expand(turns, 4, (6, 3)).collect()
    assert len(rows) == 4 and {(len(r["prompts"]), len(r["responses"]), len(r["attention_mask"])) for r in rows} == {(6, 3, 9)}
    with pytest.raises(Exception, match="longer than the given widths"):
        batching.expand(turns, 4, (3, 3)).collect()


def test_micro_batches_keep_the_budget_and_the_balance(spark):
    from trajecta.operators import batching

    made = spark.createDataFrame([(b, k, 50 + (k * 37 + b * 11) % 400 if k else 1500) for b in range(3) for k in range(40)], "block long, row long, n long")
    size = {(r["block"], r["row"]): r["n"] for r in made.collect()}
    batches = {}
    for r in batching.micro_batches(made, 1000).collect():
        batches.setdefault((r["block"], r["batch"]), []).append(size[r["block"], r["row"]])
    assert sum(map(len, batches.values())) == 120
    for own in batches.values():
        assert sum(own) <= 1000 or own == [1500]
    for block in range(3):
        work = [sum(24576 * n + n * n for n in own) for (b, _), own in batches.items() if b == block and own != [1500]]
        heaviest = max(24576 * n + n * n for n in size.values() if n <= 1000)
        assert max(work) - min(work) <= 2 * heaviest and len(work) <= -(-sum(n for (b, _), n in size.items() if b == block and n <= 1000) // 1000) + 1


def test_trees_deeper_than_a_hundred_levels(spark):
    rows = [(1, 0, None, "root")] + [(1, k, k - 1, f"o{k}") for k in range(1, 130)]
    got = {r["id"]: r["room"] for r in objects.rooms(spark, spark.createDataFrame(rows, "state long, id long, parent long, name string")).collect()}
    assert got == {0: None} | {k: "o1" for k in range(1, 130)}


def test_sources_show_their_limits_bindings_and_statuses(spark):
    steps = spark.createDataFrame([(1, 2, 0, "1", "choice:open", "hall", "seen", None, "refused")], "task long, rep long, t long, action string, semantic_action string, observation string, feedback string, format_error string, rejection string")
    none = spark.createDataFrame([], "task long, rep long, seq long, step long, type string, action string, raw_output string, feedback string, reason string")
    events = A.merged(steps, none).withColumnRenamed("kind", "kind_of_event")
    source = spark.createDataFrame([(1, 2, "teacher", "f", "selected", False, False, None, 1, "hall", "Not certified.")], "task long, rep long, kind string, file string, role string, won boolean, trusted boolean, anchor long, n_steps long, initial string, replay_limit string")
    lines = records.source_records(events, source).first()["text"].split("\n")
    at = lines.index("Not certified.")
    assert lines[at + 1 : at + 3] == [records.SOURCE_INITIAL, "hall"]
    assert lines[at + 3 : at + 11] == ["Source event 1; committed-step slot 0 [unanchored history; committed]", records.SOURCE_INPUT, "hall", "Recorded action: 1", "Recorded action binding: choice:open", "Recorded event status: refused", records.SOURCE_FEEDBACK, "seen"]
