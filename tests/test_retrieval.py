"""Hand-made executions, one for each branch of the case rules; and properties that hold on any data."""

import pytest
from pyspark.sql import functions as F

from trajecta.operators import graph, history, retrieval, verify
from trajecta.operators.graph import HOUSEHOLD, SCIENCE
from trajecta.sources import adapters

ROW = "task long, rep long, t long, event_id long, action string, value double, rejected boolean, key_before string, key_after string, won boolean, n long, feedback string, observation string, student boolean, command string, shown string, rejection string, format_error string, executed boolean, complete boolean, positive boolean, loc_before string, loc_after string"


def run(task, rep, keys, won, rejected=(), gaps=(), complete=True, unseen=()):
    """The states of an execution as letters; places in `unseen` have no locator."""
    n = len(keys) - 1
    loc = [None if k in unseen else x for k, x in enumerate(keys)]
    return [(task, rep, t, 100 * rep + t, "act", 1.0, t in rejected, keys[t], keys[t + 1], won, n, keys[t + 1] + ("?" if t in gaps else ""), keys[t], rep % 4 == 0, "go", "Here.", "no" if t in rejected else None, None, True, complete, t not in rejected, loc[t], loc[t + 1]) for t in range(n)]


@pytest.fixture(scope="module")
def tiny(spark):
    rows = run(1, 1, "abcd", True) + run(1, 2, "abxyz", False) + run(1, 3, "qbd", True, gaps={0})
    rows += run(1, 0, "abxq", False) + run(1, 4, "ghid", True) + run(1, 8, "gx", False)
    return spark.createDataFrame(rows, ROW)


def by_place(df, rep):
    return {r["t"]: r for r in df.where(F.col("rep") == rep).collect()}


def test_four_cases(tiny):
    lost = by_place(retrieval.four_case(tiny), 0)
    assert [lost[t]["case"] for t in range(3)] == ["graph_inside_with_success_suffix", "graph_inside_with_success_suffix", "graph_inside_without_usable_success_suffix"]
    # from b the gapped run 3 is shorter: the gap lies before b, so it may be followed
    assert (lost[1]["selected"], lost[1]["selected_cost"], lost[1]["selected_rep"]) == ("source", 1, 3)
    assert lost[2]["selected"] is None
    won = by_place(retrieval.four_case(tiny), 4)
    assert won[0]["case"] == "graph_outside_student_succeeded" and won[0]["selected"] == "student_self" and won[0]["selected_cost"] == 3
    assert by_place(retrieval.four_case(tiny), 8)[0]["case"] == "graph_outside_student_failed"


def test_household_needs_a_match_for_the_own_rest(tiny):
    won = by_place(retrieval.four_case(tiny, HOUSEHOLD), 4)
    assert won[0]["case"] == "outside_self_success" and won[0]["selected"] is None


def test_final_state_only_where_allowed(spark):
    rows = spark.createDataFrame(run(1, 1, "ab", True) + run(1, 0, "bc", False), ROW)
    assert by_place(retrieval.four_case(rows, SCIENCE), 0)[0]["selected_cost"] == 0
    assert by_place(retrieval.four_case(rows, HOUSEHOLD), 0)[0]["case"] == "matched_no_recorded_success"


def test_gap_after_the_anchor_breaks_a_suffix(spark):
    rows = spark.createDataFrame(run(1, 1, "abcd", True, gaps={1}) + run(1, 0, "ax", False), ROW)
    assert by_place(retrieval.four_case(rows, SCIENCE), 0)[0]["case"] == "graph_inside_without_usable_success_suffix"
    assert by_place(retrieval.four_case(rows, HOUSEHOLD), 0)[0]["selected_cost"] == 3


def test_rejected_step_is_no_candidate(spark):
    rows = spark.createDataFrame(run(1, 1, "ab", True, rejected={0}) + run(1, 0, "ax", False), ROW)
    assert by_place(retrieval.four_case(rows), 0)[0]["selected"] is None


def test_tie_goes_to_the_source(spark):
    rows = spark.createDataFrame(run(1, 1, "ab", True) + run(1, 0, "ac", True), ROW)
    assert by_place(retrieval.four_case(rows), 0)[0]["selected"] == "source"


def test_anchor_looks_back(tiny):
    got = by_place(retrieval.success_anchor(tiny), 0)
    assert [got[t]["anchor_t"] for t in range(3)] == [0, 1, 1]
    failed = by_place(retrieval.failure_anchor(tiny), 0)
    assert [(failed[t]["anchor_t"], failed[t]["source_t"]) for t in range(3)] == [(0, 0), (1, 1), (2, 2)]


def test_references_have_no_source_twice(tiny):
    refs = retrieval.references(tiny)
    assert refs.count() == refs.dropDuplicates(["task", "rep", "t", "source_rep"]).count()
    assert {r["role"] for r in refs.where("rep = 4").collect()} == {"selected"}


def test_selected_is_never_dearer_than_a_candidate(spark, data):
    s = adapters.steps(spark.read.parquet(f"{data}/events.parquet"))
    chosen = retrieval.four_case(s).join(s.select("task", "rep", "t", "loc_before"), ["task", "rep", "t"])
    worse = chosen.join(retrieval.source_visits(s).where("eligible").select("task", F.col("loc").alias("loc_before"), "cost"), ["task", "loc_before"]).where("selected_cost > cost")
    assert worse.count() == 0
    assert chosen.count() == s.where("student").count()


def test_trusted_prefix(spark):
    rows = spark.createDataFrame(run(1, 1, "abcd", True, gaps={1}) + run(1, 2, "ab", False), ROW)
    trust = {r["rep"]: (r["trusted"], r["n_mismatch"]) for r in verify.trusted_prefix(verify.compare(*verify.replay(rows))).collect()}
    assert trust == {1: (1, 1), 2: (1, 0)}


def test_replay_of_another_length_is_a_mismatch(spark):
    a = spark.createDataFrame([(1, 1, 0, "x")], "task long, rep long, t long, recorded string")
    b = spark.createDataFrame([(1, 1, 0, "x"), (1, 1, 1, "y")], "task long, rep long, t long, replayed string")
    assert verify.trusted_prefix(verify.compare(a, b)).first()["trusted"] == 1


def test_order_of_input_does_not_matter(tiny):
    a, b = (graph.nodes(x).orderBy("key").collect() for x in (tiny, tiny.repartition(7, "key_after")))
    assert a == b


def test_interaction_modes(spark):
    menu = "Ambiguous request: which?\n0: a\n1:  b  c"
    acts = [("Unknown action.", True), (menu, True), ("That can't be", False), ("That can't be moved.", True), ("x", False), ("The door is not open.", True), ("You see.", True), (None, True), (menu, False), (menu, True), ("Done.", True)]
    got = history.interaction(spark.createDataFrame([(1, 1, t, s, e) for t, (s, e) in enumerate(acts)], "task long, rep long, t long, shown string, executed boolean")).orderBy("t").collect()
    n, p, u = "normal", "pending_menu", "unknown"
    assert [r["mode"] for r in got] == [n, p, p, u, u, u, n, n, n, p, n]
    assert [r["previous_mode"] for r in got] == [None] * 3 + [p, p, u] + [None] * 5
    assert [r["last_known"] for r in got] == [{}] * 3 + [{"0": "a", "1": "b c"}] * 3 + [{}] * 5 and got[2]["options"] == {"0": "a", "1": "b c"}
    assert [r["preserved"] for r in got] == [not e for _, e in acts]


def test_untrusted_sources_and_states_without_identity_match_nothing(spark):
    def case(*rows):
        return by_place(retrieval.four_case(spark.createDataFrame([x for r in rows for x in r], ROW)), 0)[0]

    student = run(1, 0, "ax", False)
    assert case(run(1, 1, "abc", True), student)["selected_cost"] == 2
    assert case(run(1, 1, "abc", True, complete=False), student)["case"] == "graph_inside_without_usable_success_suffix"
    assert case(run(1, 1, "abc", True, unseen={0}), student)["case"] == "graph_outside_student_failed"
    assert case(run(1, 1, "abc", True), run(1, 0, "ax", False, unseen={0}))["case"] == "graph_outside_student_failed"
    # neither does one state without identity match another
    assert case(run(1, 1, "abc", True, unseen={0}), run(1, 0, "ax", False, unseen={0}))["case"] == "graph_outside_student_failed"
    assert case(run(1, 1, "abc", True, complete=False), run(1, 2, "ab", False, complete=False), student)["selected"] is None
    rows = spark.createDataFrame(run(1, 1, "ab", True, complete=False) + run(1, 2, "abcd", True) + run(1, 3, "ab", False, complete=False) + student, ROW)
    assert retrieval.fallbacks(retrieval.starts(rows)).first().asDict() == {"task": 1, "success_cost": 3, "success_rep": 2, "failure_cost": None, "failure_rep": None}


def test_a_change_comes_before_a_rejection(spark):
    rows = [(1, 1, t, "ab"[t % 2], "ab"[(t + c) % 2], "x", command, shown, no, bad, no is None and bad is None) for t, (c, command, shown, no, bad) in enumerate([(1, "go", "Unknown action.", "unknown_command", None), (0, "go", "Unknown action.", "unknown_command", None), (0, "look around", "You see.", None, None), (1, "Read book", "It says.", None, None), (0, "3", "Taken.", None, None), (0, "go", "Here.", None, "tags"), (1, "go", "Here.", None, "tags"), (0, "inspect it", "A door.", None, None), (0, "go", "Here.", None, None)])]
    steps = spark.createDataFrame(rows, "task long, rep long, t long, key_before string, key_after string, action string, command string, shown string, rejection string, format_error string, positive boolean")
    got = [(r["kind"], r["passive_during_rejection"], r["is_observation"]) for r in graph.kind(steps).orderBy("t").collect()]
    assert got == [("state_change", True, False), ("rejection", False, False), ("internal_observation", False, True), ("state_change", False, True), ("binding", False, False), ("format_invalid", False, False), ("state_change", False, False), ("internal_observation", False, True), ("unchanged_non_observation", False, False)]
    assert [r["kind"] for r in graph.kind(steps, graph.SHOP).orderBy("t").collect()] == ["rejection", "rejection", "unchanged", "state_change", "unchanged", "format_invalid", "format_invalid", "unchanged", "unchanged"]


def test_catalog_with_every_part_as_goal(spark, data):
    from trajecta.plans import registry

    parts = [r for r in spark.read.parquet(f"{data}/part.parquet").collect()]
    want = sorted((g["p_partkey"], p["p_partkey"], p["p_retailprice"]) for g in parts for p in parts if (g["p_brand"], g["p_type"]) == (p["p_brand"], p["p_type"]) and p["p_retailprice"] <= g["p_retailprice"])
    got = sorted(tuple(r) for r in registry.QUERIES["catalog_matches"](spark, data).collect())
    assert got == want and {g for g, _, _ in got} == {p["p_partkey"] for p in parts}
    first = [x for k, x in enumerate(want) if sum(y[0] == x[0] for y in want[max(0, k - 2) : k]) < 2]
    assert sorted(tuple(r) for r in registry.QUERIES["catalog_capped"](spark, data).collect()) == first


def test_every_event_is_a_decision(spark):
    rows = [(k, k // 4 * 10, k % 2, "purchase" if k in (20, 21, 130) else "view", 80.0) for k in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts long, user_id long, event_type string, value double")
    got = adapters.steps(events, cap=30).collect()
    assert sorted(r["event_id"] for r in got) == list(range(200))
    want = {}
    for user in (0, 1):
        e = t = 0
        for k in range(user, 200, 2):
            want[k] = (user + 8 * e, 0, t)
            done = k in (20, 21, 130) or t == 29
            e, t = (e + 1, 0) if done else (e, t + 1)
    assert {r["event_id"]: (r["task"], r["rep"], r["t"]) for r in got} == want
    ends = {(r["task"], r["rep"]): r for r in got if r["t"] == r["n"] - 1}
    assert len(ends) == len({(r["task"], r["rep"]) for r in got})
    assert {r["event_id"] for r in ends.values() if r["won"]} == {20, 21, 130} and all(r["key_before"] == "start" for r in got if r["t"] == 0)


def test_page_results_of_parts_with_one_id(spark, tmp_path):
    from tests.oracle import duck, spark_rows
    from trajecta.plans import registry

    # the first ten digits of both hashes are CDD90F30AD; the last two are equal entries of one page
    parts = [(805733, "bolt"), (1090164, "ring"), (5, "nut"), (9, "nut"), (9, "nut")]
    spark.createDataFrame(parts, "p_partkey long, p_name string").toPandas().to_parquet(f"{tmp_path}/part.parquet")
    got = spark_rows(registry.QUERIES["page_results"](spark, str(tmp_path)))
    assert got == duck(str(tmp_path), registry.ORACLES["page_results"]) and len(got[1]) == 2
