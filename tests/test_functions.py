import pytest
from pyspark.sql import functions as F

from trajecta.functions import observation as O
from trajecta.functions import text as T
from trajecta.operators import batching, catalog, metrics, render
from trajecta.sources import store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, action, reason",
    [
        ("<thought>go</thought> <action> Open DOOR </action>", "open door", None),
        ("<action>look</action>", "look", None),
        ("look", None, "missing_or_multiple_action_tags"),
        ("<action>a</action><action>b</action>", None, "missing_or_multiple_action_tags"),
        ("<action>a</action> then", None, "unclosed_tags_or_extra_text"),
        ("<thought>a<thought>b</thought><action>c</action>", None, "invalid_thought_tags"),
        ("<action>x < thought></action>", None, "nested_control_tags"),
        ("<action>  </action>", None, "empty_action"),
    ],
)
def test_parse_action(spark, text, action, reason):
    got = one(spark, T.parse_action(F.lit(text)))
    assert (got["action"], got["reason"]) == (action, reason)


def test_parse_action_options(spark):
    assert one(spark, T.parse_action(F.lit("<action> </action>"), allow_empty=True))["action"] == ""
    assert one(spark, T.parse_action(F.lit("<action>x <thought ></action>"), strict=False))["action"] == "x <thought >"


def test_norm(spark):
    assert one(spark, T.norm(F.lit(" a \t\nb\x1cc "))) == "a b c"
    assert one(spark, T.norm(F.lit(None).cast("string"))) == ""


def test_menu(spark):
    assert one(spark, T.menu(F.lit("Ambiguous request: which\n0: a  b\n 1 : c\n0: d"))) == {"0": "d", "1": "c"}
    assert one(spark, T.menu(F.lit("0: a"))) == {}


def test_admissibility_rules_differ(spark):
    click = F.array(F.lit("Buy Now"))
    assert one(spark, T.executable(F.lit("click[buy now] x"), click, F.lit(True))) is False
    assert one(spark, T.rollout_rejected(F.lit("click[buy now] x"), click)) is False
    assert one(spark, T.executable(F.lit("search[x]"), click, F.lit(False))) is False
    assert one(spark, T.rollout_rejected(F.lit("search[ ]"), click)) is False


@pytest.mark.parametrize("pricing, floor", [(None, 100.0), ("$10.00", 10.0), ("$30.00 to $20.00 to $1.00", 20.0), ("free", 0.0), ("$x", 0.0), ("$1,200.50", 1200.5)])
def test_price_floor(spark, pricing, floor):
    assert one(spark, T.price_floor(F.lit(pricing).cast("string"))) == floor


def test_queries_of(spark):
    got = one(spark, T.queries_of(F.lit("B1"), F.lit("The [Big] red Box of 2"), F.lit("box")))
    assert got == ["b1", '"the big red box of 2"', "box", "the big red box", "the big red box of 2", "big red box 2", "the big red box of 2"][:6] + got[6:]
    assert len(got) == len(set(got))


def test_balanced(spark):
    assert [one(spark, T.balanced(F.lit(x))) for x in ("", "(a)(b(c))", ")(", "(", "a)")] == [True, True, False, False, False]


def test_splice_and_align(spark):
    ids = F.array(*map(F.lit, [1, 9, 2, 9, 3]))
    assert one(spark, T.splice(ids, F.array(F.lit(7)), 9)) == [1, 9, 2, 7, 9, 3]
    assert one(spark, T.splice(ids, F.array(F.lit(7)), 5)) is None
    values = F.array(*(F.lit(float(x)) for x in [0, 0, 0, 5, 6, 0]))
    assert one(spark, T.aligned(values, F.lit(4), F.lit(2), F.lit(2))) == [0.0, 5.0, 6.0, 0.0]


ROOM = "This room is called the hall. In it, you see:\n"


OBSERVATIONS = [
    ("x ", " x", True, O.LITERAL),
    (ROOM + "\ta cup\n\tthe door", ROOM + "\tthe door\n\ta cup", True, O.SAME),
    (ROOM + "\ta cup\n\ta cup", ROOM + "\ta cup", False, O.DIFFERENT),
    (ROOM + "\ta table. On the table is: a cup (in it, a fly), an apple.", ROOM + "\ta table. On the table is: an apple, a cup (in it, a fly).", True, O.SAME),
    ("On the table is: a cup, an apple.", "On the table is: an apple, a cup.", True, O.SAME),
    ("On the table is: a cup, that is red", "On the table is: that is red, a cup", False, O.LAYOUT),
    ("a\n  b", "a\n b", False, O.LAYOUT),
    ("a\n\tb  c", "a\r\n    b c", True, O.LAYOUT),
    ("a\n  \tb", "a\n    b", True, O.LAYOUT),
    ("Ambiguous request:\n0: a\n1: b", "Ambiguous request:\n0: b\n1: a", True, O.MENU),
    ("Ambiguous request:\n0: a\n1: a", "Ambiguous request:\n0: a\n1: a.", False, O.MENU),
    (None, "", True, O.LITERAL),
]


def test_observations(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _, _) in enumerate(OBSERVATIONS)], "k int, a string, b string")
    got = {r["k"]: (r["e"]["equal"], r["e"]["rule"]) for r in rows.select("k", O.equivalent("a", "b").alias("e")).collect()}
    assert got == {k: (equal, rule) for k, (_, _, equal, rule) in enumerate(OBSERVATIONS)}


def test_unreadable_observations(spark):
    texts = [("", O.NO_TEXT), (None, O.NO_TEXT), ("hello", O.NO_SCOPE), (ROOM + "a cup", O.UNINDENTED), (ROOM + "\ta cup\n\t\tan ant", O.NESTED), (ROOM + "\tcup", O.NO_OBJECT), (ROOM + "\ta cup (", O.BAD_LINE)]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "k int, t string")
    got = {r["k"]: r["c"] for r in rows.select("k", O.canonical("t").alias("c")).collect()}
    assert {k: (c["supported"], c["canonical"], c["reason"]) for k, c in got.items()} == {k: (False, None, why) for k, (_, why) in enumerate(texts)}
    for text, why in (("a cup, cup", O.NO_ARTICLE), ("a cup,, a b", O.NO_ITEM), ("a cup that is red, a b", O.NOT_ATOM), ('a "b"', O.BAD_LIST), ("a (b", O.BAD_LIST)):
        with pytest.raises(O.Unreadable, match=why):
            O.item_list(text)


SCENES = [
    ("This room is called the hall.\n\tthe door\n\ta cup", "This room is called the hall.\n\ta cup\n\tthe door", True),
    ("This room is called the hall.\n\ta table. On the table is: a cup, an apple (in it, a fly).", "This room is called the hall.\n\ta table. On the table is: an apple (in it, a fly), a cup.", True),
    ("This room is called the hall.\nYou also see: a cup, red, the door.", "This room is called the hall.\nYou also see: the door, a cup, red.", True),
    ("This room is called the hall.\n\ta 'x', a b\n", "This room is called the hall.\n\ta b, a 'x'", False),
    ("a\nb", "b\na", False),
    ("Ambiguous request:\n0: a\n1: a", "Ambiguous request:\n0: a\n1: a", True),
    ("Ambiguous request:\n0: a\n1: a", "Ambiguous request:\n0: a", False),
    (" x", "x ", True),
]


def test_the_collectors_rule(spark):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(SCENES)], "k int, a string, b string")
    got = {r["k"]: r["e"] for r in rows.select("k", O.collector_equivalent("a", "b").alias("e")).collect()}
    assert got == {k: same for k, (_, _, same) in enumerate(SCENES)}


def test_weights_sum_to_rows_over_episodes(spark):
    rows = spark.createDataFrame([(1, 0, [1], [2, 3]), (1, 1, [1], [4]), (2, 0, [1, 2], [5])], "episode long, step int, prompt_ids array<int>, response_ids array<int>")
    got = batching.token_weights(rows, 4).collect()
    assert sum(r["weight"] * len(r["response_ids"]) for r in got if r["episode"] == 1) == pytest.approx(2.0)
    assert {r["weight"] for r in got if r["episode"] == 2} == {2.0}


def test_expand_pads(spark):
    turns = spark.createDataFrame([(1, 0, "user", [1, 2]), (1, 1, "assistant", [3]), (1, 2, "user", [4]), (1, 3, "assistant", [5, 6])], "episode long, step int, role string, ids array<int>")
    rows = {(r["episode"], r["step"]): r for r in batching.expand(turns, 3).collect()}
    assert len(rows) == 3
    first, fill = rows[1, 1], rows[None, -1]
    assert first["prompts"] == [batching.PAD] * 2 + [1, 2] and first["responses"] == [3, batching.PAD]
    assert first["attention_mask"] == [0, 0, 1, 1, 1, 0] and first["position_ids"] == [0, 0, 0, 1, 2, 2] and first["response_mask"] == [1, 0]
    assert fill["weight"] == 0.0 and sum(fill["response_mask"]) == 0


def test_micro_batches_hold(spark):
    rows = spark.createDataFrame([(b, r, n) for b in range(3) for r, n in enumerate([500, 10, 90, 60, 40, 80, 100, 1])], "block long, row long, n long")
    got = batching.micro_batches(rows, 100).join(rows, ["block", "row"]).groupBy("block", "batch").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r["k"] for r in got) == 24
    assert all(r["n"] <= 100 or r["k"] == 1 for r in got)


def test_group_advantage_of_one(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("b", 1.0)], "g string, r double")
    got = {(r["g"], r["r"]): r["advantage"] for r in batching.group_advantage(rows, "g", "r").collect()}
    assert got["a", 1.0] == pytest.approx(1.0, abs=1e-5) and got["b", 1.0] == -got["b", 0.0]
    assert {r["advantage"] for r in batching.group_advantage(rows, "g", "r", has_teacher=True).collect()} == {0.0}


def test_across_seeds(spark):
    seeds = spark.createDataFrame([(0, 1.0, None), (1, 3.0, 2.0)], "seed int, a double, b double")
    got = {r["metric"]: (r["mean"], r["sample_std"]) for r in metrics.across_seeds(seeds, ["a", "b"]).collect()}
    assert got["a"] == (2.0, pytest.approx(2**0.5)) and got["b"] == (None, None)
    single = metrics.across_seeds(seeds.where("seed = 1"), ["a"]).first()
    assert (single["mean"], single["sample_std"]) == (3.0, None)


def brute_cover(groups, n, fewest):
    """Every choice of at most one value a group, in the order in which groups and then values are gone through."""
    from itertools import product

    found = []
    for picks in product(*([None, *range(len(g))] for g in groups)):
        chosen = [g[k] for g, k in zip(groups, picks, strict=True) if k is not None]
        mask = 0
        for m, _ in chosen:
            mask |= m
        if mask == (1 << n) - 1:
            found.append([v for _, v in chosen])
    return found


def test_covers(spark):
    import random

    rng = random.Random(3)
    cases = [([[(1, "a"), (3, "ab")], [(2, "b")]], 2), ([[(1, "a")], [(2, "b")]], 2), ([[(1, "a"), (2, "b")]], 2), ([], 1)]
    cases += [([[(rng.randint(0, 7), f"{g}-{k}") for k in range(rng.randint(1, 4))] for g in range(rng.randint(1, 4))], 3) for _ in range(60)]
    schema = "k int, n int, g array<array<struct<mask:bigint,value:string>>>"
    rows = spark.createDataFrame([(k, n, [[{"mask": m, "value": v} for m, v in g] for g in groups]) for k, (groups, n) in enumerate(cases)], schema)
    for n in (1, 2, 3):
        own = rows.where(F.col("n") == n).select("k", catalog.cover(F.col("g"), n).alias("first"), catalog.cover(F.col("g"), n, True).alias("few")).collect()
        for r in own:
            found = brute_cover(*cases[r["k"]], False)
            assert (r["first"] in found and r["few"] in found) if found else r["first"] is r["few"] is None
            assert not found or len(r["few"]) == min(map(len, found))
    first = {r["k"]: r["p"] for r in rows.where("n = 2").select("k", catalog.cover(F.col("g"), 2).alias("p")).collect()}
    assert first == {0: ["ab"], 1: ["a", "b"], 2: None}


@pytest.mark.parametrize("a, b, ratio", [("new york mets", "new york meats", 96), ("fuzzy was a bear", "fuzzy fuzzy was a bear", 100), ("light blue", "blue", 100), ("", "x", 0), ("abc", "xyz", 0), ("dark red", "red dark", 100)])
def test_likeness_of_phrases(a, b, ratio):
    assert catalog.token_set_ratio(a, b) == ratio == catalog.token_set_ratio(b, a)


def test_common_subsequence():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert catalog.common_subsequence(a, b) == best[-1][-1]



def test_plans(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1, "a"), (1, 1, 0, 2, "b"), (2, 0, 0, 1, "a")], "asin long, grp int, ord int, mask long, value string")
    assert [(r["asin"], r["plan"]) for r in catalog.plans(rows, 2).collect()] == [(1, ["a", "b"])]


def test_budget_never_cuts(spark):
    plain = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, "a b c d")], "k int, text string")
    packed = spark.createDataFrame([(1, "x"), (2, "a b"), (3, "a b c d")], "k int, text string")
    got = {r["k"]: (r["form"], r["text"], r["over"]) for r in render.budgeted(plain, packed, 3, ["k"]).collect()}
    assert got == {1: ("plain", "a b c", False), 2: ("compressed", "a b", False), 3: (None, None, True)}


def test_back_references_are_lossless(spark):
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate("abacb")], "g int, o int, x string")
    got = render.back_references(rows, ["g"], "o", "x").orderBy("o").collect()
    firsts = {r["label"]: r["x"] for r in got if r["is_first"]}
    assert [firsts[r["label"]] for r in got] == list("abacb")


def test_task_list(spark, tmp_path):
    (tmp_path / "a.json").write_text('["boil|1|easy", "melt|2|"]')
    assert store.task_list(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "b.json").write_text('{"tasks": [{"gamefile": "boil|1|easy"}]}')
    assert store.task_list(spark, str(tmp_path / "b.json")).first()["family"] == "boil"
    for bad in ('["boil|1"]', '["boil|x|y"]', '["boil|1|a", "boil|1|a"]'):
        (tmp_path / "c.json").write_text(bad)
        with pytest.raises(store.BadInput):
            store.task_list(spark, str(tmp_path / "c.json"))


def test_unsafe_paths(spark):
    bad = ["/a/game.tw-pddl", "a/../game.tw-pddl", "a\\game.tw-pddl", "a/game.txt", None]
    rows = spark.createDataFrame([(x,) for x in [*bad, "a/b/game.tw-pddl", "a..b/game.tw-pddl"]], "p string")
    assert [r["x"] for r in rows.select(store.unsafe_path(F.col("p")).alias("x")).collect()] == [True] * 5 + [False] * 2


def test_episode_files(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "e.json.gz", "wt") as f:
        f.write('{"uid": "u", "task": "t", "rep": 1, "won": true, "steps": [{"step": 1, "action": "a", "score": 1.5}, {"step": 2, "action": "b"}]}')
    steps = store.episode_steps(store.episodes(spark, str(tmp_path))).orderBy("t").collect()
    assert [(r["t"], r["action"], r["score"]) for r in steps] == [(0, "a", 1.5), (1, "b", None)]


def test_padded_tasks_repeat_none(spark):
    tasks = spark.createDataFrame([(f"t{k}",) for k in range(5)] * 2, "task string")
    rows = store.padded_tasks(tasks, 4).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(8)) and [r["padding"] for r in rows] == [False] * 5 + [True] * 3
    assert store.padded_tasks(tasks.where("task < 't4'"), 4).count() == 4
    nested = store.task_rows(store.padded_tasks(tasks, 4), "x").where("extra_info.padding").first()
    assert nested["extra_info"]["gamefile"] is None


def test_disjoint(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2], [2, 3]))
    with pytest.raises(store.BadInput):
        store.disjoint({"a": a, "b": b}, "k")
    store.disjoint({"a": a, "b": b.where("k > 2")}, "k")


def test_write_new_and_digests(spark, tmp_path):
    path = str(tmp_path / "out")
    store.write_new(spark.range(3), path, fmt="json")
    with pytest.raises(Exception, match="already exists"):
        store.write_new(spark.range(3), path, fmt="json")
    assert store.file_digests(spark, f"{path}/part-*").count() >= 1


def test_provenance(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, expected string")
    known = spark.createDataFrame([(1, "x"), (2, "q")], "k int, sha256 string")
    assert {r["k"]: r["issue"] for r in store.with_provenance(rows, known, ["k"]).collect()} == {1: None, 2: "source_changed", 3: "source_missing"}


def test_all_queries_of_every_product(spark, data):
    from trajecta.plans import registry

    got = {r["asin"]: r["queries"].split("\n") for r in registry.QUERIES["query_candidates"](spark, data).collect()}
    parts = spark.read.parquet(f"{data}/part.parquet").collect()
    assert len(got) == len(parts)
    for r in parts:
        w = r["p_name"].replace("[", " ").replace("]", " ").lower().split()
        core = [x for x in w if x not in T.STOP]
        longest = sorted(core, key=lambda x: -len(x))[:6]
        made = [str(r["p_partkey"]), '"' + " ".join(w) + '"', *(" ".join(x) for x in (w[:4], w[:8], w[-8:], core[:10], longest, w[:2] + w[-4:]))]
        assert got[r["p_partkey"]] == list(dict.fromkeys(q for q in made if q))


def test_parentheses_of_pages(spark):
    from trajecta.plans import registry

    def closed(text):
        depth = 0
        for c in text:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                return False
        return depth == 0

    root = "/root/testdata/sf0.01"
    want = {r["page_id"]: closed(r["html"]) for r in spark.read.parquet(f"{root}/pages.parquet").collect()}
    got = {r["page_id"]: r["balanced"] for r in registry.QUERIES["balanced_parentheses"](spark, root).collect()}
    assert got == want
