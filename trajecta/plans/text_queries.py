"""Queries over conversations, documents and pages: texts, prompts, rows for training; with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.functions import text as T
from trajecta.operators import batching, history, render
from trajecta.plans.names import Registry
from trajecta.session import table
from trajecta.sources import adapters

registry = Registry()

#: Answers made of turns: one form for each way to be right or wrong.
ANSWERS = {
    0: "'<thought>' || w || '</thought> <action> ' || w || ' </action>'",
    1: "w",
    2: "'<action>' || w || '</action><action>' || w || '</action>'",
    3: "'<action>' || w || '</action> and more'",
    4: "'<action><thought >' || w || '</action>'",
    5: "'<action>  </action>'",
    6: "' <action>' || upper(w) || '</action> '",
    7: "'<thought>' || w || '<action>' || w || '</action>'",
}
_CASES = " ".join(f"WHEN {k} THEN {v}" for k, v in ANSWERS.items())
ANSWERS_SQL = f"WITH c AS (SELECT conv_id, turn, regexp_extract(text, '^[A-Za-z]*') AS w FROM conversations), a AS (SELECT conv_id, turn, CASE (conv_id * 3 + turn) % 8 {_CASES} END AS answer FROM c)"


def answers(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "conversations").select("conv_id", "turn", F.regexp_extract("text", "^[A-Za-z]*", 0).alias("w"))
    return rows.select("conv_id", "turn", F.expr(f"CASE (conv_id * 3 + turn) % 8 {_CASES} END").alias("answer"))


def _parsed(strict: bool) -> str:
    tag = r"(?i)<\s*/?\s*(thought|action)([\s>/]|$)"
    body = r"(?s)^\s*(?:<thought>(.*?)</thought>\s*)?<action>(.*?)</action>\s*$"
    count = lambda x: f"((length(answer) - length(replace(answer, '{x}', ''))) // {len(x)})"
    nested = f"WHEN regexp_matches(regexp_extract(answer, '{body}', 1), '{tag}') OR regexp_matches(regexp_extract(answer, '{body}', 2), '{tag}') THEN 'nested_control_tags'" if strict else ""
    word = f"lower(trim(regexp_extract(answer, '{body}', 2)))"
    return ANSWERS_SQL + f""", r AS (SELECT conv_id, turn, {word} AS word, CASE WHEN {count('<action>')} <> 1 OR {count('</action>')} <> 1 THEN 'missing_or_multiple_action_tags' WHEN NOT regexp_matches(answer, '{body}') THEN 'unclosed_tags_or_extra_text'
 WHEN {count('<thought>')} <> {count('</thought>')} OR {count('<thought>')} > 1 THEN 'invalid_thought_tags' {nested} WHEN {word} = '' THEN 'empty_action' END AS reason FROM a)
 SELECT conv_id, turn, CASE WHEN reason IS NULL THEN word END AS action, reason FROM r"""


@registry.add(_parsed(True))
def parse_tagged_action(spark, root):
    """F4, P11."""
    return answers(spark, root).select("conv_id", "turn", T.parse_action(F.col("answer")).alias("p")).select("conv_id", "turn", "p.*")


@registry.add(_parsed(False))
def parse_tagged_action_lenient(spark, root):
    """F5."""
    return answers(spark, root).select("conv_id", "turn", T.parse_action(F.col("answer"), strict=False).alias("p")).select("conv_id", "turn", "p.*")


_SHOP = "WITH c AS (SELECT conv_id, turn, lower(regexp_extract(text, '^[A-Za-z]*')) AS w, (conv_id + turn) % 6 AS k FROM conversations), a AS (SELECT conv_id, turn, k, [w, 'Search', 'Buy Now'] AS clickables, turn % 2 = 0 AS bar, CASE k WHEN 0 THEN 'search[' || w || ']' WHEN 1 THEN 'click[' || w || ']' WHEN 2 THEN 'click[buy now] now' WHEN 3 THEN 'search[ ]' WHEN 4 THEN 'click[search]' ELSE 'look around' END AS action FROM c)"


@registry.add(
    _SHOP
    + r""", x AS (SELECT *, regexp_extract(action, '(?s)^(search|click)\[(.*)\]$', 1) AS kind, trim(regexp_extract(action, '(?s)^(search|click)\[(.*)\]$', 2)) AS arg, regexp_matches(action, '^(.+)\[(.+)\]') AS loose, regexp_extract(action, '^(.+)\[(.+)\]', 1) AS kind2, lower(regexp_extract(action, '^(.+)\[(.+)\]', 2)) AS arg2, list_transform(clickables, lambda c: lower(c)) AS l FROM a)
SELECT conv_id, turn, action, CASE kind WHEN 'search' THEN bar AND arg <> '' WHEN 'click' THEN list_contains(l, arg) AND arg <> 'search' ELSE false END AS executable,
CASE WHEN NOT loose THEN true WHEN kind2 = 'search' THEN arg2 = '' ELSE NOT (kind2 = 'click' AND list_contains(l, arg2) AND arg2 <> 'search') END AS rejected FROM x"""
)
def shop_admissibility(spark, root):
    """P10: the two rules side by side."""
    word = F.lower(F.regexp_extract("text", "^[A-Za-z]*", 0))
    rows = table(spark, root, "conversations").select("conv_id", "turn", word.alias("w"), ((F.col("conv_id") + F.col("turn")) % 6).alias("k"), (F.col("turn") % 2 == 0).alias("bar"))
    action = F.expr("CASE k WHEN 0 THEN 'search[' || w || ']' WHEN 1 THEN 'click[' || w || ']' WHEN 2 THEN 'click[buy now] now' WHEN 3 THEN 'search[ ]' WHEN 4 THEN 'click[search]' ELSE 'look around' END")
    rows = rows.withColumn("action", action).withColumn("clickables", F.array("w", F.lit("Search"), F.lit("Buy Now")))
    return rows.select("conv_id", "turn", "action", T.executable(F.col("action"), F.col("clickables"), F.col("bar")).alias("executable"), T.rollout_rejected(F.col("action"), F.col("clickables")).alias("rejected"))


@registry.add(r"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS digest FROM documents")
def norm_text(spark, root):
    """F1."""
    return table(spark, root, "documents").select("doc_id", F.md5(T.norm(F.col("text")).cast("binary")).alias("digest"))


@registry.add("SELECT conv_id, turn, CAST('0x' || substr(sha256(conv_id || '|' || turn || '|' || role), 1, 8) AS BIGINT) % 2147483648 AS seed FROM conversations")
def request_seed(spark, root):
    """F30."""
    return table(spark, root, "conversations").select("conv_id", "turn", T.request_seed(F.concat_ws("|", "conv_id", "turn", "role")).alias("seed"))


@registry.add("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'go ' || role END AS zero, CASE WHEN turn % 2 = 0 THEN 'take' END AS one FROM conversations")
def menu_options(spark, root):
    """a menu with a repeated number; other texts have none."""
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Ambiguous request: choose\n 0: go  "), "role", F.lit("\n1: look\n 1 : take"))).otherwise(F.concat(F.lit("1: "), "role"))
    m = T.menu(said)
    return table(spark, root, "conversations").select("conv_id", "turn", m.alias("m")).select("conv_id", "turn", F.try_element_at("m", F.lit("0")).alias("zero"), F.try_element_at("m", F.lit("1")).alias("one"))


def _window(last: int) -> str:
    return f"SELECT conv_id AS episode, turn AS step, count(*) OVER w AS n_history, coalesce(md5(string_agg('[' || turn || '] ' || role || ': ' || text, chr(10)) OVER w), md5('')) AS digest FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN {last} PRECEDING AND 1 PRECEDING)"


def _history(spark, root, last):
    rows = history.windowed(table(spark, root, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("step"), "role", "text"), last)
    return rows.select("episode", "step", "n_history", F.md5(F.col("history").cast("binary")).alias("digest"))


@registry.add(_window(5))
def history_window(spark, root):
    """The last five entries."""
    return _history(spark, root, 5)


@registry.add(_window(2))
def history_window_shop(spark, root):
    """The last two."""
    return _history(spark, root, 2)


@registry.add("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents), f AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, line) AS first_ord FROM l), g AS (SELECT *, CAST(sum(CASE WHEN ord = first_ord THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) - 1 AS running FROM f) SELECT doc_id, ord, CASE WHEN ord = first_ord THEN running ELSE first_value(running) OVER (PARTITION BY doc_id, line ORDER BY ord) END AS label, ord = first_ord AS is_first FROM g")
def observation_backrefs(spark, root):
    """Lines of a document as observations; repeats point to the first."""
    lines = table(spark, root, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return render.back_references(lines, ["doc_id"], "ord", "line").select("doc_id", F.col("ord").cast("long").alias("ord"), "label", "is_first")


IDS = "WITH w AS (SELECT conv_id AS episode, turn AS step, role, list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: CAST(CAST('0x' || substr(sha256(x), 1, 8) AS BIGINT) % 32000 AS INTEGER)) AS ids FROM conversations), p AS (SELECT *, flatten(list(ids) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS prompt_ids FROM w), rows AS (SELECT episode, step, prompt_ids, ids AS response_ids FROM p WHERE role = 'assistant' AND len(prompt_ids) > 0 AND len(ids) > 0)"
WEIGHTS = ", tot AS (SELECT CAST(ceil(count(*) / 8) * 8 AS DOUBLE) AS r, CAST(count(DISTINCT episode) AS DOUBLE) AS n, (8 - count(*) % 8) % 8 AS fill, max(len(prompt_ids)) AS p, max(len(response_ids)) AS l FROM rows), tw AS (SELECT rows.*, CAST(sum(len(response_ids)) OVER (PARTITION BY episode) AS BIGINT) AS n_tokens, r / (n * sum(len(response_ids)) OVER (PARTITION BY episode)) AS weight FROM rows, tot)"


def turns(spark: SparkSession, root: str) -> DataFrame:
    return adapters.turns(table(spark, root, "conversations"))


@registry.add(IDS + WEIGHTS + " SELECT episode, step, n_tokens, round(weight, 9) AS weight FROM tw")
def token_weights(spark, root):
    """A16."""
    rows = batching.token_weights(batching.episodes(turns(spark, root)), 8)
    return rows.select("episode", "step", "n_tokens", F.round("weight", 9).alias("weight"))


_PAD = lambda n: f"list_transform(range({n}), lambda x: 151643)"


@registry.add(
    IDS
    + WEIGHTS
    + f""", al AS (SELECT episode, step, prompt_ids, response_ids, weight FROM tw UNION ALL SELECT NULL, -k, [151644], [151645], 0.0 FROM tot, unnest(range(1, fill + 1)) AS u(k))
SELECT episode, step, md5(array_to_string(list_concat({_PAD('p - len(prompt_ids)')}, prompt_ids), ',')) AS prompts, md5(array_to_string(list_concat(response_ids, {_PAD('l - len(response_ids)')}), ',')) AS responses,
len(prompt_ids) + len(response_ids) AS n_attended, len(prompt_ids) + len(response_ids) - 1 AS last_position, CASE WHEN episode IS NULL THEN 0 ELSE len(response_ids) END AS n_scored, round(weight, 9) AS weight FROM al, tot"""
)
def expand_rows(spark, root):
    """R20."""
    rows = batching.expand(turns(spark, root), 8)
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").cast("binary"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("long")
    return rows.select("episode", "step", digest("prompts").alias("prompts"), digest("responses").alias("responses"), total("attention_mask").alias("n_attended"), F.array_max("position_ids").cast("long").alias("last_position"), total("response_mask").alias("n_scored"), F.round("weight", 9).alias("weight"))


@registry.add(IDS + " SELECT episode, step, len(prompt_ids) + len(response_ids) AS n, array_to_string(list_concat(list_transform(range(len(prompt_ids) - 1), lambda x: 0), list_transform(response_ids, lambda x: -x), [0]), ',') AS aligned FROM rows")
def align_teacher(spark, root):
    """Values at a teacher prompt that is two ids longer, moved to the student's."""
    rows = batching.episodes(turns(spark, root))
    values = F.concat(F.array_repeat(F.lit(9.0), F.size("prompt_ids") + 1), F.transform("response_ids", lambda x: -x.cast("double")), F.array(F.lit(9.0)))
    moved = T.aligned(values, F.size("prompt_ids") + 2, F.size("prompt_ids"), F.size("response_ids"))
    return rows.select("episode", "step", F.size(moved).cast("long").alias("n"), F.array_join(F.transform(moved, lambda x: x.cast("long").cast("string")), ",").alias("aligned"))


@registry.add(IDS + ", s AS (SELECT episode, step, list_concat(prompt_ids, [7], response_ids, [7, 8]) AS ids, len(prompt_ids) + 1 + len(response_ids) AS pos FROM rows) SELECT episode, step, md5(array_to_string(list_concat(list_slice(ids, 1, pos), [1, 2, 3], list_slice(ids, pos + 1, len(ids))), ',')) AS digest FROM s")
def splice_prompt(spark, root):
    """a reference goes before the last end token."""
    ids = F.concat("prompt_ids", F.array(F.lit(7)), "response_ids", F.array(F.lit(7), F.lit(8)))
    out = T.splice(F.col("ids"), F.array(F.lit(1), F.lit(2), F.lit(3)), 7)
    rows = batching.episodes(turns(spark, root)).select("episode", "step", ids.alias("ids"))
    return rows.select("episode", "step", F.md5(F.array_join(F.transform(out, lambda x: x.cast("string")), ",").cast("binary")).alias("digest"))


@registry.add(None)
def microbatch_partitions(spark, root):
    """Batches of at most 400 tokens within blocks of ten episodes."""
    rows = batching.episodes(turns(spark, root)).select((F.col("episode") / 10).cast("long").alias("block"), (F.col("episode") * 1000 + F.col("step")).cast("long").alias("row"), (F.size("prompt_ids") + F.size("response_ids")).cast("long").alias("n"))
    return batching.micro_batches(rows, 400)


_LP = "-CAST('0x' || substr(sha256(episode || '|' || step || '|{who}'), 1, 8) AS BIGINT) % 5000 / 1000"


@registry.add(IDS + WEIGHTS + f", x AS (SELECT episode, weight, {_LP.format(who='s')} AS a, {_LP.format(who='t')} AS b FROM tw) SELECT episode, round(coalesce(sum(weight * (a - b)) / nullif(sum(weight), 0), 0), 9) AS loss, round(coalesce(max(weight), 0), 9) AS max_weight FROM x GROUP BY episode")
def weighted_loss(spark, root):
    """Student against teacher log-probabilities (from hashes) by token weight."""
    rows = batching.token_weights(batching.episodes(turns(spark, root)), 8)
    lp = lambda who: -(adapters.hashed(F.concat_ws("|", "episode", "step", F.lit(who)), 2**40) % 5000) / 1000
    out = batching.weighted_loss(rows.withColumn("student_lp", lp("s")).withColumn("teacher_lp", lp("t")), ["episode"])
    return out.select("episode", F.round("loss", 9).alias("loss"), F.round("max_weight", 9).alias("max_weight"))


@registry.add("SELECT conv_id, turn, '''' || text || ''' [SEP] ''' || role || '''' AS page, CASE WHEN turn % 2 = 0 THEN '''search[<your query>]'',' || chr(10) ELSE '' END || '''click[' || role || ']'',' AS actions FROM conversations")
def shop_formats(spark, root):
    """F31."""
    page = F.concat_ws(" [SEP] ", F.lit("Shop"), F.lit("task"), "text", "role")
    return table(spark, root, "conversations").select("conv_id", "turn", T.shown_page(page, F.lit("task")).alias("page"), T.shown_actions(F.array("role"), F.col("turn") % 2 == 0).alias("actions"))


@registry.add(
    """WITH p AS (SELECT page_id, html IS NULL AS none, regexp_replace(coalesce(html, ''), '[^()]', '', 'g') AS q FROM pages), c AS (SELECT page_id, q, unnest(range(1, len(q) + 1)) AS k FROM p), d AS (SELECT page_id, k, sum(CASE WHEN q[k] = '(' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM c),
e AS (SELECT page_id, min(depth) >= 0 AND arg_max(depth, k) = 0 AS closes FROM d GROUP BY page_id) SELECT page_id, CASE WHEN NOT none THEN coalesce(closes, true) END AS balanced FROM p LEFT JOIN e USING (page_id)"""
)
def balanced_parentheses(spark, root):
    """F9 on the pages' own text."""
    return table(spark, root, "pages").select("page_id", T.balanced(F.col("html")).alias("balanced"))


#: Feedback texts by the reason for which they reject; the last has none.
_FEEDBACK = [("unknown_command", "Unknown action."), ("unsupported_use", "I'm not sure how to use it"), ("unsupported_operation", "It's not clear how to flush that."), ("invalid_destination", "That can't be moved there, because"), ("liquid_pickup", "You can't pick up a liquid directly."), ("no_liquid", "The cup does not contain any liquids to dunk into."), ("not_openable", "THE door is not moveable."), ("not_activatable", "The cup is not something that can be activated."), ("closed_container", "The box isn't open, so you can't see inside."), ("empty_mix", "That container is empty, so there are no items to mix."), ("single_item_mix", "There is only one thing (x)"), (None, "You see: The door is not moveable.")]
_QUOTED = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@registry.add("SELECT conv_id, turn, CASE length(text) % 12 " + " ".join(f"WHEN {k} THEN {_QUOTED(why)}" for k, (why, _) in enumerate(_FEEDBACK)) + " END AS reason FROM conversations")
def rejection_reason(spark, root):
    """Every reason, by the length of a turn."""
    said = F.element_at(F.array(*(F.lit(f"  {x}") for _, x in _FEEDBACK)), (F.length("text") % 12 + 1).cast("int"))
    return table(spark, root, "conversations").select("conv_id", "turn", T.rejection(said).alias("reason"))


@registry.add(None)
def observation_items(spark, root):
    """Canonical forms of two orders of a room, and how they are equal."""
    from trajecta.functions import observation as O

    head = F.lit("This room is called the hall. In it, you see:\n")
    one = F.concat(head, F.lit("\ta "), "role", F.lit("\n\ta table. On the table is: a cup (containing nothing), an apple.\n"), F.lit("\tthe door"))
    two = F.concat(head, F.lit("\tthe door\n\ta table. On the table is: an apple, a cup (containing nothing).\n\ta "), "role")
    rows = table(spark, root, "conversations").select("conv_id", "turn", one.alias("one"), F.when(F.col("turn") % 3 == 0, F.concat(two, F.lit(" more"))).otherwise(two).alias("two"))
    return rows.select("conv_id", "turn", O.canonical("one").alias("c"), O.equivalent("one", "two").alias("e")).select("conv_id", "turn", "c.supported", "c.reason", F.md5(F.col("c.canonical").cast("binary")).alias("digest"), "e.equal", "e.rule")


@registry.add("WITH o AS (SELECT episode, step, role, row_number() OVER (PARTITION BY episode ORDER BY step) - 1 AS k FROM (SELECT conv_id AS episode, turn AS step, role FROM conversations)) SELECT episode, step, k FROM o WHERE k % 4 = 1")
def sharded_turns(spark, root):
    """Every fourth row of each episode from the second on."""
    k = F.row_number().over(Window.partitionBy("episode").orderBy("step")) - 1
    return table(spark, root, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("step")).withColumn("k", k.cast("long")).where("k % 4 = 1")
