"""What identifies a state: locators, signatures, keys, and the kinds of transitions between states.

All are columns of the JVM. A state that wasn't captured, or can't be matched, has no identity, so it joins with nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from trajecta.functions import text as T

# The modes of a parser in which a state may be matched, and the verbs that only look.
NORMAL, PENDING, UNKNOWN = "normal", "pending_menu", "unknown"
READ_VERBS = ["look", "read", "inventory", "task", "inspect", "examine"]


def json_of(value: Column) -> Column:
    """A value as JSON text; a null is `null`."""
    inside = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.substring(inside, F.lit(2), F.length(inside) - 2))


def json_list(*values: Column) -> Column:
    """A JSON list of values of any types."""
    return F.concat(F.lit("["), F.concat_ws(",", *(json_of(v) for v in values)), F.lit("]"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def pairs(options: Column, value: Callable[[Column], Column] = lambda v: v) -> Column:
    """The entries of a map in the order of their keys, each as [key, value]."""
    return F.transform(F.array_sort(F.map_entries(options)), lambda e: F.array(e["key"], value(e["value"])))


def signature(mode: Column, options: Column) -> Column:
    """P5: the parser's mode with its options as JSON; null if the mode isn't known, or doesn't go with the options (a
    normal parser has none, one that waits for a choice has some)."""
    fits = F.when(mode == NORMAL, F.size(options) == 0).when(mode == PENDING, F.size(options) > 0)
    return F.when(options.isNotNull() & fits, json_list(mode, pairs(options, T.norm)))


def locator(key: Column, node_key: Column, capture_ok: Column, matchable: Column, mode: Column, options: Column) -> Column:
    """struct(key, signature) by which states are matched; null unless the state was captured and may be matched."""
    own, parser = F.coalesce(key, node_key), signature(mode, options)
    return F.when(capture_ok.eqNullSafe(True) & matchable.eqNullSafe(True) & (own != "") & parser.isNotNull(), F.struct(own.alias("key"), parser.alias("signature")))


def descriptor(key: Column, physical_hash: Column, capture_ok: Column, matchable: Column, mode: Column) -> Column:
    """struct(key, physical_hash, capture_ok, matchable); without identity the key and the hash are null."""
    captured = F.coalesce(capture_ok, F.lit(False))
    valid = captured & F.coalesce(matchable, F.lit(False)) & (F.coalesce(key, F.lit("")) != "") & F.coalesce(mode.isin(NORMAL, PENDING), F.lit(False))
    return F.struct(F.when(valid, key).alias("key"), F.when(valid, physical_hash).alias("physical_hash"), captured.alias("capture_ok"), valid.alias("matchable"))


def current_state(before: Column, after: Column, by: list[str], t: str = "t") -> Column:
    """The state before a decision, or where none was recorded, the state after the decision before."""
    return F.coalesce(before, F.lag(after).over(Window.partitionBy(*by).orderBy(t)))


def public_past(steps: Column) -> Column:
    """Of an array of decisions, what was public about each."""
    return F.transform(steps, lambda s: F.struct(*(s[k].alias(k) for k in ("action", "feedback", "format_error", "env_rejection"))))


def temperature(value: Column, thresholds: dict[str, Column], quantum: float = 1.0) -> Column:
    """struct(bin, sides): the temperature in steps of `quantum`, and whether it lies under (-1), on (0) or over (1)
    each known threshold; null without a temperature."""
    side = {k: F.when(v.isNotNull(), F.signum(value - v).cast("int")) for k, v in thresholds.items()}
    return F.when(value.isNotNull(), F.struct(F.floor(value / quantum + 0.5).alias("bin"), F.struct(*(v.alias(k) for k, v in side.items())).alias("sides")))


def goal_flags(progress: Column) -> Column:
    """F8: (number, flag) of the ordered goals of a progress text."""
    lines = F.filter(F.split(F.split(progress, "Unordered")[0], "\n"), lambda x: x.rlike(r"\A\s*\d+\s+(?:true|false)\s+.+"))
    return F.transform(lines, lambda x: F.array(*(F.regexp_extract(x, r"\A\s*(\d+)\s+(true|false)\s", k) for k in (1, 2))))


def object_key(objects: Column) -> Column:
    """24 digits of the digest of the objects' names, lowered and in order."""
    names = F.array_sort(F.transform(objects, lambda x: F.lower(T.strip(x))))
    return F.substring(digest(F.concat(F.lit("["), F.array_join(F.transform(names, json_of), ", "), F.lit("]"))), 1, 24)


def visible_key(observation: Column, objects: Column, score: Column, templates: Column) -> Column:
    """the digest of what a state shows, as JSON with its names in order."""
    parts = {"objects": object_key(objects), "observation": observation, "score": score, "templates": F.array_sort(templates)}
    return digest(F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), json_of(v)) for k, v in parts.items())), F.lit("}")))


def fact_key(task: Column, facts: Column, won: Column, lost: Column) -> Column:
    """the digest of a household state: its facts in order, and its outcome."""
    parts = {"facts": F.array_sort(facts), "gamefile": task, "lost": F.coalesce(lost, F.lit(False)), "won": won}
    return digest(F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), json_of(v)) for k, v in parts.items())), F.lit("}")))


# The pages of a shop, as they stand in an address.
PAGES = ["search_results", "item_page", "item_sub_page", "done"]


def page_type(url: Column) -> Column:
    """the first known page in the address; else the start."""
    out = F.when(url.isNull(), "start")
    for page in PAGES:
        out = out.when(F.contains(url, F.lit(f"/{page}/")), page)
    return out.otherwise("start")


def shop_keys(url: Column, keywords: Column, page: Column, asin: Column, options: Column, done: Column) -> Column:
    """struct(strict, coarse, page_type). The strict key also tells searches and result pages apart; at the end both
    are the digest of what was chosen, and at the start nothing is chosen yet."""
    kind = page_type(url)
    start = kind == "start"
    sub = F.when(kind == "item_sub_page", F.element_at(F.split(url, "/"), -2))
    keywords, page, asin = F.when(start, F.array().cast("array<string>")).otherwise(F.coalesce(keywords, F.array().cast("array<string>"))), F.when(~start, page), F.when(~start, asin)
    options = F.when(start, F.array().cast("array<array<string>>")).otherwise(pairs(F.coalesce(options, F.create_map().cast("map<string,string>"))))
    ended = digest(json_list(F.lit("done"), asin, options))
    strict, coarse = digest(json_list(kind, keywords, page, asin, options, sub)), digest(json_list(kind, asin, options, sub))
    return F.struct(F.when(done, ended).otherwise(strict).alias("strict"), F.when(done, ended).otherwise(coarse).alias("coarse"), kind.alias("page_type"))


def shop_kind(format_error: Column, rejection: Column, key_before: Column, key_after: Column) -> Column:
    """what a shop decision did; a wrong format counts before a rejection, and that before a change."""
    return F.when(F.coalesce(format_error, F.lit("")) != "", "format_invalid").when(F.coalesce(rejection, F.lit("")) != "", "rejection").when(key_before.eqNullSafe(key_after), "unchanged").otherwise("state_change")


def transition(action: Column, feedback: Column, changed: Column, rejection: Column, format_error: Column) -> Column:
    """struct(kind, is_binding, is_observation, passive_during_rejection). A number, or an answer that asks for one,
    binds; the first word tells whether the action only looks."""
    word = T.strip(F.coalesce(action, F.lit("")))
    binding = word.rlike(r"\A\d+\z") | (F.size(T.menu(F.coalesce(feedback, F.lit("")))) > 0)
    read = F.lower(F.split(word, " ")[0]).isin(READ_VERBS) & ~binding
    rejected, malformed = F.coalesce(rejection, F.lit("")) != "", F.coalesce(format_error, F.lit("")) != ""
    kind = F.when(changed, "state_change").when(malformed, "format_invalid").when(binding & ~rejected, "binding").when(read & ~rejected, "internal_observation").when(rejected, "rejection").otherwise("unchanged_non_observation")
    return F.struct(kind.alias("kind"), binding.alias("is_binding"), read.alias("is_observation"), (changed & rejected).alias("passive_during_rejection"))


def prompt_parts(prompt: Column) -> Column:
    """struct(prefix, observation, suffix) around the last observation of a prompt; null fields if it has none."""
    pattern = r"(?s)\A(.*)current observation is:(.*?)\nAvailable action commands:(.*)\z"
    part = lambda k: F.when(prompt.rlike(pattern), F.regexp_extract(prompt, pattern, k))
    return F.struct(part(1).alias("prefix"), T.strip(part(2)).alias("observation"), part(3).alias("suffix"))


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two lists hold the same items as often, in any order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def action_spec(command: Column, observation: Column, after: Column) -> Column:
    """struct(raw, semantic, choice, rejected_in_source): a number that the menu offers stands for its text."""
    raw = F.lower(T.strip(command))
    choice = F.when(raw.rlike(r"\A\d+\z"), F.try_element_at(T.menu(observation), raw))
    return F.struct(raw.alias("raw"), F.coalesce(F.concat(F.lit("choice:"), choice), F.concat(F.lit("command:"), raw)).alias("semantic"), choice.alias("choice"), F.coalesce(T.rejection(after).isNotNull(), F.lit(False)).alias("rejected_in_source"))


def rebind(spec: Column, observation: Column) -> Column:
    """struct(action, error): the number that the present menu has for the same choice; an error unless just one does."""
    numbers = F.map_keys(F.map_filter(T.menu(observation), lambda k, v: v == spec["choice"]))
    one = F.size(numbers) == 1
    return F.struct(F.when(spec["choice"].isNull(), spec["raw"]).when(one, F.try_element_at(numbers, F.lit(1))).alias("action"), F.when(spec["choice"].isNotNull() & ~one, "semantic parser choice is absent or ambiguous").alias("error"))


def menus_permuted(expected: Column, actual: Column) -> Column:
    """Whether two menus offer the same distinct options under one heading."""
    left, right = F.map_values(T.menu(expected)), F.map_values(T.menu(actual))
    head = lambda x: F.substring_index(x, "\n0:", 1)
    return (F.size(left) > 0) & (F.size(F.array_distinct(left)) == F.size(left)) & same_multiset(left, right) & (head(expected) == head(actual))


def relation(expected: Column, actual: Column, scene: Callable[[Column], Column]) -> Column:
    """how two observations agree: as written, as menus in another order, as scenes in another order (scene: their
    canonical form), or null."""
    menu = (F.size(T.menu(expected)) > 0) | (F.size(T.menu(actual)) > 0)
    return F.when(T.strip(expected) == T.strip(actual), "exact").when(menu, F.when(menus_permuted(expected, actual), "choice_permutation")).when(scene(expected) == scene(actual), "scene_permutation")


# Names of the two families of sources; planners count from this run on.
PLANNER, TEACHER, PLANNER_FROM = "planner_actual_replay", "original_qwen32b_k16", 1_000_000


def source_label(kind: Column, rep: Column) -> Column:
    """F32."""
    planner = F.startswith(F.coalesce(kind, F.lit("")), F.lit("planner")) | (F.coalesce(rep, F.lit(0)) >= PLANNER_FROM)
    return F.concat(F.when(planner, PLANNER).otherwise(TEACHER), F.lit(":"), rep.cast("string"))


def proposed_action(action: Column, raw_output: Column) -> Column:
    """the action an attempt proposed: what was recorded, else the one its answer holds, in its own spelling; null if
    that has control tags."""
    parsed = T.parse_action(raw_output, allow_empty=True)
    inner = T.strip(F.regexp_extract(raw_output, r"(?s)<action>(.*?)</action>", 1))
    return F.when(action.isNotNull(), F.when(~T.has_control_tag(action), action)).when(parsed["reason"].isNull(), inner)


def shown_action(action: Column, missing: str) -> Column:
    """an action as evidence: withheld if it has control tags."""
    return F.when(action.isNull(), missing).when(T.has_control_tag(action), "[recorded action text withheld: invalid control tags]").otherwise(action)


def blob_id(content: Column) -> Column:
    """the id by which version control knows a file of these bytes."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(data).cast("string").cast("binary"), F.unhex(F.lit("00")), data))


def teacher_is(model_id: Column, path: Column, name: str) -> Column:
    """Whether a record is of the named model: by its id, or where none was recorded, by the end of its path."""
    end = F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", "")
    return F.coalesce(model_id == name, F.endswith(end, F.lit("/" + name.split("/")[-1])))


def same_value(a: Column, b: Column) -> Column:
    """whether two JSON texts hold the same value at any depth: objects whatever the order of their names, lists in
    order, numbers by value; a text that isn't JSON equals nothing, and null equals null."""
    whole = lambda x: F.to_json(F.try_parse_json(x))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.coalesce(whole(a) == whole(b), F.lit(False))).otherwise(a.isNull() & b.isNull())
