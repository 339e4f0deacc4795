"""Column functions over the texts of executions: normalisation, tags, menus, rejections, formats, seeds.

All but the decoding of character references run in the JVM. Patterns carry (?U) where white space means any Unicode white space.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as white space beyond Java's Unicode class.
SPACE = r"[\s\x1c-\x1f]"


def norm(text: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed, null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?U){SPACE}+", " "))


def norm_inline(text: Column) -> Column:
    """Only tabs and blanks are collapsed."""
    return strip(F.regexp_replace(text, "[\\t ]+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def has_control_tag(text: Column) -> Column:
    """Reserved tags, also malformed or in other cases."""
    return text.rlike(r"(?i)<\s*/?\s*(?:thought|action)(?:[\s>/]|$)")


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


# Names of the reasons for which an answer has no action.
NO_SINGLE_TAG, EXTRA_TEXT, BAD_THOUGHT, NESTED, EMPTY = "missing_or_multiple_action_tags", "unclosed_tags_or_extra_text", "invalid_thought_tags", "nested_control_tags", "empty_action"
ANSWER = r"(?s)\A\s*(?:<thought>(.*?)</thought>\s*)?<action>(.*?)</action>\s*\z"


def parse_action(text: Column, strict: bool = True, allow_empty: bool = False) -> Column:
    """struct(action, reason): the action of an answer with one optional thought and one action, or why there is none.

    The lenient form doesn't look for tags inside the parts.
    """
    thought, action = F.regexp_extract(text, ANSWER, 1), F.regexp_extract(text, ANSWER, 2)
    opened, closed = count_of(text, "<thought>"), count_of(text, "</thought>")
    word = F.lower(strip(action))
    reason = F.when((count_of(text, "<action>") != 1) | (count_of(text, "</action>") != 1), NO_SINGLE_TAG).when(~text.rlike(ANSWER), EXTRA_TEXT).when((opened != closed) | (opened > 1), BAD_THOUGHT)
    if strict:
        reason = reason.when(has_control_tag(thought) | has_control_tag(action), NESTED)
    if not allow_empty:
        reason = reason.when(word == "", EMPTY)
    return F.struct(F.when(reason.isNull(), word).alias("action"), reason.alias("reason"))


def menu(text: Column, normalised: bool = True) -> Column:
    """Number to option of an ambiguous request; empty for any other text. Later numbers win."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\A\s*\d+\s*:\s*\S"))
    option = lambda x: F.regexp_extract(x, r"\A\s*\d+\s*:\s*(.+)", 1)
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"\A\s*(\d+)", 1).alias("k"), (norm(option(x)) if normalised else option(x)).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.when(F.contains(text, F.lit("Ambiguous request:")), F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>"))


# Fixed values: (reason, pattern) of feedback that rejects an action; the first that fits counts.
REJECTIONS = [
    ("unknown_command", r"^(?:No known action matches that input\.|Unknown action\.)"),
    ("unsupported_use", r"^I'm not sure how to use "),
    ("unsupported_operation", r"^It's not clear how to (?:read|flush) that\."),
    ("invalid_destination", r"^That can't be moved there"),
    ("liquid_pickup", r"^You can't pick up a liquid directly\."),
    ("no_liquid", r"^The .+ does not contain any liquids to dunk into\."),
    ("not_openable", r"^The .+ is not (?:openable|closeable|moveable|open)\."),
    ("not_activatable", r"^The .+ is not something that can be activated\."),
    ("closed_container", r"^The .+ isn't open, so you can't see inside\."),
    ("empty_mix", r"^That container is empty, so there are no items to mix\."),
    ("single_item_mix", r"^There is only one thing \("),
]


def rejection(feedback: Column) -> Column:
    """The reason for which feedback rejects its action, or null."""
    text = strip(feedback)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in REJECTIONS:
        out = out.when(text.rlike(f"(?i){pattern}"), name)
    return out


def executable(action: Column, clickables: Column, search_bar: Column) -> Column:
    """Whether a shop action may be recorded: the whole text is search[...] or click[...], and the page offers it."""
    kind, arg = F.regexp_extract(action, r"(?s)\A(search|click)\[(.*)\]\z", 1), strip(F.regexp_extract(action, r"(?s)\A(search|click)\[(.*)\]\z", 2))
    click = F.array_contains(F.transform(clickables, F.lower), arg) & (arg != "search")
    return F.when(kind == "search", search_bar & (arg != "")).when(kind == "click", click).otherwise(F.lit(False))


def rollout_rejected(action: Column, clickables: Column) -> Column:
    """Whether a rollout counts an action as rejected: a looser rule that ignores trailing text and the search bar."""
    pattern = r"\A(.+)\[(.+)\]"
    kind, arg = F.regexp_extract(action, pattern, 1), F.lower(F.regexp_extract(action, pattern, 2))
    click = (kind == "click") & F.array_contains(F.transform(clickables, F.lower), arg) & (arg != "search")
    return F.when(~action.rlike(pattern), True).when(kind == "search", arg == "").otherwise(~click)


def shown_page(page: Column, task: Column) -> Column:
    """The segments after the task's, quoted; the page as it is if it doesn't show the task."""
    parts = F.split(page, r" \[SEP\] ")
    at = F.array_position(parts, task).cast("int")
    rest = F.slice(parts, at + 1, F.greatest(F.size(parts), F.lit(1)))
    return F.when(at > 0, F.array_join(F.transform(rest, lambda p: F.concat(F.lit("'"), p, F.lit("'"))), " [SEP] ")).otherwise(page)


def shown_actions(clickables: Column, search_bar: Column) -> Column:
    """One quoted action a line, each with a comma."""
    acts = F.concat(F.when(search_bar, F.array(F.lit("search[<your query>]"))).otherwise(F.array().cast("array<string>")), F.transform(clickables, lambda c: F.concat(F.lit("click["), c, F.lit("]"))))
    return F.array_join(F.transform(acts, lambda a: F.concat(F.lit("'"), a, F.lit("',"))), "\n")


def request_seed(key: Column) -> Column:
    """A 31-bit seed from the SHA-256 of a key."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long") % 2147483648


def price_floor(pricing: Column) -> Column:
    """The smaller of the first two dollar amounts; 100 if no price is given, 0 if one can't be read."""
    amounts = F.transform(F.slice(F.split(pricing, r"\$"), 2, 2), lambda p: F.try_to_number(F.regexp_replace(p, r"[^\d.]", ""), F.lit("999999999.99")).cast("double"))
    every = F.slice(F.split(pricing, r"\$"), 2, 1000)
    unread = (F.size(every) == 0) | F.exists(every, lambda p: ~F.regexp_replace(p, r"[^\d.]", "").rlike(r"\A(\d+\.?\d*|\.\d+)\z"))
    return F.when(pricing.isNull() | (pricing == ""), 100.0).when(unread, 0.0).otherwise(F.array_min(amounts))


# Words that a query of core words leaves out.
STOP = ["a", "an", "and", "by", "for", "in", "of", "pack", "set", "the", "to", "with"]


def queries_of(asin: Column, name: Column, query: Column) -> Column:
    """Search queries for a product, first occurrences in order."""
    words = F.split(norm(F.regexp_replace(name, r"[\[\]]", " ")), " ")
    core = F.filter(words, lambda w: ~F.lower(w).isin(STOP))
    n = F.size(words)
    tail = lambda k: F.slice(words, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
    ranked = F.transform(core, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    longest = F.transform(F.slice(F.array_sort(ranked), 1, 6), lambda x: x["w"])
    made = [asin, F.concat(F.lit('"'), F.array_join(words, " "), F.lit('"')), F.coalesce(query, F.lit("")), F.array_join(F.slice(words, 1, 4), " "), F.array_join(F.slice(words, 1, 8), " "), F.array_join(tail(8), " "), F.array_join(F.slice(core, 1, 10), " "), F.array_join(longest, " "), F.array_join(F.concat(F.slice(words, 1, 2), tail(4)), " ")]
    return F.array_distinct(F.filter(F.transform(F.array(*made), lambda q: F.lower(norm(q))), lambda q: q != ""))


def balanced(text: Column) -> Column:
    """Whether parentheses close in order."""
    chars = F.filter(F.split(F.regexp_replace(text, r"[^()]", ""), ""), lambda c: c != "")
    depth = F.aggregate(chars, F.lit(0), lambda d, c: F.when(d < 0, d).when(c == "(", d + 1).otherwise(d - 1))
    return depth == 0


def splice(ids: Column, reference: Column, end: int) -> Column:
    """The ids with the reference put before the last end token; null if there is none."""
    at = F.size(ids) - F.array_position(F.reverse(ids), end).cast("int")
    return F.when(F.array_contains(ids, end), F.concat(F.slice(ids, F.lit(1), at), reference, F.slice(ids, at + 1, F.greatest(F.size(ids), F.lit(1)))))


def aligned(values: Column, teacher_prompt: Column, prompt: Column, response: Column) -> Column:
    """Values that predict the response, moved from the teacher's prompt length to the student's; zeros elsewhere."""
    zero = F.lit(0.0)
    return F.concat(F.array_repeat(zero, prompt - 1), F.slice(values, teacher_prompt, response), F.array_repeat(zero, F.lit(1)))


@F.pandas_udf(StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def html_norm(text: Column) -> Column:
    """Character references decoded, lowered, runs of white space as one blank. Only texts with a reference leave the JVM."""
    return F.lower(norm(F.when(F.contains(text, F.lit("&")), _unescaped(text)).otherwise(text)))
