"""The parser's state after one answer, for operators that take one decision at a time.

The same rules as history.interaction and history.focus, which take whole executions.
"""

from __future__ import annotations

import re

from trajecta.functions.identity import NORMAL, PENDING, UNKNOWN
from trajecta.functions.text import REJECTIONS
from trajecta.operators.history import TURNED_DOWN

_ENDS = re.compile(r"\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\Z")
_TURNED_DOWN = re.compile(TURNED_DOWN)
_OPTION = re.compile(r"\s*(\d+)\s*:\s*(\S.*)")
_FOCUS = re.compile(r"You focus on (?:the )?(.+?)\.")


def menu(text: str) -> dict[str, str]:
    """Number to option of an ambiguous request."""
    if "Ambiguous request:" not in text:
        return {}
    found = (_OPTION.match(line) for line in text.split("\n"))
    return {m[1]: " ".join(m[2].split()) for m in found if m}


def parser_after(mode: str, options: dict[str, str], feedback: str | None, executed: bool = True) -> tuple[str, dict[str, str]]:
    """(mode, options); while the mode is unknown, the options are those known last."""
    text = feedback or ""
    if not executed:
        return mode, options
    shown = menu(text)
    if not shown and mode in (PENDING, UNKNOWN) and _TURNED_DOWN.search(_ENDS.sub("", text)):
        return UNKNOWN, options
    return (PENDING if shown else NORMAL), shown


def focus_after(focus: str | None, feedback: str | None) -> str | None:
    text = feedback or ""
    if "You reset the goal progress and focus." in text:
        return None
    found = _FOCUS.search(text)
    return found[1].strip() if found else focus


def rejection_of(feedback: str | None) -> str | None:
    text = _ENDS.sub("", feedback or "")
    return next((name for name, pattern in REJECTIONS if re.search(pattern, text, re.I)), None)
