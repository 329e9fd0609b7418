"""Rule patterns as data: translate the portable rule dialect to Java's.

Rule tables are written with ASCII ``\\b`` and ``\\w`` and a Unicode-aware
``\\s``.  Java 17 does the opposite for ``\\b`` (Unicode) and ``\\s`` (ASCII), so
patterns are translated once, when the plan is built, and then run inside
Spark's own regex expressions.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# A rule that opens with \\b opens with a word character, so only word starts qualify;
# this skips the whole alternation at every other position of a long text.
_WORD_START = r"(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])"
_SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


@lru_cache(maxsize=None)
def java(pattern: str, flags: str = "i") -> str:
    """Translate one rule pattern. ``flags`` holds any of ``i``, ``m`` and ``s``."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "b" and not in_class:
                out.append(_WORD_START if i == 0 else _EDGE)
            elif n == "s":
                out.append(_SPACE if in_class else f"[{_SPACE}]")
            else:
                out.append(c + n)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c in "[&":
                c = "\\" + c
        elif c == "[":
            in_class = True
        elif c == "$" and "m" not in flags:
            c = r"\z"
        out.append(c)
        i += 1
    prefix = f"(?{flags})" if flags else ""
    return prefix + "".join(out)


def any_of(patterns: list[str]) -> str:
    """One alternation of several rule patterns (still in the rule dialect)."""
    if patterns and all(p.startswith(r"\b") for p in patterns):
        return r"\b(?:" + "|".join(f"(?:{p[2:]})" for p in patterns) + ")"
    return "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


@lru_cache(maxsize=None)
def without_lookaheads(pattern: str) -> str:
    """Drop lookahead groups: a cheap superset of the pattern, used to gate exact scans."""
    out, i, depth, skip_to = [], 0, 0, None
    while i < len(pattern):
        if pattern[i] == "\\":
            if skip_to is None:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if pattern[i] == "[":
            j = i + 1
            while pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            if skip_to is None:
                out.append(pattern[i : j + 1])
            i = j + 1
            continue
        if pattern[i] == "(":
            if skip_to is None and pattern.startswith(("(?!", "(?="), i):
                skip_to = depth
            depth += 1
        if skip_to is None:
            out.append(pattern[i])
        if pattern[i] == ")":
            depth -= 1
            if depth == skip_to:
                skip_to = None
        i += 1
    return "".join(out)


@lru_cache(maxsize=None)
def needed_words(pattern: str) -> frozenset[tuple[str, bool]] | None:
    """Runs of ASCII letters and digits, of which every match holds one, and whether they open a word; None: no such runs."""

    def marks_only(op: object, value: object) -> bool:
        """Whether an item always stands for characters outside of words."""
        if op is sre.MAX_REPEAT:
            return value[0] > 0 and len(value[2]) == 1 and marks_only(*value[2][0])
        if op is sre.IN:
            return all(marks_only(*v) for v in value)
        if op is sre.CATEGORY:
            return value is sre.CATEGORY_SPACE
        return op is sre.LITERAL and not (chr(value).isalnum() or chr(value) == "_")

    def best(items: list, edge: bool) -> frozenset[tuple[str, bool]] | None:
        """``edge``: whether a letter that comes next opens a word."""
        found, run, opens = [], [], edge
        for i, (op, value) in enumerate([*items, (None, None)]):
            if op is sre.LITERAL and chr(value).isascii() and chr(value).isalnum():
                run.append((op, value))
                continue
            if op is sre.MAX_REPEAT and value[0] == 0 and value[1] == 1 and all(marks_only(*v) for v in value[2]):
                each = [best([*run, *gap, *items[i + 1 :]], opens) for gap in (list(value[2]), [])]  # x-ray, xray
                found.append(each[0] | each[1] if all(each) else None)
            if op is sre.SUBPATTERN:
                found.append(best([*run, *value[-1]], opens))
            elif op is sre.BRANCH:
                each = [best([*run, *b], opens) for b in value[1]]
                found.append(frozenset().union(*each) if all(each) else None)
            elif op is sre.MAX_REPEAT and value[0] > 0:
                found.append(best(list(value[2]), False))
            if run:
                found.append(frozenset([("".join(chr(v).lower() for _, v in run), opens)]))
            inside = op in (sre.ASSERT, sre.ASSERT_NOT) and not run and opens
            run, opens = [], inside or (op is sre.AT and value is sre.AT_BOUNDARY) or marks_only(op, value)
        return max(filter(None, found), key=lambda words: (min(len(w) + o for w, o in words), -len(words)), default=None)

    return best(list(sre.parse(pattern)), False)


def word_gate(patterns: list[str]) -> str | None:
    """A pattern found in every text that holds a match of one of these; None if some may match without any word."""
    each = [needed_words(p) for p in patterns]
    if not each or not all(each):
        return None
    words = frozenset().union(*each)

    def any_word(opening: bool) -> str:
        ends: dict[str, set[str]] = {}
        for word in (w for w, opens in words if opens == opening):
            ends.setdefault(word[0], set()).add(word[1:])
        # By first letter: a regex tries the words of an alternation one after the other.
        return "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(ends.items()))

    opening, other = any_word(True), any_word(False)
    return "|".join([*([rf"\b(?:{opening})"] if opening else []), *([other] if other else [])])


def matches(text: Column, pattern: str, flags: str = "i") -> Column:
    """True when the pattern occurs in the text; NULL text counts as no match."""
    return F.coalesce(text.rlike(java(pattern, flags)), F.lit(False))


def position(text: Column, pattern: str, flags: str = "i") -> Column:
    """1-based position of the first match, NULL when there is none."""
    return F.nullif(F.regexp_instr(text, F.lit(java(pattern, flags))), F.lit(0))


def occurrences(text: Column, pattern: str, flags: str = "i") -> Column:
    """All matched substrings in order, as array<string>."""
    return F.coalesce(
        F.regexp_extract_all(text, F.lit(java(pattern, flags)), F.lit(0)),
        F.array().cast("array<string>"),
    )


def replace(text: Column, pattern: str, replacement: str = "", flags: str = "i") -> Column:
    return F.regexp_replace(text, java(pattern, flags), replacement)


def extract(text: Column, pattern: str, group: int = 0, flags: str = "i") -> Column:
    """First match of a group, NULL when there is no match or it is empty."""
    return F.nullif(F.regexp_extract(text, java(pattern, flags), group), F.lit(""))


_NAME = re.compile(r"^Column<'[\w.`]+'>$")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    Column functions nest by substitution, so reusing a computed column doubles
    the expression at every level.  A one-element ``transform`` binds it instead;
    a plain column reference is passed through and stays inside code generation.
    """
    if _NAME.match(str(value)):
        return body(value)
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """Keep an expensive text column in a projection of its own.

    Spark copies a deterministic expression into every pushed-down filter and every
    nested-field reference, which would scan the text several times.  The always-true
    row-id guard stops that; the value itself does not depend on it.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
