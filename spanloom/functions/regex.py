"""Python regular expressions as Java ones, with the offset of a named group kept.

Spark returns matches without positions. A group's position follows from the match
start once everything that stands before the group is captured as well, so this
module wraps those stretches in groups of their own.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class JavaPattern:
    """A Java pattern, the groups before the wanted one, and the wanted group(s)."""

    text: str
    before: tuple
    wanted: tuple


def java_flags(flags: str = "") -> str:
    """Unicode classes and Unix line ends, which is how Python reads a str pattern."""
    return "(?dU" + "".join(sorted(set(flags))) + ")"


def to_java(pattern: str, flags: str = "", wanted=("name", "name2")) -> JavaPattern:
    """Translate ``pattern``. ``wanted`` holds group names, or the number of one group.

    Group loops become possessive where that changes no match (see ``_possessive``):
    Java recurses once per repetition of any other group loop, and a long text would
    overflow the stack. Every other capturing group becomes non-capturing. A wanted group may stand inside
    groups that are not repeated. Where several are wanted they exclude one another
    (alternatives), so their texts can be concatenated without loss.
    """
    pattern = _possessive(pattern)
    out, levels, number = [], [{"from": 0, "wrapped": False}], 0
    i, in_class = 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
            out.append("\\[" if ch == "[" else ch)      # Java nests classes
        elif ch == "[":
            in_class = True
            out.append(ch)
            if pattern[i + 1:i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1:i + 2] == "]":
                out.append("\\]")
                i += 1
        elif ch == "(":
            name, step, opening = None, 1, None
            if pattern.startswith("(?P<", i):
                close = pattern.index(">", i)
                name, step = pattern[i + 4:close], close + 1 - i
                number += 1
            elif pattern.startswith("(?", i):
                opening = "("
            else:
                number += 1
            if opening is None and (name in wanted or number in wanted):
                _wrap_before(out, levels)
                opening = "WANT"
            levels.append({"open": len(out), "from": len(out) + 1, "wrapped": False})
            out.append(opening or "(?:")
            i += step
            continue
        elif ch == ")":
            levels.pop()
            out.append(ch)
        elif ch == "|":
            out.append(ch)
            levels[-1].update({"from": len(out), "wrapped": False})
        else:
            out.append(ch)
        i += 1
    before, kept, count = [], [], 0
    for k, token in enumerate(out):
        if token in ("WANT", "BEFORE"):
            count += 1
            (kept if token == "WANT" else before).append(count)
            out[k] = "("
    return JavaPattern(java_flags(flags) + "".join(out), tuple(before), tuple(kept))


def _wrap_before(out, levels):
    """Open a capture at the start of the current alternative of every enclosing level
    and close it where the next level opens."""
    for depth, level in enumerate(levels):
        if level["wrapped"]:
            continue
        start = level["from"]
        stop = levels[depth + 1]["open"] if depth + 1 < len(levels) else len(out)
        # inline look-around openers such as "?!" belong to the group, not to its body
        level["wrapped"] = True
        if start == stop:
            continue
        if out[start] == "?":
            start += 2
            if start >= stop:
                continue
        out.insert(stop, ")")
        out.insert(start, "BEFORE")
        for deeper in levels[depth + 1:]:
            deeper["open"] += 2
            deeper["from"] += 2


_LOOP = re.compile(r"[*+]|\{\d+,\}")


def _scan(pattern):
    """(position, token) of a pattern: escapes, classes, group openers and single characters."""
    i = 0
    while i < len(pattern):
        j = i + 1
        if pattern[i] == "\\":
            j = i + 2
        elif pattern[i] == "[":
            j = i + 2 + pattern.startswith("[^", i)
            while pattern[j] != "]":
                j += 1 + (pattern[j] == "\\")
            j += 1
        elif pattern.startswith("(?P<", i):
            j = pattern.index(">", i) + 1
        elif pattern.startswith("(?<", i):
            j = i + 4
        elif pattern.startswith("(?", i):
            j = i + 3
        yield i, pattern[i:j]
        i = j


@lru_cache(maxsize=4096)
def _meets(atom: str, others: tuple) -> bool:
    """Whether a character of the basic plane fits ``atom`` and one of ``others``, in either case."""
    one = re.compile(atom, re.S | re.I)
    several = [re.compile(o, re.S | re.I) for o in others]
    return any(one.fullmatch(c) and any(o.fullmatch(c) for o in several) for c in map(chr, range(0xD800)))


def _possessive(pattern: str) -> str:
    """Mark group loops that never need to give anything back.

    That is so where the pattern, or one of its top alternatives, ends after the loop, and
    where the next thing after it is one character that the loop's body cannot hold.
    """
    tokens = list(_scan(pattern))
    stack, marks = [], []
    for n, (i, token) in enumerate(tokens):
        if token.startswith("("):
            stack.append(n)
        elif token == ")":
            opened = stack.pop()
            loop = _LOOP.match(pattern, i + 1)
            if not loop or pattern[loop.end():loop.end() + 1] in ("?", "+"):
                continue
            rest = [t for t in tokens if t[0] >= loop.end()]
            depth = len(stack)
            while rest and rest[0][1] == ")" and depth and not re.match(r"[*+?{]", pattern[rest[0][0] + 1:]):
                rest, depth = rest[1:], depth - 1
            at_end = not depth and (not rest or rest[0][1] == "|")
            if not at_end:
                follows = rest[0][1] if rest else ""
                after = pattern[rest[0][0] + len(follows):][:1] if rest else ""
                body = tuple(t for _, t in tokens[opened + 1:n] if _one_character(t))
                plain = all(_one_character(t) or t in "()|?*+" or t.startswith("(?:") for _, t in tokens[opened + 1:n])
                if not follows or not _one_character(follows) or after in ("?", "*", "{") or not plain or _meets(follows, body):
                    continue
            marks.append(loop.end())
    for at in reversed(marks):
        pattern = pattern[:at] + "+" + pattern[at:]
    return pattern


def _one_character(token: str) -> bool:
    return token[0] == "[" or (token[0] == "\\" and token[1] not in "bBAZGzk0123456789") or (len(token) == 1 and token not in "()|?*+{}^$")


def line_bound(pattern: str, flags: str = "") -> bool:
    """Whether a match and what it looks at lie in one line: nothing in ``pattern`` fits a line end. Anchors of the whole text
    are no line's, so they need the flag ``m``."""
    tokens = [t for _, t in _scan(pattern)]
    atoms = {t for t in tokens if _one_character(t) and t[:1] not in "()|?*+{}"}
    return (not {"^", "$"} & set(tokens) or "m" in flags) and not any(re.match(r"\\[AZzG0-9]", t) for t in tokens) and not any(
        re.compile(a, re.S if "s" in flags else 0).fullmatch("\n") for a in atoms)


def first_characters(pattern: str):
    """The letters that a match of ``pattern`` can begin with; None where they are not a few plain ones."""
    tokens = [t for _, t in _scan(pattern)]

    def letters(token):
        if re.fullmatch(r"[A-Za-z]|\[[A-Za-z]+\]", token):
            return set(token.strip("[]"))
        if re.fullmatch(r"\[(?:[A-Za-z]-[A-Za-z])+\]", token):
            return {c for low, high in re.findall("(.)-(.)", token) for c in map(chr, range(ord(low), ord(high) + 1))}

    def alternatives(i):
        """(letters or None, whether it may be empty, position of what ends it) of the alternatives from ``i`` on."""
        found, empty, first = set(), False, True
        while i < len(tokens) and tokens[i] != ")":
            if tokens[i] == "|":
                empty, first, i = empty or first, True, i + 1
                continue
            if tokens[i] == "(" or tokens[i].startswith(("(?:", "(?P<")):
                inner, may, i = alternatives(i + 1)
            elif tokens[i].startswith("("):
                inner, may, i = None, False, alternatives(i + 1)[2]
            else:
                inner, may = letters(tokens[i]), False
            i += 1
            may = may or bool(re.match(r"[?*]|\{0", "".join(tokens[i:i + 2])))
            if first:
                found = None if found is None or inner is None else found | inner
                first = may
            while i < len(tokens) and re.fullmatch(r"[?*+{},0-9]", tokens[i]):
                i += 1
        return found, empty or first, i

    found, empty, _ = alternatives(0)
    return None if empty else found
