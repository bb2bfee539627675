"""The pattern dialect: unanchored search, Unicode classes, no constructs that need backtracking.

A pattern is read by a small tokenizer, refused if it holds anything the dialect lacks, and written
for Java: `(?dU)` for Unicode classes and line ends of `\\n` only, `\\z` for a final `$`.
"""

from __future__ import annotations

import re


class PatternError(ValueError):
    pass


_GROUP = re.compile(r"\(\?(?:P?<(?P<name>[A-Za-z_][A-Za-z0-9_]*)>|(?P<flags>[isU]*(?:-[isU]+)?)(?P<end>[:)]))")
_COUNT = re.compile(r"\{\d+(?:,\d*)?\}")
_ESCAPES = frozenset("dDwWsSbBntrfvAz")
_PROPERTY = re.compile(r"\\[pP](?:[A-Z]|\{\^?[A-Za-z0-9_=]+\})")
_HEX = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|x\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4})")


def to_java(pattern: str) -> str:
    """The same search for `rlike`. Raises PatternError for look-around, back-references, possessive
    or atomic parts, inline flags other than i, s, U, and whatever isn't known here."""
    out, at, depth, can_repeat = [], 0, 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            piece, at = _escape(pattern, at)
            out.append(piece)
            can_repeat = piece not in (r"\b", r"\B", r"\A", r"\z")
        elif c == "[":
            piece, at = _class(pattern, at)
            out.append(piece)
            can_repeat = True
        elif c == "(":
            depth += 1
            can_repeat = False
            if pattern.startswith("(?", at):
                m = _GROUP.match(pattern, at)
                if not m:
                    raise PatternError(f"unsupported group at {at}")
                if m["name"]:
                    out.append(f"(?<{m['name'].replace('_', 'U')}>")
                elif m["end"] == ")":
                    depth -= 1
                    out.append(f"(?{m['flags'].replace('U', '')})" if m["flags"].replace("U", "").strip("-") else "")
                else:
                    out.append(f"(?{m['flags'].replace('U', '')}:")
                at = m.end()
            else:
                out.append(c)
                at += 1
        elif c == ")":
            depth -= 1
            if depth < 0:
                raise PatternError("unopened group")
            out.append(c)
            at += 1
            can_repeat = True
        elif c in "*+?" or c == "{":
            m = _COUNT.match(pattern, at) if c == "{" else None
            if c == "{" and not m:
                raise PatternError(f"repetition at {at} is not understood")
            if not can_repeat:
                raise PatternError(f"nothing to repeat at {at}")
            piece = m[0] if m else c
            at += len(piece)
            if at < len(pattern) and pattern[at] == "?":
                piece, at = piece + "?", at + 1
            if at < len(pattern) and pattern[at] in "*+?":
                raise PatternError(f"possessive or doubled repetition at {at}")
            out.append(piece)
            can_repeat = False
        elif c == "$":
            out.append(r"\z")
            at += 1
            can_repeat = False
        elif c in "^|":
            out.append(r"\A" if c == "^" else c)
            at += 1
            can_repeat = False
        elif c in "}]":
            out.append("\\" + c)
            at += 1
            can_repeat = True
        else:
            out.append(c)
            at += 1
            can_repeat = True
    if depth:
        raise PatternError("unclosed group")
    java = "(?dU)" + "".join(out)
    return java


def _escape(pattern: str, at: int) -> tuple[str, int]:
    if at + 1 >= len(pattern):
        raise PatternError("a lone backslash at the end")
    for known in (_PROPERTY, _HEX):
        if m := known.match(pattern, at):
            return m[0].replace("{^", "{"), m.end()
    c = pattern[at + 1]
    if c.isdigit():
        raise PatternError("back-references are not supported")
    if c.isalpha() and c not in _ESCAPES:
        raise PatternError(f"unknown escape \\{c}")
    return ("\\x0B" if c == "v" else "\\" + c), at + 2


def _class(pattern: str, at: int) -> tuple[str, int]:
    out, k = ["["], at + 1
    if pattern.startswith("^", k):
        out.append("^")
        k += 1
    first = True
    while True:
        if k >= len(pattern):
            raise PatternError("unclosed class")
        c = pattern[k]
        if c == "]" and not first:
            out.append("]")
            return "".join(out), k + 1
        if c == "[":
            m = re.match(r"\[:(\^?)([a-z]+):\]", pattern[k:])
            if m:
                name = {"alnum": "Alnum", "alpha": "Alpha", "digit": "Digit", "lower": "Lower", "upper": "Upper", "punct": "Punct", "space": "Space", "xdigit": "XDigit"}.get(m[2])
                if not name:
                    raise PatternError(f"unknown class {m[0]}")
                out.append(f"\\{'P' if m[1] else 'p'}{{{name}}}")
                k += len(m[0])
            else:
                piece, k = _class(pattern, k)
                out.append(piece)
        elif c == "\\":
            piece, k = _escape(pattern, k)
            out.append(piece)
        elif pattern.startswith("&&", k) or pattern.startswith("--", k) or pattern.startswith("~~", k):
            raise PatternError("set operations in classes are not supported")
        else:
            out.append("\\" + c if c in "]^&~|" else c)
            k += 1
        first = False


def check(pattern: str) -> str | None:
    """Why a pattern can't be used, or None."""
    try:
        java = to_java(pattern)
    except PatternError as e:
        return str(e)
    try:
        # Python reads what is left of the dialect closely enough to find unbalanced counts and ranges
        re.compile(re.sub(r"\\[pP](?:[A-Z]|\{[^}]*\})", "a", java.replace("(?dU)", "").replace(r"\z", r"\Z").replace("(?<", "(?P<")))
    except re.error as e:
        return str(e)
    return None
