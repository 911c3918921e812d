"""ASCII folding, byte length, concatenation and POSIX patterns as Spark columns."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: POSIX class names and the same classes in Java patterns.
POSIX_CLASSES = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "blank": r" \t", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\s\x0B", "upper": r"\p{Upper}", "xdigit": r"\p{XDigit}",
}


def ascii_lower(c: Column) -> Column:
    """Lower case for A-Z only; Spark's lower() folds every script."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def ascii_fold(s: str) -> str:
    return s.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def posix_to_java(pattern: str) -> str:
    """A POSIX extended regular expression in Java's syntax; ValueError if it is malformed.

    Differences that matter: a backslash is an ordinary character inside brackets, classes are named
    ``[:name:]``, ``$`` stands for the very end only, the dot takes newlines too, and a second
    quantifier repeats the first (in Java it would make it lazy or possessive)."""
    out: list[str] = []
    opens: list[int] = []
    atom: int | None = None  # where the last complete atom begins in out
    repeated = False
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "[":
            text, i = _bracket(pattern, i)
            atom, repeated = len(out), False
            out.append(text)
            continue
        if ch == "\\":
            if i + 1 == n:
                raise ValueError("trailing backslash")
            nxt = pattern[i + 1]
            atom, repeated = len(out), False
            out.append("\\b" if nxt in "<>" else "\\" + nxt if nxt in "wWsSbB" or nxt.isdigit() or not nxt.isalnum() else nxt)
            i += 2
            continue
        interval = re.match(r"\{\d*(,\d*)?\}", pattern[i:]) if ch == "{" else None
        if ch in "*+?" or (interval and interval[0] not in ("{}", "{,}")):
            if atom is None:
                raise ValueError("nothing to repeat")
            if repeated:
                out.insert(atom, "(?:")
                out.append(")")
            text = interval[0] if interval else ch
            out.append("{0" + text[1:] if text.startswith("{,") else text)
            i, repeated = i + len(text), True
            continue
        if ch == "(":
            opens.append(len(out))
            atom = None
            out.append("(")
        elif ch == ")" and opens:
            atom, repeated = opens.pop(), False
            out.append(")")
        elif ch == "|":
            atom = None
            out.append("|")
        elif ch in "^$":
            atom, repeated = len(out), False
            out.append("^" if ch == "^" else "\\z")
        else:
            atom, repeated = len(out), False
            out.append("." if ch == "." else re.escape(ch) if ch in "{})" else ch)
        i += 1
    if opens:
        raise ValueError("unmatched parenthesis")
    return "(?s)" + "".join(out)


def _bracket(pattern: str, at: int) -> tuple[str, int]:
    i = at + 1
    out = "["
    if pattern[i : i + 1] == "^":
        out, i = "[^", i + 1
    first = True
    while i < len(pattern):
        ch = pattern[i]
        if ch == "]" and not first:
            return out + "]", i + 1
        named = re.match(r"\[:(\w+):\]", pattern[i:])
        if named:
            if named[1] not in POSIX_CLASSES:
                raise ValueError(f"unknown class {named[1]}")
            out, i = out + POSIX_CLASSES[named[1]], i + len(named[0])
        else:
            out, i = out + ("\\" + ch if ch in "[]\\&^~" else ch), i + 1
        first = False
    raise ValueError("unmatched bracket")


def search_pattern(pattern: str) -> str | None:
    """The Java form of a POSIX pattern, or None if it isn't valid."""
    try:
        java = posix_to_java(pattern)
    except ValueError:
        return None
    session = SparkSession.getActiveSession()
    try:
        if session is not None:
            session._jvm.java.util.regex.Pattern.compile(java)
        else:
            re.compile(java.replace(r"\z", r"\Z"))
    except Exception:
        return None
    return java
