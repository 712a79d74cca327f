"""Shell globs compiled once on the driver to regexes that mean the same in Java and RE2."""

from __future__ import annotations

from collections.abc import Iterable

_PLAIN = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_/ ")


def literal(text: str) -> str:
    """Regex that matches ``text`` itself."""
    return "".join(c if c in _PLAIN or ord(c) > 127 else "\\" + c for c in text)


def glob_body(pattern: str) -> str:
    """fnmatch meaning: ``*`` and ``?`` also cross ``/``; ``[...]`` is a character class."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inner = pattern[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = close
        else:
            out.append(literal(c))
        i += 1
    return "".join(out)


def whole(pattern: str) -> str:
    """Regex for a glob that must match the whole string."""
    return "(?s)^" + glob_body(pattern) + "$"


def any_of(patterns: Iterable[str]) -> str:
    """One alternation for a list of globs, so that a row is tested once."""
    return "(?s)^(?:" + "|".join(glob_body(p) for p in patterns) + ")$"


def path_suffix(pattern: str) -> str:
    """Glob with a ``/`` matches any tail of the path; one without matches the base name."""
    body = glob_body(pattern)
    if "/" in pattern:
        return "(?s)^(?:.*/)?" + body + "$"
    # the base name holds no separator, so wildcards are kept inside it
    return "^(?:.*/)?" + body.replace(".*", "[^/]*") + "$"


def prefix_of(prefixes: Iterable[str]) -> str:
    return "^(?:" + "|".join(literal(p) for p in prefixes) + ")"


def suffix_of(suffixes: Iterable[str]) -> str:
    return "(?:" + "|".join(literal(s) for s in suffixes) + ")$"
