"""Ignore files as version control reads them: ordered patterns, the last match wins, deeper files before higher ones."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

#: File names, the first of which has the last word wherever both decide.
NAMES = (".ignore", ".gitignore")


class Rule(NamedTuple):
    keep: bool
    dirs_only: bool
    match: Callable


def _glob(pattern: str) -> str:
    """A regular expression for one pattern without its leading and trailing slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i) and i + 2 == len(pattern) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            while pattern.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.compile(r"\[([!^]?)(\]?(?:\\.|\[:\w+:\]|[^\]\\])*)\]").match(pattern, i)):
            # fixed values: named classes
            named = {"[:digit:]": "0-9", "[:alpha:]": "A-Za-z", "[:alnum:]": "A-Za-z0-9", "[:lower:]": "a-z", "[:upper:]": "A-Z", "[:space:]": r"\s", "[:xdigit:]": "0-9A-Fa-f"}
            body = m.group(2)
            body = re.sub(r"\[:\w+:\]|\\.|[\[\]^&~|]", lambda x: named.get(x.group(), "\\" + x.group()[-1]), body)
            out, i = out + f"(?!/)[{'^' if m.group(1) else ''}{body}]", m.end()
        elif c == "[":
            return r"(?!)"  # a class that doesn't end matches nothing
        elif c == "\\":
            if i + 1 == len(pattern):
                return r"(?!)"
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def compiled(text: str) -> tuple[Rule, ...]:
    """The rules of an ignore file, the last one first. Patterns that can't be read match nothing."""
    rules = []
    for line in text.removeprefix("﻿").split("\n"):
        line = re.sub(r"(?<!\\)((?:\\\\)*) +$", r"\1", line.removesuffix("\r"))
        if not line or line[0] == "#":
            continue
        keep = line[0] == "!"
        line = line[keep:]
        dirs_only = line.endswith("/")
        pattern = line.removesuffix("/")
        if not pattern:
            continue
        free = "/" not in pattern
        body = ("(?:.*/)?" if free else "") + _glob(pattern.removeprefix("/"))
        try:
            rules.append(Rule(keep, dirs_only, re.compile(body, re.S).fullmatch))
        except re.error:
            continue
    return tuple(reversed(rules))


def ignored(path: str, is_dir: bool, files: Sequence[tuple[str, str, tuple[Rule, ...]]]) -> bool:
    """Whether ``path`` is left out; files: (name, directory with trailing slash or empty, rules), from the root down.

    The directory that holds ``path`` isn't left out itself, as those are never entered.
    """
    for name in NAMES:
        for kind, base, rules in reversed(files):
            if kind != name or not path.startswith(base):
                continue
            inner = path[len(base) :]
            for rule in rules:
                if (is_dir or not rule.dirs_only) and rule.match(inner):
                    return not rule.keep
            continue
    return False


cached = functools.lru_cache(maxsize=4096)(compiled)
