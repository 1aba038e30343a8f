"""Tokens of source texts, whatever state the text is in.

One pattern per language tells comments, strings, characters, words and marks
apart. What a pattern can't is done by modes: nested comments, templates that
hold code, and slashes that begin a regular expression or divide. A string that
isn't closed ends with its line, so a stray quote spoils one line at most.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # w word, n number, s string, p mark, d preprocessor directive
    text: str
    at: int
    end: int


_WORD, _NUMBER = r"(?P<w>[^\W\d][\w$]*|\$[\w$]*)", r"(?P<n>\d(?:[\w.]|(?<=[\da-fA-F])'(?=[\da-fA-F]))*)"
_COMMENT = r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)', r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
_CHAR = r"'(?:\\.[^'\n]{0,8}|[^'\\\n]{1,4})'"
_MARK = r"(?P<p>\?\.(?!\d)|=>|->|::|:=|&&|\|\||[^\s\w])"
_DIRECTIVE = r"(?P<d>(?:^|(?<=\n))[ \t]*\#(?:\\\r?\n|/\*.*?\*/|[^\n])*)"
_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)'


def _pattern(*parts: str) -> re.Pattern:
    return re.compile("|".join(parts), re.S)


_C = (_DIRECTIVE, _COMMENT, rf"(?P<s>(?:u8|[uUL])?(?:{_DOUBLE}|{_CHAR}))", _WORD, _NUMBER, _MARK)
PATTERNS = {
    "c": _pattern(*_C),
    "cpp": _pattern(r'(?P<s>(?:u8|[uUL])?R"(?P<fence>[^()\\\s]{0,16})\(.*?(?:\)(?P=fence)"|\Z))', *(x.replace("(?P<s>", "(?P<s2>") for x in _C)),
    "java": _pattern(_COMMENT, rf"(?P<s>{_TRIPLE}|{_DOUBLE}|{_CHAR})", _WORD, _NUMBER, _MARK),
    "go": _pattern(_COMMENT, rf"(?P<s>`[^`]*(?:`|\Z)|{_DOUBLE}|{_CHAR})", _WORD, _NUMBER, _MARK),
    "rust": _pattern(
        r"(?P<c>//[^\n]*)|(?P<nest>/\*)", r'(?P<s>[bc]?r(?P<fence>\#*)".*?(?:"(?P=fence)|\Z)|[bc]?"(?:\\.|[^"\\])*(?:"|\Z)|b?\'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}\n]*\}|.)|[^\\\'\n])\')',
        r"(?P<life>'[^\W\d]\w*)", r"(?:r\#)?" + _WORD, _NUMBER, _MARK,
    ),
    "javascript": _pattern(_COMMENT, rf"(?P<s>{_DOUBLE}|{_SINGLE})", r"(?P<tick>`)", r"(?P<w>\#?[^\W\d][\w$]*|\$[\w$]*)", _NUMBER, _MARK),
    "python": _pattern(
        r"(?P<c>\#[^\n]*|\\\r?\n)", rf"(?P<s>(?:[rRbBuUfFtT]{{1,2}})?(?:{_TRIPLE}|{_TRIPLE.replace(chr(34), chr(39))}|{_DOUBLE}|{_SINGLE}))", _WORD, _NUMBER, _MARK,
    ),
}
PATTERNS["typescript"] = PATTERNS["javascript"]
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])*/\w*")
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
_NEST = re.compile(r"/\*|\*/")
_BEFORE_VALUE = set("return typeof case in of delete void throw new else do instanceof yield await".split())


def _value_ends(out: list[Token], heads: list[bool], blocks: list[bool]) -> bool:
    """Whether the last token ends a value, so that a slash after it divides."""
    if not out:
        return False
    last = out[-1]
    if last.text == ")":
        return not heads[-1]
    if last.text == "}":
        return not blocks[-1]
    return last.kind in "ns" or last.text == "]" or (last.kind == "w" and last.text not in _BEFORE_VALUE)


def tokens(text: str, language: str) -> list[Token]:
    """The tokens of ``text`` without comments and blanks; nothing is an error."""
    search, script = PATTERNS[language].search, language in ("javascript", "typescript")
    out: list[Token] = []
    open_, heads, blocks, at = [], [False], [True], 0  # open brackets; whether the last ) closed an if, the last } a block

    def template(at: int) -> int:
        """Past a template's text from ``at`` on: its end, or the start of the code it holds."""
        end = _TEMPLATE.match(text, at).end()
        out.append(Token("s", "`", at, end))
        if text.startswith("${", end):
            open_.append("${")
            return end + 2
        return end + 1

    while m := search(text, at):
        kind, begin, at = m.lastgroup, m.start(), m.end()
        if kind in ("c", "life"):
            continue
        if kind == "nest":
            depth = 1
            while depth and (n := _NEST.search(text, at)):
                depth, at = depth + (1 if n.group() == "/*" else -1), n.end()
            at = len(text) if depth else at
        elif kind == "tick":
            at = template(at)
        elif kind == "p" and script:
            mark = m.group()
            if mark == "/" and not _value_ends(out, heads, blocks) and (r := _REGEX.match(text, begin)):
                at = r.end()
                out.append(Token("s", "/", begin, at))
                continue
            if mark in "([{":
                before = out[-1].text if out else ""
                if mark == "(":
                    open_.append("if" if before in ("if", "while", "for", "with") else "(")
                elif mark == "{":
                    open_.append("object" if before in ("=", "(", ",", ":", "[", "?", "return", "&&", "||") else "{")
                else:
                    open_.append("[")
            elif mark in ")]}":
                last = open_.pop() if open_ else ""
                heads[-1], blocks[-1] = last == "if", last != "object"
                if last == "${" and mark == "}":
                    at = template(at)
                    continue
            out.append(Token("p", mark, begin, at))
        elif kind == "d":
            out.append(Token("d", m.group().lstrip(" \t#").split(None, 1)[0] if m.group().strip(" \t#") else "", begin, at))
        else:
            if kind in ("s2", "fence"):
                kind = "s"
            word = m.group()
            out.append(Token(kind, word[2:] if kind == "w" and word.startswith("r#") else word, begin, at))
    return out


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def pairs(found: list[Token]) -> dict[int, int]:
    """Each bracket's partner, by token; those without one are left out.

    A closing brace gives up the round and square brackets open within it; a
    closing one of these never gives up a brace.
    """
    out, stack = {}, []
    for i, t in enumerate(found):
        if t.kind != "p":
            continue
        if t.text in _OPEN:
            stack.append(i)
        elif t.text in _CLOSE:
            want = _CLOSE[t.text]
            at = len(stack) - 1
            while at >= 0 and found[stack[at]].text != want and (t.text == "}" or found[stack[at]].text != "{"):
                at -= 1
            if at >= 0 and found[stack[at]].text == want:
                out[i], out[stack[at]] = stack[at], i
                del stack[at:]
    return out
