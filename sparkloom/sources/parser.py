"""Definitions and calls in source files, whatever state a file is in.

A file is cut into tokens (see ``lexer``) and read once with a stack of open
scopes. A definition's head tells where its body begins; its last line is that
of the body's closing brace, and a call belongs to the innermost definition
around it. Calls outside any definition are left out. If the braces of a file
don't match, it is read again, and a line that begins no deeper than the head
of an open definition ends that definition. Branches of preprocessor conditions
begin with the same open scopes. Python goes by the standard library's grammar;
where that finds an error, by tokens and indentation.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import LANGUAGES, loader
from .lexer import Token, pairs, tokens

ROWS = (
    "file_path string, kind string, ordinal int, name string, scope_path string, symbol_type string, line_start int, line_end int, "
    "signature string, caller int, call_line int"
)
READ = f"{ROWS}, file_hash string, line_count int"
#: Words before a round bracket that aren't calls.
NOT_CALLED = {
    "javascript": "if for while switch catch return typeof function async with do try await yield delete void in of else throw case new class super import instanceof",
    "go": "if for switch func return go defer select case interface struct map chan type var const package import else range",
    "rust": "if while for match return fn in let else loop impl where as move unsafe pub crate mod use type struct enum trait Fn FnMut FnOnce dyn ref mut",
    "java": "if for while switch catch synchronized return try assert throw new class interface enum super this else do instanceof case",
    "c": "if for while switch return sizeof defined do else goto case typeof __attribute__ __attribute __declspec alignof alignas _Alignas _Alignof _Static_assert static_assert asm __asm__ int char void float double long short unsigned signed bool",
    "python": "if elif while for return in not and or is lambda with assert del yield await except raise import from class def async else break continue pass True False None case",
}
NOT_CALLED["typescript"] = NOT_CALLED["javascript"]
NOT_CALLED["cpp"] = NOT_CALLED["c"] + " catch new delete throw decltype noexcept operator co_await co_return co_yield requires typeid"
NOT_CALLED = {k: frozenset(v.split()) for k, v in NOT_CALLED.items()}
_TYPE_HEADS = {"javascript": ("class",), "typescript": ("class", "interface"), "java": ("class", "interface", "enum", "record"), "rust": ("struct", "enum", "trait"), "c": ("struct",), "cpp": ("struct", "class")}
#: Words of a type or a modifier that a C function's or a Java method's name may not follow.
_NO_TYPE = frozenset("return else case goto new delete throw do sizeof in public private protected static final abstract synchronized native default strictfp".split())
#: Words before a call in C and Java; after any other word a name is being declared.
_BEFORE_CALL = frozenset("return else case do throw assert co_await co_return co_yield".split())
_MODIFIERS = frozenset("public private protected static async readonly get set override abstract declare pub unsafe const extern default crate".split())
#: Marks and words after which a function is a value, not a declaration.
_VALUE_BEFORE = frozenset("= ( , : ? [ ! & | + - * / => && || return typeof new void yield await of in case throw".split())


@dataclass
class _Scope:
    """An open definition or block: the token of its body's brace, its name if it has one, the symbol if it is one."""

    body: int
    kind: str = "block"
    name: str = ""
    symbol: int = -1
    column: int = -1


@dataclass
class _Head:
    """What a definition's first tokens say; without a body it lasts to ``end``."""

    name: int
    kind: str
    start: int
    body: int | None
    end: int = -1
    symbol: bool = True
    within: str = ""
    text: str = ""


@dataclass
class _Reader:
    text: str
    language: str
    resync: bool = False
    symbols: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    errors: int = 0

    named: set = field(default_factory=set)  # tokens that name something, so call nothing

    def __post_init__(self):
        self.t = [*tokens(self.text, self.language), Token("e", "", len(self.text), len(self.text))]
        self.pair = pairs(self.t)
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.last = len(self.t) - 1
        self.bodies: dict[int, str] = {}  # braces of known kind without a definition
        self.specs: set[int] = set()  # first tokens of grouped types
        self.quiet = -1  # no calls up to this token
        self.not_called = NOT_CALLED[self.language]

    # places ----------------------------------------------------------------
    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def column(self, i: int) -> int:
        """Blanks before the first token of the token's line."""
        begin = self.starts[self.line(self.t[i].at) - 1]
        return len(self.text[begin : self.t[i].at + 1]) - len(self.text[begin : self.t[i].at + 1].lstrip())

    def first_of_line(self, i: int) -> bool:
        return i == 0 or self.line(self.t[i - 1].end - 1) < self.line(self.t[i].at)

    def s(self, i: int) -> str:
        return self.t[i].text if 0 <= i <= self.last and self.t[i].kind in "wpd" else ""

    def word(self, i: int) -> bool:
        return 0 <= i <= self.last and self.t[i].kind == "w"

    def after(self, i: int) -> int:
        """The token after a bracket's partner; the next one where it has none."""
        return self.pair.get(i, i) + 1

    def angles(self, i: int) -> int:
        """Past the angle brackets that open at ``i``, or ``i`` itself."""
        depth, j = 0, i
        while j < self.last and self.s(j) not in (";", ")"):
            x = self.s(j)
            if x in ("(", "[", "{"):
                j = self.after(j)
                continue
            depth += (x == "<") - (x == ">")
            j += 1
            if depth <= 0:
                return j if x == ">" else i
        return i

    def angles_back(self, i: int) -> int:
        """The token that opens the angle brackets closed at ``i``."""
        depth, j = 0, i
        while j > 0 and self.s(j) not in (";", "{", "}"):
            depth += (self.s(j) == ">") - (self.s(j) == "<")
            if not depth:
                return j
            j -= 1
        return i

    def seek(self, i: int, stops: str) -> int:
        """The first token from ``i`` on that is one of ``stops``, or a brace that opens or closes, outside brackets."""
        while i < self.last and self.s(i) not in stops.split():
            if self.s(i) in ("{", "}"):
                return i
            i = self.after(i) if self.s(i) in ("(", "[") else i + 1
        return i

    # heads -----------------------------------------------------------------
    def back(self, i: int, words: frozenset) -> int:
        while (self.word(i - 1) and self.s(i - 1) in words) or (self.s(i - 1) == "*" and self.language == "typescript"):
            i -= 1
        return i

    def statement(self, i: int) -> int:
        """The first token of the declaration around ``i``, modifiers and annotations with it."""
        while i > 0 and self.s(i - 1) not in ("{", "}", ";") and self.t[i - 1].kind != "d":
            if self.s(i - 1) == ":" and self.s(i - 2) in ("public", "private", "protected"):
                break
            i = self.pair.get(i - 1, i - 1) if self.s(i - 1) in (")", "]") else i - 1
        if self.s(i) == "template" and self.s(i + 1) == "<":
            return self.angles(i + 1)
        return i + 2 if self.s(i) == "extern" and self.t[i + 1].kind == "s" else i

    def typed(self, i: int) -> _Head | None:
        """class, struct, interface, trait and the like, with a name and a body."""
        if self.s(i - 1) in (".", "enum", "::") or not self.word(i + 1):
            return None
        j, name = i + 2, i + 1
        if self.language == "cpp":
            while self.word(j) and self.s(j) != "final" or self.s(j) == "::" or (self.s(j) == "(" and self.s(j - 1) in ("alignas", "__attribute__")):
                name, j = (j, j + 1) if self.word(j) else (name, self.after(j) if self.s(j) == "(" else j + 1)
        if self.s(name) in ("extends", "implements"):
            return None
        if self.s(i) == "record" and self.s(j) not in ("(", "<"):
            return None
        if self.s(j) in (")", ",", ">", "=", "*", "&", ".") or (self.language in ("c", "cpp") and self.s(j) not in ("{", ":", "final")):
            return None
        body = j
        while body < self.last and self.s(body) not in ("{", ";", "}", ")"):
            body = max(body + 1, self.angles(body)) if self.s(body) == "<" else self.after(body) if self.s(body) in ("(", "[") else body + 1
        kind = {"interface": "class", "record": "class", "struct": "class", "trait": "class"}.get(self.s(i), self.s(i))
        if self.s(body) == "{":
            start = self.statement(i) if self.language == "java" else self.back(i, frozenset(["abstract", "pub", "crate"]))
            return _Head(name, kind, start, body)
        return _Head(name, kind, i, None, body) if self.language == "rust" and self.s(body) == ";" else None

    def script(self, i: int) -> _Head | None:
        x = self.s(i)
        if x == "function" and self.s(i - 1) not in _VALUE_BEFORE | {"."}:
            name = i + 1 + (self.s(i + 1) == "*")
            j = self.angles(name + 1) if self.s(name + 1) == "<" else name + 1
            if self.word(name) and self.s(j) == "(" and (body := self.result(self.after(j))):
                return _Head(name, "function", self.back(i, frozenset(["async"])), body)
        elif x in ("const", "let", "var") and self.word(i + 1):
            j = i + 2
            if self.s(j) == ":":
                while j < self.last and self.s(j) not in ("=", ";") and not (self.s(j) == "}" and j not in self.pair):
                    j = self.after(j) if self.s(j) in ("(", "[", "{") else j + 1
            j += 1 + (self.s(j + 1) == "async") if self.s(j) == "=" else 0
            if self.s(j - 1) not in ("=", "async"):
                return None
            j = self.angles(j) if self.s(j) == "<" else j
            j = self.after(j) if self.s(j) == "(" else j + 1 if self.word(j) and self.s(j + 1) == "=>" else self.last
            if self.s(j) == ":":
                j = self.seek(j, "=> ; =")
            if self.s(j) == "=>" and self.s(j + 1) == "{":
                return _Head(i + 1, "function", i, j + 1)
        elif self.word(i) and x not in self.not_called and self.s(i - 1) not in (".", "new", "?.", "function"):
            j = i + 1 + (self.s(i + 1) == "?")
            j = self.angles(j) if self.s(j) == "<" else j
            if self.s(j) == "(" and j in self.pair and (body := self.result(self.after(j))):
                return _Head(i, "function", self.back(i, _MODIFIERS), body, symbol=self.language == "typescript" and not x.startswith("#"))
        return None

    def result(self, i: int) -> int | None:
        """The body's brace after parameters and a result type, or None where there is no body."""
        if self.s(i) == ":":
            i += 1
            while i < self.last:
                if self.s(i) in ("(", "[") or (self.s(i) == "{" and self.s(i - 1) in (":", "|", "&", "=>", "is", "<", ",")):
                    i = self.after(i)
                elif self.s(i) == "<":
                    i = max(i + 1, self.angles(i))
                elif self.s(i) in ("{", "}", ";", ",", "=", ")", "]"):
                    break
                else:
                    i += 1
        return i if self.s(i) == "{" else None

    def go(self, i: int) -> _Head | None:
        x = self.s(i)
        if x == "func":
            name = self.after(i + 1) if self.s(i + 1) == "(" else i + 1
            j = self.after(name + 1) if self.s(name + 1) == "[" else name + 1
            if self.word(name) and self.s(j) == "(":
                return self.to_line_end(name, "function", i, self.after(j))
        elif x == "type" and self.s(i - 1) != "(":
            if self.s(i + 1) != "(":
                self.specs.add(i + 1)
            else:
                j, end = i + 2, self.pair.get(i + 1, self.last)
                while j < end:
                    if self.word(j) and self.first_of_line(j):
                        self.specs.add(j)
                    j = self.after(j) if self.s(j) in ("(", "[", "{") else j + 1
        elif i in self.specs and self.s(i + 1) != "=":
            j = i + 1
            if self.s(j) == "[" and self.word(j + 1) and self.s(j + 2) != "]":
                j = self.after(j)
            if self.s(j) in ("struct", "interface") and self.s(j + 1) == "{":
                self.bodies[j + 1] = "members"
            return None if self.s(j) == "=" else self.to_line_end(i, "class", i, j)
        return None

    def to_line_end(self, name: int, kind: str, start: int, j: int) -> _Head:
        """A body that begins on this line, or none."""
        while j < self.last and not self.first_of_line(j) and self.s(j) not in (";", "}", ")"):
            if self.s(j) == "{" and self.s(j - 1) not in ("struct", "interface"):
                return _Head(name, kind, start, j)
            if self.s(j) == "{" and kind == "class":
                return _Head(name, kind, start, j)
            j = self.after(j) if self.s(j) in ("(", "[", "{") else j + 1
        return _Head(name, kind, start, None, j - 1)

    def rust(self, i: int) -> _Head | None:
        x = self.s(i)
        if x == "fn" and self.word(i + 1):
            body = self.seek(i + 2, "; }")
            start = i
            while self.s(start - 1) in _MODIFIERS or self.t[start - 1].kind == "s" or (self.s(start - 1) == ")" and self.s(self.pair.get(start - 1, 0) - 1) == "pub"):
                start = self.pair.get(start - 1, start - 1)
            return _Head(i + 1, "function", start, body) if self.s(body) == "{" else None
        if x == "mod" and self.word(i + 1) and self.s(i + 2) == "{":
            return _Head(i + 1, "scope", i, i + 2, symbol=False)
        if x == "impl" and self.s(i - 1) in ("", "}", ";", "{", "]", "unsafe", "default"):
            j, name = self.angles(i + 1) if self.s(i + 1) == "<" else i + 1, -1
            while j < self.last and self.s(j) not in ("{", ";", "where"):
                if self.s(j) == "<":
                    j = max(j + 1, self.angles(j))
                    continue
                if self.word(j) and self.s(j) not in ("dyn", "mut", "const"):
                    name = -1 if self.s(j) == "for" else j
                j = self.after(j) if self.s(j) in ("(", "[") else j + 1
            body = self.seek(j, ";")
            if self.s(body) == "{":
                return _Head(name, "class", i, body, symbol=name >= 0)
        return None

    def java(self, i: int, scope: _Scope | None) -> _Head | None:
        if self.s(i) == "new":
            j = i + 1
            while self.word(j) or self.s(j) in (".", "<"):
                j = max(j + 1, self.angles(j)) if self.s(j) == "<" else j + 1
            if self.s(j) == "(" and self.s(self.after(j)) == "{":
                self.bodies[self.after(j)] = "class"
            return None
        if self.s(i + 1) != "(" or i + 1 not in self.pair or scope is None or scope.kind not in ("class", "enum") or self.s(i) in self.not_called:
            return None
        j = self.after(i + 1)
        if scope.kind == "enum" and self.s(i - 1) in ("{", ",") or self.s(i - 1) == "@":
            if self.s(j) == "{":
                self.bodies[j] = "class"
            self.quiet = max(self.quiet, i)
            return None
        while self.s(j) in ("[", "]"):
            j += 1
        if self.s(j) == "throws":
            j = self.seek(j, ";")
        if self.s(j) not in ("{", ";", "default") or self.s(i - 1) in ("=", ".", "(", ",", "->", "!", "?", ":", "&&", "||", "+", "-"):
            return None
        has_type = (self.word(i - 1) and self.s(i - 1) not in _NO_TYPE) or self.s(i - 1) in (">", "]")
        start = self.statement(i)
        if self.s(j) == "{":
            return _Head(i, "function", start, j, symbol=has_type)
        return _Head(i, "function", start, None, self.seek(j, ";")) if has_type else None

    def c(self, i: int, scope: _Scope | None) -> _Head | None:
        if self.s(i) == "namespace":
            body = self.seek(i + 1, "; =")
            return _Head(body - 1, "scope", i, body, symbol=False) if self.s(body) == "{" else None
        if self.s(i) == "extern" and self.t[i + 1].kind == "s" and self.s(i + 2) == "{":
            self.bodies[i + 2] = "scope"
            return None
        if self.s(i + 1) != "(" or i + 1 not in self.pair or self.s(i) in self.not_called or (scope is not None and scope.kind not in ("scope", "class")):
            return None
        within, first = [], i
        while self.s(first - 1) in ("::", "~"):
            first -= 1
            if self.s(first) == "::":
                first = self.angles_back(first - 1) if self.s(first - 1) == ">" else first
                if self.word(first - 1):
                    first -= 1
                    within.insert(0, self.s(first))
        before = self.s(first - 1)
        own = scope is not None and scope.name == self.s(i) or (within and within[-1] == self.s(i)) or self.s(i - 1) == "~"
        if not own and not (self.word(first - 1) and before not in _NO_TYPE - {"static"}) and before not in ("*", "&", "&&", ">"):
            return None
        body = self.c_body(self.after(i + 1))
        return _Head(i, "function", self.statement(first), body, within="::".join(within), text=("~" if self.s(i - 1) == "~" else "") + self.s(i)) if body else None

    def c_body(self, j: int) -> int | None:
        """The body's brace after a C or C++ function's parameters."""
        if self.language == "c" and self.word(j) and self.s(j + 1) != "(":  # old style: declarations of the parameters
            k = j
            while self.word(k) or self.s(k) in ("*", ",", ";", "["):
                k = self.after(k) if self.s(k) == "[" else k + 1
            return k if self.s(k) == "{" and self.s(k - 1) == ";" or k == j + 1 and self.s(k) == "{" else None
        while j < self.last:
            x = self.s(j)
            if x == "{":
                return j
            if x == ":":  # members made before the body
                j += 1
                while j < self.last and self.s(j) not in (";", "}"):
                    while self.word(j) or self.s(j) in ("::", "<", "."):
                        self.named.add(j)
                        j = max(j + 1, self.angles(j)) if self.s(j) == "<" else j + 1
                    if self.s(j) not in ("(", "{"):
                        return None
                    j = self.after(j)
                    if self.s(j) != ",":
                        return j if self.s(j) == "{" else None
                    j += 1
                return None
            if not (self.word(j) or x in ("&", "&&", "->", "::", "*", "(", "[", "<", ">")):
                return None
            j = self.after(j) if x in ("(", "[") else j + 1
        return None

    # reading ---------------------------------------------------------------
    def head(self, i: int, scope: _Scope | None) -> _Head | None:
        if not self.word(i):
            return None
        language, x = self.language, self.s(i)
        if x in _TYPE_HEADS.get(language, ()) and (found := self.typed(i)):
            return found
        if language in ("javascript", "typescript"):
            return self.script(i)
        if language == "java":
            return self.java(i, scope)
        return self.go(i) if language == "go" else self.rust(i) if language == "rust" else self.c(i, scope)

    def called(self, i: int, scope: _Scope | None) -> bool:
        if not self.word(i) or i <= self.quiet or self.s(i) in self.not_called:
            return False
        before, after = self.s(i - 1), self.s(i + 1)
        if after != "(":
            if self.language == "typescript" and after == "<" and (j := self.angles(i + 1)) > i + 1 and self.s(j) == "(":
                return before not in ("new", "function")
            return after == "?." and self.s(i + 2) == "("
        if self.language == "go":
            return before not in ("]", "func") and not (scope is not None and scope.kind == "members")
        if self.language == "rust":
            return not (scope is not None and scope.kind in ("class", "enum") and scope.body < i) and before not in ("fn", "!")
        if self.language in ("javascript", "typescript"):
            member = scope is not None and scope.kind == "class" and scope.body < i and (before in ("{", ";", "}", ",", "*") or before in _MODIFIERS or self.first_of_line(i))
            return not member and before not in ("new", "function")
        j = i
        while self.s(j - 1) == "." and self.word(j - 2):
            j -= 2
        if self.s(j - 1) in ("new", "@"):
            return False
        return not self.word(i - 1) or before in _BEFORE_CALL

    def skipped(self, i: int) -> int:
        """Rust's attributes and macros are not code: past them; and calls don't stand in patterns."""
        if self.s(i) == "#" and self.s(i + 1 + (self.s(i + 1) == "!")) == "[":
            return self.after(i + 1 + (self.s(i + 1) == "!"))
        if self.word(i) and self.s(i + 1) == "!" and self.t[i + 1].at == self.t[i].end:
            j = i + 2 + self.word(i + 2)
            if self.s(j) in ("(", "[", "{") and j in self.pair:
                return self.after(j)
        if self.s(i) == "let":
            self.quiet = max(self.quiet, self.seek(i + 1, "= ; :") - 1)
        elif self.s(i) == "for" and self.s(i + 1) != "<":
            self.quiet = max(self.quiet, self.seek(i + 1, "in ;") - 1)
        elif self.word(i) and self.s(i + 1) == "(" and (end := self.pair.get(i + 1)):
            then = self.s(end + 1)
            if then in ("=>", "if") or (then == "|" and self.s(i - 1) in ("{", ",", "|", "}", "::")):
                self.quiet = max(self.quiet, end)
        return i

    def read(self) -> _Reader:
        stack: list[_Scope] = []
        held: list[list[_Scope]] = []  # what was open when conditions of the preprocessor began
        waiting: list[_Scope] = []  # heads whose body is still to come
        i = 0
        while i < self.last:
            t, scope = self.t[i], (waiting or stack or [None])[-1]
            if self.language == "rust" and (past := self.skipped(i)) > i:
                i = past
                continue
            if self.resync and t.kind == "w" and not waiting and self.first_of_line(i) and self.s(i + 1) != ":":
                deep = next((k for k, x in enumerate(stack) if x.column >= 0 and x.column >= self.column(i)), None)
                if deep is not None:
                    self.close(stack, deep, i - 1)
                    scope = stack[-1] if stack else None
            if t.kind == "d":
                if t.text.startswith("if"):
                    held.append(list(stack))
                elif t.text.startswith("el") and held:
                    stack[:] = held[-1]
                elif t.text == "endif" and held:
                    held.pop()
            elif t.text == "{" and t.kind == "p":
                if waiting and waiting[-1].body == i:
                    stack.append(waiting.pop())
                else:
                    stack.append(_Scope(i, self.bodies.get(i, "block")))
            elif t.text == "}" and t.kind == "p":
                if stack:
                    self.close(stack, len(stack) - 1, i)
                else:
                    self.errors += 1
            elif head := self.head(i, scope):
                self.define(head, stack, waiting)
            elif self.called(i, scope):
                owner = next((x.symbol for x in reversed([*stack, *waiting]) if x.symbol >= 0), -1)
                if owner >= 0 and i not in self.named:
                    self.calls.append((owner, t.text, self.line(t.at)))
            i += 1
        self.errors += len(stack)
        self.close(stack, 0, self.last - 1)
        return self

    def define(self, head: _Head, stack: list[_Scope], waiting: list[_Scope]) -> None:
        if head.name in self.named:
            return
        self.named.add(head.name)
        name = head.text or (self.s(head.name) if head.name >= 0 else "")
        above = [x.name for x in [*stack, *waiting] if x.name]
        symbol = -1
        if head.symbol:
            symbol = len(self.symbols)
            kind = "function" if head.kind == "function" else "class"
            path = "::".join([*above, *([head.within] if head.within else []), name])
            self.symbols.append([name, path, kind, self.line(self.t[head.start].at), 0, self.t[head.start].at])
        if head.body is None:
            self.end(symbol, head.end)
            self.quiet = max(self.quiet, head.end)
            return
        kind = self.bodies.get(head.body) or head.kind
        shown = name if head.symbol or head.kind in ("scope", "class") else ""
        waiting.append(_Scope(head.body, kind, shown, symbol, self.column(head.start) if head.symbol else -1))

    def end(self, symbol: int, token: int) -> None:
        if symbol < 0:
            return
        row, end = self.symbols[symbol], self.t[max(token, 0)].end
        row[4] = max(self.line(max(end - 1, 0)), row[3])
        signature = self.text[row[5] : max(end, row[5])].split("\n", 1)[0].strip() if row[2] == "function" else None
        row[5:] = [row[5], signature]

    def close(self, stack: list[_Scope], depth: int, token: int) -> None:
        for x in stack[depth:]:
            self.end(x.symbol, token)
        del stack[depth:]


def _braced(text: str, language: str) -> tuple[list, list]:
    found = _Reader(text, language).read()
    if found.errors:
        found = _Reader(text, language, resync=True).read()
    for k, row in enumerate(found.symbols):
        if len(row) < 7:  # a head whose body never came, or a branch that was left
            found.end(k, found.last - 1)
    return [(n, p, kind, a, b, g) for n, p, kind, a, b, _, g in found.symbols], found.calls


def _python(text: str) -> tuple[list, list]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _indented(text)
    symbols, calls = [], []
    lines = re.split("\r\n|\r|\n", text)

    def visit(node, scope: tuple, owner: int) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                for outside in child.decorator_list:
                    visit(ast.Expression(outside), scope, owner)
                child.decorator_list = []
                own, is_class = len(symbols), isinstance(child, ast.ClassDef)
                path = (*scope, child.name)
                head = lines[child.lineno - 1].encode()[child.col_offset : child.end_col_offset if child.end_lineno == child.lineno else None].decode("utf-8", "replace").strip()
                symbols.append((child.name, "::".join(path), "class" if is_class else "function", child.lineno, child.end_lineno, None if is_class else head))
                visit(child, path, own)
                continue
            if isinstance(child, ast.Call) and owner >= 0:
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    calls.append((owner, name, f.end_lineno))
            visit(child, scope, owner)

    try:
        visit(tree, (), -1)
    except RecursionError:
        return _indented(text)
    return symbols, calls


#: Words that begin a statement and stand nowhere else, so a line that begins with one ends what an open bracket left open.
_STATEMENTS = frozenset("def class return import while try except finally raise with assert del pass break continue global nonlocal elif".split())


#: Calls within the braces of a format string.
_IN_FORMAT = re.compile(r"([^\W\d]\w*)\((?=[^{]*\})")


def _indented(text: str) -> tuple[list, list]:
    """Python by tokens: a definition lasts until a line begins no deeper than it."""
    found = _Reader(text, "python")
    symbols, calls, open_, depth, end = [], [], [], 0, 0  # open_: (column, symbol)

    def leave(column: int) -> None:
        while open_ and open_[-1][0] >= column:
            symbols[open_.pop()[1]][4] = end

    for i, t in enumerate(found.t[:-1]):
        at = found.line(t.at)
        if found.first_of_line(i):
            if t.kind == "w" and (t.text in _STATEMENTS or (t.text == "async" and found.s(i + 1) == "def")):
                depth = 0
            if not depth and not found.text[: t.at].endswith(("\\\n", "\\\r\n")):
                leave(found.column(i))
        if t.kind == "p":
            depth = max(0, depth + (t.text in "([{") - (t.text in ")]}"))
        elif t.kind == "w" and t.text in ("def", "class") and found.word(i + 1) and (found.first_of_line(i) or found.s(i - 1) in ("async", ":", ";")):
            j = found.after(i + 2) if found.s(i + 2) == "[" else i + 2
            j = found.after(j) if found.s(j) == "(" and j in found.pair else j
            if found.s(j) == ":" or (t.text == "def" and found.s(j) == "->"):
                start = i - 1 if found.s(i - 1) == "async" else i
                name, is_class = found.s(i + 1), t.text == "class"
                path = "::".join([*(symbols[k][0] for _, k in open_), name])
                head = text[found.t[start].at :].split("\n", 1)[0].strip()
                symbols.append([name, path, "class" if is_class else "function", found.line(found.t[start].at), at, None if is_class else head])
                open_.append((found.column(start) if found.first_of_line(start) else 10**6, len(symbols) - 1))
        elif t.kind == "w" and found.s(i + 1) == "(" and t.text not in found.not_called and found.s(i - 1) not in ("def", "class") and open_:
            calls.append((open_[-1][1], t.text, at))
        elif t.kind == "s" and open_ and "f" in t.text[:2].lower():
            calls += [(open_[-1][1], m.group(1), found.line(t.at + m.start(1))) for m in _IN_FORMAT.finditer(t.text) if m.group(1) not in found.not_called]
        end = found.line(t.end - 1)
    leave(-1)
    return [tuple(x) for x in symbols], calls


def parse_text(text: str, language: str) -> tuple[list, list]:
    """(symbols, calls): (name, scope path, type, first line, last line, signature) and (index of the caller, name, line)."""
    return _python(text) if language == "python" else _braced(text, language) if language in NOT_CALLED else ([], [])


def _rows(path: str, text: str, language: str) -> list[tuple]:
    symbols, calls = parse_text(text, language)
    out = [(path, "symbol", i, n, s, t, a, b, g, None, None) for i, (n, s, t, a, b, g) in enumerate(symbols)]
    return out + [(path, "call", i, n, None, None, None, None, None, c, at) for i, (c, n, at) in enumerate(calls)]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    kinds = dict(f.split() for f in schema.split(", "))
    return pd.DataFrame(rows, columns=list(kinds)).astype({c: "Int32" for c, kind in kinds.items() if kind == "int"})


def parse(files: DataFrame) -> DataFrame:
    """Rows of definitions and calls of ``files(file_path, extension, content)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, ext, content in pdf[["file_path", "extension", "content"]].itertuples(index=False):
                yield _frame(_rows(path, bytes(content).decode("utf-8", "replace"), LANGUAGES.get(ext, "")), ROWS)

    return files.select("file_path", "extension", "content").mapInPandas(run, ROWS)


def read_changed(files: DataFrame, root: str) -> DataFrame:
    """Reads ``files(file_path, extension, known_hash)`` below ``root`` once: a row each, and their definitions and calls if the hash isn't the known one.

    kind is ``file``, or ``same`` for one whose content is as known; a file that
    is gone meanwhile has no row. Contents don't leave the task that reads them.
    """
    load = loader(root)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for pdf in batches:
            for path, ext, known in pdf[["file_path", "extension", "known_hash"]].itertuples(index=False):
                content = load(path)
                if content is None:
                    continue
                found = hashlib.sha256(content).hexdigest()
                text = content.decode("utf-8", "replace")
                lines = text.count("\n") + (0 if not text or text.endswith("\n") else 1) if ext in LANGUAGES else 0
                out.append((path, "same" if found == known else "file", *[None] * 9, found, lines))
                if found != known:
                    out += [(*r, None, None) for r in _rows(path, text, LANGUAGES.get(ext, ""))]
                if len(out) > 5000:
                    yield _frame(out, READ)
                    out = []
        if out:
            yield _frame(out, READ)

    return files.select("file_path", "extension", "known_hash").mapInPandas(run, READ)


def symbol_id(path, ordinal):
    """Ids that a file's definitions keep as long as their order does."""
    return F.xxhash64(path, ordinal)
