"""A small sandboxed template language, compiled to Python closures.

Text is copied; ``{{ expression }}`` writes a value; ``{% ... %}`` holds ``for x in
y``/``endfor``, ``if``/``elif``/``else``/``endif``, ``set x = y`` and
``generation``/``endgeneration``, which marks what an assistant generates; ``{# #}``
is a comment. ``-`` inside a mark strips white space on that side. Expressions
have literals, names, ``a.b`` and ``a[b]`` (items of mappings and sequences only:
no Python attributes, no calls), ``or and not in == != < <= > >= + - * % ~``, and
filters ``x | name(arguments)``.

``compile_template`` parses to a syntax tree of tuples, folds constants, joins
neighbouring text, and turns each node into a closure that yields ``(text,
generated)`` pieces. Sequences are read once, one item ahead (for ``loop.last``),
so a conversation of any length streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

# Inside a mark a string literal may hold any signs, the mark's own end as well.
INSIDE = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?"""
MARKS = re.compile(rf"\{{\{{-?(?P<out>{INSIDE})-?\}}\}}|\{{%-?(?P<tag>{INSIDE})-?%\}}|\{{#.*?#\}}", re.S)
LEXEMES = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>.|()\[\],=]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The template can't be compiled, or reads what it may not."""


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _protect(value: Any, signs: str) -> str:
    """A backslash before every backslash and every one of ``signs``."""
    return re.sub(f"[{re.escape(signs)}\\\\]", lambda m: "\\" + m[0], _text(value))


def _number(run: Callable) -> Callable:
    """An operation on numbers only: of texts and lists it could grow without bound."""
    def checked(a: Any, b: Any) -> Any:
        if not isinstance(a, (int, float)) or not isinstance(b, (int, float)):
            raise TemplateError(f"no numbers: {type(a).__name__} and {type(b).__name__}")
        return run(a, b)

    return checked


def guarded(run: Callable) -> Callable:
    """Errors of an operation as errors of the template."""
    def checked(*args: Any) -> Any:
        try:
            return run(*args)
        except (TypeError, ValueError, ArithmeticError) as e:
            raise e if isinstance(e, TemplateError) else TemplateError(str(e)) from e

    return checked


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v),
    "default": lambda v, other: other if v is None else v,
    "replace": lambda v, a, b: _text(v).replace(a, b),
    "protect": _protect,
}
# Arguments of each filter besides the value.
ARGUMENTS = {"default": 1, "replace": 2, "protect": 1}
BINARY: dict[str, tuple[int, Callable]] = {
    "or": (1, None), "and": (2, None), "in": (4, lambda a, b: a in b), "==": (4, lambda a, b: a == b), "!=": (4, lambda a, b: a != b),
    "<": (4, lambda a, b: a < b), "<=": (4, lambda a, b: a <= b), ">": (4, lambda a, b: a > b), ">=": (4, lambda a, b: a >= b),
    "~": (5, lambda a, b: _text(a) + _text(b)), "+": (6, lambda a, b: a + b), "-": (6, lambda a, b: a - b), "*": (7, _number(lambda a, b: a * b)), "%": (7, _number(lambda a, b: a % b)),
}


def get_item(value: Any, key: Any) -> Any:
    """An item of a mapping or sequence; None where there is none."""
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return value[key] if -len(value) <= key < len(value) else None
    if value is None:
        return None
    raise TemplateError(f"{type(value).__name__} has no items to read")


class Expression:
    """Precedence-climbing parser of one expression into a tree."""

    def __init__(self, source: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = LEXEMES.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:].strip()!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.toks[self.at][1] if self.at < len(self.toks) and self.toks[self.at][0] != "str" else None

    def take(self, *wanted: str) -> tuple[str, str]:
        if self.at >= len(self.toks) or (wanted and self.peek() not in wanted):
            raise TemplateError(f"expected {' or '.join(wanted) or 'more'}")
        self.at += 1
        return self.toks[self.at - 1]

    def name(self) -> str:
        what, value = self.take()
        if what != "name":
            raise TemplateError(f"{value!r} is no name")
        return value

    def done(self) -> None:
        if self.at < len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.at][1]!r}")

    def tree(self, level: int = 0) -> tuple:
        if self.peek() == "not" and level <= 3:
            self.take()
            left = ("not", self.tree(3))
        elif self.peek() == "-":
            self.take()
            left = ("binary", "-", ("const", 0), self.tree(8))
        else:
            left = self.postfix()
        while True:
            op, negate = self.peek(), False
            if op == "not" and level <= 4 and self.at + 1 < len(self.toks) and self.toks[self.at + 1] == ("name", "in"):
                self.take()
                op, negate = "in", True
            if op not in BINARY or BINARY[op][0] < max(level, 1):
                return left
            self.take()
            left = ("binary", op, left, self.tree(BINARY[op][0] + 1))
            left = ("not", left) if negate else left

    def postfix(self) -> tuple:
        what, value = self.take()
        if what == "num":
            node = ("const", float(value) if "." in value else int(value))
        elif what == "str":
            node = ("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif value == "(":
            node = self.tree()
            self.take(")")
        elif what == "name" and value.lower() in ("true", "false", "none"):
            node = ("const", {"true": True, "false": False, "none": None}[value.lower()])
        elif what == "name" and value not in BINARY and value != "not":
            node = ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek() in (".", "[", "|"):
            _, sign = self.take()
            if sign == ".":
                node = ("item", node, ("const", self.name()))
            elif sign == "[":
                node = ("item", node, self.tree())
                self.take("]")
            else:
                name, args = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.peek() == "(":
                    self.take()
                    while self.peek() != ")":
                        args.append(self.tree())
                        if self.take(",", ")")[1] == ")":
                            break
                    else:
                        self.take(")")
                if len(args) != ARGUMENTS.get(name, 0):
                    raise TemplateError(f"{name} takes {ARGUMENTS.get(name, 0)} arguments")
                node = ("filter", name, node, tuple(args))
        return node


def _expression(source: str) -> tuple:
    e = Expression(source)
    node = e.tree()
    e.done()
    return node


def parse(source: str) -> list[tuple]:
    """Syntax tree: a list of statements."""
    parts: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in MARKS.finditer(source):
        text = source[at:m.start()]
        text = text.lstrip() if strip else text
        parts.append(("text", text.rstrip() if source[m.start() + 2:m.start() + 3] == "-" else text))
        strip, at = source[m.end() - 3:m.end() - 2] == "-", m.end()
        if m["out"] is not None:
            parts.append(("out", m["out"]))
        elif m["tag"] is not None:
            parts.append(("tag", m["tag"].strip()))
    parts.append(("text", source[at:].lstrip() if strip else source[at:]))
    if any(what == "text" and re.search(r"\{[{%]", text) for what, text in parts):
        raise TemplateError("a mark has no end")
    pos = 0

    def until(*ends: str) -> tuple[list[tuple], str]:
        nonlocal pos
        body: list[tuple] = []
        while pos < len(parts):
            what, value = parts[pos]
            pos += 1
            if what == "text":
                if value:
                    body.append(("text", value))
            elif what == "out":
                body.append(("out", _expression(value)))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return body, value
                if word == "for":
                    e = Expression(rest)
                    target = e.name()
                    e.take("in")
                    source_tree = e.tree()
                    e.done()
                    body.append(("for", target, source_tree, until("endfor")[0]))
                elif word == "if":
                    arms, other, test = [], [], _expression(rest)
                    while True:
                        own, end = until("elif", "else", "endif")
                        arms.append((test, own))
                        if end.startswith("elif"):
                            test = _expression(end.partition(" ")[2])
                            continue
                        if end.startswith("else"):
                            other = until("endif")[0]
                        break
                    body.append(("if", arms, other))
                elif word == "set":
                    e = Expression(rest)
                    target = e.name()
                    e.take("=")
                    value_tree = e.tree()
                    e.done()
                    body.append(("set", target, value_tree))
                elif word == "generation":
                    body.append(("generation", until("endgeneration")[0]))
                else:
                    raise TemplateError(f"no statement {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, ""

    return until()[0]


def fold(node: tuple) -> tuple:
    """Expression with all that is constant worked out."""
    if node[0] in ("const", "name"):
        return node
    if node[0] == "not":
        inner = fold(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if node[0] == "item":
        new = ("item", fold(node[1]), fold(node[2]))
        parts = new[1:]
    elif node[0] == "binary":
        new = ("binary", node[1], fold(node[2]), fold(node[3]))
        parts = new[2:]
        if node[1] in ("and", "or") and parts[0][0] == "const":
            return parts[1] if bool(parts[0][1]) == (node[1] == "and") else parts[0]
    else:
        new = ("filter", node[1], fold(node[2]), tuple(map(fold, node[3])))
        parts = (new[2], *new[3])
    return ("const", value(new)({})) if all(p[0] == "const" for p in parts) else new


def fold_body(body: list[tuple]) -> list[tuple]:
    """Statements with constant output as text, constant branches chosen, and
    neighbouring text joined."""
    out: list[tuple] = []

    def add(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        if node[0] == "out":
            e = fold(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2]), fold_body(node[3])))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2])))
        elif node[0] == "generation":
            add(("generation", fold_body(node[1])))
        elif node[0] == "if":
            arms, other = [], fold_body(node[2])
            for test, own in node[1]:
                test = fold(test)
                if test[0] == "const" and test[1]:
                    other = fold_body(own)
                    break
                if test[0] != "const":
                    arms.append((test, fold_body(own)))
            if arms:
                add(("if", arms, other))
            else:
                for n in other:
                    add(n)
        else:
            add(node)
    return out


def value(node: tuple) -> Callable[[dict], Any]:
    """Closure that works out an expression from the names in scope."""
    if node[0] == "const":
        return lambda scope, v=node[1]: v
    if node[0] == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if node[0] == "not":
        inner = value(node[1])
        return lambda scope: not inner(scope)
    if node[0] == "item":
        of, key = value(node[1]), value(node[2])
        return lambda scope: get_item(of(scope), key(scope))
    if node[0] == "filter":
        run, of, args = guarded(FILTERS[node[1]]), value(node[2]), [value(a) for a in node[3]]
        return lambda scope: run(of(scope), *(a(scope) for a in args))
    left, right = value(node[2]), value(node[3])
    if node[1] == "and":
        return lambda scope: left(scope) and right(scope)
    if node[1] == "or":
        return lambda scope: left(scope) or right(scope)
    run = guarded(BINARY[node[1]][1])
    return lambda scope: run(left(scope), right(scope))


Piece = tuple[str, bool]


def statements(body: list[tuple], generated: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """Closure that yields the pieces of a list of statements."""
    steps = [statement(n, generated) for n in body]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def statement(node: tuple, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    if node[0] == "text":
        piece = (node[1], generated)
        return lambda scope: iter((piece,))
    if node[0] == "out":
        of = value(node[1])
        return lambda scope: iter(((_text(of(scope)), generated),))
    if node[0] == "generation":
        return statements(node[1], True)
    if node[0] == "set":
        of = value(node[2])

        def put(scope: dict, name=node[1]) -> Iterator[Piece]:
            scope[name] = of(scope)
            return iter(())

        return put
    if node[0] == "if":
        arms, other = [(value(t), statements(b, generated)) for t, b in node[1]], statements(node[2], generated)
        return lambda scope: next((b for t, b in arms if t(scope)), other)(scope)
    of, inner, target = value(node[2]), statements(node[3], generated), node[1]

    def loop(scope: dict) -> Iterator[Piece]:
        items, i, end = guarded(iter)(of(scope) or ()), 0, object()
        now = next(items, end)
        while now is not end:
            after = next(items, end)
            yield from inner({**scope, target: now, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is end}})
            now, i = after, i + 1

    return loop


class Template:
    """A compiled template; ``pieces`` streams, ``render`` joins."""

    def __init__(self, source: str):
        self.tree = fold_body(parse(source))
        self.run = statements(self.tree)

    def pieces(self, **names: Any) -> Iterator[Piece]:
        return self.run(dict(names))

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and the ranges of it that are generated (neighbours joined)."""
        out, spans, at = [], [], 0
        for text, generated in self.pieces(**names):
            if generated and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans


def compile_template(source: str) -> Template:
    return Template(source)


def as_messages(rows: Iterable[tuple[str | None, str | None]]) -> Iterator[dict[str, str]]:
    return ({"role": r or "", "text": t or ""} for r, t in rows)
