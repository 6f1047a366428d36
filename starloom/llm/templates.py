"""Compiler of a small, closed template language for conversations.

    text  {{ expression }}  {# remark #}  {% set name = e %}
    {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}  {% for m in messages %} .. {% endfor %}
    {% generation %} .. {% endgeneration %}

A hyphen within a tag's braces takes the white space beside it away. Expressions have literals (texts,
whole numbers, true, false, none), names, a.b, a['b'], a[0], == != < <= > >= in, not in, and, or, not,
+ - ~ (joins as text), a if c else b, `a is defined`, and filters a|f(b).

Source becomes a syntax tree; what is constant in it is evaluated while compiling (operators, filters,
branches whose condition is known, outputs that are text then, neighbouring texts); the rest becomes Python closures.

Nothing outside is in reach: names come from the conversation alone, a dot is the key of a mapping
and no Python attribute, calls are filters of a fixed table, nothing repeats a text, and there is one
loop, over the messages, which is not nested. So a render takes one pass and time in proportion to the
conversation; messages come from an iterator, and what has been rendered can be handed on after each.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

MISSING = type("Missing", (), {"__bool__": lambda self: False, "__repr__": lambda self: "missing", "__reduce__": lambda self: "MISSING"})()
Closure = Callable[[dict], Any]


class TemplateError(ValueError):
    """The source does not follow the language, or a render meets a value that an operator does not take."""


# -- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    owner: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or filter of the tables below with its operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Choice:
    """kind: `and`, `or`, or `if` (condition, then, else); operands are evaluated as needed."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    condition: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- operators and filters


def text_of(value: Any) -> str:
    if isinstance(value, str):
        return value
    if value is None or value is MISSING:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    raise TemplateError("only texts and numbers have a text")


def _plus(a, b):
    if isinstance(a, str) != isinstance(b, str) or not isinstance(a, (str, int)) or not isinstance(b, (str, int)):
        raise TemplateError("+ takes two texts or two numbers; ~ joins whatever there is")
    return a + b


def _ordered(compare):
    def apply(a, b):
        if isinstance(a, str) != isinstance(b, str) or not isinstance(a, (str, int)) or not isinstance(b, (str, int)):
            raise TemplateError("only texts with texts and numbers with numbers have an order")
        return compare(a, b)

    return apply


def _minus(a, b):
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TemplateError("- takes numbers")
    return a - b


def _within(a, b):
    if not isinstance(b, (str, dict, list, tuple)) or isinstance(b, str) and not isinstance(a, str):
        raise TemplateError("in takes a text and a text that may hold it, or a mapping")
    return a in b


OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt), ">=": _ordered(operator.ge),
    "in": _within, "not in": lambda a, b: not _within(a, b), "not": lambda a: not a, "+": _plus, "-": _minus, "~": lambda a, b: text_of(a) + text_of(b), "is defined": lambda a: a is not MISSING,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda s: text_of(s).strip(), "upper": lambda s: text_of(s).upper(), "lower": lambda s: text_of(s).lower(), "length": lambda s: len(text_of(s)),
    "default": lambda s, other: other if s is MISSING or s is None else s,
}


# -- parser

_TAGS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[<>+\-~|.,()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "is", "if", "else", "elif", "for", "endfor", "endif", "set", "generation", "endgeneration"} | set(_WORDS)


class Tokens:
    def __init__(self, source: str):
        self.items, at, end = [], 0, len(source.rstrip())
        while at < end:
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    @property
    def next(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *wanted: str) -> bool:
        """Goes on if the next tokens are these."""
        if [v for k, v in self.items[self.at : self.at + len(wanted)] if k != "text"] == list(wanted):
            self.at += len(wanted)
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing before {self.next[1]!r}")

    def name(self) -> str:
        kind, value = self.next
        if kind != "name" or value in _RESERVED:
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def done(self) -> None:
        if self.next[0] != "end":
            raise TemplateError(f"{self.next[1]!r} is too much")


class Parser:
    def __init__(self, source: str, filters: Iterable[str]):
        self.filters, self.parts, self.at = set(filters), [], 0
        at, strip = 0, False
        for m in _TAGS.finditer(source):
            before, after = (bool(m[1] or m[4] or m[7]), bool(m[3] or m[6] or m[8]))
            self._text(source[at : m.start()], strip, before)
            kind = "output" if m[2] is not None else "tag" if m[5] is not None else None
            if kind:
                self.parts.append((kind, m[2] if kind == "output" else m[5]))
            at, strip = m.end(), after
        self._text(source[at:], strip, False)

    def _text(self, value: str, left: bool, right: bool) -> None:
        value = value.lstrip() if left else value
        value = value.rstrip() if right else value
        if any(mark in value for mark in ("{{", "{%", "{#", "}}", "%}", "#}")):
            raise TemplateError(f"a tag is not closed or not opened in {value[:40]!r}")
        if value:
            self.parts.append(("text", value))

    def whole(self) -> tuple:
        body, _ = self.block((), loops=True)
        return body

    def block(self, ends: tuple[str, ...], loops: bool = False) -> tuple[tuple, Tokens | None]:
        """Statements up to a tag of the given kinds; its tokens, behind the first."""
        out = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out.append(Text(value))
                continue
            tokens = Tokens(value)
            if kind == "output":
                out.append(Output(self.expression(tokens)))
                tokens.done()
                continue
            word = tokens.next[1]
            tokens.at += 1
            if word in ends:
                return tuple(out), tokens
            out.append(self.statement(word, tokens, loops))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), None

    def statement(self, word: str, tokens: Tokens, loops: bool):
        if word == "set":
            name = tokens.name()
            tokens.need("=")
            out = Set(name, self.expression(tokens))
            tokens.done()
            return out
        if word == "if":
            return self.branch(tokens)
        if word == "for":
            name = tokens.name()
            tokens.need("in")
            if not loops or tokens.name() != "messages":
                raise TemplateError("the one loop is over messages and stands within no other tag")
            tokens.done()
            body, rest = self.block(("endfor",))
            rest.done()
            return Loop(name, body)
        if word == "generation":
            tokens.done()
            body, rest = self.block(("endgeneration",))
            rest.done()
            return Generation(body)
        raise TemplateError(f"{word!r} is no tag, or has nothing to end")

    def branch(self, tokens: Tokens) -> If:
        condition = self.expression(tokens)
        tokens.done()
        self_at = self.at
        then, rest = self.block(("elif", "else", "endif"))
        ended = self.parts[self.at - 1][1].split()[0] if self.at > self_at else ""
        if ended == "elif":
            return If(condition, then, (self.branch(rest),))
        rest.done()
        if ended == "endif":
            return If(condition, then, ())
        other, rest = self.block(("endif",))
        rest.done()
        return If(condition, then, other)

    def expression(self, t: Tokens):
        value = self.either(t)
        if t.take("if"):
            condition = self.either(t)
            t.need("else")
            return Choice("if", (condition, value, self.expression(t)))
        return value

    def either(self, t: Tokens):
        value = self.both(t)
        while t.take("or"):
            value = Choice("or", (value, self.both(t)))
        return value

    def both(self, t: Tokens):
        value = self.negated(t)
        while t.take("and"):
            value = Choice("and", (value, self.negated(t)))
        return value

    def negated(self, t: Tokens):
        return Apply("not", (self.negated(t),)) if t.take("not") else self.compared(t)

    def compared(self, t: Tokens):
        value = self.sum(t)
        while True:
            if t.take("not", "in"):
                value = Apply("not in", (value, self.sum(t)))
            elif t.take("is", "not", "defined"):
                value = Apply("not", (Apply("is defined", (value,)),))
            elif t.take("is", "defined"):
                value = Apply("is defined", (value,))
            elif (found := t.next)[0] in ("mark", "name") and found[1] in ("==", "!=", "<", "<=", ">", ">=", "in"):
                t.at += 1
                value = Apply(found[1], (value, self.sum(t)))
            else:
                return value

    def sum(self, t: Tokens):
        value = self.filtered(t)
        while t.next[0] == "mark" and t.next[1] in "+-~":
            sign = t.next[1]
            t.at += 1
            value = Apply(sign, (value, self.filtered(t)))
        return value

    def filtered(self, t: Tokens):
        value = self.item(t)
        while t.take("|"):
            name, args = t.name(), [value]
            if name not in self.filters:
                raise TemplateError(f"there is no filter {name!r}")
            if t.take("("):
                while not t.take(")"):
                    args.append(self.expression(t))
                    if not t.take(",") and t.next[1] != ")":
                        raise TemplateError("a parenthesis is not closed")
            value = Apply(f"|{name}", tuple(args))
        return value

    def item(self, t: Tokens):
        value = self.atom(t)
        while True:
            if t.take("."):
                value = Item(value, Const(t.name()))
            elif t.take("["):
                value = Item(value, self.expression(t))
                t.need("]")
            else:
                return value

    def atom(self, t: Tokens):
        kind, value = t.next
        if kind == "text":
            t.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        if kind == "number":
            t.at += 1
            return Const(int(value))
        if kind == "name" and value in _WORDS:
            t.at += 1
            return Const(_WORDS[value])
        if t.take("("):
            inner = self.expression(t)
            t.need(")")
            return inner
        if t.take("-"):
            return Apply("-", (Const(0), self.item(t)))
        name = t.name()
        if name == "messages":
            raise TemplateError("messages can only be looped over")
        return Name(name)


# -- folding


def folded(node, table: dict[str, Callable]):
    """The expression with all that is constant evaluated."""
    if isinstance(node, Item):
        node = Item(folded(node.owner, table), folded(node.key, table))
        return Const(item_of(node.owner.value, node.key.value)) if isinstance(node.owner, Const) and isinstance(node.key, Const) else node
    if isinstance(node, Apply):
        args = tuple(folded(a, table) for a in node.args)
        return Const(applied(table, node.name, [a.value for a in args])) if all(isinstance(a, Const) for a in args) else Apply(node.name, args)
    if isinstance(node, Choice):
        first, *rest = (folded(a, table) for a in node.args)
        if not isinstance(first, Const):
            return Choice(node.kind, (first, *rest))
        if node.kind == "if":
            return rest[0] if first.value else rest[1]
        return rest[0] if bool(first.value) == (node.kind == "and") else first
    return node


def condensed(body: tuple, table: dict[str, Callable]) -> tuple:
    """Statements with their expressions folded, dead branches left out and neighbouring texts joined."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + node.value)
        elif not isinstance(node, Text) or node.value:
            out.append(node)

    for node in body:
        if isinstance(node, Output):
            value = folded(node.value, table)
            add(Text(text_of(value.value)) if isinstance(value, Const) else Output(value))
        elif isinstance(node, If):
            condition = folded(node.condition, table)
            then, other = condensed(node.then, table), condensed(node.other, table)
            if isinstance(condition, Const):
                for x in then if condition.value else other:
                    add(x)
            elif then or other:
                add(If(condition, then, other))
        elif isinstance(node, Set):
            add(Set(node.name, folded(node.value, table)))
        elif isinstance(node, Loop):
            add(Loop(node.name, condensed(node.body, table)))
        elif isinstance(node, Generation):
            add(Generation(condensed(node.body, table)))
        else:
            add(node)
    return tuple(out)


# -- closures


def item_of(owner: Any, key: Any) -> Any:
    if isinstance(owner, dict) and isinstance(key, str):
        return owner.get(key, MISSING)
    if isinstance(owner, str) and isinstance(key, int) and not isinstance(key, bool):
        return owner[key] if -len(owner) <= key < len(owner) else MISSING
    if owner is MISSING or owner is None:
        return MISSING
    raise TemplateError(f"a {type(owner).__name__} has no part {key!r}")


def applied(table: dict[str, Callable], name: str, args: list) -> Any:
    try:
        return table[name](*args)
    except TypeError as e:
        raise TemplateError(f"{name.lstrip('|')} does not take this: {e}") from None


def closure(node, table: dict[str, Callable]) -> Closure:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name, MISSING)
    if isinstance(node, Item):
        owner, key = closure(node.owner, table), closure(node.key, table)
        return lambda env: item_of(owner(env), key(env))
    args = [closure(a, table) for a in node.args]
    if isinstance(node, Apply):
        name = node.name
        return lambda env: applied(table, name, [a(env) for a in args])
    if node.kind == "if":
        condition, then, other = args
        return lambda env: then(env) if condition(env) else other(env)
    one, two = args
    return (lambda env: one(env) and two(env)) if node.kind == "and" else lambda env: one(env) or two(env)


@dataclass
class Written:
    """What has been rendered since it was last taken: pieces of text, and the ranges (code points) within generation tags."""

    pieces: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    open: int = 0

    def add(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        out = "".join(self.pieces), self.spans
        self.pieces, self.size, self.spans = [], 0, []
        return out


def runner(body: tuple, table: dict[str, Callable]) -> Callable[[dict, Written], None]:
    """One closure for a list of statements without a loop."""
    steps = [step(node, table) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Written) -> None:
        for s in steps:
            s(env, out)

    return run


def step(node, table: dict[str, Callable]) -> Callable[[dict, Written], None]:
    if isinstance(node, Text):
        value = node.value
        return lambda env, out: out.add(value)
    if isinstance(node, Output):
        shown = closure(node.value, table)
        return lambda env, out: out.add(text_of(shown(env)))
    if isinstance(node, Set):
        name, given = node.name, closure(node.value, table)
        return lambda env, out: env.__setitem__(name, given(env))
    if isinstance(node, If):
        condition, then, other = closure(node.condition, table), runner(node.then, table), runner(node.other, table)
        return lambda env, out: then(env, out) if condition(env) else other(env, out)
    inner = runner(node.body, table)

    def generation(env: dict, out: Written) -> None:
        if out.open:
            raise TemplateError("generation tags cannot be nested")
        start, out.open = out.size, 1
        inner(env, out)
        out.open = 0
        out.spans.append((start, out.size))

    return generation


def nested_generation(body: tuple, within: bool = False) -> bool:
    for node in body:
        if isinstance(node, Generation) and (within or nested_generation(node.body, True)):
            return True
        if isinstance(node, If) and (nested_generation(node.then, within) or nested_generation(node.other, within)):
            return True
        if isinstance(node, Loop) and nested_generation(node.body, within):
            return True
    return False


class Template:
    """A compiled template. filters: further ones by name; they must be pure functions."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        named = FILTERS | (filters or {})
        table = OPERATORS | {f"|{k}": f for k, f in named.items()}
        self.tree = condensed(Parser(source, named).whole(), table)
        if sum(isinstance(x, Loop) for x in self.tree) > 1:
            raise TemplateError("messages can be looped over once")
        if nested_generation(self.tree):
            raise TemplateError("generation tags cannot be nested")
        at = next((i for i, x in enumerate(self.tree) if isinstance(x, Loop)), len(self.tree))
        self.loop = self.tree[at] if at < len(self.tree) else None
        self.head, self.tail = runner(self.tree[:at], table), runner(self.tree[at + 1 :], table)
        self.body = runner(self.loop.body, table) if self.loop else None

    def parts(self, messages: Iterable[dict], limit: int, **given: Any) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """The rendered conversation and its generation ranges, in one part or, beyond `limit` code points, several; a part ends with a message. Ranges count from the start of their part."""
        env, out = dict(given), Written()
        self.head(env, out)
        if self.loop:
            coming, before, k = iter(messages), MISSING, 0
            now = next(coming, MISSING)
            while now is not MISSING:
                after = next(coming, MISSING)
                env[self.loop.name] = now
                env["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": after is MISSING, "previtem": before, "nextitem": after}
                self.body(env, out)
                if out.size >= limit and after is not MISSING:
                    yield out.take()
                before, now, k = now, after, k + 1
            env.pop("loop", None)
            env.pop(self.loop.name, None)
        self.tail(env, out)
        yield out.take()

    def render(self, messages: Iterable[dict], **given: Any) -> tuple[str, list[tuple[int, int]]]:
        """All in one."""
        text, spans = "", []
        for part, found in self.parts(messages, 1 << 62, **given):
            spans += [(a + len(text), b + len(text)) for a, b in found]
            text += part
        return text, spans
