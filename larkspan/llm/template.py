"""A compiler for a small, sandboxed template language.

    {{ m.text | escape }}   {% if m.role == 'user' %} {% elif ... %} {% else %} {% endif %}
    {% for m in messages %} {% endfor %}   {% generation %} {% endgeneration %}   {# comment #}

Expressions: strings, integers, true, false, names, message fields, + (joining), ==, !=, in, not, and, or, parentheses and
the filters escape, trim, upper, lower and length. There are no calls, no attributes but the fields of a message, and no
loops but over the messages given, so a template ends and reaches nothing else. Source text becomes a syntax tree, the
tree is folded where it is constant, and what is left becomes closures that append to a list and note where generation
begins and ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

FIELDS = frozenset({"role", "text"})
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_LEXEME = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|[|.+()]))", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


class Escaper:
    """Makes control strings inert and takes that back: a backslash goes in after a control string's first character, and
    backslashes are doubled, so that no control string is left and every text comes back."""

    def __init__(self, controls: tuple[str, ...]):
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise TemplateError("control strings have two characters or more and no backslash")
        self.controls = controls
        found = "|".join(map(re.escape, controls))
        self._cut = re.compile(rf"(?=(?:{found}))(.)" if controls else r"(?!)", re.DOTALL)
        self._back = re.compile(r"\\(.)", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._cut.sub(r"\1\\", text.replace("\\", "\\\\"))

    def unescape(self, text: str) -> str:
        return self._back.sub(r"\1", text)


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Apply:
    """An operation on expressions: a filter's name, '+', '==', '!=', 'in', 'not', 'and' or 'or'."""

    what: str
    of: tuple


@dataclass(frozen=True)
class Output:
    of: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class Parser:
    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        at = 0
        for tag in _TAG.finditer(source):
            if tag.start() > at:
                self.parts.append(("text", source[at : tag.start()]))
            if tag[1] is not None:
                self.parts.append(("output", tag[1]))
            elif tag[2] is not None:
                self.parts.append(("tag", tag[2].strip()))
            at = tag.end()
        if at < len(source):
            self.parts.append(("text", source[at:]))
        self.at = 0

    def parse(self) -> tuple:
        tree, stop = self.body(())
        assert not stop
        return tree

    def body(self, ends: tuple[str, ...]) -> tuple[tuple, str]:
        """Nodes up to a tag that starts with one of ends, and that tag."""
        nodes: list = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Output(Const(value)))
                continue
            if kind == "output":
                nodes.append(Output(Expression(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return tuple(nodes), value
            if word == "if":
                nodes.append(self.condition(rest))
            elif word == "for":
                found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)", rest.strip())
                if not found:
                    raise TemplateError(f"not a loop: {value}")
                inner, _ = self.body(("endfor",))
                nodes.append(For(found[1], found[2], inner))
            elif word == "generation" and not rest.strip():
                inner, _ = self.body(("endgeneration",))
                nodes.append(Generation(inner))
            else:
                raise TemplateError(f"unknown tag: {value}")
        if ends:
            raise TemplateError(f"the template ends before {ends[-1]}")
        return tuple(nodes), ""

    def condition(self, test: str) -> If:
        then, stop = self.body(("elif", "else", "endif"))
        word, _, rest = stop.partition(" ")
        other: tuple = ()
        if word == "elif":
            other = (self.condition(rest),)
        elif word == "else":
            other, _ = self.body(("endif",))
        return If(Expression(test).whole(), then, other)


class Expression:
    def __init__(self, source: str):
        self.lexemes: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            found = _LEXEME.match(source, at)
            if not found or found.end() == at:
                raise TemplateError(f"not an expression: {source}")
            self.lexemes.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at, self.source = 0, source

    def whole(self):
        tree = self.either()
        if self.at < len(self.lexemes):
            raise TemplateError(f"not an expression: {self.source}")
        return tree

    def take(self, *values: str) -> str | None:
        if self.at < len(self.lexemes) and self.lexemes[self.at][0] != "string" and self.lexemes[self.at][1] in values:
            self.at += 1
            return self.lexemes[self.at - 1][1]
        return None

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        if what := self.take("==", "!=", "in"):
            return Apply(what, (left, self.joined()))
        return left

    def joined(self):
        left = self.filtered()
        while self.take("+"):
            left = Apply("+", (left, self.filtered()))
        return left

    def filtered(self):
        tree = self.single()
        while self.take("|"):
            kind, name = self.lexemes[self.at] if self.at < len(self.lexemes) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter: {name}")
            self.at += 1
            tree = Apply(name, (tree,))
        return tree

    def single(self):
        if self.at >= len(self.lexemes):
            raise TemplateError(f"not an expression: {self.source}")
        kind, value = self.lexemes[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Const(int(value))
        if value == "(":
            tree = self.either()
            if not self.take(")"):
                raise TemplateError(f"no closing parenthesis: {self.source}")
            return tree
        if kind != "name":
            raise TemplateError(f"not an expression: {self.source}")
        if value in ("true", "false"):
            return Const(value == "true")
        tree: object = Name(value)
        while self.take("."):
            kind, value = self.lexemes[self.at] if self.at < len(self.lexemes) else ("", "")
            if kind != "name" or value not in FIELDS:
                raise TemplateError(f"no such field: {value}")
            self.at += 1
            tree = Field(tree, value)
        return tree


FILTERS: dict[str, Callable] = {"escape": None, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}
_OPERATIONS: dict[str, Callable] = {"+": lambda a, b: _shown(a) + _shown(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def _shown(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


class Compiler:
    """Folds a tree and turns it into closures. Scopes are dictionaries; out is a list of strings with their length so far
    and the spans of generation."""

    def __init__(self, escaper: Escaper):
        self.functions = FILTERS | {"escape": escaper.escape}

    def operation(self, what: str) -> Callable:
        if what in self.functions:
            own = self.functions[what]
            return lambda a: own(a if what == "length" and not isinstance(a, int) else _shown(a))
        return _OPERATIONS[what]

    def fold(self, node):
        if isinstance(node, Apply):
            of = tuple(map(self.fold, node.of))
            if all(isinstance(x, Const) for x in of):
                return Const(self.operation(node.what)(*(x.value for x in of)))
            if node.what in ("and", "or") and isinstance(of[0], Const):
                return of[1] if bool(of[0].value) == (node.what == "and") else of[0]
            return Apply(node.what, of)
        return node

    def fold_all(self, nodes: tuple) -> tuple:
        out: list = []
        for node in nodes:
            new: tuple
            if isinstance(node, Output):
                of = self.fold(node.of)
                new = (Output(Const(_shown(of.value)) if isinstance(of, Const) else of),)
            elif isinstance(node, If):
                test = self.fold(node.test)
                then, other = self.fold_all(node.then), self.fold_all(node.other)
                new = (then if test.value else other) if isinstance(test, Const) else (If(test, then, other),)
            elif isinstance(node, For):
                new = (For(node.name, node.over, self.fold_all(node.body)),)
            else:
                new = (Generation(self.fold_all(node.body)),)
            for x in new:
                constant = isinstance(x, Output) and isinstance(x.of, Const)
                if constant and out and isinstance(out[-1], Output) and isinstance(out[-1].of, Const):
                    out[-1] = Output(Const(out[-1].of.value + x.of.value))
                elif not constant or x.of.value:
                    out.append(x)
        return tuple(out)

    def value(self, node) -> Callable:
        if isinstance(node, Const):
            constant = node.value
            return lambda scope: constant
        if isinstance(node, Name):
            name = node.name

            def look(scope):
                if name not in scope:
                    raise TemplateError(f"unknown name: {name}")
                return scope[name]

            return look
        if isinstance(node, Field):
            of, field = self.value(node.of), node.name
            return lambda scope: of(scope).get(field)
        call, of = self.operation(node.what), tuple(map(self.value, node.of))
        if node.what == "and":
            return lambda scope: of[0](scope) and of[1](scope)
        if node.what == "or":
            return lambda scope: of[0](scope) or of[1](scope)
        if len(of) == 1:
            only = of[0]
            return lambda scope: call(only(scope))
        left, right = of
        return lambda scope: call(left(scope), right(scope))

    def block(self, nodes: tuple) -> Callable:
        steps = tuple(map(self.step, nodes))

        def run(scope, out):
            for step in steps:
                step(scope, out)

        return steps[0] if len(steps) == 1 else run

    def step(self, node) -> Callable:
        if isinstance(node, Output):
            of = self.value(node.of)
            return lambda scope, out: out.write(_shown(of(scope)))
        if isinstance(node, If):
            test, then, other = self.value(node.test), self.block(node.then), self.block(node.other)
            return lambda scope, out: (then if test(scope) else other)(scope, out)
        if isinstance(node, Generation):
            inner = self.block(node.body)

            def generation(scope, out):
                start = out.length
                inner(scope, out)
                out.spans.append((start, out.length))

            return generation
        name, over, body = node.name, self.value(Name(node.over)), self.block(node.body)

        def loop(scope, out):
            for item in over(scope):
                body({**scope, name: item}, out)

        return loop


class Rendering:
    """What closures write to: parts of text, their length, and the spans of generation."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


class Template:
    """A compiled template. before, turn and after render what stands before the loop over messages, a message, and the
    rest, so that a conversation can be rendered piece by piece; they are None where the template has another form."""

    def __init__(self, source: str, controls: tuple[str, ...] = ()):
        self.escaper = Escaper(controls)
        compiler = Compiler(self.escaper)
        self.tree = compiler.fold_all(Parser(source).parse())
        self._all = compiler.block(self.tree)
        loops = [i for i, node in enumerate(self.tree) if isinstance(node, For) and node.over == "messages"]
        self.before = self.turn = self.after = None
        if len(loops) == 1:
            at = loops[0]
            self.before, self.after = compiler.block(self.tree[:at]), compiler.block(self.tree[at + 1 :])
            body, name = compiler.block(self.tree[at].body), self.tree[at].name
            self.turn = lambda message, scope, out: body({**scope, name: message}, out)

    def render(self, messages: list[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        """(text, spans of generation)."""
        out = Rendering()
        self._all({**names, "messages": messages}, out)
        return out.text, out.spans
