"""A small template language for conversations, compiled to Python closures.

    {{ expression }}   {% set x = e %}   {% if e %} {% elif e %} {% else %} {% endif %}   {# comment #}
    {% for m in messages %} .. {% endfor %}   {% for x in [1, 2] %} .. {% endfor %}   {% generation %} .. {% endgeneration %}

A dash inside a tag (`{%-`, `-%}`) trims the white space on its side. Expressions have strings, integers, true, false, none, lists,
names, `x.key` and `x["key"]`, filters (`x | trim`), `is defined` and `is none`, `a if c else b`, or, and, not, in, comparisons,
`~` (join as text), + - * // %. `+` adds numbers or joins texts, the others take numbers.

The language is a sandbox: it reaches the constants, the message and the loop only, by keys of mappings and never by
attributes; it has no calls but the filters below, and no loop but over lists of the template or of a message. The loop over
`messages` stands at the top, once, so a template is a head, a body for one message and a tail: a conversation of any length is
rendered message by message, in many tasks. Work and output for a message are bounded by the template and the message.

`compile_template` lexes and parses the source into a syntax tree (`Node`), folds what does not depend on a message, joins
neighbouring text, drops branches that cannot be taken, and makes one closure of each node left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

MOST_SOURCE = 1 << 16
DEEPEST = 40


class TemplateError(ValueError):
    pass


class Node(NamedTuple):
    kind: str
    parts: tuple = ()


class Writer:
    """Rendered text and the spans, in code points, that were written under the generation mark."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []
        self.depth = 0

    def write(self, text: str) -> None:
        self.texts.append(text)
        self.length += len(text)

    def text(self) -> str:
        return "".join(self.texts)


def _text(x: Any) -> str:
    """What a value prints as; null is empty."""
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (str, int)):
        return str(x)
    raise TemplateError(f"cannot print a {type(x).__name__}")


def escape(x: Any) -> str:
    """No `<|` is left: each gets a backslash between, and so does one that already has some. `unescape` takes it out."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", _text(x))


def unescape(x: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", x)


def one_line(x: Any) -> str:
    """Line ends as backslash and n, backslashes doubled. `many_lines` takes it back."""
    return _text(x).replace("\\", "\\\\").replace("\n", "\\n")


def many_lines(x: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], x)


def _number(x: Any) -> int:
    if isinstance(x, int):
        return x
    raise TemplateError(f"a number is needed, not {x!r}")


def _divided(f: Callable) -> Callable:
    def run(a: Any, b: Any) -> int:
        if _number(b) == 0:
            raise TemplateError("division by zero")
        return f(_number(a), b)

    return run


def _ordered(f: Callable) -> Callable:
    def run(a: Any, b: Any) -> bool:
        if isinstance(a, str) != isinstance(b, str) or a is None or b is None:
            raise TemplateError(f"cannot order {a!r} and {b!r}")
        return f(a, b)

    return run


def _within(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return _text(a) in b
    return a in b if isinstance(b, (list, dict)) else False


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "line": one_line,
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (list, dict)) else len(_text(x)),
    "default": lambda x, other: other if x is None else x,
    "replace": lambda x, old, new: _text(x).replace(old, new) if old else _text(x),
}

BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "in": _within,
    "not in": lambda a, b: not _within(a, b),
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b),
    "-": lambda a, b: _number(a) - _number(b),
    "*": lambda a, b: _number(a) * _number(b),
    "//": _divided(lambda a, b: a // b),
    "%": _divided(lambda a, b: a % b),
}
# Operators that bind alike, from loose to tight.
LEVELS = [("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%")]

_TAG = re.compile(r"""\{#.*?\#\}|\{(?P<kind>[{%])(?P<left>-?)(?P<body>(?:"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^"'])*?)(?P<right>-?)[}%]\}""", re.S)
_LEXEME = re.compile(r"""\s*(?:(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|//|[-+*%~<>|.,()\[\]=]))""")
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none"}
_SIGNS = {"n": "\n", "t": "\t", "r": "\r"}


class Expressions:
    """A parser of one tag by recursive descent."""

    def __init__(self, source: str) -> None:
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(source.rstrip()):
            m = _LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = m.lastgroup or ""
            self.items.append(("word" if m[kind] in _WORDS and kind == "name" else kind, m[kind]))
            at = m.end()
        self.at = 0
        self.depth = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][1] in values and self.items[self.at][0] in ("word", "sign")

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at < len(self.items) and self.items[self.at][0] == "name":
            self.at += 1
            return self.items[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self) -> Node:
        out = self.choice()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return out

    def choice(self) -> Node:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("too deeply nested")
        out = self.either()
        if self.take("if"):
            condition = self.either()
            out = Node("choice", (condition, out, self.choice() if self.take("else") else Node("const", (None,))))
        self.depth -= 1
        return out

    def either(self) -> Node:
        out = self.both()
        while self.take("or"):
            out = Node("or", (out, self.both()))
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.take("and"):
            out = Node("and", (out, self.negated()))
        return out

    def negated(self) -> Node:
        if self.take("not"):
            self.depth += 1
            if self.depth > DEEPEST:
                raise TemplateError("too deeply nested")
            out = Node("not", (self.negated(),))
            self.depth -= 1
            return out
        return self.binary(0)

    def binary(self, level: int) -> Node:
        if level == len(LEVELS):
            return self.value()
        out = self.binary(level + 1)
        while True:
            sign = self.take(*LEVELS[level])
            if not sign and level == 0 and self.take("not"):
                self.need("in")
                sign = "not in"
            if not sign and level == 0 and self.take("is"):
                negative = self.take("not")
                test = self.take("none") or self.name()
                if test not in ("none", "defined"):
                    raise TemplateError(f"unknown test {test}")
                out = Node("is " + test, (out,))
                out = Node("not", (out,)) if negative else out
                continue
            if not sign:
                return out
            out = Node("binary", (sign, out, self.binary(level + 1)))

    def value(self) -> Node:
        out = self.atom()
        while True:
            if self.take("."):
                out = Node("get", (out, Node("const", (self.name(),))))
            elif self.take("["):
                out = Node("get", (out, self.choice()))
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name}")
                given = self.several(")") if self.take("(") else []
                if len(given) + 1 != FILTERS[name].__code__.co_argcount:
                    raise TemplateError(f"wrong number of values for {name}")
                out = Node("filter", (name, out, *given))
            else:
                return out

    def several(self, end: str) -> list[Node]:
        out = []
        while not self.take(end):
            out.append(self.choice())
            if not self.peek(end):
                self.need(",")
        return out

    def atom(self) -> Node:
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        if self.take("["):
            return Node("list", tuple(self.several("]")))
        if self.take("-"):
            return Node("binary", ("-", Node("const", (0,)), self.value()))
        for word, x in (("true", True), ("false", False), ("none", None)):
            if self.take(word):
                return Node("const", (x,))
        if self.at == len(self.items):
            raise TemplateError("a value is missing")
        kind, text = self.items[self.at]
        if kind == "name":
            return Node("name", (self.name(),))
        self.at += 1
        if kind == "int":
            return Node("const", (int(text),))
        if kind == "string":
            return Node("const", (re.sub(r"\\(.)", lambda m: _SIGNS.get(m[1], m[1]), text[1:-1], flags=re.S),))
        raise TemplateError(f"unexpected {text!r}")


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """('text', s), ('{', expression) and ('%', statement) in order."""
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        yield "text", text.rstrip() if m["left"] else text
        if m["kind"]:
            if m[0][-2] != {"{": "}", "%": "%"}[m["kind"]]:
                raise TemplateError(f"unclosed {m[0]!r}")
            yield m["kind"], m["body"].strip()
        at, trim = m.end(), bool(m["right"])
    rest = source[at:]
    if re.search(r"\{[{%#]", rest):
        raise TemplateError("a tag is not closed")
    yield "text", rest.lstrip() if trim else rest


class Statements:
    """A parser of the whole source into a list of nodes."""

    def __init__(self, source: str) -> None:
        if len(source) > MOST_SOURCE:
            raise TemplateError("the template is too long")
        self.pieces = [p for p in _pieces(source) if p[1] or p[0] != "text"]
        self.at = 0

    def block(self, ends: tuple[str, ...], depth: int = 0) -> tuple[list[Node], str]:
        """Nodes up to one of the statements in `ends`, and that statement."""
        if depth > DEEPEST:
            raise TemplateError("too deeply nested")
        out: list[Node] = []
        while self.at < len(self.pieces):
            kind, body = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                out.append(Node("print", (Node("const", (body,)),)))
            elif kind == "{":
                out.append(Node("print", (Expressions(body).whole(),)))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return out, body
                out.append(self.statement(word, rest, depth))
        if "" in ends:
            return out, ""
        raise TemplateError(f"one of {', '.join(ends)} is missing")

    def statement(self, word: str, rest: str, depth: int) -> Node:
        if word == "if":
            cases = []
            condition: Node = Expressions(rest).whole()
            while True:
                body, end = self.block(("elif", "else", "endif"), depth + 1)
                cases.append((condition, tuple(body)))
                if end.startswith("elif"):
                    condition = Expressions(end[4:]).whole()
                    continue
                if end == "else":
                    body, _ = self.block(("endif",), depth + 1)
                    cases.append((Node("const", (True,)), tuple(body)))
                return Node("if", tuple(cases))
        if word == "for":
            parser = Expressions(rest)
            name = parser.name()
            parser.need("in")
            over = parser.whole()
            return Node("for", (name, over, tuple(self.block(("endfor",), depth + 1)[0])))
        if word == "generation":
            return Node("generation", (tuple(self.block(("endgeneration",), depth + 1)[0]),))
        if word == "set":
            parser = Expressions(rest)
            name = parser.name()
            parser.need("=")
            return Node("set", (name, parser.whole()))
        raise TemplateError(f"unknown statement {word!r}")


def fold(x: Node) -> Node:
    """Work out what needs no message: operators, filters, choices and lists of constants."""
    kind, parts = x
    if kind in ("const", "name"):
        return x
    parts = tuple(fold(p) if isinstance(p, Node) else p for p in parts)
    known = [p.kind == "const" for p in parts if isinstance(p, Node)]
    if kind in ("and", "or", "choice") and parts[0].kind == "const":
        first = parts[0].parts[0]
        if kind == "choice":
            return parts[1] if first else parts[2]
        return parts[1] if bool(first) == (kind == "and") else parts[0]
    x = Node(kind, parts)
    if all(known) and kind != "is defined":
        return Node("const", (expression(x)({}),))
    return x


def folded(block: tuple | list) -> list[Node]:
    """Statements with folded expressions, joined text and only the branches that can be taken."""
    out: list[Node] = []
    for kind, parts in block:
        if kind == "print":
            x = fold(parts[0])
            if x.kind == "const":
                text = _text(x.parts[0])
                last = out[-1].parts[0] if out and out[-1].kind == "print" else None
                if last and last.kind == "const":
                    text = last.parts[0] + text
                    out.pop()
                if text:
                    out.append(Node("print", (Node("const", (text,)),)))
            else:
                out.append(Node("print", (x,)))
        elif kind == "if":
            cases = []
            for condition, body in parts:
                condition = fold(condition)
                if condition.kind == "const" and not condition.parts[0]:
                    continue
                cases.append((condition, folded(body)))
                if condition.kind == "const":
                    break
            if cases and cases[0][0].kind == "const":
                out += cases[0][1]
                out = folded(out) if len(cases[0][1]) else out
            elif cases:
                out.append(Node("if", tuple(cases)))
        elif kind == "for":
            out.append(Node("for", (parts[0], fold(parts[1]), folded(parts[2]))))
        elif kind == "set":
            out.append(Node("set", (parts[0], fold(parts[1]))))
        else:
            out.append(Node(kind, (folded(parts[0]),)))
    return out


def _get(x: Any, key: Any) -> Any:
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, list) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else None
    raise TemplateError(f"no {key!r} in a {type(x).__name__}")


def expression(x: Node) -> Callable[[dict], Any]:
    """The closure of an expression: from names to a value."""
    kind, parts = x
    if kind == "const":
        value = parts[0]
        return lambda names: value
    if kind == "name":
        name = parts[0]

        def look(names: dict) -> Any:
            if name not in names:
                raise TemplateError(f"unknown name {name}")
            return names[name]

        return look
    if kind == "is defined":
        (inner,) = parts
        if inner.kind == "name":
            return lambda names: inner.parts[0] in names
        value = expression(inner)
        return lambda names: value(names) is not None
    if kind == "binary":
        f, a, b = BINARY[parts[0]], expression(parts[1]), expression(parts[2])
        return lambda names: f(a(names), b(names))
    if kind == "filter":
        f, given = FILTERS[parts[0]], [expression(p) for p in parts[1:]]
        if len(given) == 1:
            only = given[0]
            return lambda names: f(only(names))
        return lambda names: f(*(g(names) for g in given))
    made = [expression(p) for p in parts]
    if kind == "list":
        return lambda names: [m(names) for m in made]
    if kind == "choice":
        condition, yes, no = made
        return lambda names: yes(names) if condition(names) else no(names)
    if kind in ("is none", "not"):
        only = made[0]
        return (lambda names: not only(names)) if kind == "not" else (lambda names: only(names) is None)
    a, b = made
    if kind == "get":
        return lambda names: _get(a(names), b(names))
    return (lambda names: a(names) and b(names)) if kind == "and" else (lambda names: a(names) or b(names))


def statements(block: list[Node]) -> Callable[[dict, Writer], None]:
    """The closure of a block: writes, given the names in scope."""
    made = [_statement(x) for x in block]
    if len(made) == 1:
        return made[0]

    def run(names: dict, out: Writer) -> None:
        for m in made:
            m(names, out)

    return run


def _statement(x: Node) -> Callable[[dict, Writer], None]:
    kind, parts = x
    if kind == "print":
        if parts[0].kind == "const":
            text = parts[0].parts[0]
            return lambda names, out: out.write(text)
        value = expression(parts[0])
        return lambda names, out: out.write(_text(value(names)))
    if kind == "set":
        name, value = parts[0], expression(parts[1])
        return lambda names, out: names.__setitem__(name, value(names))
    if kind == "if":
        cases = [(expression(condition), statements(body)) for condition, body in parts]

        def choose(names: dict, out: Writer) -> None:
            for condition, body in cases:
                if condition(names):
                    return body(names, out)

        return choose
    if kind == "generation":
        inner = statements(parts[0])

        def mark(names: dict, out: Writer) -> None:
            start = out.length
            out.depth += 1
            inner(names, out)
            out.depth -= 1
            if not out.depth and out.length > start:
                out.spans.append((start, out.length))

        return mark
    name, over, body = parts[0], expression(parts[1]), statements(parts[2])

    def loop(names: dict, out: Writer) -> None:
        items = over(names)
        if not isinstance(items, list):
            raise TemplateError("a loop needs a list")
        for i, item in enumerate(items):
            body({**names, name: item, "loop": _place(i, i == len(items) - 1)}, out)

    return loop


def _place(index: int, last: bool) -> dict:
    return {"index0": index, "index": index + 1, "first": index == 0, "last": last}


def _loops_over_messages(block: list[Node] | tuple) -> bool:
    """Whether `messages` is named anywhere below."""
    return any(
        x == Node("name", ("messages",)) or (isinstance(x, (tuple, list)) and _loops_over_messages(tuple(x)))
        for x in block
    )


class Program:
    """A compiled template: head, one message, tail."""

    def __init__(self, block: list[Node], constants: dict) -> None:
        at = [k for k, x in enumerate(block) if x.kind == "for" and x.parts[1] == Node("name", ("messages",))]
        rest = [x for k, x in enumerate(block) if k not in at] + [y for k in at for y in block[k].parts[2]]
        if len(at) != 1 or _loops_over_messages(rest):
            raise TemplateError("a template has one loop over messages, at the top, and no other use of them")
        self.name = block[at[0]].parts[0]
        self.tree = block
        self.names = dict(constants)
        self.head = Writer()
        statements(block[: at[0]])(self.names, self.head)
        self.body = statements(block[at[0]].parts[2])
        self.tail = statements(block[at[0] + 1 :])

    def turn(self, message: dict, index: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """The text of one message of a conversation and its generated spans; the first has the head, the last the tail."""
        out = Writer()
        if index == 0:
            out.write(self.head.text())
            out.spans += self.head.spans
        self.body({**self.names, self.name: message, "loop": _place(index, last)}, out)
        if last:
            self.tail(dict(self.names), out)
        return out.text(), out.spans

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """A whole conversation."""
        text, spans = "", []
        for i, m in enumerate(messages):
            more, found = self.turn(m, i, i == len(messages) - 1)
            spans += [(a + len(text), b + len(text)) for a, b in found]
            text += more
        return text, spans


def _assigned(block: list | tuple) -> set[str]:
    """Names that a statement below gives a value."""
    out: set[str] = set()
    for x in block:
        if isinstance(x, Node) and x.kind in ("set", "for"):
            out.add(x.parts[0])
        if isinstance(x, (tuple, list)):
            out |= _assigned(tuple(x))
    return out


def _with_constants(x: Any, constants: dict) -> Any:
    """The tree with the values of constants in the place of their names."""
    if isinstance(x, Node):
        if x.kind == "name":
            return Node("const", (constants[x.parts[0]],)) if x.parts[0] in constants else x
        if x.kind == "is defined" and x.parts[0].kind == "name":
            return Node("const", (True,)) if x.parts[0].parts[0] in constants else x
        return Node(x.kind, _with_constants(x.parts, constants))
    if isinstance(x, (tuple, list)):
        return type(x)(_with_constants(y, constants) for y in x)
    return x


def compile_template(source: str, constants: dict | None = None) -> Program:
    block, _ = Statements(source).block(("",))
    own = {"messages", "loop", *_assigned(block)}
    fixed = {k: v for k, v in (constants or {}).items() if k not in own}
    return Program(folded(_with_constants(block, fixed)), constants or {})
