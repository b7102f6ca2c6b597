"""Chat formatting with a compiled, sandboxed template language.

A template is text with `{{ expression }}`, `{% for x in expr %}`, `{% if %}/{% elif %}/{% else %}`, `{% set x = expr %}`,
`{% generation %}` and `{# comments #}`; `-` next to a tag's bracket strips the white space on that side. compile_template()
parses it into a syntax tree, folds constant expressions, branches and adjacent text, and generates nested Python closures.
The sandbox: a template sees only its variables; names lead to dict items and list elements (never to attributes of Python
objects), and only the listed filters can be called. A closure appends to the output; what a generation block appends is
marked as a span of code points, which is the loss mask.

Control strings inside a value are escaped by the `escape` filter with a backslash and come back with unescape(); parse()
reads a formatted conversation back into its turns.

Defined cases of format_conversations(): a null text or role is empty; turns go by (turn, role, text), nulls first; equal
rows are separate turns; a null conversation id is a conversation of its own; an empty table gives no conversations. One
conversation is one value and lives in one task; tasks stream, so no more than one conversation is held at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

OPEN, SEP, CLOSE = "### ", ": ", "</turn>"
TURN_TEMPLATE = (
    "{% for m in messages %}"
    "### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)


class TemplateError(ValueError):
    """The template can't be parsed, or reaches outside the sandbox."""


# -- syntax tree ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    a: Any


@dataclass(frozen=True)
class Binary:
    op: str
    a: Any
    b: Any


@dataclass(frozen=True)
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    yes: tuple
    no: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# -- escapes ----------------------------------------------------------------------------------

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash goes before each backslash and each control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[..., Any]] = {
    "escape": lambda v: escape(_text(v)),
    "escape_role": lambda v: escape_role(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "title": lambda v: _text(v).title(),
    "length": len,
    "string": lambda v: _text(v),
    "first": lambda v: v[0] if v else None,
    "last": lambda v: v[-1] if v else None,
    "default": lambda v, other="": other if v is None else v,
    "replace": lambda v, old, new: _text(v).replace(old, new),
    "join": lambda v, by="": by.join(map(_text, v)),
}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "%": lambda a, b: a % b if isinstance(a, int) else _refuse("% is for integers"),
    "~": lambda a, b: _text(a) + _text(b),
}


def _refuse(why: str) -> Any:
    raise TemplateError(why)


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# -- parser -----------------------------------------------------------------------------------

_TAG = re.compile(r"(\{\{-?|\{%-?|\{#-?)(.*?)(-?\}\}|-?%\}|-?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(not\s+in\b|[A-Za-z_]\w*)|(==|!=|<=|>=|[-+%~<>|.,:()\[\]=]))", re.S)
_PAIRS = {"{{": "}}", "{%": "%}", "{#": "#}"}
_STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_RESERVED = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at : at + 12]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("const", int(m[1])))
            elif m[2]:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _STRING_ESCAPES.get(e[1], e[1]), m[2][1:-1], flags=re.S)))
            elif m[3]:
                self.tokens.append(("name", re.sub(r"\s+", " ", m[3])))
            else:
                self.tokens.append(("sign", m[4]))
        self.at = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("name", "sign") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if self.take(value) is None:
            raise TemplateError(f"{value!r} is missing before {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"{value!r} is no name that a template may use")
        self.at += 1
        return value

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def whole(self) -> Any:
        out = self.choice()
        self.end()
        return out

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else Const(None)
            return Choice(test, value, other)
        return value

    def either(self) -> Any:
        a = self.both()
        while self.take("or"):
            a = Binary("or", a, self.both())
        return a

    def both(self) -> Any:
        a = self.negated()
        while self.take("and"):
            a = Binary("and", a, self.negated())
        return a

    def negated(self) -> Any:
        return Unary("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        a = self.added()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in", "not in"):
            a = Binary(op, a, self.added())
        return a

    def added(self) -> Any:
        a = self.filtered()
        while op := self.take("+", "-", "~", "%"):
            a = Binary(op, a, self.filtered())
        return a

    def filtered(self) -> Any:
        a = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            args = [a]
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    if not self.take(","):
                        self.need(")")
                        break
            a = Filter(name, tuple(args))
        return a

    def reached(self) -> Any:
        kind, value = self.peek()
        if kind == "const":
            self.at += 1
            a: Any = Const(value)
        elif self.take("("):
            a = self.choice()
            self.need(")")
        elif self.take("-"):
            a = Binary("-", Const(0), self.reached())
        elif kind == "name" and value in _RESERVED:
            self.at += 1
            a = Const(_RESERVED[value])
        else:
            a = Name(self.name())
        while True:
            if self.take("."):
                a = Item(a, Const(self.name()))
            elif self.take("["):
                a = Item(a, self.choice())
                self.need("]")
            else:
                return a


def parse_template(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if m[1].endswith("-") else text))
        if _PAIRS[m[1][:2]] != m[3][-2:]:
            raise TemplateError(f"{m[1]} ends in {m[3]}")
        pieces.append((m[1][:2], m[2].strip()))
        at, strip = m.end(), m[3].startswith("-")
    tail = source[at:]
    pieces.append(("text", tail.lstrip() if strip else tail))
    if any(kind == "text" and re.search(r"\{[{%#]", text) for kind, text in pieces):
        raise TemplateError("a tag isn't closed")
    where = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal where
        out: list[Any] = []
        while where < len(pieces):
            kind, body = pieces[where]
            where += 1
            if kind == "text":
                if body:
                    out.append(Output(Const(body)))
            elif kind == "{{":
                out.append(Output(_Expression(body).whole()))
            elif kind == "{%":
                word = body.split(None, 1)[0] if body else ""
                rest = body[len(word) :]
                if word in ends:
                    return tuple(out), body
                if word == "for":
                    e = _Expression(rest)
                    name = e.name()
                    e.need("in")
                    over = e.whole()
                    out.append(For(name, over, block("endfor")[0]))
                elif word == "if":
                    out.append(branch(rest))
                elif word == "set":
                    e = _Expression(rest)
                    name = e.name()
                    e.need("=")
                    out.append(Assign(name, e.whole()))
                elif word == "generation":
                    out.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), ""

    def branch(test: str) -> If:
        yes, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return If(_Expression(test).whole(), yes, (branch(end[4:]),))
        no = block("endif")[0] if end == "else" else ()
        return If(_Expression(test).whole(), yes, no)

    return block()[0]


# -- constant folding -------------------------------------------------------------------------


def fold(node: Any) -> Any:
    """The node with constant parts computed; a tuple of nodes with dead branches gone and adjacent text joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.value, Const):
                    text = _text(y.value.value)
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        out[-1] = Output(Const(out[-1].value.value + text))
                    elif text:
                        out.append(Output(Const(text)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, (Const, Name)):
        return node
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, For):
        over = fold(node.over)
        return () if isinstance(over, Const) and not over.value else For(node.name, over, fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no)
        return If(test, fold(node.yes), fold(node.no))
    if isinstance(node, Choice):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.yes if test.value else node.no)
        return Choice(test, fold(node.yes), fold(node.no))
    if isinstance(node, Filter):
        made: Any = Filter(node.name, tuple(fold(x) for x in node.args))
        parts = made.args
    elif isinstance(node, Unary):
        made = Unary(node.op, fold(node.a))
        parts = (made.a,)
    elif isinstance(node, Binary):
        made = Binary(node.op, fold(node.a), fold(node.b))
        parts = (made.a, made.b)
    else:
        made = Item(fold(node.of), fold(node.key))
        parts = (made.of, made.key)
    return Const(_closure(made)({})) if all(isinstance(x, Const) for x in parts) else made


# -- code generation --------------------------------------------------------------------------


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return None


def _closure(node: Any) -> Callable[[dict], Any]:
    """An expression as a function of the variables."""
    if isinstance(node, Const):
        value = node.value
        return lambda _: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _closure(node.of), _closure(node.key)
        return lambda env: _item(of(env), key(env))
    if isinstance(node, Unary):
        a = _closure(node.a)
        return lambda env: not a(env)
    if isinstance(node, Choice):
        test, yes, no = map(_closure, (node.test, node.yes, node.no))
        return lambda env: yes(env) if test(env) else no(env)
    if isinstance(node, Filter):
        call, args = FILTERS[node.name], tuple(map(_closure, node.args))
        if len(args) == 1:
            (only,) = args
            return lambda env: call(only(env))
        return lambda env: call(*(x(env) for x in args))
    a, b = _closure(node.a), _closure(node.b)
    if node.op == "and":
        return lambda env: a(env) and b(env)
    if node.op == "or":
        return lambda env: a(env) or b(env)
    op = _BINARY[node.op]
    return lambda env: op(a(env), b(env))


@dataclass
class _Page:
    """What has been written so far."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)


Step = Callable[[dict, _Page], None]


def _steps(nodes: tuple) -> Step:
    steps = tuple(map(_step, nodes))
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, page: _Page) -> None:
        for s in steps:
            s(env, page)

    return run


def _step(node: Any) -> Step:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text, n = node.value.value, len(node.value.value)

            def put_constant(env: dict, page: _Page) -> None:
                page.parts.append(text)
                page.length += n

            return put_constant
        value = _closure(node.value)

        def put(env: dict, page: _Page) -> None:
            page.parts.append(out := _text(value(env)))
            page.length += len(out)

        return put
    if isinstance(node, Assign):
        name, value = node.name, _closure(node.value)

        def assign(env: dict, page: _Page) -> None:
            env[name] = value(env)

        return assign
    if isinstance(node, If):
        test, yes, no = _closure(node.test), _steps(node.yes), _steps(node.no)
        return lambda env, page: yes(env, page) if test(env) else no(env, page)
    if isinstance(node, Generation):
        body = _steps(node.body)

        def marked(env: dict, page: _Page) -> None:
            start = page.length
            body(env, page)
            page.spans.append((start, page.length))

        return marked
    name, over, body = node.name, _closure(node.over), _steps(node.body)

    def loop(env: dict, page: _Page) -> None:
        items = over(env) or ()
        inner = dict(env)
        for i, x in enumerate(items):
            inner[name] = x
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
            body(inner, page)

    return loop


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """render(variables) -> (text, spans of generation blocks in code points)."""
    body = _steps(fold(parse_template(source)))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        page = _Page()
        body(dict(variables), page)
        return "".join(page.parts), page.spans

    return render


# -- reading back -----------------------------------------------------------------------------

_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that TURN_TEMPLATE made."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


# -- DataFrame operator -----------------------------------------------------------------------


def format_conversations(turns: DataFrame, template: str = TURN_TEMPLATE, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss_starts, loss_ends): a row per conversation; the loss mask in code points of formatted."""
    compile_template(template)  # a bad template fails here, not on an executor
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.repartition(partitions(turns.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        done: list[tuple[Any, str, list[int], list[int]]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            nonlocal done, held
            columns = zip(*done)
            arrays = [pa.array(list(c), type=t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            done, held = [], 0
            return pa.RecordBatch.from_arrays(arrays, names=["conv", "formatted", "loss_starts", "loss_ends"])

        now, messages = None, []

        def finish() -> None:
            nonlocal held
            if messages:
                out, spans = render({"messages": messages})
                done.append((now, out, [s for s, _ in spans], [e for _, e in spans]))
                held += len(out)

        for b in batches:
            for conv_id, who, what in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if messages and conv_id != now:
                    finish()
                    messages = []
                    if held > 4 << 20:
                        yield batch()
                now = conv_id
                messages.append({"role": who, "text": what})
        finish()
        if done:
            yield batch()

    out = rows.mapInArrow(run, "conv long, formatted string, loss_starts array<long>, loss_ends array<long>")
    return out.withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all taken from the formatted text and its mask."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv_id, text, starts, ends in zip(*(b.column(i).to_pylist() for i in range(4))):
                turns = parse(text)
                sha = hashlib.sha256()
                for who, what in turns:
                    sha.update(f"{who}\n{what}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends))
                out.append((conv_id, len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, kinds)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(F.col(conv).alias("conv"), "formatted", "loss_starts", "loss_ends")
    return rows.mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv)
