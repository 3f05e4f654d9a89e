"""Chat formatting: a small sandboxed template language compiled to closures.

A template is text with ``{{ expression }}`` and the statements ``for x in
list``, ``if``/``elif``/``else``, ``set name = expression`` and ``generation``
(what is inside counts for the loss). Expressions know strings, integers,
true/false/none, names, ``.field``, ``[index]``, ``+ == != in not and or``,
comparisons and the filters below; nothing reaches Python objects, calls or
attributes, so a template can neither run code nor read outside its input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Marks the start of each turn, its text and its end; <, [ and & in texts are
#: escaped, so no text can hold a control string.
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<s>[' + (m.role | escape) + ']' + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.content | escape }}{% endgeneration %}"
    "{% else %}{{ m.content | escape }}{% endif %}"
    "{{ '</s>' + '\\n' }}"
    "{% endfor %}"
)
#: Turns and characters after which a long conversation's output goes on in a further row.
PIECE_TURNS, PIECE_CHARS = 256, 1 << 20

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


def escape(text: str) -> str:
    for raw, safe in _ESCAPES:
        text = text.replace(raw, safe)
    return text


def unescape(text: str) -> str:
    for raw, safe in reversed(_ESCAPES):
        text = text.replace(safe, raw)
    return text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(str(x)),
    "trim": lambda x: str(x).strip(),
    "lower": lambda x: str(x).lower(),
    "upper": lambda x: str(x).upper(),
    "length": len,
}


class TemplateError(ValueError):
    pass


class Node(NamedTuple):
    """kind: const, name, field, index, filter, unary, binary, text, out, for, if, set, generation."""

    kind: str
    args: tuple


_LEX = re.compile(r"\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+<>|.()\[\]]))")
_UNQUOTE = {"n": "\n", "t": "\t", "r": "\r"}
_BLOCK = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_COMPARE: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
_BINARY = _COMPARE | {"+": lambda a, b: a + b, "-": lambda a, b: a - b}


class _Expression:
    """Recursive descent: or < and < not < comparison < sum < filter < postfix."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.peek("or"):
            self.take("or")
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.peek("and"):
            self.take("and")
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        if self.peek("not"):
            self.take("not")
            return Node("not", (self.negated(),))
        node = self.total()
        if self.peek(*_COMPARE):
            node = Node("binary", (self.take(*_COMPARE), node, self.total()))
        return node

    def total(self) -> Node:
        node = self.filtered()
        while self.peek("+", "-"):
            node = Node("binary", (self.take("+", "-"), node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.postfix()
        while self.peek("|"):
            self.take("|")
            if not self.peek(*FILTERS):
                raise TemplateError("unknown filter")
            node = Node("filter", (self.take(*FILTERS), node))
        return node

    def postfix(self) -> Node:
        node = self.atom()
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
                    raise TemplateError("expected a field")
                node = Node("index", (node, Node("const", (self.tokens[self.at][1],))))
                self.at += 1
            else:
                node = Node("index", (node, self.either()))
                self.take("]")
        return node

    def atom(self) -> Node:
        if self.peek("("):
            self.take("(")
            node = self.either()
            self.take(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Node("const", (int(value),))
        if kind == "str":
            return Node("const", (re.sub(r"\\(.)", lambda m: _UNQUOTE.get(m[1], m[1]), value[1:-1], flags=re.S),))
        if kind == "name":
            return Node("const", ({"true": True, "false": False, "none": None}[value],)) if value in ("true", "false", "none") else Node("name", (value,))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple[Node, ...]:
    """The template's syntax tree."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _BLOCK.finditer(source):
        parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("out", m[1]))
        elif m[2] is not None:
            parts.append(("do", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))
    place = 0

    def body(*ends: str) -> tuple[tuple[Node, ...], str]:
        nonlocal place
        nodes: list[Node] = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                if value:
                    nodes.append(Node("text", (value,)))
                continue
            if kind == "out":
                nodes.append(Node("out", (_Expression(value).parse(),)))
                continue
            word = value.split(None, 1)[0] if value else ""
            if word in ends:
                return tuple(nodes), value
            if word == "for" and (m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", value, re.S)):
                inner, _ = body("endfor")
                nodes.append(Node("for", (m[1], _Expression(m[2]).parse(), inner)))
            elif word == "set" and (m := re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=\s*(.+)", value, re.S)):
                nodes.append(Node("set", (m[1], _Expression(m[2]).parse())))
            elif word == "if":
                arms, test = [], value[2:]
                while True:
                    inner, end = body("elif", "else", "endif")
                    arms.append((Node("const", (True,)) if test is None else _Expression(test).parse(), inner))
                    if end == "endif":
                        break
                    test = None if end == "else" else end[4:]
                nodes.append(Node("if", tuple(arms)))
            elif value == "generation":
                inner, _ = body("endgeneration")
                nodes.append(Node("generation", (inner,)))
            else:
                raise TemplateError(f"unknown or misplaced statement {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    return body()[0]


def fold(node: Node) -> Node:
    """Constant parts of an expression, evaluated once."""
    args = tuple(fold(a) if isinstance(a, Node) else a for a in node.args)
    node = Node(node.kind, args)
    inner = [a for a in args if isinstance(a, Node)]
    if node.kind in ("binary", "filter", "not", "and", "or", "index") and inner and all(a.kind == "const" for a in inner):
        try:
            return Node("const", (_closure(node)({}),))
        except (TypeError, KeyError, IndexError):
            return node
    if node.kind == "binary" and args[0] == "+" and args[2].kind == "const" and args[1].kind == "binary" and args[1].args[0] == "+" and args[1].args[2].kind == "const":
        left, right = args[1].args[2].args[0], args[2].args[0]
        if isinstance(left, str) and isinstance(right, str):  # (x + 'a') + 'b'
            return Node("binary", ("+", args[1].args[1], Node("const", (left + right,))))
    return node


def fold_body(nodes: Iterable[Node]) -> tuple[Node, ...]:
    """Folded statements: constant output becomes text, dead arms go, texts are joined."""
    out: list[Node] = []
    for n in nodes:
        if n.kind == "out":
            e = fold(n.args[0])
            made = [Node("text", (str(e.args[0]),)) if e.kind == "const" else Node("out", (e,))]
        elif n.kind == "for":
            made = [Node("for", (n.args[0], fold(n.args[1]), fold_body(n.args[2])))]
        elif n.kind == "set":
            made = [Node("set", (n.args[0], fold(n.args[1])))]
        elif n.kind == "generation":
            made = [Node("generation", (fold_body(n.args[0]),))]
        elif n.kind == "if":
            arms = []
            for test, inner in ((fold(t), fold_body(b)) for t, b in n.args):
                if test.kind == "const" and not test.args[0]:
                    continue
                arms.append((test, inner))
                if test.kind == "const":
                    break
            made = list(arms[0][1]) if arms and arms[0][0].kind == "const" else [Node("if", tuple(arms))] if arms else []
        else:
            made = [n]
        for m in made:
            if m.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", (out[-1].args[0] + m.args[0],))
            else:
                out.append(m)
    return tuple(out)


def _closure(node: Node) -> Callable[[dict], Any]:
    kind, args = node
    if kind == "const":
        value = args[0]
        return lambda env: value
    if kind == "name":
        name = args[0]
        return lambda env: env.get(name)
    if kind == "filter":
        f, x = FILTERS[args[0]], _closure(args[1])
        return lambda env: f(x(env))
    if kind == "binary":
        f, a, b = _BINARY[args[0]], _closure(args[1]), _closure(args[2])
        return lambda env: f(a(env), b(env))
    if kind == "not":
        a = _closure(args[0])
        return lambda env: not a(env)
    a, b = _closure(args[0]), _closure(args[1])
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)

    def index(env: dict) -> Any:
        of, at = a(env), b(env)
        if isinstance(of, dict):
            return of.get(at)
        if isinstance(of, (list, tuple, str)) and isinstance(at, int):
            return of[at]
        raise TemplateError("only lists, strings and records have parts")

    return index


Piece = tuple[str, bool]


def _run(nodes: Sequence[Node]) -> Callable[[dict, bool], Iterator[Piece]]:
    steps: list[Callable[[dict, bool], Iterator[Piece]]] = []
    for kind, args in nodes:
        if kind == "text":
            steps.append(lambda env, on, t=args[0]: iter(((t, on),)))
        elif kind == "out":
            steps.append(lambda env, on, f=_closure(args[0]): iter(((str(f(env)), on),)))
        elif kind == "set":

            def put(env, on, name=args[0], f=_closure(args[1])):
                env[name] = f(env)
                return iter(())

            steps.append(put)
        elif kind == "generation":
            steps.append(lambda env, on, f=_run(args[0]): f(env, True))
        elif kind == "for":

            def loop(env, on, name=args[0], of=_closure(args[1]), f=_run(args[2])):
                for x in of(env) or ():
                    yield from f(env | {name: x}, on)

            steps.append(loop)
        else:
            arms = [(_closure(t), _run(b)) for t, b in args]

            def choose(env, on, arms=arms):
                for test, f in arms:
                    if test(env):
                        return f(env, on)
                return iter(())

            steps.append(choose)

    def run(env: dict, on: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(env, on)

    return run


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A function of the template's names that yields (text, in generation) in order.

    Lists may be iterators: a conversation is rendered turn by turn.
    """
    run = _run(fold_body(parse(source)))
    return lambda **names: run(dict(names), False)


def render(template: Callable[..., Iterator[Piece]], messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and the loss spans [start, end) in code points."""
    out, spans, at = [], [], 0
    for text, on in template(messages=messages):
        if on:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


_TURN = re.compile(r"<s>\[([^\[]*?)\]\n([^<\[]*)</s>\n")


def turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from text in the form of TEMPLATE."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Formatted text and loss spans of every conversation, in pieces of whole turns.

    Columns conv_id, piece (from 0), n_turns, formatted, loss (spans in code
    points of this piece). Turns go by turn, then role and text; turn may be
    null (first); null role or text is empty; repeated rows are turns of their
    own; rows of null conv_id form one conversation. A conversation of any
    length passes through its task as a sorted stream, a piece at a time. The
    template sees each piece's turns as ``messages``.
    """
    small_batches(conversations.sparkSession)
    compile_template(template)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, piece int, n_turns long, formatted string, loss array<struct<start:int,end:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compile_template(template)
        kinds = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        out: list[dict] = []
        held: list[dict] = []
        conv, piece, chars, ready = None, 0, 0, 0

        def close() -> None:
            text, spans = render(made, held)
            out.append({"conv_id": conv, "piece": piece, "n_turns": len(held), "formatted": text, "loss": [{"start": s, "end": e} for s, e in spans]})

        for c, role, text in _rows(batches):
            if held and (c != conv or len(held) >= PIECE_TURNS or chars >= PIECE_CHARS):
                close()
                ready += chars
                piece = piece + 1 if c == conv else 0
                held, chars = [], 0
                if ready >= PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out, ready = [], 0
            conv = c
            held.append({"role": role, "content": text})
            chars += len(text)
        if held:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, kinds)

    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema)


def digest(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation, from what ``format_conversations`` gave: turns and loss text.

    ``in_order``: the pieces come straight from there, so those of a conversation
    follow one another in one partition; else, as when they were written and
    read again, they are brought together first. Null texts and roles were
    formatted as empty ones; pieces without loss spans add nothing to the loss;
    a conversation of any length is digested piece by piece; null conv_id is one
    conversation; an empty table gives no rows; other columns are not read.
    """
    small_batches(formatted.sparkSession)
    ordered = formatted if in_order else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def closed() -> pa.RecordBatch:
            n, of_turns, loss, of_loss, chars = state
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([of_turns.hexdigest()]), pa.array([loss], pa.int64()), pa.array([of_loss.hexdigest()]), pa.array([chars], pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

        done: list[pa.RecordBatch] = []
        for b in batches:
            for c, text, spans in zip(*(b.column(x).to_pylist() for x in ("conv_id", "formatted", "loss")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append(closed())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if state is not None:
            yield closed()

    return ordered.select("conv_id", "formatted", "loss").mapInArrow(run, schema)
