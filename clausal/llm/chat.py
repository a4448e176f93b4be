"""Chat formatting by a template compiler.

A small template language is parsed to a syntax tree, constants are folded, and the tree
is compiled to Python closures: no template text is ever executed as Python, names resolve
to the conversation's fields only, and filters come from a fixed table. The renderer
writes pieces turn by turn, each with a mark of whether it lies in a generation block, so
a conversation of any length streams through in bounded memory.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}
    {% for m in messages %} {% endfor %}   {% generation %} {% endgeneration %}   {# comment #}

Expressions: strings, integers, names, attributes (m.role, loop.index, loop.first, loop.last),
`==`, `!=`, `and`, `or`, `not`, `+`, parentheses and filters (`x | escape`). `-` at a tag's
inner edge trims the white space beside it.

`escape` puts a backslash before every backslash, `#` and `<`, so that no text can hold a
control string; `read_back` undoes it.

Defined results: a null text or role is empty; a conversation's turns are ordered by turn
(null first), then role, then text; repeated rows are turns of their own; a null conv_id
is one conversation; very long texts and conversations stream through whole; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks turns; the text of assistant turns lies in generation blocks.
TEMPLATE = "{% for m in messages %}### {{ m.role | escape_head }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"

_SPECIAL = re.compile(r"[\\#<]")
_HEAD = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

#: The only functions that a template can call; all are pure, so constant arguments fold.
FILTERS: dict[str, Callable] = {
    "escape": lambda s: _SPECIAL.sub(r"\\\g<0>", s),
    "escape_head": lambda s: _HEAD.sub(r"\\\g<0>", s),
    "trim": lambda s: s.strip(),
    "upper": lambda s: s.upper(),
    "lower": lambda s: s.lower(),
    "capitalize": lambda s: s.capitalize(),
    "length": len,
}


class TemplateError(ValueError):
    """The template isn't well formed, or asks for something the language doesn't have."""


@dataclass(frozen=True)
class Node:
    """A node of the syntax tree: its kind, what it holds, and its children."""

    kind: str
    value: object = None
    parts: tuple = ()


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.+()]))""", re.DOTALL)


def _expression_tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"can't read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of an expression."""

    def __init__(self, source: str):
        self.tokens, self.at, self.source = _expression_tokens(source), 0, source

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if value is not None and token[1] != value or token[0] == "end":
            raise TemplateError(f"expected {value or 'more'} in {self.source!r}")
        self.at += 1
        return token

    def whole(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"can't read the end of {self.source!r}")
        return node

    def chain(self, words: tuple[str, ...], below: Callable[[], Node]) -> Node:
        node = below()
        while self.peek()[1] in words and self.peek()[0] != "str":
            node = Node("binary", self.take()[1], (node, below()))
        return node

    def either(self) -> Node:
        return self.chain(("or",), lambda: self.chain(("and",), self.negated))

    def negated(self) -> Node:
        if self.peek() == ("name", "not"):
            self.take()
            return Node("not", None, (self.negated(),))
        return self.chain(("==", "!="), lambda: self.chain(("+",), self.filtered))

    def filtered(self) -> Node:
        node = self.primary()
        while self.peek() in (("op", "|"), ("op", ".")):
            op, (kind, name) = self.take()[1], self.take()
            if kind != "name" or name.startswith("_"):
                raise TemplateError(f"{name!r} isn't allowed in {self.source!r}")
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter" if op == "|" else "field", name, (node,))
        return node

    def primary(self) -> Node:
        kind, text = self.take()
        if kind == "int":
            return Node("constant", int(text))
        if kind == "str":
            return Node("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if (kind, text) == ("op", "("):
            node = self.either()
            self.take(")")
            return node
        if kind == "name" and text in ("true", "false"):
            return Node("constant", text == "true")
        if kind == "name" and text not in ("and", "or", "not"):
            return Node("name", text)
        raise TemplateError(f"can't read {text!r} in {self.source!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        k = next(i for i in (1, 4, 7) if m[i] is not None)
        pieces.append(("text", text.rstrip() if m[k] else text))
        if k != 7:
            pieces.append(("out" if k == 1 else "tag", m[k + 1].strip()))
        at, trim = m.end(), bool(m[k + 2])
    pieces.append(("text", source[at:].lstrip() if trim else source[at:]))
    pieces.reverse()

    def block(*ends: str) -> tuple[Node, str]:
        parts: list[Node] = []
        while pieces:
            kind, text = pieces.pop()
            if kind == "text":
                if text:
                    parts.append(Node("text", text))
            elif kind == "out":
                parts.append(Node("out", None, (_Expression(text).whole(),)))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return Node("block", None, tuple(parts)), text
                if word == "if":
                    parts.append(branches(rest))
                elif word == "for":
                    if not (m := re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+messages\s*", rest)):
                        raise TemplateError(f"can't loop over {rest!r}")
                    parts.append(Node("for", m[1], (block("endfor")[0],)))
                elif word == "generation":
                    parts.append(Node("generation", None, (block("endgeneration")[0],)))
                else:
                    raise TemplateError(f"no tag {text!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return Node("block", None, tuple(parts)), ""

    def branches(condition: str) -> Node:
        test = _Expression(condition).whole()
        body, end = block("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        other = branches(rest) if word == "elif" else block("endif")[0] if word == "else" else Node("block")
        return Node("if", None, (test, body, other))

    return block()[0]


_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def folded(node: Node) -> Node:
    """The tree with constant expressions evaluated, decided branches taken and neighbouring texts joined."""
    parts = tuple(folded(p) for p in node.parts)
    constant = bool(parts) and all(p.kind == "constant" for p in parts)
    if node.kind == "filter" and constant:
        return Node("constant", FILTERS[node.value](parts[0].value))
    if node.kind == "not" and constant:
        return Node("constant", not parts[0].value)
    if node.kind == "binary" and constant:
        return Node("constant", _BINARY[node.value](parts[0].value, parts[1].value))
    if node.kind == "out" and constant:
        return Node("text", str(parts[0].value))
    if node.kind == "if" and parts[0].kind == "constant":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "block":
        joined: list[Node] = []
        for p in (q for p in parts for q in (p.parts if p.kind == "block" else (p,))):
            if p.kind == "text" and joined and joined[-1].kind == "text":
                joined[-1] = Node("text", joined[-1].value + p.value)
            else:
                joined.append(p)
        parts = tuple(joined)
    return Node(node.kind, node.value, parts)


#: A rendered piece: its text, and whether it lies in a generation block.
Piece = tuple[str, bool]


def _value(node: Node) -> Callable[[dict], object]:
    """The closure of an expression over the fields in scope."""
    if node.kind == "constant":
        return lambda scope, v=node.value: v
    if node.kind == "name":

        def name(scope: dict, n=node.value):
            if n not in scope:
                raise TemplateError(f"no name {n!r}")
            return scope[n]

        return name
    inner = [_value(p) for p in node.parts]
    if node.kind == "field":

        def field(scope: dict, of=inner[0], n=node.value):
            held = of(scope)
            if not isinstance(held, dict) or n not in held:
                raise TemplateError(f"no field {n!r}")
            return held[n]

        return field
    if node.kind == "filter":
        return lambda scope, f=FILTERS[node.value], of=inner[0]: f(of(scope))
    if node.kind == "not":
        return lambda scope, of=inner[0]: not of(scope)
    a, b = inner
    if node.value == "and":
        return lambda scope: a(scope) and b(scope)
    if node.value == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope, f=_BINARY[node.value]: f(a(scope), b(scope))


def _emitter(node: Node, marked: bool) -> Callable[[dict], Iterator[Piece]]:
    """The closure of a statement: yields its pieces."""
    if node.kind == "text":
        piece = (node.value, marked)
        return lambda scope: iter((piece,))
    if node.kind == "out":
        value = _value(node.parts[0])
        return lambda scope: iter(((str(value(scope)), marked),))
    if node.kind == "generation":
        return _emitter(node.parts[0], True)
    if node.kind == "if":
        test, then, other = _value(node.parts[0]), _emitter(node.parts[1], marked), _emitter(node.parts[2], marked)
        return lambda scope: then(scope) if test(scope) else other(scope)
    if node.kind == "for":
        body = _emitter(node.parts[0], marked)

        def loop(scope: dict, name=node.value) -> Iterator[Piece]:
            # one message is held back, so that loop.last is known of a stream
            index, held = 0, None
            for message in scope["messages"]:
                if index:
                    yield from body(scope | {name: held, "loop": {"index": index, "first": index == 1, "last": False}})
                held, index = message, index + 1
            if index:
                yield from body(scope | {name: held, "loop": {"index": index, "first": index == 1, "last": True}})

        return loop
    emitters = [_emitter(p, marked) for p in node.parts]

    def block(scope: dict) -> Iterator[Piece]:
        for e in emitters:
            yield from e(scope)

    return block


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A renderer: from messages (dicts with role and text; any iterable) to pieces of the output."""
    emit = _emitter(folded(parse(source)), False)
    return lambda messages: emit({"messages": messages})


class Reader:
    """Reads what TEMPLATE has written, piece by piece: turns, and the text under the loss mask."""

    def __init__(self):
        self.turns, self.chars, self.rest = 0, 0, ""
        self.turn_hash, self.loss_hash, self.loss_chars = hashlib.sha256(), hashlib.sha256(), 0
        self.state, self.role, self.body = "between", "", []

    @staticmethod
    def plain(text: str) -> str:
        return _ESCAPED.sub(r"\1", text)

    def feed(self, text: str, marked: bool) -> None:
        self.chars += len(text)
        if marked:
            loss = self.plain(text)
            self.loss_chars += len(loss)
            self.loss_hash.update(loss.encode())
        self.rest += text
        if "</turn>\n" in text or len(self.rest) > 1 << 16:
            self._read()

    def _read(self) -> None:
        at = 0
        while m := _NEXT[self.state].match(self.rest, at):
            if self.state == "head":
                self.role = self.plain(m[1])
            elif self.state == "body":
                self.body.append(self.plain(m[1]))
                self._turn()
            at = m.end()
            self.state = {"between": "head", "head": "body", "body": "between"}[self.state]
        self.rest = self.rest[at:]

    def _turn(self) -> None:
        self.turns += 1
        self.turn_hash.update(f"{self.role}\n{''.join(self.body)}\n".encode())
        self.body = []

    def close(self) -> None:
        self._read()
        if self.rest or self.state != "between":
            raise ValueError("the output doesn't end with a turn")


#: What ends each state: a turn's mark, the role's colon, the end of the turn. Possessive runs: no backtracking.
_NEXT = {
    "between": re.compile(r"### ()"),
    "head": re.compile(r"((?:[^\\:]++|\\.)*+): ", re.DOTALL),
    "body": re.compile(r"((?:[^\\<]++|\\.)*+)</turn>\n", re.DOTALL),
}


def read_back(pieces: Iterable[Piece]) -> Reader:
    reader = Reader()
    for text, marked in pieces:
        reader.feed(text, marked)
    reader.close()
    return reader


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of rows with one conv_id, as streams over batch borders; each must be read to its end."""
    rows = ((c, {"role": r or "", "text": t or ""}) for b in batches for c, r, t in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True))
    held = next(rows, None)
    while held is not None:
        conv = held[0]

        def turns() -> Iterator[dict]:
            nonlocal held
            while held is not None and held[0] == conv:
                yield held[1]
                held = next(rows, None)

        yield conv, turns()


def formatted(turns: DataFrame, template: str = TEMPLATE, with_text: bool = False) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text), read back from its output.

    Turns of a conversation meet in one task, sorted, and stream through the renderer and
    the reader; nothing is gathered. With `with_text` the output and its generation spans
    (code points, end exclusive) come too, which holds a whole conversation in memory.
    """
    compile_template(template)  # fails early, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"] + ["formatted", "spans"] * with_text
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.string(), pa.list_(pa.list_(pa.int64()))] * with_text
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for conv, messages in _conversations(batches):
            reader, kept, spans = Reader(), [], []
            for text, marked in render(messages):
                if with_text:
                    kept.append(text)
                    if marked and spans and spans[-1][1] == reader.chars:
                        spans[-1][1] += len(text)
                    elif marked:
                        spans.append([reader.chars, reader.chars + len(text)])
                reader.feed(text, marked)
            reader.close()
            for _ in messages:  # a template may leave turns unread
                pass
            rows.append((conv, reader.turns, reader.turn_hash.hexdigest(), reader.loss_chars, reader.loss_hash.hexdigest(), reader.chars, *(["".join(kept), spans] if with_text else [])))
            if len(rows) >= 2000 or with_text and len(rows) >= 100:
                yield batch()
                rows.clear()
        yield batch()

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long" + ", formatted string, spans array<array<long>>" * with_text
    source = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    return source.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, ddl)
