"""Chat formatting: a small template language, compiled to Python closures that render conversations.

A template is text with `{{ expression }}`, `{% for x in messages %}`, `{% if %} {% elif %} {% else %}`,
`{% set x = expression %}`, `{% generation %}` and `{# comment #}`. Expressions have strings, numbers, true,
false, none, names, `.field`, `['field']`, `~` (joins texts), comparisons, `in`, `and`, `or`, `not` and filters
from a fixed list. There are no calls, no imports and no access to attributes of Python objects: a field is a
key of a message or of `loop`, so a template can read nothing but the conversation. The text is parsed to a
tree, constant parts of the tree are folded, and every node becomes a closure that yields pieces of output.

Rendering is a stream: messages are walked once and pieces leave as they are made, so a conversation of any
length takes the memory of its longest message. Pieces between `{% generation %}` and `{% endgeneration %}`
are under the loss mask.

`escape` makes control strings in texts harmless and reversible: a backslash is doubled, and one is put behind
the first character of every control string. `unescape` drops each backslash and keeps the character after it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings that must not appear in an escaped text. "<|" covers all markers of the template below.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{# role, text and end markers; only what the assistant says is trained on #}"
    "{% set marker = '<|' ~ 'turn' ~ '|>' %}"
    "{% for m in messages %}{{ marker }}{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>{% endfor %}"
)
LONGEST_TEMPLATE, DEEPEST = 20_000, 50
# Characters of output per row of a rendered conversation.
PART_CHARS = 1 << 16


class TemplateError(ValueError):
    """A template that does not parse or reads what it may not."""


# Escaping


def control_pattern(control: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\\|(?:" + "|".join(f"(?={re.escape(c)})" for c in control) + ").", re.DOTALL)


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


# Syntax tree


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
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Filter:
    name: str
    value: object


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Branch:
    cases: tuple  # (condition, body), the last condition may be Const(True)


@dataclass(frozen=True)
class Loop:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


PIECES = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
TOKENS = re.compile(
    r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|~.()\[\]=]))", re.DOTALL
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None}
FILTERS: dict[str, Callable[[str], object]] = {
    "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len,
}
FIELDS = {"role", "text", "index", "index0", "first", "last"}
KEYWORDS = {"and", "or", "not", "in", "if", "for", "else", "elif", "set", "generation"}


class Parser:
    """Template text to a tree."""

    def __init__(self, source: str):
        if len(source) > LONGEST_TEMPLATE:
            raise TemplateError(f"a template has at most {LONGEST_TEMPLATE} characters")
        self.parts: list[tuple[str, str]] = []
        at = 0
        for m in PIECES.finditer(source):
            self.parts.append(("text", source[at : m.start()]))
            if m.group(1) is not None:
                self.parts.append(("output", m.group(1)))
            elif m.group(2) is not None:
                self.parts.append(("block", m.group(2)))
            at = m.end()
        self.parts.append(("text", source[at:]))
        if stray := next((t for k, t in self.parts if k == "text" and re.search(r"\{[{%#]|[%}#]\}", t)), None):
            raise TemplateError(f"unclosed tag in {stray[:40]!r}")
        self.at = 0
        self.tokens: list[tuple[str, str]] = []

    def template(self) -> tuple:
        body, stop = self.body((), 0)
        if stop:
            raise TemplateError(f"unexpected {stop}")
        return body

    def body(self, stops: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        """Nodes up to one of the closing tags, and that tag."""
        if depth > DEEPEST:
            raise TemplateError("nested too deeply")
        nodes: list[object] = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            if kind == "text":
                if text:
                    nodes.append(Output(Const(text)))
            elif kind == "output":
                self.start(text)
                nodes.append(Output(self.whole()))
            else:
                self.start(text)
                word = self.word()
                if word in stops:
                    return tuple(nodes), word
                nodes.append(self.block(word, depth))
        if stops:
            raise TemplateError(f"missing {stops[-1]}")
        return tuple(nodes), ""

    def block(self, word: str, depth: int) -> object:
        if word == "for":
            name = self.own_name()
            self.expect("in")
            self.expect("messages")
            self.end()
            return Loop(name, self.body(("endfor",), depth + 1)[0])
        if word == "generation":
            self.end()
            return Generation(self.body(("endgeneration",), depth + 1)[0])
        if word == "set":
            name = self.own_name()
            self.expect("=")
            return Assign(name, self.whole())
        if word == "if":
            cases, condition = [], self.whole()
            while True:
                body, stop = self.body(("elif", "else", "endif"), depth + 1)
                cases.append((condition, body))
                if stop == "endif":
                    return Branch(tuple(cases))
                if stop == "else":
                    self.end()
                    cases.append((Const(True), self.body(("endif",), depth + 1)[0]))
                    return Branch(tuple(cases))
                condition = self.whole()
        raise TemplateError(f"unknown tag {word!r}")

    # Expressions, loosest operator first.

    def start(self, text: str) -> None:
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = TOKENS.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.tokens.reverse()

    def peek(self) -> str:
        return self.tokens[-1][1] if self.tokens and self.tokens[-1][0] != "string" else ""

    def take(self, *words: str) -> str:
        return self.tokens.pop()[1] if self.peek() and self.peek() in words else ""

    def word(self) -> str:
        if not self.tokens or self.tokens[-1][0] != "name":
            raise TemplateError("a tag starts with a word")
        return self.tokens.pop()[1]

    def own_name(self) -> str:
        name = self.word()
        if name in KEYWORDS | set(CONSTANTS) | {"messages", "loop"} or name.startswith("_"):
            raise TemplateError(f"{name!r} cannot be set")
        return name

    def expect(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"expected {word!r}")

    def end(self) -> None:
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[-1][1]!r}")

    def whole(self) -> object:
        node = self.any_of(0)
        self.end()
        return node

    def any_of(self, depth: int) -> object:
        if depth > DEEPEST:
            raise TemplateError("nested too deeply")
        node = self.all_of(depth)
        while self.take("or"):
            node = Binary("or", node, self.all_of(depth))
        return node

    def all_of(self, depth: int) -> object:
        node = self.negated(depth)
        while self.take("and"):
            node = Binary("and", node, self.negated(depth))
        return node

    def negated(self, depth: int) -> object:
        if self.take("not"):
            return Unary("not", self.negated(depth + 1))
        node = self.joined(depth)
        if op := self.take("==", "!=", "in"):
            return Binary(op, node, self.joined(depth))
        if self.peek() == "not":
            self.take("not")
            self.expect("in")
            return Unary("not", Binary("in", node, self.joined(depth)))
        return node

    def joined(self, depth: int) -> object:
        node = self.filtered(depth)
        while self.take("~"):
            node = Binary("~", node, self.filtered(depth))
        return node

    def filtered(self, depth: int) -> object:
        node = self.primary(depth)
        while op := self.take("|", ".", "["):
            if op == "|":
                name = self.word()
                if name not in FILTERS and name != "escape":
                    raise TemplateError(f"unknown filter {name!r}")
                node = Filter(name, node)
            else:
                if op == "[" and (not self.tokens or self.tokens[-1][0] != "string"):
                    raise TemplateError("a field's name is a string")
                name = self.literal(self.tokens.pop()[1]) if op == "[" else self.word()
                if op == "[":
                    self.expect("]")
                if name not in FIELDS:
                    raise TemplateError(f"unknown field {name!r}")
                node = Field(node, name)
        return node

    def primary(self, depth: int) -> object:
        if not self.tokens:
            raise TemplateError("an expression is missing")
        kind, text = self.tokens.pop()
        if kind == "string":
            return Const(self.literal(text))
        if kind == "number":
            return Const(int(text))
        if kind == "name" and text not in KEYWORDS:
            return Const(CONSTANTS[text]) if text in CONSTANTS else Name(text)
        if text == "(":
            node = self.any_of(depth + 1)
            self.expect(")")
            return node
        raise TemplateError(f"unexpected {text!r}")

    @staticmethod
    def literal(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: ESCAPES.get(m.group(1), m.group(1)), text[1:-1], flags=re.DOTALL)


# Folding


def shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def apply(op: str, left: object, right: object) -> object:
    if op == "~":
        return shown(left) + shown(right)
    if op == "in":
        return shown(left) in shown(right)
    return (left == right) is (op == "==")


def fold(node: object, known: dict[str, object], filters: dict[str, Callable]) -> object:
    """The expression with all constant parts computed; `known` are names set to constants."""
    if isinstance(node, Name) and node.name in known:
        return Const(known[node.name])
    if isinstance(node, Field):
        return replace(node, of=fold(node.of, known, filters))
    if isinstance(node, Unary):
        value = fold(node.value, known, filters)
        return Const(not value.value) if isinstance(value, Const) else replace(node, value=value)
    if isinstance(node, Filter):
        value = fold(node.value, known, filters)
        return Const(filters[node.name](shown(value.value))) if isinstance(value, Const) else replace(node, value=value)
    if isinstance(node, Binary):
        left, right = fold(node.left, known, filters), fold(node.right, known, filters)
        if node.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) is (node.op == "and") else left
        if node.op not in ("and", "or") and isinstance(left, Const) and isinstance(right, Const):
            return Const(apply(node.op, left.value, right.value))
        return Binary(node.op, left, right)
    return node


def fold_body(body: tuple, known: dict[str, object], filters: dict[str, Callable]) -> tuple:
    """Fold all expressions, drop branches that cannot be taken, and join neighbouring constant outputs."""
    out: list[object] = []

    def add(node: object) -> None:
        if isinstance(node, Output) and isinstance(node.value, Const):
            text = shown(node.value.value)
            if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                text = out.pop().value.value + text
            if text:
                out.append(Output(Const(text)))
        else:
            out.append(node)

    for node in body:
        if isinstance(node, Output):
            add(Output(fold(node.value, known, filters)))
        elif isinstance(node, Assign):
            value = fold(node.value, known, filters)
            known.pop(node.name, None)
            if isinstance(value, Const):
                known[node.name] = value.value
            add(Assign(node.name, value))
        elif isinstance(node, Branch):
            cases, sure = [], False
            for condition, inner in node.cases:
                condition = fold(condition, known, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                cases.append((condition, fold_body(inner, dict(known), filters)))
                if isinstance(condition, Const):
                    sure = True
                    break
            if sure and len(cases) == 1:
                for inner in cases[0][1]:
                    add(inner)
                    if isinstance(inner, Assign):
                        known.pop(inner.name, None)
            elif cases:
                add(Branch(tuple(cases)))
            for name in assigned(node):
                known.pop(name, None)
        elif isinstance(node, Loop):
            changed = assigned(node) | {node.name, "loop"}
            inside = {k: v for k, v in known.items() if k not in changed}
            add(Loop(node.name, fold_body(node.body, inside, filters)))
            for name in changed:
                known.pop(name, None)
        else:
            add(Generation(fold_body(node.body, known, filters)))
    return tuple(out)


def assigned(node: object) -> set[str]:
    """Names that a node may set."""
    if isinstance(node, Assign):
        return {node.name}
    bodies = [b for _, b in node.cases] if isinstance(node, Branch) else [node.body] if isinstance(node, Loop | Generation) else []
    return {name for body in bodies for inner in body for name in assigned(inner)} | ({node.name} if isinstance(node, Loop) else set())


# Closures

OPEN, CLOSE = object(), object()


def value_of(node: object, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """A closure from the names' values to the expression's value."""
    if isinstance(node, Const):
        return lambda env: node.value
    if isinstance(node, Name):
        return lambda env: env.get(node.name)
    if isinstance(node, Field):
        of = value_of(node.of, filters)

        def field(env: dict) -> object:
            value = of(env)
            return value.get(node.name) if isinstance(value, dict) else None

        return field
    if isinstance(node, Unary):
        inner = value_of(node.value, filters)
        return lambda env: not inner(env)
    if isinstance(node, Filter):
        inner, change = value_of(node.value, filters), filters[node.name]
        return lambda env: change(shown(inner(env)))
    left, right = value_of(node.left, filters), value_of(node.right, filters)
    if node.op == "and":
        return lambda env: left(env) and right(env)
    if node.op == "or":
        return lambda env: left(env) or right(env)
    return lambda env: apply(node.op, left(env), right(env))


def runner(body: tuple, filters: dict[str, Callable]) -> Callable[[dict], Iterator[object]]:
    """A closure from the names' values to the pieces of output: texts, OPEN and CLOSE."""
    steps = [step(node, filters) for node in body]

    def run(env: dict) -> Iterator[object]:
        for s in steps:
            yield from s(env)

    return run


def step(node: object, filters: dict[str, Callable]) -> Callable[[dict], Iterable[object]]:
    if isinstance(node, Output):
        value = value_of(node.value, filters)
        return lambda env: (shown(value(env)),)
    if isinstance(node, Assign):
        value = value_of(node.value, filters)

        def assign(env: dict) -> tuple:
            env[node.name] = value(env)
            return ()

        return assign
    if isinstance(node, Branch):
        cases = [(value_of(c, filters), runner(b, filters)) for c, b in node.cases]

        def branch(env: dict) -> Iterable[object]:
            return next((body(env) for condition, body in cases if condition(env)), ())

        return branch
    inner = runner(node.body, filters)
    if isinstance(node, Generation):

        def generation(env: dict) -> Iterator[object]:
            yield OPEN
            yield from inner(env)
            yield CLOSE

        return generation

    def loop(env: dict) -> Iterator[object]:
        messages = iter(env["messages"])
        following, index = next(messages, None), 0
        while following is not None:
            env[node.name], following = following, next(messages, None)
            env["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": following is None}
            yield from inner(env)
            index += 1

    return loop


def count_loops(body: tuple, inside: str = "") -> int:
    """Loops in a body. Loops and generation blocks cannot be nested in their own kind: messages pass once."""
    n = 0
    for node in body:
        if isinstance(node, Branch):
            n += sum(count_loops(b, inside) for _, b in node.cases)
        elif isinstance(node, Loop | Generation):
            kind = type(node).__name__
            if kind in inside:
                raise TemplateError(f"nested {kind}")
            n += isinstance(node, Loop) + count_loops(node.body, inside + kind)
    return n


@dataclass(frozen=True)
class ChatTemplate:
    """A template and its control strings; closures are made anew in every task."""

    source: str = TEMPLATE
    control: tuple[str, ...] = CONTROL

    def tree(self) -> tuple:
        tree = Parser(self.source).template()
        if count_loops(tree) > 1:
            raise TemplateError("messages can be walked once")
        return fold_body(tree, {}, self.filters())

    def filters(self) -> dict[str, Callable]:
        return {**FILTERS, "escape": partial(escape, pattern=control_pattern(self.control))}

    def compiled(self) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
        """A function from messages to (text, under the loss mask), in order."""
        run = runner(self.tree(), self.filters())

        def render(messages: Iterable[dict]) -> Iterator[tuple[str, bool]]:
            loss = False
            for piece in run({"messages": messages}):
                if piece is OPEN or piece is CLOSE:
                    loss = piece is OPEN
                elif piece:
                    yield piece, loss

        return render


# Rendering tables


def grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conversation, its rows) of batches in which a conversation's rows stand together; rows are read as they are asked for."""
    rows = (row for batch in batches for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True))
    held = next(rows, None)
    while held is not None:
        key = held[0]

        def own(key: object = key) -> Iterator[tuple]:
            nonlocal held
            while held is not None and held[0] == key:
                row, held = held, next(rows, None)
                yield row

        mine = own()
        yield key, mine
        for _ in mine:  # what the reader left
            pass


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def parts_of(pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, bool]]:
    """Pieces joined to parts of at most PART_CHARS, cut where the loss mask changes."""
    held, size, mask = [], 0, False
    for text, loss in pieces:
        for at in range(0, len(text), PART_CHARS):
            chunk = text[at : at + PART_CHARS]
            if held and (loss != mask or size + len(chunk) > PART_CHARS):
                yield "".join(held), mask
                held, size = [], 0
            held.append(chunk)
            size, mask = size + len(chunk), loss
    if held:
        yield "".join(held), mask


def render_batches(batches: Iterator[pa.RecordBatch], template: ChatTemplate, key: pa.DataType) -> Iterator[pa.RecordBatch]:
    render = template.compiled()
    schema = pa.schema([("conv_id", key), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("n_turns", pa.int64())])

    def rows() -> Iterator[tuple]:
        for conversation, turns in grouped(batches, ["conv_id", "role", "text"]):
            count = 0

            def messages(turns=turns) -> Iterator[dict]:
                nonlocal count
                for _, role, text in turns:
                    count += 1
                    yield {"role": role or "", "text": text or ""}

            last = -1
            for last, (text, loss) in enumerate(parts_of(render(messages()))):
                yield conversation, last, text, loss, None
            yield conversation, last + 1, "", False, count

    yield from batched(rows(), schema, 64)


def render_conversations(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, part, text, loss, n_turns): every conversation as its formatted text, in parts of bounded size.

    Turns go by `turn`, null first; equal turns by role, then text, so that repeated rows are repeated turns.
    Null texts and roles are empty. Rows without a conv_id are one conversation. The last part of each
    conversation is empty and has the number of turns. An empty table gives no rows; other columns are ignored.
    Parts stand in order within their partition.
    """
    template = template or ChatTemplate()
    template.compiled()  # fails here, not in a task
    kind = conversations.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string("part bigint, text string, loss boolean, n_turns bigint").fields])
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    from pyspark.sql.pandas.types import to_arrow_type

    return rows.mapInArrow(partial(render_batches, template=template, key=to_arrow_type(kind)), schema)


def formatted_conversations(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, formatted, loss_spans) with one row a conversation, for conversations that fit into a row.
    A span is (start, end) in code points of the formatted text."""
    parts = render_conversations(conversations, template)
    lists = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "text", "loss"))).alias("_parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state, part):
        end = state["at"] + F.length(part["text"])
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        spans = F.when(part["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.cast("array<struct<start:int,end:int>>").alias("spans"))

    return lists.select(
        "conv_id", F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("formatted"), F.aggregate("_parts", start, add)["spans"].alias("loss_spans")
    )


# Reading back


class Reader:
    """Takes the formatted text of one conversation part by part and recovers its turns."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.n_chars = self.n_loss = 0
        self.rest, self.state, self.loss_rest = "", END, ""

    def feed(self, text: str, loss: bool) -> None:
        self.n_chars += len(text)
        if loss:
            plain, self.loss_rest = self.plain(self.loss_rest + text)
            self.loss.update(plain.encode())
            self.n_loss += len(plain)
        self.rest += text
        # Each state ends at one marker. What cannot be the beginning of the marker is taken at once.
        following = {END: TURN, TURN: TEXT, TEXT: END}
        while True:
            marker = following[self.state]
            at = self.rest.find(marker)
            if at >= 0:
                self.take(self.rest[:at])
                self.rest = self.rest[at + len(marker) :]
                if marker == TURN:
                    self.n_turns += 1
                else:
                    self.turns.update(b"\n")
                self.state = marker
                continue
            sure = len(self.rest) - len(marker) + 1
            if sure > 0:
                trail = len(self.rest[:sure]) - len(self.rest[:sure].rstrip("\\"))
                sure -= trail % 2
                self.take(self.rest[:sure])
                self.rest = self.rest[sure:]
            return

    def take(self, escaped: str) -> None:
        if escaped and self.state == END:
            raise ValueError("text outside of a turn")
        self.turns.update(unescape(escaped).encode())

    @staticmethod
    def plain(escaped: str) -> tuple[str, str]:
        """Unescaped text, and a backslash whose second half is still to come."""
        trail = len(escaped) - len(escaped.rstrip("\\"))
        keep = len(escaped) - trail % 2
        return unescape(escaped[:keep]), escaped[keep:]

    def close(self) -> None:
        if self.rest or self.loss_rest or self.state != END:
            raise ValueError("the formatted text ends within a turn")


def read_batches(batches: Iterator[pa.RecordBatch], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("conv_id", key), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def rows() -> Iterator[tuple]:
        for conversation, parts in grouped(batches, ["conv_id", "text", "loss"]):
            reader = Reader()
            for _, text, loss in parts:
                reader.feed(text, loss)
            reader.close()
            yield conversation, reader.n_turns, reader.turns.hexdigest(), reader.n_loss, reader.loss.hexdigest(), reader.n_chars

    yield from batched(rows(), schema, 1024)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of every conversation, recovered from the output of `render_conversations` with the default markers:
    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = parts.schema["conv_id"].dataType
    fields = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(fields).fields])
    return parts.mapInArrow(partial(read_batches, key=to_arrow_type(kind)), schema)
