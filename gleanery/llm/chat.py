"""Chat formatting with a template compiler.

A small template language is parsed into a syntax tree, constants are folded,
and the tree becomes nested Python closures that render one conversation. What
stands between ``{% generation %}`` and ``{% endgeneration %}`` is marked: its
places in the output are the loss mask.

The language: ``{{ expression }}``; ``{% for x in list %}``, ``{% if %}``,
``{% elif %}``, ``{% else %}``, ``{% set x = ... %}``, ``{% generation %}``
with their ends; ``-`` beside a delimiter strips white space there.
Expressions have literals, names, ``x.field``, ``x[index]``, ``==`` and the
other comparisons, ``in``, ``and``/``or``/``not``, ``+``, ``~`` and
``value | filter``. It is a sandbox: fields are looked up in dictionaries
only, never as Python attributes, filters are those given, nothing is called
and loops run over lists only.

Edge cases: null role or text is empty; turns are in order of turn, role,
text, null turns first; rows with a null id are one conversation; an empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks turns; m is one of ``messages``.
CHATML = (
    "{% for m in messages %}{{ '<|im_start|>' ~ (m.role | mark) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)


def escape(text: str) -> str:
    """Control strings begin with ``<|``; a backslash goes between, one more where there are some."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def mark(role: str) -> str:
    """A role on one line."""
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unmark(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


FILTERS: dict[str, Callable] = {"escape": escape, "mark": mark, "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "string": str}


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)
_LEXEME = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.\[\]()]))")
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over one expression; nodes are tuples, ('const', value) if known."""

    def __init__(self, source: str):
        self.items, at = [], 0
        while source[at:].strip():
            m = _LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.items.append(("end", ""))
        self.at = 0

    def peek(self, *values: str) -> bool:
        kind, value = self.items[self.at]
        return kind in ("op", "name") and value in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        node = self.either()
        if self.items[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.joined()
        while op := self.take(*_COMPARE, "in"):
            node = ("compare", op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "~"):
            node = ("join" if op == "~" else "add", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.reached()
        while self.take("|"):
            node = ("filter", self.name(), node)
        return node

    def reached(self) -> tuple:
        node = self.single()
        while op := self.take(".", "["):
            if op == ".":
                node = ("field", node, ("const", self.name()))
            else:
                node = ("field", node, self.either())
                self.expect("]")
        return node

    def single(self) -> tuple:
        kind, value = self.items[self.at]
        self.at += 1
        if kind == "num":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            return ("const", _WORDS[value.lower()]) if value.lower() in _WORDS else ("name", self.allowed(value))
        if (kind, value) == ("op", "("):
            node = self.either()
            self.expect(")")
            return node
        raise TemplateError(f"unexpected {value!r}")

    def name(self) -> str:
        kind, value = self.items[self.at]
        if kind != "name":
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return self.allowed(value)

    def expect(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    @staticmethod
    def allowed(name: str) -> str:
        if name.startswith("_"):
            raise TemplateError(f"{name!r} is not allowed")
        return name


def parse(source: str) -> tuple:
    """The syntax tree of a template: ('block', [nodes])."""
    stack: list[tuple[str, Any, list]] = [("block", None, [])]
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        left, right = (m[1], m[3]) if m[2] is not None else (m[4], m[6])
        text = text.rstrip() if left else text
        if text:
            stack[-1][2].append(("text", text))
        at, strip = m.end(), bool(right)
        if m[2] is not None:
            stack[-1][2].append(("show", _Expression(m[2]).whole()))
            continue
        word, _, rest = m[5].strip().partition(" ")
        if word == "for":
            name, found, over = rest.partition(" in ")
            if not found:
                raise TemplateError("for needs in")
            stack.append(("for", (_Expression.allowed(name.strip()), _Expression(over).whole()), []))
        elif word == "if":
            stack.append(("if", ([], _Expression(rest).whole()), []))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            _, (arms, test), body = stack.pop()
            arms.append((test, ("block", body)))
            stack.append(("if", (arms, _Expression(rest).whole() if word == "elif" else ("const", True)), []))
        elif word == "set":
            name, found, value = rest.partition("=")
            if not found:
                raise TemplateError("set needs =")
            stack[-1][2].append(("set", _Expression.allowed(name.strip()), _Expression(value).whole()))
        elif word == "generation":
            stack.append(("generation", None, []))
        elif word.startswith("end") and len(stack) > 1 and stack[-1][0] == word[3:]:
            kind, head, body = stack.pop()
            block = ("block", body)
            node = ("for", *head, block) if kind == "for" else ("if", [*head[0], (head[1], block)]) if kind == "if" else ("generation", block)
            stack[-1][2].append(node)
        else:
            raise TemplateError(f"{word!r} is not expected here")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    tail = source[at:].lstrip() if strip else source[at:]
    if tail:
        stack[0][2].append(("text", tail))
    return ("block", stack[0][2])


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: tuple, filters: dict[str, Callable] = FILTERS) -> tuple:
    """The tree with constant parts worked out, dead branches gone and texts merged."""
    kind = node[0]
    if kind == "block":
        out: list[tuple] = []
        for child in (fold(c, filters) for c in node[1]):
            for c in child[1] if child[0] == "block" else [child]:
                if c[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + c[1])
                elif c != ("text", ""):
                    out.append(c)
        return ("block", out)
    if kind == "show":
        inner = fold(node[1], filters)
        return ("text", _shown(inner[1])) if inner[0] == "const" else ("show", inner)
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "generation":
        return ("generation", fold(node[1], filters))
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test = fold(test, filters)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, fold(body, filters)))
            if test[0] == "const":
                break
        if not arms:
            return ("block", [])
        return arms[0][1] if arms[0][0][0] == "const" else ("if", arms)
    if kind in ("const", "name", "text"):
        return node
    parts = tuple(fold(p, filters) if isinstance(p, tuple) else p for p in node[1:])
    folded = (kind, *parts)
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(p[0] == "const" for p in parts if isinstance(p, tuple)):
        return ("const", _closure(folded, filters)({}))
    return folded


def _closure(node: tuple, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    """A function from the names' values to the value of an expression."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "field":
        of, key = _closure(node[1], filters), _closure(node[2], filters)
        return lambda env: _field(of(env), key(env))
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"no filter {node[1]!r}")
        f, of = filters[node[1]], _closure(node[2], filters)
        return lambda env: f(_shown(v) if (v := of(env)) is None else v)
    if kind == "not":
        of = _closure(node[1], filters)
        return lambda env: not of(env)
    if kind == "compare":
        a, b = _closure(node[2], filters), _closure(node[3], filters)
        if node[1] == "in":
            return lambda env: a(env) in (b(env) or ())
        return lambda env, op=_COMPARE[node[1]]: op(a(env), b(env))
    a, b = _closure(node[1], filters), _closure(node[2], filters)
    if kind == "join":
        return lambda env: _shown(a(env)) + _shown(b(env))
    if kind == "add":
        return lambda env: a(env) + b(env)
    return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))


def _field(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


class _Output:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.marks: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _writer(node: tuple, filters: dict[str, Callable]) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, out, t=node[1]: out.put(t)
    if kind == "show":
        of = _closure(node[1], filters)
        return lambda env, out: out.put(_shown(of(env)))
    if kind == "block":
        steps = [_writer(c, filters) for c in node[1]]

        def block(env: dict, out: _Output) -> None:
            for step in steps:
                step(env, out)

        return block
    if kind == "for":
        name, over, body = node[1], _closure(node[2], filters), _writer(node[3], filters)

        def loop(env: dict, out: _Output) -> None:
            values = over(env)
            if not isinstance(values, list):
                raise TemplateError("for runs over lists only")
            for i, v in enumerate(values):
                body({**env, name: v, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(values) - 1}}, out)

        return loop
    if kind == "if":
        arms = [(_closure(t, filters), _writer(b, filters)) for t, b in node[1]]

        def choose(env: dict, out: _Output) -> None:
            for test, body in arms:
                if test(env):
                    body(env, out)
                    return

        return choose
    if kind == "set":
        of = _closure(node[2], filters)
        return lambda env, out, n=node[1]: env.__setitem__(n, of(env))
    body = _writer(node[1], filters)

    def generation(env: dict, out: _Output) -> None:
        start = out.length
        body(env, out)
        out.marks.append((start, out.length))

    return generation


def compile_template(source: str, filters: dict[str, Callable] = FILTERS) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the text and the marked places (start, end) in it."""
    write = _writer(fold(parse(source), filters), filters)

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write(dict(variables), out)
        return "".join(out.parts), out.marks

    return render


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``CHATML`` formatted."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unmark(m[1]), unescape(m[2])))
        at = m.end()
    return out


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, messages: the turns of each conversation in order. A conversation is one row however long."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))


def format_chats(turns: DataFrame, template: str = CHATML) -> DataFrame:
    """conv_id, formatted (text), marks (start, end of what is trained on) of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            texts, marks = [], []
            for k in range(batch.num_rows):
                text, own = render({"messages": batch.column("messages")[k].as_py()})
                texts.append(text)
                marks.append([{"start": a, "end": b} for a, b in own])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(marks, kind)], ["conv_id", "formatted", "marks"])

    return conversations(turns).withColumn("conv_id", F.col("conv_id").cast("long")).mapInArrow(run, "conv_id long, formatted string, marks array<struct<start: int, end: int>>")


def digest(formatted: DataFrame) -> DataFrame:
    """Figures read back from formatted texts and their marks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, marks in zip(batch.column("formatted").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[m["start"] : m["end"]]) for m in marks)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
