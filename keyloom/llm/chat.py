"""Chat formatting with a small template compiler: text to syntax tree, constants folded, tree to Python closures.

The language has ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}``/``elif``/``else`` and ``{% generation %}`` blocks.
Expressions have strings, numbers, names, fields (``m.role``, ``m['role']``), ``== != and or not + ~``, ``a if c else b`` and
the filters below. It is a sandbox: there are no calls, names and fields are looked up in plain mappings only, and the
only loop is over what the caller gives. Closures are generators, so a conversation streams through its template.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches

#: Strings that a model reads as control, its own and other families'.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_ESCAPE = re.compile("|".join([r"\\", *(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL)]))
_UNESCAPE = re.compile(r"\\(\\?)")
TEMPLATE = (
    "{% for m in messages %}<|im_start|>{{ m.role | escape }}<|im_sep|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>{% endfor %}"
)


def escape(text: str) -> str:
    """A backslash doubles; a control string gets one after its first character, so that it is none any more."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": lambda s: s.strip(), "upper": lambda s: s.upper(), "lower": lambda s: s.lower()}


class TemplateError(ValueError):
    pass


# -- syntax: tuples whose first item is the kind of node -------------------------------------------------------------

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.\[\]()+~]))""")
_WORDS = {"and", "or", "not", "if", "else", "true", "false", "none"}
_LITERALS = {"true": True, "false": False, "none": None}


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") else None

    def take(self, *what: str) -> bool:
        if self.peek() in what:
            self.at += 1
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            raise TemplateError(f"{what!r} expected")

    def parse(self) -> tuple:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.any()
        if self.take("if"):
            test = self.any()
            self.need("else")
            node = ("choice", test, node, self.choice())
        return node

    def any(self) -> tuple:
        node = self.all()
        while self.take("or"):
            node = ("or", node, self.all())
        return node

    def all(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.sum()
        while (op := self.peek()) in ("==", "!="):
            self.at += 1
            node = (op, node, self.sum())
        return node

    def sum(self) -> tuple:
        node = self.filtered()
        while (op := self.peek()) in ("+", "~"):
            self.at += 1
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.take("|"):
            name = self.peek()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "num":
            return ("const", int(value))
        if kind != "name" or value in _WORDS - set(_LITERALS):
            raise TemplateError(f"unexpected {value!r}")
        node = ("const", _LITERALS[value]) if value in _LITERALS else ("name", value)
        while True:
            if self.take("."):
                kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("a field's name is expected")
                self.at += 1
                node = ("field", node, ("const", value))
            elif self.take("["):
                node = ("field", node, self.choice())
                self.need("]")
            else:
                return node


def parse(source: str) -> tuple:
    """The template's tree: ("block", nodes)."""
    parts = _TAGS.split(source)
    at = 0

    def block(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        nodes: list[tuple] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{") and part.endswith("}}"):
                nodes.append(("put", _Expression(part[2:-2]).parse()))
            elif part.startswith("{%") and part.endswith("%}"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return ("block", nodes), word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"for {rest!r}")
                    nodes.append(("for", m[1], _Expression(m[2]).parse(), block("endfor")[0]))
                elif word == "generation":
                    nodes.append(("generation", block("endgeneration")[0]))
                elif word == "if":
                    nodes.append(branch(rest))
                else:
                    raise TemplateError(f"unexpected {word!r}")
            elif part:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return ("block", nodes), "", ""

    def branch(rest: str) -> tuple:
        test = _Expression(rest).parse()
        then, word, more = block("elif", "else", "endif")
        other: tuple = ("block", [])
        if word == "elif":
            other = ("block", [branch(more)])
        elif word == "else":
            other = block("endif")[0]
        return ("if", test, then, other)

    return block()[0]


_OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b)}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def fold(node: tuple) -> tuple:
    """The same tree with constant expressions computed, constant branches chosen and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "block":
        nodes: list[tuple] = []
        for n in map(fold, node[1]):
            for x in n[1] if n[0] == "block" else [n]:
                if x[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + x[1])
                elif x != ("text", ""):
                    nodes.append(x)
        return ("block", nodes)
    if kind == "put":
        value = fold(node[1])
        return ("text", _text(value[1])) if value[0] == "const" else ("put", value)
    if kind == "if":
        test = fold(node[1])
        return fold(node[2] if test[1] else node[3]) if test[0] == "const" else ("if", test, fold(node[2]), fold(node[3]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "choice":
        test = fold(node[1])
        return fold(node[2] if test[1] else node[3]) if test[0] == "const" else ("choice", test, fold(node[2]), fold(node[3]))
    if kind == "filter":
        value = fold(node[2])
        return ("const", FILTERS[node[1]](_text(value[1]))) if value[0] == "const" else ("filter", node[1], value)
    sides = [fold(n) for n in node[1:]]
    if kind in ("and", "or") and sides[0][0] == "const":
        return sides[1] if bool(sides[0][1]) == (kind == "and") else sides[0]
    if all(s[0] == "const" for s in sides):
        if kind == "not":
            return ("const", not sides[0][1])
        if kind in _OPS:
            try:
                return ("const", _OPS[kind](sides[0][1], sides[1][1]))
            except TypeError as e:
                raise TemplateError(str(e)) from e
    return (kind, *sides)


def _value(node: tuple) -> Callable[[dict], object]:
    """The closure of an expression."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":

        def name(env, n=node[1]):
            if n not in env:
                raise TemplateError(f"no name {n!r}")
            return env[n]

        return name
    if kind == "filter":
        f, of = FILTERS[node[1]], _value(node[2])
        return lambda env: f(_text(of(env)))
    sides = [_value(n) for n in node[1:]]
    if kind == "field":

        def field(env):
            of = sides[0](env)
            if type(of) is not dict:
                raise TemplateError("only mappings have fields")
            return of.get(sides[1](env))

        return field
    if kind == "not":
        return lambda env: not sides[0](env)
    if kind == "and":
        return lambda env: sides[0](env) and sides[1](env)
    if kind == "or":
        return lambda env: sides[0](env) or sides[1](env)
    if kind == "choice":
        return lambda env: sides[1](env) if sides[0](env) else sides[2](env)
    op = _OPS[kind]
    return lambda env: op(sides[0](env), sides[1](env))


Piece = tuple[str, bool]


def _render(node: tuple) -> Callable[[dict, bool], Iterator[Piece]]:
    """The closure of a node: it yields pieces of text, each with whether it is under the loss mask."""
    kind = node[0]
    if kind == "text":

        def text(env, masked, t=node[1]):
            yield t, masked

        return text
    if kind == "put":
        value = _value(node[1])

        def put(env, masked):
            yield _text(value(env)), masked

        return put
    if kind == "block":
        parts = [_render(n) for n in node[1]]

        def block(env, masked):
            for part in parts:
                yield from part(env, masked)

        return block
    if kind == "generation":
        inner = _render(node[1])

        def generation(env, masked):
            yield from inner(env, True)

        return generation
    if kind == "if":
        test, then, other = _value(node[1]), _render(node[2]), _render(node[3])

        def branch(env, masked):
            yield from (then if test(env) else other)(env, masked)

        return branch
    name, values, body = node[1], _value(node[2]), _render(node[3])

    def loop(env, masked):
        inner = dict(env)
        for x in values(env):
            inner[name] = x
            yield from body(inner, masked)
            yield TURN_END

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from names and values to pieces of text. The object TURN_END marks the end of a turn and is no text."""
    render = _render(fold(parse(source)))
    return lambda env: render(env, False)


#: A place where a long output may be cut. It is told by identity, as a text may be the same characters.
TURN_END: Piece = ("\0", False)


def ends_turn(piece: Piece) -> bool:
    return piece is TURN_END  # here, as a function sent to a task has copies of the values it names


class Once:
    """Turns that are read as they stream by; a template that loops over them again is refused."""

    def __init__(self, turns: Iterator[dict]):
        self.turns: Iterator[dict] | None = turns

    def __iter__(self) -> Iterator[dict]:
        if self.turns is None:
            raise TemplateError("messages can be looped over once")
        turns, self.turns = self.turns, None
        return turns


# -- conversations -------------------------------------------------------------------------------------------------


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_turns: int = 1024) -> DataFrame:
    """(conv_id, part, formatted, loss array<struct<start, end>>) from rows (conv_id, turn, role, text).

    Turns are in the order of turn, role, text (nulls first), so repeated turns stay and ties have one order. A null text
    or role is empty; a null conv_id is a conversation. A conversation of more than ``part_turns`` turns has several
    rows, in order, so no row and no task's memory grows with its number of turns (one turn's text is one cell by its nature); rows of a conversation are neighbours in one
    partition. ``loss`` has the code points under the mask. An empty table gives no rows; other columns are not read.
    """
    bounded_batches(turns.sparkSession)
    compile_template(template)  # errors show here, not in a task
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        ready: list[tuple] = []
        following = next(rows, None)
        while following is not None:
            now = following[0]

            def messages(now=now):
                nonlocal following
                while following is not None and following[0] == now:
                    yield {"role": following[1] or "", "text": following[2] or ""}
                    following = next(rows, None)

            part, n, out, size, loss = 0, 0, [], 0, []
            for piece in render({"messages": Once(messages())}):
                text, masked = piece
                if ends_turn(piece):
                    n += 1
                    if n == part_turns:
                        ready.append((now, part, "".join(out), loss))
                        part, n, out, size, loss = part + 1, 0, [], 0, []
                    continue
                if masked and text:
                    if loss and loss[-1]["end"] == size and out:
                        loss[-1]["end"] += len(text)
                    else:
                        loss.append({"start": size, "end": size + len(text)})
                out.append(text)
                size += len(text)
            for _ in messages():  # turns that the template left unread
                pass
            if out or not part:
                ready.append((now, part, "".join(out), loss))
            if len(ready) >= 256:
                yield made(ready)
                ready = []
        if ready:
            yield made(ready)

    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        ids, parts, texts_, spans = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(parts, pa.int32()), pa.array(texts_, pa.string()), pa.array(spans, loss)], ["conv_id", "part", "formatted", "loss"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(turns.schema["conv_id"].dataType)
    dealt = turns.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, part int, formatted string, loss array<struct<start: long, end: long>>")


_TURN = re.compile(re.escape("<|im_start|>") + "(.*?)" + re.escape("<|im_sep|>") + "(.*?)" + re.escape("<|im_end|>"), re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the output of ``format_conversations``
    with the standard template, part by part."""
    import hashlib

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(formatted.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(s: list) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        state, done = None, []
        end = object()
        for row in chain((r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)), [end]):
            if state is not None and (row is end or row[1] == 0):
                done.append(made(state))
                state = None
            if done and (row is end or len(done) >= 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
                done = []
            if row is end:
                break
            conv, _, text, loss = row
            state = state or [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in _TURN.findall(text):
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
