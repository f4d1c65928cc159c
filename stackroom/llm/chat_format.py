"""Chat formatting: a small template language compiled to Python closures.

A template is parsed to a syntax tree, constants are folded, and the tree becomes closures. The
language is sandboxed: names are `message.role`, `message.text` and `message.turn`, string
constants, `+`, `==`, `!=`, `and`, `or`, `not` and parentheses; statements are `{{ expr }}`,
`{% if %}/{% elif %}/{% else %}/{% endif %}`, `{% for message in messages %}/{% endfor %}` and
`{% generation %}/{% endgeneration %}`. Nothing else parses: no calls, indexes or attributes.

Whatever comes from a message is escaped when it is printed: backslashes and the characters that
control strings begin with are written as a backslash and a letter, so a text never holds a control
string, and reading back is exact.

The loop's body depends on one message only, so a corpus is rendered turn by turn where the turns
lie: no conversation is gathered, however long it is. What a template has before or after the
loop becomes pieces of their own, one for each conversation.

Defined cases: null role or text is empty; turns sort by turn (nulls first), role, text; repeated
rows are turns of their own; a null conversation id is a conversation of its own; an empty table
gives no pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPLATE = "{% for message in messages %}{{ '### ' + message.role + ': ' }}{% if message.role == 'assistant' %}{% generation %}{{ message.text }}{% endgeneration %}{% else %}{{ message.text }}{% endif %}{{ ' </turn>' + '\\n' }}{% endfor %}"
#: Strings that steer reading.
CONTROL = ("### ", ": ", " </turn>\n")
#: How the backslash and the characters that control strings begin with (after blanks) are written inside texts and roles.
ESCAPES = {"\\": "\\\\", "#": "\\h", ":": "\\c", "<": "\\l"}
_SPECIAL = re.compile(r"[\\#:<]")
_ESCAPED = re.compile(r"\\([\\hcl])")
_ORIGINAL = {v[1]: k for k, v in ESCAPES.items()}
_TURN = re.compile(r"### ((?:[^\\#:<]|\\.)*): ((?:[^\\#:<]|\\.)*) </turn>\n", re.S)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _ORIGINAL[m[1]], text)


class TemplateError(ValueError):
    """The template doesn't parse or goes beyond the sandbox."""


# Syntax tree: ("const", s) ("field", name) ("add", a, b) ("eq", a, b) ("ne", a, b) ("and", a, b) ("or", a, b) ("not", a)
# ("print", e) ("if", [(condition, body)], otherwise) ("for", body) ("generation", body)
_LEXER = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<op>==|!=|\+|\(|\))|(?P<name>[A-Za-z_][\w.]*))", re.S)
_PART = re.compile(r"\{\{(.*?)\}\}|\{%\s*(.*?)\s*%\}", re.S)
_FIELDS = {"message.role", "message.text", "message.turn"}
_CONSTANT = {"n": "\n", "t": "\t"}


def _expression(source: str) -> tuple:
    found, at = [], 0
    while source[at:].strip():
        m = _LEXER.match(source, at)
        if not m:
            raise TemplateError(f"not understood: {source[at:]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    found.append(("end", ""))
    pos = 0

    def take(*wanted: str) -> str | None:
        nonlocal pos
        if found[pos][1] in wanted and found[pos][0] != "str":
            pos += 1
            return found[pos - 1][1]
        return None

    def binary(below: Callable[[], tuple], names: dict[str, str]) -> tuple:
        left = below()
        while op := take(*names):
            left = (names[op], left, below())
        return left

    def either() -> tuple:
        return binary(both, {"or": "or"})

    def both() -> tuple:
        return binary(negated, {"and": "and"})

    def negated() -> tuple:
        return ("not", negated()) if take("not") else compared()

    def compared() -> tuple:
        return binary(added, {"==": "eq", "!=": "ne"})

    def added() -> tuple:
        return binary(atom, {"+": "add"})

    def atom() -> tuple:
        nonlocal pos
        if take("("):
            inner = either()
            if not take(")"):
                raise TemplateError("a bracket stays open")
            return inner
        kind, value = found[pos]
        pos += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _CONSTANT.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name" and value in _FIELDS:
            return ("field", value.partition(".")[2])
        raise TemplateError(f"not allowed: {value!r}")

    out = either()
    if found[pos][0] != "end":
        raise TemplateError(f"not understood: {found[pos][1]!r}")
    return out


def parse(template: str) -> list[tuple]:
    """The template's syntax tree."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(template):
        parts += [("text", template[at : m.start()])] * (m.start() > at) + [("print", m[1]) if m[1] is not None else ("tag", m[2])]
        at = m.end()
    parts += [("text", template[at:])] * (at < len(template))
    pos = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal pos
        body: list[tuple] = []
        while pos < len(parts):
            kind, value = parts[pos]
            pos += 1
            if kind == "text":
                body.append(("print", ("const", value)))
            elif kind == "print":
                body.append(("print", _expression(value)))
            else:
                word = value.split()[0] if value.split() else ""
                if word in ends:
                    return body, value
                if word == "if":
                    cases, rest, tag = [], [], value
                    while tag.startswith(("if", "elif")):
                        inner, after = block("elif", "else", "endif")
                        cases.append((_expression(tag.partition(" ")[2]), inner))
                        tag = after
                    if tag == "else":
                        rest, _ = block("endif")
                    body.append(("if", cases, rest))
                elif value.split() == ["for", "message", "in", "messages"]:
                    inner, _ = block("endfor")
                    body.append(("for", inner))
                elif value == "generation":
                    inner, _ = block("endgeneration")
                    body.append(("generation", inner))
                else:
                    raise TemplateError(f"not allowed: {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, ""

    return block()[0]


def fold(node):
    """The tree with constant expressions worked out, constant conditions taken and constant prints joined."""
    if isinstance(node, list):
        out: list[tuple] = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if y == ("print", ("const", "")):
                    continue
                if out and y[0] == "print" == out[-1][0] and y[1][0] == "const" == out[-1][1][0]:
                    y = ("print", ("const", out.pop()[1][1] + y[1][1]))
                out.append(y)
        return out
    kind = node[0]
    if kind in ("add", "eq", "ne", "and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if kind == "add" and b[0] == "const" and a[0] == "add" and a[2][0] == "const":
            return ("add", a[1], ("const", a[2][1] + b[1]))
        if a[0] == b[0] == "const":
            return ("const", {"add": lambda x, y: x + y, "eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "and": lambda x, y: x and y, "or": lambda x, y: x or y}[kind](a[1], b[1]))
        return (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "print":
        return ("print", fold(node[1]))
    if kind == "if":
        cases: list[tuple] = []
        for c, body in node[1]:
            c, body = fold(c), fold(body)
            if c[0] == "const" and not c[1]:
                continue
            if c[0] == "const":
                return ("if", cases, body) if cases else body
            cases.append((c, body))
        rest = fold(node[2])
        return ("if", cases, rest) if cases else rest
    if kind in ("for", "generation"):
        return (kind, fold(node[1]))
    return node


Message = dict[str, str]


def _value(node) -> Callable[[Message, bool], object]:
    """raw is true inside a comparison, where texts are compared as they are."""
    kind = node[0]
    if kind == "const":
        c = node[1]
        return lambda m, raw: c
    if kind == "field":
        name = node[1]
        return lambda m, raw: m[name] if raw else escape(m[name])
    a = _value(node[1])
    if kind == "not":
        return lambda m, raw: not a(m, True)
    b = _value(node[2])
    return {
        "add": lambda m, raw: str(a(m, raw)) + str(b(m, raw)),
        "eq": lambda m, raw: a(m, True) == b(m, True),
        "ne": lambda m, raw: a(m, True) != b(m, True),
        "and": lambda m, raw: a(m, raw) and b(m, raw),
        "or": lambda m, raw: a(m, raw) or b(m, raw),
    }[kind]


Writer = Callable[[Message, list[str], list[list[int]], int], int]


def _writer(body: list[tuple]) -> Writer:
    """A closure that appends to the output and to the generation spans, and returns the length so far."""
    steps: list[Writer] = []
    for node in body:
        if node[0] == "print":

            def put(m, out, spans, at, value=_value(node[1])):
                s = str(value(m, False))
                out.append(s)
                return at + len(s)

            steps.append(put)
        elif node[0] == "if":

            def choose(m, out, spans, at, cases=[(_value(c), _writer(b)) for c, b in node[1]], rest=_writer(node[2])):  # noqa: B006
                for c, then in cases:
                    if c(m, True):
                        return then(m, out, spans, at)
                return rest(m, out, spans, at)

            steps.append(choose)
        elif node[0] == "generation":

            def mark(m, out, spans, at, inner=_writer(node[1])):
                end = inner(m, out, spans, at)
                if end > at:
                    spans.append([at, end])
                return end

            steps.append(mark)
        else:
            raise TemplateError("a loop can't stand inside another statement")

    def run(m, out, spans, at):
        for step in steps:
            at = step(m, out, spans, at)
        return at

    return run


@dataclass
class Template:
    """Compiled: what stands before the loop, for each message, and after it."""

    before: Writer
    each: Writer
    after: Writer
    bare: bool  #: nothing stands outside the loop

    @staticmethod
    def compile(source: str) -> Template:
        tree = fold(parse(source))
        loops = [i for i, x in enumerate(tree) if x[0] == "for"]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages")
        k = loops[0]
        outside = [*tree[:k], *tree[k + 1 :]]
        if re.search(r"\('field'", repr(outside)):
            raise TemplateError("a message stands outside the loop")
        return Template(_writer(tree[:k]), _writer(tree[k][1]), _writer(tree[k + 1 :]), not outside)

    def piece(self, message: Message | None, phase: int = 1) -> tuple[str, list[list[int]]]:
        """One message's text and its generation spans; phase 0 and 2: what stands around the loop."""
        out: list[str] = []
        spans: list[list[int]] = []
        (self.before, self.each, self.after)[phase](message or {}, out, spans, 0)
        return "".join(out), spans

    def render(self, messages: list[Message]) -> tuple[str, list[list[int]]]:
        """A whole conversation's text and generation spans."""
        text, marks = "", []
        for phase, m in [(0, None), *((1, m) for m in messages), (2, None)]:
            piece, spans = self.piece(m, phase)
            marks += [[a + len(text), b + len(text)] for a, b in spans]
            text += piece
        return text, marks


def format_turns(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Pieces (conv_id, phase, turn, role, text, piece, spans): in order of all but the last two, a conversation's pieces are its text."""
    Template.compile(template)  # fails here rather than in a task
    own = rows.select("conv_id", F.lit(1).alias("phase"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not Template.compile(template).bare:
        around = rows.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit(0), F.lit(2))).alias("phase"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
        own = own.unionByName(around)
    schema = T.StructType([*own.schema.fields, T.StructField("piece", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = Template.compile(template)
        for pdf in batches:
            made = [compiled.piece({"role": r, "text": t, "turn": "" if pd.isna(k) else str(int(k))}, p) for p, k, r, t in zip(pdf["phase"], pdf["turn"], pdf["role"], pdf["text"], strict=True)]
            yield pdf.assign(turn=pdf["turn"].astype("Int64"), piece=[x for x, _ in made], spans=[y for _, y in made])

    return own.mapInPandas(render, schema)


def read_whole_turns(text: str) -> tuple[list[tuple[str, str]], str]:
    """Role and text of the turns that a text made by the template above begins with, and what follows the last whole one."""
    out, at = [], 0
    while at < len(text) and (m := _TURN.match(text, at)):
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out, text[at:]


def read_turns(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a whole text made by the template above."""
    out, rest = read_whole_turns(text)
    if rest:
        raise ValueError(f"no turn at character {len(text) - len(rest)}")
    return out


def digest(pieces: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its pieces: counts and digests of turns and of the text under the loss mask.

    A digest is made front to back, so a conversation's pieces pass through one task, but sorted and
    streamed: the task holds a piece, the running digests and what isn't a whole turn yet. Turns are
    read from the joined text, whatever piece they were rendered in; text that is no turn is refused.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    order = ["conv_id", "phase", "turn", "role", "text"]
    ordered = pieces.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "piece", "spans")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        held = None

        def row() -> tuple:
            read_turns(held["rest"])
            return held["id"], held["n"], held["turns"].hexdigest(), held["chars"], held["loss"].hexdigest(), held["all"]

        for pdf in batches:
            done = []
            for conv, piece, spans in zip(pdf["conv_id"].astype("Int64").astype(object).where(pdf["conv_id"].notna(), None), pdf["piece"], pdf["spans"], strict=True):
                if held is None or held["id"] != conv:
                    if held is not None:
                        done.append(row())
                    held = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0, "rest": ""}
                turns, held["rest"] = read_whole_turns(held["rest"] + piece)
                for role, text in turns:
                    held["n"] += 1
                    held["turns"].update(f"{role}\n{text}\n".encode())
                for a, b in spans:
                    lost = unescape(piece[a:b])
                    held["chars"] += len(lost)
                    held["loss"].update(lost.encode())
                held["all"] += len(piece)
            if done:
                yield pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})
        if held is not None:
            yield pd.DataFrame([row()], columns=names).astype({"conv_id": "Int64"})

    return ordered.mapInPandas(run, schema)
