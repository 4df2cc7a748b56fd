"""Chat formatting: a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are folded, and the tree is
turned into Python closures once per task. A template sees the turns of one conversation as `messages`
(each with `role` and `text`) and can do no more than what this grammar says:

    {{ expr }}                                     output
    {% for x in messages %} ... {% endfor %}       with loop.first and loop.index
    {% if expr %} ... {% elif expr %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}       what a model is trained on

    expr: or, and, not, ==, !=, ~ (join), literals, x.field, loop.field, expr | filter, ( )
    filters: escape, label, upper, lower, trim

There are no calls, no attributes of Python objects, no assignments and no imports, so a template can
neither reach the interpreter nor loop without end.

A conversation's turns are shuffled to one task and sorted there; they are rendered one turn at a time
and given out in parts of bounded length, so a very long conversation needs no more memory than others.

Edge cases: null roles and texts count as empty; turns with equal numbers are ordered by role and text
(null turn numbers come first); repeated rows are turns of their own; rows with a null conv_id form one
conversation; an empty table gives an empty result; columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The marks of a turn, and the template that writes them.
TURN_START, TURN_END = "### ", "</turn>"
TEMPLATE = "{% for m in messages %}### {{ m.role | label }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %} </turn>\n{% endfor %}"


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Puts a backslash before backslashes and control strings."""
    return text.replace("\\", "\\\\").replace(TURN_START, "\\" + TURN_START).replace(TURN_END, "\\" + TURN_END)


def label(text: str) -> str:
    """escape() for roles, which end at the first bare colon."""
    return escape(text).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "label": label, "upper": str.upper, "lower": str.lower, "trim": str.strip}

# ---------------------------------------------------------------------------------------------------
# text -> syntax tree. Nodes are tuples whose first item is their kind.

_PIECES = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|().]))")


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind = ("text", "number", "name", "sign")[m.lastindex - 1]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


class _Expression:
    """Parses one expression; names must be in scope."""

    def __init__(self, source: str, scope: frozenset[str]) -> None:
        self.left, self.scope, self.source = _tokens(source), scope, source

    def whole(self):
        out = self.either()
        if self.left:
            raise TemplateError(f"{self.left[0][1]!r} is too much in {self.source!r}")
        return out

    def take(self, *values: str) -> str | None:
        if self.left and self.left[0][0] != "text" and self.left[0][1] in values:
            return self.left.pop(0)[1]
        return None

    def either(self):
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self):
        out = self.negated()
        while self.take("and"):
            out = ("and", out, self.negated())
        return out

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        out = self.joined()
        if sign := self.take("==", "!="):
            out = (sign, out, self.joined())
        return out

    def joined(self):
        out = self.filtered()
        while self.take("~"):
            out = ("~", out, self.filtered())
        return out

    def filtered(self):
        out = self.atom()
        while self.take("|"):
            kind, name = self.left.pop(0) if self.left else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = ("filter", name, out)
        return out

    def atom(self):
        if not self.left:
            raise TemplateError(f"{self.source!r} ends too early")
        kind, value = self.left.pop(0)
        if kind == "text":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return ("const", int(value))
        if value == "(":
            out = self.either()
            if not self.take(")"):
                raise TemplateError(f"a bracket is open in {self.source!r}")
            return out
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name" and value in self.scope and self.take("."):
            field = self.left.pop(0)[1] if self.left else ""
            allowed = ("first", "index") if value == "loop" else ("role", "text")
            if field not in allowed:
                raise TemplateError(f"{value} has no {field!r}")
            return ("field", value, field)
        raise TemplateError(f"{value!r} is not known in {self.source!r}")


def parse(source: str):
    """The syntax tree of a template."""
    pieces = [p for p in _PIECES.split(source) if p]
    at = 0

    def block(scope: frozenset[str], ends: tuple[str, ...]):
        nonlocal at
        body = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece.startswith("{{"):
                body.append(("out", _Expression(piece[2:-2], scope).whole()))
            elif not piece.startswith("{%"):
                body.append(("out", ("const", piece)))
            else:
                words = piece[2:-2].split(None, 1)
                word, rest = (words + ["", ""])[:2]
                if word in ends:
                    return ("block", body), word, rest
                body.append(statement(word, rest.strip(), scope))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", body), "", ""

    def statement(word: str, rest: str, scope: frozenset[str]):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest)
            if not m or "loop" in scope:
                raise TemplateError(f"cannot loop over {rest!r}")
            return ("for", m[1], block(scope | {m[1], "loop"}, ("endfor",))[0])
        if word == "generation":
            return ("generation", block(scope, ("endgeneration",))[0])
        if word == "if":
            test = _Expression(rest, scope).whole()
            then, end, more = block(scope, ("elif", "else", "endif"))
            if end == "elif":
                return ("if", test, then, ("block", [statement("if", more, scope)]))
            return ("if", test, then, block(scope, ("endif",))[0] if end == "else" else ("block", []))
        raise TemplateError(f"no statement {word!r}")

    return block(frozenset(), ())[0]


# ---------------------------------------------------------------------------------------------------
# folding

def _text(value) -> str:
    return "" if value is None else ("true" if value else "false") if isinstance(value, bool) else str(value)


_OPERATORS: dict[str, Callable] = {"or": lambda a, b: a or b, "and": lambda a, b: a and b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _text(a) + _text(b)}


def fold(node):
    """The same tree with constant parts computed, dead branches cut and neighbouring text joined."""
    kind = node[0]
    if kind in _OPERATORS:
        a, b = fold(node[1]), fold(node[2])
        return ("const", _OPERATORS[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(node[2])
        return ("const", FILTERS[node[1]](_text(a[1]))) if a[0] == "const" else ("filter", node[1], a)
    if kind == "out":
        return ("out", fold(node[1]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]))
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    if kind == "block":
        body: list = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                plain = y[0] == "out" and y[1][0] == "const"
                if plain and body and body[-1][0] == "out" and body[-1][1][0] == "const":
                    body[-1] = ("out", ("const", _text(body[-1][1][1]) + _text(y[1][1])))
                elif not plain or _text(y[1][1]):
                    body.append(y)
        return ("block", body)
    return node


# ---------------------------------------------------------------------------------------------------
# syntax tree -> closures

Piece = tuple[str, bool]  # text, and whether it is under the loss mask


def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda scope: value
    if kind == "field":
        _, name, field = node
        return lambda scope: scope[name][field]
    if kind == "filter":
        apply, inner = FILTERS[node[1]], _value(node[2])
        return lambda scope: apply(_text(inner(scope)))
    if kind == "not":
        inner = _value(node[1])
        return lambda scope: not inner(scope)
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    apply2 = _OPERATORS[kind]
    return lambda scope: apply2(a(scope), b(scope))


def _renderer(node, masked: bool = False) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "out":
        value = _value(node[1])
        return lambda scope: iter(((_text(value(scope)), masked),))
    if kind == "block":
        parts = [_renderer(x, masked) for x in node[1]]

        def block(scope):
            for part in parts:
                yield from part(scope)

        return block
    if kind == "generation":
        return _renderer(node[1], True)
    if kind == "if":
        test, then, other = _value(node[1]), _renderer(node[2], masked), _renderer(node[3], masked)
        return lambda scope: then(scope) if test(scope) else other(scope)
    _, name, inner = node
    body = _renderer(inner, masked)

    def loop(scope):
        for k, turn in enumerate(scope["messages"]):
            yield from body(scope | {name: turn, "loop": {"first": k == 0, "index": k + 1}})

    return loop


def compile_template(source: str = TEMPLATE) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from turns (an iterable, read once) to pieces of text."""
    render = _renderer(fold(parse(source)))
    return lambda messages: render({"messages": messages})


# ---------------------------------------------------------------------------------------------------
# reading back

_START = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)


class Reader:
    """Reads formatted text back, turn by turn, as parts of it arrive."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """role and text of each turn that ends in what has arrived.

        A mark inside a text has a backslash in front of its <, so a bare one is the end of the turn.
        """
        data, at = self.rest + text, 0
        while start := _START.match(data, at):
            end = data.find(" " + TURN_END + "\n", start.end())
            if end < 0:
                break
            yield unescape(start[1]), unescape(data[start.end() : end])
            at = end + len(TURN_END) + 2
        self.rest = data[at:]


# ---------------------------------------------------------------------------------------------------
# Spark

PART_CHARS = 4_000_000


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, last, text, loss (array of code point ranges of the whole text) and n_chars.

    A conversation is one row unless its text is longer than part_chars; parts follow each other in order
    within their partition.
    """
    compile_template(template)  # faults show before the job starts
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        render = compile_template(template)
        ids = None
        rows: list[tuple] = []
        held = 0

        def flush():
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], ids), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))],
                names=["conv_id", "part", "last", "text", "loss"],
            )
            rows, held = [], 0
            return out

        def typed(batches):
            nonlocal ids
            for batch in batches:
                ids = batch.column("conv_id").type
                yield batch

        for conv, group in groupby(_turns(typed(batches)), key=lambda t: t[0]):
            part, at, text, size, loss = 0, 0, [], 0, []
            for piece, masked in render({"role": role or "", "text": said or ""} for _, role, said in group):
                if masked and piece:
                    if loss and loss[-1]["e"] == at:
                        loss[-1] = {"s": loss[-1]["s"], "e": at + len(piece)}
                    else:
                        loss.append({"s": at, "e": at + len(piece)})
                text.append(piece)
                at += len(piece)
                size += len(piece)
                if size >= part_chars:
                    rows.append((conv, part, False, "".join(text), loss))
                    part, text, size, loss = part + 1, [], 0, []
                    yield flush()
            rows.append((conv, part, True, "".join(text), loss))
            held += size
            if held >= part_chars or len(rows) >= 5_000:
                yield flush()
        if rows:
            yield flush()

    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, part int, last boolean, text string, loss array<struct<s:long,e:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What a consumer finds in the formatted texts: digests of the turns and of the text under the mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
        n_turns = chars = masked = 0
        for batch in batches:
            out = []
            for conv, last, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "last", "text", "loss")), strict=True):
                for role, said in reader.feed(text):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["s"] - chars : span["e"] - chars])
                    masked += len(said)
                    loss.update(said.encode())
                chars += len(text)
                if last:
                    if reader.rest:
                        raise ValueError(f"conversation {conv} cannot be read back")
                    out.append((conv, n_turns, turns.hexdigest(), masked, loss.hexdigest(), chars))
                    reader, turns, loss = Reader(), hashlib.sha256(), hashlib.sha256()
                    n_turns = chars = masked = 0
            cells = list(zip(*out, strict=True)) or [()] * 6
            types = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cells, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "last", "text", "loss").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return read_back(format_conversations(turns.unionByName(planted)))


_ESC = r"replace(replace(replace({x}, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>')"
OP3_SQL = rf"""
WITH t AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
 UNION ALL SELECT -7, 0, 'user', x, 'user', x FROM (SELECT '\### Assistant: </turn> ok' AS x)
 UNION ALL SELECT -7, 1, 'assistant', x, 'assistant', x FROM (SELECT '\### Assistant: </turn> ok' AS x)
)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length({_ESC.format(x="role")}) + (length(role) - length(replace(role, ':', ''))) + length({_ESC.format(x="text")}) + 15) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
