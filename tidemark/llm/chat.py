"""Chat formatting: records of unlike layouts become canonical turns, then one template.

A record's fingerprint is a hash of its nested field paths that hold a value, of those that some mapping names. Mappings declare the paths
they need and the paths that may be missing; the fingerprints of a mapping follow from that, taken over its own paths, so a further field of a message or a column of
another layout doesn't hide a record. The first mapping that a fingerprint selects converts it. All of it is column expressions: the paths come from the schema, their presence from the row.

The template writes ``### Role: text</turn>\\n`` per turn. Inside roles and texts a backslash is doubled and one is put
into ``###`` and ``</turn>``, so neither control string occurs in an escaped text and the output can be read back.

Defined results: a null text or role is empty; an unknown fingerprint gives no turns and a null ``layout``, and a conversation of such
records alone stays as a row whose formatted text is null; turns are
ordered by the order column, nulls last, then by role and text (repeated rows all stay); rows of a null conversation
form one conversation; an empty table gives no rows; columns that no mapping names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = "array<struct<role:string,text:string>>"
MARK, END = "### ", "</turn>\n"
KNOWN = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
#: Names under which the four roles appear in published chat data.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "function": "tool"}


@dataclass(frozen=True)
class Mapping:
    """``turns`` is an SQL expression of type ``TURN`` over the record's columns."""

    name: str
    needs: tuple[str, ...]
    turns: str
    may: tuple[str, ...] = field(default=())


def _turn(role: str, path: str) -> str:
    return f"struct('{role}' as role, cast({path} as string) as text)"


def _list(path: str, role: str, text: str) -> str:
    return f"transform({path}, m -> struct(cast(m.{role} as string) as role, cast(m.{text} as string) as text))"


def _some(*turns: tuple[str, str]) -> str:
    return "filter(array(" + ", ".join(_turn(*t) for t in turns) + "), t -> t.text is not null)"


MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), "concat(" + _some(("system", "system")) + ", " + _list("messages", "role", "content") + ")", ("system",)),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), "concat(" + _some(("system", "system")) + ", " + _list("conversations", "from", "value") + ")", ("system",)),
    Mapping("instruction", ("instruction", "output"), "filter(array(" + _turn("system", "system") + ", struct('user' as role, concat_ws('\\n\\n', instruction, nullif(input, '')) as text), "
            + _turn("assistant", "output") + "), t -> t.text is not null)", ("input", "system")),
    Mapping("prompt_completion", ("prompt", "completion"), _some(("system", "system"), ("user", "prompt"), ("assistant", "completion")), ("system",)),
    Mapping("question_answer", ("question", "answer"), _some(("user", "context"), ("user", "question"), ("assistant", "answer")), ("context",)),
    Mapping("turn_row", (), "array(struct(cast(role as string) as role, cast(text as string) as text))", ("role", "text")),
)


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, leaves only; ``[]`` marks the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    return [at]


def _quoted(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def _present(path: str) -> Column:
    """Whether the row has a value at a path; within an array, in any element."""
    head, *rest = path.split("[]")

    def there(value: Column, rest: list[str]) -> Column:
        if not rest:
            return value.isNotNull()

        def inside(e: Column) -> Column:
            for name in filter(None, rest[0].split(".")):
                e = e[name]
            return there(e, rest[1:])

        return F.exists(value, inside)

    return F.coalesce(there(F.expr(_quoted(head)), rest), F.lit(False))


def hash_of(found) -> int:
    value = xxhash.xxh64("\n".join(sorted(found)).encode(), seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


def fingerprint(records: DataFrame, ignored: tuple[str, ...] = ()) -> Column:
    """64-bit hash of the sorted nested field paths that hold a value in a record."""
    return _print(p for f in records.schema.fields if f.name not in ignored for p in paths(f.dataType, f.name))


def _print(names) -> Column:
    names = sorted(names)
    if not names:
        return F.xxhash64(F.lit(""))
    return F.xxhash64(F.concat_ws("\n", *(F.when(_present(p), F.lit(p)) for p in names)))


def canonical(records: DataFrame, ignored: tuple[str, ...] = (), mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The ignored columns, the fingerprint, the layout's name and the canonical turns of each record.

    Pass ids and order columns as ``ignored``, so that they don't count as fields; so should columns a corpus adds.
    """
    fields = {f.name: paths(f.dataType, f.name) for f in records.schema.fields if f.name not in ignored}
    known = {p for m in mappings for p in (*m.needs, *m.may)}
    fields = {name: own for name, own in fields.items() if set(own) & known}
    have = {p for own in fields.values() for p in own} & known
    out = records.select(*ignored, *fields).withColumn("fingerprint", _print(have))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURN)
    for m in reversed(mappings):  # the first one that fits stands
        may = [p for p in m.may if p in have]
        if not set(m.needs) <= have or not (m.needs or may):
            continue
        for p in {*m.may} - {*fields}:  # a field that the table lacks reads as null
            out = out if p in out.columns else out.withColumn(p, F.lit(None).cast("string"))
        codes = [hash_of((*m.needs, *some)) for k in range(len(may) + 1) for some in combinations(may, k) if m.needs or some]
        hit = _print((*m.needs, *may)).isin(codes)
        if not m.needs:  # a record without any value is one of its kind with nothing in it
            hit = hit | (F.col("fingerprint") == hash_of(()))
        layout, turns = F.when(hit, F.lit(m.name)).otherwise(layout), F.when(hit, F.expr(m.turns).cast(TURN)).otherwise(turns)
    turns = F.transform(turns, lambda t: F.struct(F.coalesce(_role(t["role"]), F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return out.select(*ignored, "fingerprint", layout.alias("layout"), turns.alias("turns"))


def _role(r: Column) -> Column:
    out = r
    for alias, name in ROLE_NAMES.items():
        out = F.when(r == alias, F.lit(name)).otherwise(out)
    return out


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\", r"\\\\")
    out = F.regexp_replace(out, r"#(?=##)", r"#\\")
    return F.regexp_replace(out, r"</turn>", r"<\\/turn>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    name = F.concat(F.lit("="), escape(F.regexp_replace(role, ":", "::")))
    for known, shown in KNOWN.items():
        name = F.when(role == known, F.lit(shown)).otherwise(name)
    return F.concat(F.lit(MARK), name, F.lit(": "))


def format_chats(turns: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """``conv``, the formatted text and its loss mask.

    ``turns`` has a row per record with its canonical ``turns``; records of a conversation follow each other by ``order``.
    The mask is ``segments``: the pieces of the formatted text in order, with ``loss`` true on assistant texts only.
    A conversation is gathered by its id, combined within each task before the shuffle; it is one row of the result,
    so one conversation has to fit a row, as its formatted text does.
    """
    n = len(order)
    one = turns.select(conv, *order, F.posexplode_outer("turns").alias("pos", "t"))
    keys = [k for i in range(n) for k in (F.col(order[i]).isNull().alias(f"n{i}"), F.col(order[i]).alias(f"o{i}"))]
    piece = F.struct(*keys, "pos", F.col("t.role").alias("role"), F.col("t.text").alias("text"))
    whole = one.groupBy(conv).agg(F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), piece))).alias("p"))
    shown = F.transform("p", lambda p: F.array(
        F.struct(_header(p["role"]).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(p["text"]).alias("text"), (p["role"] == "assistant").alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))
    out = whole.select(conv, F.flatten(shown).alias("segments"))
    return out.select(conv, F.when(F.size("segments") > 0, F.array_join(F.transform("segments", lambda s: s["text"]), "")).alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.slice(F.split(formatted, END), 1, F.greatest(F.size(F.split(formatted, END)) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        shown = F.regexp_extract(part, r"(?s)^### (=(?:[^:]|::)*|[A-Za-z]+): ", 1)
        role = F.regexp_replace(unescape(F.regexp_replace(shown, "^=", "")), "::", ":")
        for known, name in KNOWN.items():
            role = F.when(shown == name, F.lit(known)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.substr(part, F.length(shown) + len(MARK) + 3)).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
