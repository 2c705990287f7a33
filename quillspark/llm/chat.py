"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

Records come in many layouts (prompt and response, instruction with input and output,
message lists under several names).  A layout is known by its fingerprint: the hash of
the sorted nested field paths that a record fills (of lists, the fields that some element
fills; OPTIONAL ones don't count).  Each mapping declares its paths and,
for each turn it makes, where role and text come from; the fingerprint of a record picks
its mapping.  Everything is DataFrame expressions.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>`` and a line feed.  Inside
roles and texts ``<`` before ``|`` or ``\\`` gets a backslash after it, so no text can
hold a control string and the change can be undone: texts may say anything, control strings of this or
any other template included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillspark.llm.common import fresh

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TURN_TYPE = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class ListOf:
    """Turns from a list of structs.  ``role`` and ``text`` are paths inside an element; a text that is
    itself a list (``[]``) has its parts joined by blank lines.  ``renamed``: roles have the names of ROLES."""

    path: str
    role: str
    text: str
    renamed: bool = False

    def paths(self) -> tuple[str, ...]:
        return (f"{self.path}[]", f"{self.path}[].{self.role}", f"{self.path}[].{self.text}")


@dataclass(frozen=True)
class Fixed:
    """One turn of a fixed role from one or more fields, joined by blank lines."""

    role: str
    fields: tuple[str, ...]

    def paths(self) -> tuple[str, ...]:
        return self.fields


#: Fields of list elements that may be filled in every layout and make no turn.
OPTIONAL = {"name", "weight"}
#: The layouts: each mapping makes its turns in this order.
MAPPINGS: dict[str, tuple[ListOf | Fixed, ...]] = {
    "messages": (ListOf("messages", "role", "content"),),
    "messages_text": (ListOf("messages", "role", "text"),),
    "conversations": (ListOf("conversations", "from", "value", renamed=True),),
    "mapping_parts": (ListOf("mapping", "author.role", "content.parts[]"),),
    "system_messages": (Fixed("system", ("system",)), ListOf("messages", "role", "content")),
    "prompt_response": (Fixed("user", ("prompt",)), Fixed("assistant", ("response",))),
    "prompt_completion": (Fixed("user", ("prompt",)), Fixed("assistant", ("completion",))),
    "system_prompt_response": (Fixed("system", ("system",)), Fixed("user", ("prompt",)), Fixed("assistant", ("response",))),
    "question_answer": (Fixed("user", ("question",)), Fixed("assistant", ("answer",))),
    "instruction_output": (Fixed("user", ("instruction",)), Fixed("assistant", ("output",))),
    "instruction_input_output": (Fixed("user", ("instruction", "input")), Fixed("assistant", ("output",))),
    "data_prompt_response": (Fixed("user", ("data.prompt",)), Fixed("assistant", ("data.response",))),
}
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(paths: tuple[str, ...] | list[str]) -> str:
    """The fingerprint of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def mapping_fingerprints() -> dict[str, str]:
    return {fingerprint_of([p for s in sources for p in s.paths()]): name for name, sources in MAPPINGS.items()}


def _layouts() -> list[tuple[str, str]]:
    """(fingerprint, mapping): of full records, then of records with a list that fills less:
    an empty one, or one without any role or any text."""
    out = [(code, name) for code, name in mapping_fingerprints().items()]
    for name, sources in MAPPINGS.items():
        fixed = [p for s in sources if isinstance(s, Fixed) for p in s.paths()]
        for s in sources:
            if isinstance(s, ListOf):
                first, role, text = s.paths()
                out += [(fingerprint_of([*fixed, *some]), name) for some in ((first,), (first, role), (first, text))]
    return out


def _field(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _kind(schema: T.StructType, path: str) -> T.DataType | None:
    """The type at a path of nested structs and lists (``[]`` for the elements); None if there is none."""
    kind: T.DataType | None = schema
    for step in path.split("."):
        name = step.removesuffix("[]")
        kind = next((f.dataType for f in kind.fields if f.name == name), None) if isinstance(kind, T.StructType) else None
        if step.endswith("[]"):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else None
    return kind


def _filled(path: str, kind: T.DataType, some: Callable[[Callable[[Column], Column]], Column]) -> Iterator[Column]:
    """The paths from here on, each null unless filled.  ``some(p)``: whether p holds for a value at this path."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _filled(f"{path}.{f.name}", f.dataType, lambda p, f=f: some(lambda x: p(x[f.name])))
    elif isinstance(kind, T.ArrayType):
        yield F.when(some(lambda x: x.isNotNull()), F.lit(f"{path}[]"))
        for f in kind.elementType.fields if isinstance(kind.elementType, T.StructType) else ():
            if f.name not in OPTIONAL:
                yield from _filled(f"{path}[].{f.name}", f.dataType, lambda p, f=f: some(lambda x: F.exists(x, lambda y: p(y[f.name]))))
    else:
        yield F.when(some(lambda x: x.isNotNull()), F.lit(path))


def fingerprint(schema: T.StructType, columns: list[str]) -> Column:
    """The fingerprint of each row over the given columns: the nested paths that it fills.

    A null fills nothing; a struct fills what its fields fill; a list fills its own path and those
    that some element fills, at any depth.
    """
    paths = [p for name in columns for p in _filled(name, schema[name].dataType, lambda p, name=name: p(F.col(f"`{name}`")))]
    filled = F.array_sort(F.array_compact(F.array(*paths))) if paths else F.array().cast("array<string>")
    return F.substring(F.sha2(F.concat_ws("\n", filled), 256), 1, 16)


def _renamed(role: Column) -> Column:
    out = role
    for name, known in ROLES.items():
        out = F.when(F.lower(role) == name, known).otherwise(out)
    return out


def _inside(x: Column, path: str) -> Column:
    """The value at a path inside an element; the parts of a list joined by blank lines."""
    for step in path.split("."):
        x = x[step.removesuffix("[]")]
    return F.array_join(x, "\n\n") if path.endswith("[]") else x


def _turns(source: ListOf | Fixed) -> Column:
    if isinstance(source, Fixed):
        text = F.array_join(F.filter(F.array(*(_field(f) for f in source.fields)), lambda x: F.length(x) > 0), "\n\n")
        return F.array(F.struct(F.lit(source.role).alias("role"), text.alias("text")))

    def one(x: Column) -> Column:
        role = F.coalesce(_inside(x, source.role), F.lit(""))
        return F.struct((_renamed(role) if source.renamed else role).alias("role"), F.coalesce(_inside(x, source.text), F.lit("")).alias("text"))

    return F.transform(_field(source.path), one)


def canonical(records: DataFrame, columns: list[str]) -> DataFrame:
    """The records with ``turns`` (array of role and text) by the mapping that their fingerprint selects,
    ``layout`` (the mapping's name) and ``fingerprint``.

    A record of an unknown layout gets null turns and a null layout, and is kept.  Null
    texts in lists are empty texts; roles stay as they are but in layouts that name them otherwise.
    Equal records give equal turns.  A column that the records have is never replaced: an added
    column whose name is taken gets underscores after it.
    """
    code_col, layout_col, turns_col = (fresh(records, c) for c in ("fingerprint", "layout", "turns"))
    known = records.withColumn(code_col, fingerprint(records.schema, columns))
    layout, out = F.lit(None).cast("string"), F.lit(None).cast(TURN_TYPE)
    for code, name in reversed(_layouts()):
        sources = MAPPINGS[name]
        if all(p.split(".")[0].removesuffix("[]") in columns and _kind(records.schema, p) for s in sources for p in s.paths()):
            layout = F.when(F.col(code_col) == code, name).otherwise(layout)
            out = F.when(F.col(code_col) == code, F.concat(*(_turns(s) for s in sources)).cast(TURN_TYPE)).otherwise(out)
    return known.withColumn(turns_col, out).withColumn(layout_col, layout)


def escape(text: Column) -> Column:
    r"""``<|`` becomes ``<\|`` and ``<\`` becomes ``<\\``: afterwards no ``<|`` is left."""
    return F.regexp_replace(text, r"<(?=[|\\])", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(?=[|\\])", "<")


def format_turns(turns: Column) -> Column:
    """One string of all turns, every turn marked."""
    one = lambda t: F.concat(F.lit(TURN), escape(F.coalesce(t["role"], F.lit(""))), F.lit(TEXT), escape(F.coalesce(t["text"], F.lit(""))), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def parse_turns(formatted: Column) -> Column:
    """The turns read back from a formatted string."""

    def one(x: Column) -> Column:
        text = F.substring_index(x, TEXT, -1)
        return F.struct(unescape(F.substring_index(x, TEXT, 1)).alias("role"), unescape(F.left(text, F.length(text) - len(END))).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: F.length(x) > 0), one)


def loss_spans(formatted: Column) -> Column:
    """The spans (start, length in code points of the formatted string) under the loss mask:
    the texts of assistant turns."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: F.length(x) > 0)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        role = F.substring_index(x, TEXT, 1)
        start = state["at"] + len(TURN) + F.length(role) + len(TEXT)
        size = (F.length(x) - F.length(role) - len(TEXT) - len(END)).cast("long")
        span = F.struct(start.cast("long").alias("start"), size.alias("length"))
        spans = F.when(role == "assistant", F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + len(TURN) + F.length(x)).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(parts, begin, step, lambda s: s["spans"])


def format_chat(records: DataFrame, columns: list[str]) -> DataFrame:
    """The records with ``turns``, ``layout``, ``fingerprint``, ``formatted`` and ``loss`` (its loss spans).

    A record without turns has an empty string and no spans; one of an unknown layout
    null in both.  No rows give no rows; the record's other columns are carried, and a taken name
    gets underscores as in ``canonical``.
    """
    turns, formatted, loss = (fresh(records, c) for c in ("turns", "formatted", "loss"))
    done = canonical(records, columns).withColumn(formatted, format_turns(F.col(turns)))
    return done.withColumn(loss, loss_spans(F.col(formatted)))


def conversations_as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, messages): rows (conv_id, turn, role, text) gathered by turn.

    Ties in turn are ordered by role, then text; a null turn comes first.  A conversation
    is one record of the formatted output, so its turns meet in one row.
    """
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    ordered = F.array_sort(F.collect_list(turn), _by_turn)
    messages = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.groupBy("conv_id").agg(messages.alias("messages"))


def _by_turn(a: Column, b: Column) -> Column:
    def compare(name: str, otherwise: Column) -> Column:
        x, y = a[name], b[name]
        return (
            F.when(x.isNull() & y.isNull(), otherwise).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(otherwise)
        )

    return compare("turn", compare("role", compare("content", F.lit(0))))
