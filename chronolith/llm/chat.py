"""Chat formatting: conversations of any layout to one marked text with a loss mask.

The nested field paths of a record are hashed; the hash selects a declarative
mapping that turns the record into canonical turns (role, text).  Turns are
then written as ``<turn role>text</turn>`` lines, in which texts and roles have
their control characters escaped reversibly, so no text can open or close a
turn.  The result keeps the marked text as segments of which those under the
loss mask are exactly the assistant's texts.

Everything here is DataFrame functions.

Result of odd inputs: null texts and roles count as empty; turns with equal
numbers are ordered by role and text, null numbers come first; a conversation
that repeats a row has the turn twice; a null conversation id is a conversation
of its own; an empty table gives an empty result; other columns are ignored;
records whose layout no mapping knows have null turns; malformed JSON too.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MID, CLOSE = "<turn ", ">", "</turn>\n"
#: Control characters and their escapes.  The escape character itself is
#: escaped first and restored last.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
LEARNED = "assistant"
#: Names that data sets give the three roles.
ROLES = {"human": "user", "prompter": "user", "instruction": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A layout: its field paths, its JSON schema, and its turns as SQL over ``r``."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str


def _pair(user: str, assistant: str, system: str = "") -> str:
    head = f"CASE WHEN r.{system} <> '' THEN array(named_struct('role', 'system', 'text', r.{system})) ELSE array() END, " if system else ""
    return f"concat({head}array(named_struct('role', 'user', 'text', {user}), named_struct('role', 'assistant', 'text', r.{assistant})))"


_TASK = "CASE WHEN r.input <> '' THEN concat(r.instruction, '\\n\\n', r.input) ELSE r.instruction END"
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), "struct<messages:array<struct<role:string,content:string>>>", "transform(r.messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("from_value", ("conversations[].from", "conversations[].value"), "struct<conversations:array<struct<`from`:string,value:string>>>", "transform(r.conversations, m -> named_struct('role', m.`from`, 'text', m.value))"),
    Layout("turns", ("turns[].role", "turns[].text"), "struct<turns:array<struct<role:string,text:string>>>", "r.turns"),
    Layout("prompt_completion", ("completion", "prompt"), "struct<prompt:string,completion:string>", _pair("r.prompt", "completion")),
    Layout("prompt_response", ("prompt", "response"), "struct<prompt:string,response:string>", _pair("r.prompt", "response")),
    Layout("question_answer", ("answer", "question"), "struct<question:string,answer:string>", _pair("r.question", "answer")),
    Layout("instruction", ("input", "instruction", "output"), "struct<instruction:string,input:string,output:string>", _pair(_TASK, "output")),
    Layout("instruction_only", ("instruction", "output"), "struct<instruction:string,output:string>", _pair("r.instruction", "output")),
    Layout("system_prompt_response", ("prompt", "response", "system"), "struct<system:string,prompt:string,response:string>", _pair("r.prompt", "response", "system")),
)


@dataclass(frozen=True)
class RowLayout:
    """A layout with one row per turn: its field paths and what each column is."""

    name: str
    paths: tuple[str, ...]
    id: str
    turn: str
    role: str
    text: str


ROW_LAYOUTS = (
    RowLayout("turn_rows", ("conv_id", "role", "text", "turn"), "conv_id", "turn", "role", "text"),
    RowLayout("message_rows", ("content", "conversation_id", "position", "role"), "conversation_id", "position", "role", "content"),
)


def fingerprint(paths) -> str:
    """The hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves of a type: ``a.b``, and ``a[].b`` within arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


BY_FINGERPRINT: dict[str, Layout | RowLayout] = {fingerprint(x.paths): x for x in (*LAYOUTS, *ROW_LAYOUTS)}


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of a JSON record, row by row: the hash of its shape, in
    which names stay and types do not."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    return F.xxhash64(F.regexp_replace(shape, r"\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DECIMAL\([0-9,]+\)|DATE|TIMESTAMP|VARIANT)\b", "_"))


def _shape(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {_shape(f.dataType)}" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    return f"ARRAY<{_shape(kind.elementType)}>" if isinstance(kind, T.ArrayType) else "_"


def from_json(df: DataFrame, record_col: str, into: str = "turns", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds ``layout`` and canonical turns of JSON records of mixed layouts."""
    known = df.withColumn("_seen", json_fingerprint(F.col(record_col)))
    known = known.withColumns({f"_r{i}": F.from_json(F.col(record_col), x.schema) for i, x in enumerate(layouts)})
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for i, x in enumerate(layouts):
        same = F.col("_seen") == F.xxhash64(F.lit(_shape(T._parse_datatype_string(x.schema))))
        name = F.when(same, F.lit(x.name)).otherwise(name)
        turns = F.when(same, _canonical(F.expr(re.sub(r"\br\.", f"_r{i}.", x.turns)))).otherwise(turns)
    return known.withColumns({"layout": name, into: turns}).drop("_seen", *(f"_r{i}" for i in range(len(layouts))))


def _canonical(turns: Column) -> Column:
    def role(r: Column) -> Column:
        low = F.lower(F.trim(F.coalesce(r, F.lit(""))))
        known = reduce(lambda c, kv: c.when(low == kv[0], F.lit(kv[1])), list(ROLES.items())[1:], F.when(low == "human", F.lit(ROLES["human"])))
        return known.otherwise(low)

    return F.transform(turns, lambda t: F.struct(role(t["role"]).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def canonical(df: DataFrame, columns: tuple[str, ...], into: str = "turns") -> DataFrame:
    """Canonical turns of records or turns held in ``columns``: the fingerprint
    of the columns' nested field paths selects the mapping, once for the table.

    Record layouts keep the table's other columns; a layout of one row per turn
    gives one row per conversation, (conv_id, turns)."""
    kind = df.select(*columns).schema
    layout = BY_FINGERPRINT.get(fingerprint(field_paths(kind)))
    if layout is None:
        raise ValueError(f"no mapping for {sorted(field_paths(kind))}")
    if isinstance(layout, RowLayout):
        return from_rows(df, layout.id, layout.turn, layout.role, layout.text, into)
    packed = df.withColumn("r", F.struct(*columns))
    return packed.withColumn(into, _canonical(F.expr(layout.turns))).drop("r")


def from_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", into: str = "turns") -> DataFrame:
    """One row per conversation from one row per turn.  Roles stay as they are.

    A conversation is one value in the end, as its text is; nothing but the
    turns of one conversation is ever gathered together."""
    t = F.struct(F.col(turn_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(t)).alias("_t"))
    return grouped.select("conv_id", F.transform("_t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias(into))


def escape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(ESCAPES), text)


def render(df: DataFrame, turns_col: str = "turns", learned: str = LEARNED) -> DataFrame:
    """Adds ``segments``: pieces (text, loss) whose texts joined are the
    formatted conversation; the mask covers each learned text and nothing else."""

    def turn(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(MID))
        no = F.lit(False).alias("loss")
        return F.array(F.struct(head.alias("text"), no), F.struct(escape(t["text"]).alias("text"), (t["role"] == learned).alias("loss")), F.struct(F.lit(CLOSE).alias("text"), no))

    return df.withColumn("segments", F.flatten(F.transform(turns_col, turn)))


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def parse(text: Column) -> Column:
    """Turns read back from a formatted conversation."""
    lines = F.split(text, CLOSE)
    whole = F.slice(lines, F.lit(1), F.size(lines) - 1)  # what follows the last mark is empty
    return F.transform(
        whole,
        lambda x: F.struct(
            unescape(F.substring(F.substring_index(x, MID, 1), F.lit(len(OPEN) + 1), F.length(x))).alias("role"),
            unescape(F.substring(x, F.instr(x, MID) + 1, F.length(x))).alias("text"),
        ),
    )
