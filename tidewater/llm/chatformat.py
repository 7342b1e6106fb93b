"""Chat formatting by schema fingerprinting.

Conversations come as JSON records of any layout, or as tables with a row per
turn.  The nested field paths (names and nesting, not types) are hashed - of a
record those of its JSON, per row; of a table those of its schema - and the
hash selects a declarative mapping that turns the layout into canonical
turns (role, text).  Turns are then written in one template

    <s>[ROLE]role[/ROLE]text</s>

per turn.  Inside roles and texts every ``<``, ``[`` and ``\\`` is followed by
an inserted ``\\``, so no control string of this or a similar template
survives in a text, and taking the inserted character out restores it.  The
loss mask is a list of (start, length) spans in code points, one per
assistant text.

Only DataFrame functions.  Work is row-local after a conversation's rows
have been put together; a conversation is one record, the unit of output.

Defined results: null role or text is empty; rows of one conversation are
ordered by turn (nulls first), then role and text; repeated rows are repeated
turns; a null conv_id is one conversation; a record with an unknown
fingerprint has layout null and no turns; one that the parser does not read
(no JSON, or beyond the parser's limits: 20,000,000 characters a string, the
size of a variant) has also ``unread`` true; a table of an unknown layout is
an error; an empty table gives no rows; fields that belong to no layout are
not read.  Conversations given as rows are not parsed: they are bounded by
what Spark holds in one row (under 2 GB), beyond which Spark fails.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: turns of a conversation that came as rows, and the fingerprint and layout of its table
MESSAGES, TABLE_PRINT, TABLE_LAYOUT = "_cf_messages", "_cf_print", "_cf_layout"


class Layout(NamedTuple):
    """Field paths of a layout and where its turns are.

    ``listed``: (path, role field, text field) of an array of messages, after
    the single ``fields``: (role, path) pairs in order.  ``roles`` renames.
    """
    name: str
    shapes: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", ("OBJECT<messages: ARRAY<OBJECT<content, role>>>", "OBJECT<messages: ARRAY<>>"),
           listed=("$.messages", "role", "content")),
    Layout("system_messages", ("OBJECT<messages: ARRAY<OBJECT<content, role>>, system>",),
           fields=(("system", "$.system"),), listed=("$.messages", "role", "content")),
    Layout("from_value", ("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "OBJECT<conversations: ARRAY<>>"),
           listed=("$.conversations", "from", "value"), roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt_response", ("OBJECT<prompt, response>",), fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("prompt_completion", ("OBJECT<completion, prompt>",), fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("question_answer", ("OBJECT<answer, question>",), fields=(("user", "$.question"), ("assistant", "$.answer"))),
    Layout("instruction", ("OBJECT<instruction, output>",), fields=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", ("OBJECT<input, instruction, output>",),
           fields=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("system_prompt_response", ("OBJECT<prompt, response, system>",),
           fields=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
)

class RowLayout(NamedTuple):
    """Paths of a table's fields: the conversation a row belongs to, its order in it, role and text; ``roles`` renames."""
    name: str
    conversation: str
    order: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> tuple[str, ...]:
        return self.conversation, self.order, self.role, self.text


ROW_LAYOUTS = (
    RowLayout("turn_rows", "conv_id", "turn", "role", "text"),
    RowLayout("content_rows", "conversation_id", "position", "role", "content"),
    RowLayout("from_value_rows", "id", "index", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    RowLayout("message_rows", "conv_id", "turn", "message.role", "message.content"),
    RowLayout("author_rows", "conversation.id", "turn", "author.role", "content.text"),
)

_SCALAR = r": (?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID|VARIANT|DECIMAL\([0-9]+,[0-9]+\))(?=[,>])"


def field_paths(record: Column) -> Column:
    """The record's nested field names without value types, keys in order."""
    shape = F.schema_of_variant(record)
    return F.regexp_replace(F.replace(shape, F.lit("ARRAY<VOID>"), F.lit("ARRAY<>")), _SCALAR, "")


def schema_paths(schema: T.StructType, above: str = "") -> list[str]:
    """Nested field paths of a table, without types, in order."""
    out = []
    for f in schema.fields:
        out += schema_paths(f.dataType, f"{above}{f.name}.") if isinstance(f.dataType, T.StructType) else [above + f.name]
    return sorted(out)


def row_layout(schema: T.StructType, layouts=ROW_LAYOUTS) -> tuple[str, RowLayout]:
    """(fingerprint, layout) of a table of turns: by the hash of all its paths, or of those that some layout knows,
    or of a layout's own among them (the first layout that is all there)."""
    paths = schema_paths(schema)
    by_hash = {_sha(",".join(sorted(lay.paths()))): lay for lay in reversed(layouts)}
    known = {p for lay in layouts for p in lay.paths()}
    tried = [paths, [p for p in paths if p in known], *[sorted(lay.paths()) for lay in layouts if set(lay.paths()) <= set(paths)]]
    for fingerprint in (_sha(",".join(t)) for t in tried):
        if fingerprint in by_hash:
            return fingerprint, by_hash[fingerprint]
    raise ValueError(f"no layout for a table with the fields {paths}")


def canonical_turns(records: DataFrame, *, record: str = "record", layouts=LAYOUTS) -> DataFrame:
    """Add ``fingerprint``, ``layout``, ``unread`` and ``turns`` to rows with a JSON text column.

    Conversations of ``records_of`` (``MESSAGES`` is there and not null) bring turns, fingerprint and layout of their table.
    """
    from_rows = MESSAGES in records.columns
    given, table_print, table_layout = ((F.col(MESSAGES), F.col(TABLE_PRINT), F.col(TABLE_LAYOUT)) if from_rows
                                        else (F.lit(None).cast(TURNS), F.lit(None).cast("string"), F.lit(None).cast("string")))
    rows = records.withColumn("_cf_v", F.try_parse_json(F.col(record)))
    rows = rows.withColumn("fingerprint", F.coalesce(table_print, F.sha2(field_paths(F.col("_cf_v")), 256)))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for lay in reversed(layouts):
        hit = F.col("fingerprint").isin([_sha(s) for s in lay.shapes])
        got = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.try_variant_get("_cf_v", p, "string"), F.lit("")).alias("text"))
                        for r, p in lay.fields]).cast(TURNS) if lay.fields else F.array().cast(TURNS)
        if lay.listed:
            path, role, text = lay.listed
            kind = f"array<struct<`{role}`:string,`{text}`:string>>"
            found = F.coalesce(F.try_variant_get("_cf_v", path, kind), F.array().cast(kind))
            got = F.concat(got, F.transform(found, _message(role, text, lay.roles)).cast(TURNS))
        name = F.when(hit, F.lit(lay.name)).otherwise(name)
        turns = F.when(hit, got).otherwise(turns)
    unread = given.isNull() & F.col(record).isNotNull() & F.col("_cf_v").isNull()
    return rows.withColumns({"layout": F.coalesce(table_layout, name), "unread": unread, "turns": F.coalesce(given, turns)}).drop("_cf_v")


def _message(role: str, text: str, roles):
    def turn(m):
        r = F.coalesce(m[role], F.lit(""))
        for a, b in roles:
            r = F.when(r == a, F.lit(b)).otherwise(r)
        return F.struct(r.alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))
    return turn


def _sha(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()


def escape(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


_OPEN, _MID, _CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
_RUN = 64
_CUT = 2048


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often the lambda reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _starts(lengths: Column) -> Column:
    """Exclusive running sums of an array, over runs of ``_RUN`` so that long conversations stay near linear."""
    zero = F.lit(0).cast("long")
    add = lambda a, b: a + b
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int")),
                       lambda r: F.aggregate(F.slice(lengths, r * _RUN + 1, F.lit(_RUN)), zero, add))
    bases = lambda sums: F.transform(sums, lambda _, i: F.aggregate(F.slice(sums, F.lit(1), i), zero, add))
    start = lambda base: F.transform(lengths, lambda _, i: F.get(base, F.floor(i / _RUN).cast("int")) + F.aggregate(
        F.slice(lengths, (F.floor(i / _RUN) * _RUN).cast("int") + 1, (i % _RUN).cast("int")), zero, add))
    return F.when(F.size(lengths) > 0, _let(runs, lambda sums: _let(bases(sums), start))).otherwise(F.array().cast("array<long>"))


def formatted(rows: DataFrame, *, trained_role: str = "assistant") -> DataFrame:
    """Add ``formatted`` and ``loss_spans`` (array of struct<start, length>, code points, from 0) to rows with ``turns``."""
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(_OPEN), escape(t["role"]), F.lit(_MID)).alias("head"), escape(t["text"]).alias("body"),
        (t["role"] == trained_role).alias("trained")))

    def write(p):
        lengths = F.transform(p, lambda x: (F.char_length(x["head"]) + F.char_length(x["body"]) + len(_CLOSE)).cast("long"))
        spans = lambda at: F.filter(F.transform(p, lambda x, i: F.when(x["trained"], F.struct(
            (F.get(at, i) + F.char_length(x["head"])).alias("start"), F.char_length(x["body"]).alias("length")))),
            lambda s: s.isNotNull())
        return F.struct(F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(_CLOSE))), "").alias("formatted"),
                        _let(lengths, lambda n: _let(_starts(n), spans)).alias("loss_spans"))

    rows = rows.withColumn("_cf", _let(pieces, write))
    return rows.withColumns({"formatted": F.col("_cf.formatted"), "loss_spans": F.col("_cf.loss_spans")}).drop("_cf")


def read_back(rows: DataFrame) -> DataFrame:
    """Add ``turns_read`` and ``loss_text`` from ``formatted`` and ``loss_spans`` alone."""
    body = lambda p: F.substring(p, len(_OPEN) + 1, 2147483647)
    turn = lambda p: _let(F.split(body(p), r"\[/ROLE\]", 2), lambda x: F.struct(
        unescape(F.get(x, F.lit(0))).alias("role"), unescape(F.get(x, F.lit(1))).alias("text")))
    turns = _let(F.split("formatted", _CLOSE, -1), lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), turn))
    # the masked text is read from cuts of equal length, so that a span does not walk the whole text to its place
    cut = lambda cuts, s: F.substring(
        F.array_join(F.slice(cuts, F.floor(s["start"] / _CUT).cast("int") + 1,
                             (F.floor((s["start"] + s["length"]) / _CUT) - F.floor(s["start"] / _CUT) + 1).cast("int")), ""),
        (s["start"] % _CUT + 1).cast("int"), s["length"].cast("int"))
    loss = _let(F.regexp_extract_all("formatted", F.lit(r"(?s).{1,%d}" % _CUT), F.lit(0)),
                lambda cuts: F.array_join(F.transform("loss_spans", lambda s: unescape(cut(cuts, s))), ""))
    return rows.withColumns({"turns_read": turns, "loss_text": loss})


def records_of(conversations: DataFrame, layouts=ROW_LAYOUTS) -> DataFrame:
    """(conv_id, record, MESSAGES, TABLE_PRINT, TABLE_LAYOUT): the turns of each conversation of a table, in order.

    The fingerprint of the table's schema selects the mapping that says where
    conversation, order, role and text are; ``record`` is null.
    """
    fingerprint, lay = row_layout(conversations.schema, layouts)
    at = lambda path: F.col(".".join(f"`{p}`" for p in path.split(".")))
    turn = F.struct(at(lay.order).alias("order"), _message("role", "text", lay.roles)(
        {"role": at(lay.role).cast("string"), "text": at(lay.text).cast("string")}).alias("m"))
    return conversations.groupBy(at(lay.conversation).alias("conv_id")).agg(
        F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["m"]).alias(MESSAGES)).select(
        "conv_id", F.lit(None).cast("string").alias("record"), MESSAGES, F.lit(fingerprint).alias(TABLE_PRINT), F.lit(lay.name).alias(TABLE_LAYOUT))
