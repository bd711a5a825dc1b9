"""Chat formatting: typed content parts flattened into one text with a loss mask, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What stands for the characters that the template uses, in texts and roles.  Each code begins with the
#: escape character and no other place holds one, so replacing the codes one after the other undoes it.
CODES = (("\\", "\\s"), ("<", "\\l"), (">", "\\g"))
#: Tokens that a model's encoder puts in the place of a part.
PART_TOKENS = {"image": 576, "audio": 250, "document": 1024}
CLOSE = "</turn>\n"


def escaped(x: str) -> str:
    """SQL for a text with its control characters replaced."""
    for plain, code in CODES:
        x = f"replace({x}, {quoted(plain)}, {quoted(code)})"
    return x


def restored(x: str) -> str:
    for plain, code in reversed(CODES):
        x = f"replace({x}, {quoted(code)}, {quoted(plain)})"
    return x


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("\n", "\\n") + "'"


def format_conversations(rows: DataFrame, loss_role: str = "assistant", part_tokens: dict[str, int] | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    A turn is `<turn ROLE>`, a new line, its parts in order, `</turn>` and a new
    line.  Parts come from parts_col, an array of structs with type, text and ref,
    or else the text column is the one text part.  A text part is written with
    its control characters escaped; any other becomes the placeholder `<TYPE TURN.PLACE>`
    (both from 1), and an entry (turn, place, kind, ref, tokens) of attachments, in
    order.  expanded_tokens sums the tokens that stand for the placeholders
    (0 for an unknown type).  loss_spans has the first character (from 0) and the length of what each
    turn of loss_role says.

    Turns are ordered by turn, role and content; rows that agree in all of these
    are interchangeable, and each makes a turn.  A null text or part is empty, a null role
    an empty one, null turns come first and rows with a null conversation id are one
    conversation.  An empty table gives an empty one; further columns are not
    read.  One shuffle by conversation serves the order, the offsets and the
    collection.  A conversation is one output value, so its turns meet in a task; nothing else does.
    """
    tokens = PART_TOKENS if part_tokens is None else part_tokens
    parts = f"coalesce(`{parts_col}`, array())" if parts_col else f"array(named_struct('type', 'text', 'text', cast(`{text_col}` as string), 'ref', cast(null as string)))"
    size = "case p.type " + " ".join(f"when '{k}' then {int(v)}" for k, v in tokens.items()) + " else 0 end" if tokens else "0"
    turns = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.expr(f"coalesce(cast(`{role_col}` as string), '')").alias("role"), F.expr(parts).alias("parts"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    turns = turns.withColumn("ordinal", F.row_number().over(order))
    body = f"array_join(transform(parts, (p, i) -> case when coalesce(p.type, 'text') = 'text' then coalesce({escaped('p.text')}, '') else concat('<', {escaped('p.type')}, ' ', ordinal, '.', i + 1, '>') end), '')"
    turns = turns.withColumn("head", F.expr(f"concat('<turn ', {escaped('role')}, '>\\n')")).withColumn("body", F.expr(body))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("start", before)
    turns = turns.withColumn("span", F.when(F.col("role") == loss_role, F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))))
    files = f"filter(transform(parts, (p, i) -> named_struct('turn', ordinal, 'place', i + 1, 'kind', p.type, 'ref', p.ref, 'tokens', {size})), a -> coalesce(a.kind, 'text') <> 'text')"
    kept = turns.select("conv_id", F.struct("ordinal", "piece", "span", F.expr(files).alias("files")).alias("t"))
    whole = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(
        "conv_id",
        F.expr("array_join(t.piece, '')").alias("formatted"),
        F.expr("filter(t.span, s -> s is not null)").alias("loss_spans"),
        F.expr("flatten(t.files)").alias("attachments"),
        F.expr("aggregate(flatten(t.files), 0L, (a, f) -> a + f.tokens)").alias("expanded_tokens"),
    )


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text each) and loss_text, read from formatted and loss_spans alone.

    Placeholders of other parts stay in a turn's text as they are.
    """
    pieces = f"slice(split(formatted, {quoted(CLOSE)}, -1), 1, size(split(formatted, {quoted(CLOSE)}, -1)) - 1)"
    turn = f"named_struct('role', {restored('substring(x, 7, locate(' + quoted('>') + ', x) - 7)')}, 'text', {restored('substring(x, locate(' + quoted('>') + ', x) + 2)')})"
    said = restored("substring(formatted, cast(s.start + 1 as int), cast(s.length as int))")
    return formatted.select("*", F.expr(f"transform({pieces}, x -> {turn})").alias("turns"), F.expr(f"array_join(transform(loss_spans, s -> {said}), '')").alias("loss_text"))


def digests(rows: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, from what is read back."""
    back = parse_conversations(format_conversations(rows))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.expr("sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256)").alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation whose texts hold control strings.
PROBE = r"\### Assistant: </turn> ok"

SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
s AS (SELECT conv_id, turn, role, text, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) AS n FROM c),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  CAST(sum(n + length(role) + 16) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""
