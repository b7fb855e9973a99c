r"""Chat formatting with a grammar that reads back what it wrote.

    conversation = turn*
    turn         = "<s>[INST] " role " [/INST] " body " </s>"

Roles and bodies may not hold a control string (<s>, </s>, [INST], [/INST]) or what unescaping would
change. The text is rendered as it is, parsed again by this grammar and compared with the source;
where they differ, control strings inside roles and bodies get a backslash after their first character
(one more, if they have some: <\/s>, [\\INST], ...), and the result is parsed and compared again. Unescaping takes
one backslash away, so any text comes back; a conversation that would not is an error, never a wrong row.

All of it is DataFrame functions. The result has a row per conversation, so its turns meet in one row.

Defined cases: null roles and texts are empty; turns with equal (or null, which come first) numbers
are in order of role, then text; repeated rows are turns of their own; rows without a conversation id are one
conversation with a null id; no rows give no rows; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL, STOP = "<s>[INST] ", " [/INST] ", " ", "</s>"
_PATTERNS = ((r"(<\\*)(/?s>)", r"(<\\*)\\(/?s>)"), (r"(\[\\*)(/?INST\])", r"(\[\\*)\\(/?INST\])"))
_CONTROL = r"</?s>|\[/?INST\]"


def escape(c: Column) -> Column:
    for plain, _ in _PATTERNS:
        c = F.regexp_replace(c, plain, r"$1\\$2")
    return c


def unescape(c: Column) -> Column:
    for _, escaped in _PATTERNS:
        c = F.regexp_replace(c, escaped, "$1$2")
    return c


def render(turns: Column) -> Column:
    """Of an array of struct<role, text>."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEAD), t.role, F.lit(MIDDLE), t.text, F.lit(TAIL + STOP))), "")


def parse(formatted: Column) -> Column:
    """Turns as they stand (still escaped); null where the grammar doesn't hold."""
    pieces = F.split(formatted, STOP)  # what follows the last STOP is empty
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    rest = lambda p: F.substr(p, F.lit(len(HEAD) + 1))
    role = lambda p: F.substring_index(rest(p), MIDDLE, 1)

    def body(p: Column) -> Column:
        text = F.substr(rest(p), F.length(role(p)) + F.lit(len(MIDDLE) + 1))
        return F.substr(text, F.lit(1), F.length(text) - len(TAIL))

    good = lambda p: F.startswith(p, F.lit(HEAD)) & F.contains(rest(p), F.lit(MIDDLE)) & ~role(p).rlike(_CONTROL) & ~body(p).rlike(_CONTROL)
    return F.transform(pieces, lambda p: F.when(good(p), F.struct(role(p).alias("role"), body(p).alias("text"))))


def recovered(parsed: Column) -> Column:
    return F.transform(parsed, lambda t: F.when(t.isNotNull(), F.struct(unescape(t.role).alias("role"), unescape(t.text).alias("text"))))


def chat(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """conv_id, formatted and pieces: struct<content, loss>, which joined are ``formatted``; loss marks bodies of the trained role."""
    one = rows.select(F.col(key).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    whole = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = whole.select("conv_id", F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("source"))
    first = source.withColumn("formatted", render(F.col("source")))
    same = recovered(parse(F.col("formatted"))).eqNullSafe(F.col("source"))
    escaped = F.transform("source", lambda t: F.struct(escape(t.role).alias("role"), escape(t.text).alias("text")))
    second = first.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(render(escaped)))
    held = second.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation did not come back as it was"))))
    pieces = F.flatten(F.transform(parse(F.col("formatted")), lambda t: F.array(_piece(F.concat(F.lit(HEAD), t.role, F.lit(MIDDLE)), F.lit(False)), _piece(t.text, unescape(t.role) == trained), _piece(F.lit(TAIL + STOP), F.lit(False)))))
    return held.select("conv_id", "formatted", pieces.alias("pieces"))


def _piece(content: Column, loss: Column) -> Column:
    return F.struct(content.alias("content"), loss.alias("loss"))


def digest(found: DataFrame) -> DataFrame:
    """All read back from the formatted text and its mask."""
    turns = recovered(parse(F.col("formatted")))
    source = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p.loss), lambda p: unescape(p.content)), "")
    return found.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(source.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
