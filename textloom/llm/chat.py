"""Chat formatting that reads back as it was written.

Grammar of the formatted text::

    conversation = turn*
    turn         = "### " role ": " text "</turn>" newline

The reader is deterministic: it cuts at every "</turn>" newline, takes the role up to the first
": " and, in both, drops each backslash and keeps the character after it.  A turn is first written
as it is and read again; if that is not its source, or shows a mark inside, the conflicting strings
are escaped (backslashes doubled, "###" to "\\###", "</turn>" to "<\\/turn>", and ":" in roles to
"\\:"), which always reads back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import col

END = "</turn>\n"


def _role_name(role: Column) -> Column:
    return F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 1 << 30))


def _escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\###"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    """text without its escaping backslashes."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), role, F.lit(": "), text, F.lit(END))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text, raw_text, start>>: the turns of a formatted text; start: where raw_text begins in its own turn."""
    turns = F.filter(F.split(formatted, END, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        head = F.regexp_extract(x, r"\A### ((?s:[^\\:]|\\.)*+): ", 0)
        raw = F.substr(x, F.length(head) + 1)
        role = F.regexp_replace(F.regexp_replace(head, r"\A### ", ""), r": \z", "")
        return F.struct(unescaped(role).alias("role"), unescaped(raw).alias("text"), raw.alias("raw_text"), F.length(head).alias("start"))

    return F.transform(turns, turn)


def format_turns(turns: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns with `rendered`: each turn's text in the grammar, escaped only where it would not read back.

    Null role or text: empty.
    """
    role, text = F.coalesce(col(role_col).cast("string"), F.lit("")), F.coalesce(col(text_col).cast("string"), F.lit(""))
    plain = _rendered(role, text)
    safe = _rendered(F.replace(_escaped(role), F.lit(":"), F.lit("\\:")), _escaped(text))
    # What the reader makes of the plain form; a mark inside the text is a conflict even if it would read back.
    back = parsed(plain)
    same = (F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text) & ~F.contains(text, F.lit("###")) & ~F.contains(text, F.lit("</turn>")) & ~F.contains(role, F.lit("###")) & ~F.contains(role, F.lit("</turn>"))
    suspect = F.concat(role, text).rlike(r"\\|###|</turn>") | role.contains(":")
    return turns.withColumn("rendered", F.when(~suspect | F.coalesce(same, F.lit(False)), plain).otherwise(safe))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(id, formatted, loss_mask): one row for each conversation, its turns in order.

    loss_mask: array<struct<turn, start, length>>, for each turn of the role `learn` where its text
    stands inside the turn's own piece of `formatted` (code points).  Turns with equal numbers are
    ordered by role, then text; null numbers come first.  Null text or role: empty.  A null id is a
    conversation of its own.  Repeated rows are turns of their own.  Conversations grow with nothing
    but their own turns: a row has to hold all of its conversation in any case.
    """
    rows = format_turns(turns.select(col(id_col).alias("id"), col(turn_col).cast("bigint").alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")))
    piece = F.struct("turn", "role", "text", "rendered")
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    whole = whole.select("id", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"), F.transform("turns", lambda t: t["role"]).alias("roles"))
    back = parsed(F.col("formatted"))
    mask = F.filter(F.transform(back, lambda t, i: F.when(t["role"] == learn, F.struct(i.alias("turn"), (t["start"] + 1).alias("start"), F.length(t["raw_text"]).alias("length")))), lambda x: x.isNotNull())
    return whole.select(F.col("id").alias(id_col), "formatted", mask.alias("loss_mask"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations: turns as the reader finds them, and the text under the loss mask."""
    f = formatted.withColumn("turns", parsed(F.col("formatted"))).withColumn("pieces", F.filter(F.split("formatted", END, -1), lambda x: x != ""))
    under = F.transform("loss_mask", lambda m: unescaped(F.substr(F.get(F.col("pieces"), m["turn"]), m["start"], m["length"])))
    f = f.withColumn("loss", F.array_join(under, ""))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return f.select(
        id_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
