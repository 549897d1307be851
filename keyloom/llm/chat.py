"""Chat formatting with a grammar round trip. Native operations only.

Grammar of a formatted conversation, which any text tiles exactly:

    conversation := turn*
    turn         := open text close
    open         := "<s>" for an assistant, "[INST] " for a user, "[SYS] " for a
                    system row, "[ROLE:name] " for others, name URL-encoded
    close        := "</s>", " [/INST]", " [/SYS]", " [/ROLE]"

A control string is one of those without its blank. Inside a text it is escaped
by one more backslash after its first character, at whatever number it has
already (``</s>`` is written ``<\\/s>``, ``<\\/s>`` is written ``<\\\\/s>``), so that
unescaping gives back each text. Texts are first rendered as they are and read
back by the parser; a turn that comes back differently is escaped, until the
recovered turns are identical to the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What opens or closes a turn.
CONTROL = r"</?s>|\[/?INST\]|\[/?SYS\]|\[ROLE:|\[/ROLE\]"
_HEAD, _TAIL = r"([<\[])", r"(/?s>|/?INST\]|/?SYS\]|ROLE:|/ROLE\])"
_ESCAPE = _HEAD + r"(\\*)" + _TAIL
_UNESCAPE = _HEAD + r"\\(\\*)" + _TAIL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$1$2\\$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2$3"))


def _open(role: Column) -> Column:
    return F.when(role == "assistant", "<s>").when(role == "user", "[INST] ").when(role == "system", "[SYS] ").otherwise(F.concat(F.lit("[ROLE:"), F.url_encode(role), F.lit("] ")))


def _close(role: Column) -> Column:
    return F.when(role == "assistant", "</s>").when(role == "user", " [/INST]").when(role == "system", " [/SYS]").otherwise(" [/ROLE]")


def _render(turns: Column, escaped: Column) -> Column:
    """Turns as segments; those whose place is marked in ``escaped`` are escaped."""
    return F.zip_with(turns, escaped, lambda t, e: F.concat(_open(t.role), F.when(e, escape(t.text)).otherwise(t.text), _close(t.role)))


_OPENING = r"^(?:<s>|\[INST\] |\[SYS\] |\[ROLE:[^\]]*\] )"
_PARSED = "array<struct<role:string,text:string,raw:string,chars:bigint,loss_chars:bigint>>"


def parse(formatted: Column) -> Column:
    """``array<struct<role,text,raw,chars,loss_chars>>`` of a formatted conversation, by its control strings alone.

    The tokens between control strings come in pairs: the first has the opening
    and the text, the second the closing. ``raw`` is the text as written.
    """
    tokens = F.filter(F.split(formatted, f"(?={CONTROL})"), lambda t: t != "")

    def pairs(t: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.floor((F.size(t) - 1) / 2).cast("int")), lambda i: F.struct(F.get(t, 2 * i).alias("head"), F.coalesce(F.get(t, 2 * i + 1), F.lit("")).alias("close")))
        opened = F.transform(each, lambda p: F.struct(p.head.alias("head"), F.regexp_extract(p.head, _OPENING, 0).alias("by"), F.length(p.close).alias("closing")))
        return F.when(F.size(t) > 0, F.transform(F.transform(opened, cut), turn)).otherwise(F.array().cast(_PARSED))

    def cut(p: Column) -> Column:
        blank = F.when(p.by == "<s>", 0).otherwise(1)  # before the closing
        chars = F.length(p.head)
        return F.struct(p.by.alias("by"), F.substring(p.head, F.length(p.by) + 1, chars - F.length(p.by) - blank).alias("raw"), (chars + p.closing).cast("long").alias("chars"))

    def turn(p: Column) -> Column:
        role = F.when(p.by == "<s>", "assistant").when(p.by == "[INST] ", "user").when(p.by == "[SYS] ", "system").when(p.by != "", F.try_url_decode(F.substring(p.by, F.lit(7), F.length(p.by) - 8)))
        return F.struct(role.alias("role"), unescape(p.raw).alias("text"), p.raw.alias("raw"), p.chars.alias("chars"), F.when(p.by == "<s>", F.length(p.raw)).otherwise(0).cast("long").alias("loss_chars"))

    return _let(tokens, pairs)


def _let(value: Column, use) -> Column:
    """``use(value)``, with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask, turns`` for each conversation of ``rows(conv_id, turn, role, text)``.

    Turns are in order of turn, then role, then text, so ties and repeated rows
    have one result. Null texts and roles count as empty, a null turn comes
    first, rows with a null conv_id are one conversation. loss_mask has the
    formatted text's runs, ``array<struct<chars,loss>>`` in code points: loss
    holds for what stands in an assistant's turn between opening and closing.
    turns is what the parser reads back from the formatted text, as ``parse`` gives it. A
    conversation that the parser can't recover raises an error; none is known.
    A conversation is one row of output, so its turns meet in one task; other
    columns are not read and an empty table gives no rows.
    """
    turns = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    convs = convs.select("conv_id", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))
    # plain first: a text that has anything to escape can't come back from the parser as it was
    plain = convs.withColumn("segments", _render(F.col("turns"), F.transform("turns", lambda t: F.lit(False))))
    plain = plain.withColumn("back", F.transform("segments", parse))
    differs = F.zip_with("turns", "back", lambda t, b: ~((F.size(b) == 1) & F.coalesce((b[0].role == t.role) & (b[0].text == t.text), F.lit(False))))
    marked = plain.select("conv_id", "turns", differs.alias("escaped"))
    done = marked.select("conv_id", "turns", F.array_join(_render(F.col("turns"), F.col("escaped")), "").alias("formatted"))
    done = done.withColumn("back", parse(F.col("formatted")))
    same = F.transform("back", lambda b: F.struct(b.role.alias("role"), b.text.alias("text"))) == F.col("turns")
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    runs = F.flatten(F.transform("back", lambda b: F.when(b.role == "assistant", F.array(_run(F.lit(3), False), _run(b.loss_chars, True), _run(b.chars - b.loss_chars - 3, False))).otherwise(F.array(_run(b.chars, False)))))
    return done.select("conv_id", checked.alias("formatted"), runs.alias("loss_mask"), F.col("back").alias("turns"))


def _run(chars: Column, loss: bool) -> Column:
    return F.struct(chars.cast("long").alias("chars"), F.lit(loss).alias("loss"))
