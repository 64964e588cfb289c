"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn as

    ### role: text</turn>\n

The parser is deterministic: turns end at `</turn>\n`, a turn starts with `### `, its role ends at the
first `: `, and no control string may stand inside a text. Rendering starts without escapes; the text is
parsed again and the turns it yields are compared with the source. Where they differ the content is
escaped and tried again: first the control strings, then backslashes as well. The last form always
comes back: after it a backslash is always followed by one of four letters.

    ### -> \\h    </turn> -> \\t    : (in roles) -> \\c    \\ -> \\b

The loss mask is a list of (start, length) in bytes of the UTF-8 text, one per assistant turn.

Defined cases: null texts and roles count as empty; rows of a conversation stand in order of turn,
then role, then text, a null turn first; repeated rows are turns of their own; rows without a
conversation id form one conversation with a null id. No rows, no conversations. A conversation is one
text, so its turns meet in one row; they are sorted and measured by a window, which spills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.operators.common import once

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings and their codes; the backslash is escaped first and restored last.
CODES = [("###", "\\h"), ("</turn>", "\\t")]
ROLE_CODES = [(":", "\\c")]
BACKSLASH = ("\\", "\\b")
LEVELS = 3


def swap(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column, level: int, role: bool = False) -> Column:
    """Level 0 leaves the text, 1 escapes control strings, 2 backslashes as well."""
    pairs = CODES + (ROLE_CODES if role else [])
    return swap(c, ([BACKSLASH] if level > 1 else []) + (pairs if level else []))


def unescape(c: Column) -> Column:
    return swap(c, [(new, old) for old, new in [*CODES, *ROLE_CODES, BACKSLASH]])


def head(role: Column, level: int) -> Column:
    return F.concat(F.lit(OPEN), escape(role, level, role=True), F.lit(COLON))


def parse(formatted: Column) -> Column:
    """The turns of a rendered conversation; a piece outside the grammar gives a null turn."""
    pieces = F.split(formatted, CLOSE, -1)

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(OPEN) + 1))
        at = F.instr(rest, COLON)
        role, text = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(COLON))
        sound = F.startswith(piece, F.lit(OPEN)) & (at > 0)
        for control, _ in CODES:
            sound = sound & ~F.contains(rest, F.lit(control))
        return F.when(sound, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def chosen(level: Column, of: Callable[[int], Column]) -> Column:
    case = F.when(level == 0, of(0))
    for i in range(1, LEVELS - 1):
        case = case.when(level == i, of(i))
    return case.otherwise(of(LEVELS - 1))


def format_chats(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, escapes (the level used), loss (array of start and length in bytes)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    slim = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("nth", F.row_number().over(in_order))
    for i in range(LEVELS):
        slim = slim.withColumns(
            {
                f"head{i}": F.octet_length(head(F.col("role"), i)),
                f"size{i}": F.octet_length(escape(F.col("text"), i)),
            }
        )
    whole = [F.col(f"head{i}") + F.col(f"size{i}") + len(CLOSE) for i in range(LEVELS)]
    slim = slim.withColumns(
        {f"start{i}": F.coalesce(F.sum(whole[i]).over(so_far), F.lit(0)) + F.col(f"head{i}") for i in range(LEVELS)}
    )
    fields = ["nth", "role", "text", *[f"{n}{i}" for i in range(LEVELS) for n in ("start", "size")]]
    chats = slim.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("turns"))

    def rendered(level: int) -> Column:
        piece = lambda t: F.concat(head(t["role"], level), escape(t["text"], level), F.lit(CLOSE))
        return F.array_join(F.transform("turns", piece), "")

    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    fits = lambda text: F.coalesce(parse(text) == F.col("source"), F.lit(False))
    chats = once(chats, source=source, formatted=rendered(0))
    chats = once(chats, escapes=F.when(fits(F.col("formatted")), 0))
    for i in range(1, LEVELS):
        again = F.when(F.col("escapes").isNull(), rendered(i)).otherwise(F.col("formatted"))
        chats = once(chats, again=again).drop("formatted").withColumnRenamed("again", "formatted")
        level = F.coalesce(F.col("escapes"), F.when(fits(F.col("formatted")), i))
        chats = once(chats, level=level).drop("escapes").withColumnRenamed("level", "escapes")
    broken = F.raise_error(F.lit("a rendered conversation does not come back"))
    chats = chats.withColumn("escapes", F.coalesce("escapes", broken.cast("int")))
    mine = F.filter("turns", lambda t: t["role"] == trained)
    spans = lambda i: F.transform(
        mine, lambda t: F.struct(t[f"start{i}"].cast("long").alias("start"), t[f"size{i}"].cast("long").alias("length"))
    )
    return chats.select("conv_id", "formatted", "escapes", chosen(F.col("escapes"), spans).alias("loss"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, loss_text: turns parsed from the text, and what stands under the mask, unescaped."""
    ready = once(formatted, bytes=F.encode("formatted", "UTF-8"), turns=parse(F.col("formatted")))
    under = F.transform(
        "loss", lambda s: unescape(F.decode(F.substr(F.col("bytes"), (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    )
    return ready.select("conv_id", "formatted", "turns", F.array_join(under, "").alias("loss_text"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: number of turns, digests of the turns and of the trained text, lengths."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return once(read_chats(formatted), said=said).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
