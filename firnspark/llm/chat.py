"""Chat formatting whose text can be parsed back into the same turns, by DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: turn := OPEN role TEXT text SHUT END
OPEN, TEXT, SHUT, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Control strings and their escapes. The backslash comes first on the way in and last on the way out.
ESCAPES = (("\\", "\\b"), (END, "\\e"), (OPEN, "\\s"), (TEXT, "\\i"), (SHUT, "\\o"))


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(TEXT), text, F.lit(SHUT + END))


def parse(formatted: Column) -> Column:
    """Array of (role, text) of the turns; null for a turn that doesn't follow the grammar.

    A turn ends at the first END. Its role ends at the first TEXT; no control string may stand in role or text.
    """
    pieces = F.split(formatted, END)

    def turn(x: Column) -> Column:
        at = F.instr(x, TEXT)
        role = F.substr(x, F.lit(len(OPEN) + 1), F.greatest(at - len(OPEN) - 1, F.lit(0)))
        text = F.substr(x, at + len(TEXT), F.greatest(F.char_length(x) - at - len(TEXT) - len(SHUT) + 1, F.lit(0)))
        clean = ~F.contains(text, F.lit(TEXT)) & ~F.contains(text, F.lit(SHUT)) & ~F.contains(text, F.lit(OPEN)) & ~F.contains(role, F.lit(OPEN)) & ~F.contains(role, F.lit(SHUT))
        good = F.startswith(x, F.lit(OPEN)) & F.endswith(x, F.lit(SHUT)) & (at > 0) & clean
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: ``conv_col``, ``n_turns``, ``formatted``, ``loss_spans`` (array of start, from 0,
    and length in code points of the texts of the role ``learn``), ``escaped`` (turns that needed it), ``round_trip``.

    Each turn is rendered as it is and parsed. If that doesn't give back its role and text, its control strings are
    escaped; the first form that parses to the source is used. The
    whole conversation is parsed once more for ``round_trip``. Null roles and texts count as empty; turns with equal
    numbers follow in the order of role and text; repeated rows are turns of their own; a null conversation is one
    of its own; an empty table gives no rows. A conversation becomes one string, so its turns do meet in one task.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("n"), role.alias("role"), text.alias("text"))
    forms: list[Callable[[Column], Column]] = [lambda c: c, escape]
    best, level = F.lit(None), F.lit(None)
    for k, form in reversed(list(enumerate(forms))):
        shown = render(form(F.col("role")), form(F.col("text")))
        back = parse(shown)
        same = (F.size(back) == 1) & back[0]["role"].eqNullSafe(F.col("role")) & back[0]["text"].eqNullSafe(F.col("text"))
        head = F.char_length(form(F.col("role"))) + len(OPEN) + len(TEXT)
        best = F.when(same, F.struct(shown.alias("shown"), head.alias("head"), F.char_length(form(F.col("text"))).alias("size"))).otherwise(best)
        level = F.when(same, k).otherwise(level)
    rows = rows.withColumns({"best": best, "level": level}).select("c", "n", "role", "text", "best.*", "level")
    order = Window.partitionBy("c").orderBy("n", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("before", F.sum(F.char_length("shown").cast("long")).over(order) - F.char_length("shown"))
    turn = F.struct("n", "role", "text", "before", "shown", "head", "size", "level")
    convs = rows.groupBy("c").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.select(
        "c", "turns", F.concat_ws("", F.col("turns.shown")).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == learn), lambda t: F.struct((t["before"] + t["head"]).alias("start"), t["size"].cast("long").alias("length"))).alias("loss_spans"),
    )
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return convs.select(
        F.col("c").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), "formatted", "loss_spans",
        F.size(F.filter("turns", lambda t: t["level"] > 0)).alias("escaped"), (parse(F.col("formatted")) == source).alias("round_trip"),
    )


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
