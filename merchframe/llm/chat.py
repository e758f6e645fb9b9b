"""Chat formatting with SQL functions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role are merged
into blocks:

    <|im_start|>role
    text<|im_sep|>text<|im_end|>

Control strings inside texts and roles are escaped, so the formatted string can be read back: a
backslash is doubled and "<|" becomes "<\\|"; in roles a line end becomes a backslash and n. Segments
of the string carry the loss mask, which covers assistant texts and none of the marks.

A conversation is one value of the result, so its turns have to fit one row, as the contract asks.
"""

from pyspark.sql import Column, DataFrame, functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _replace(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _replace(_replace(text, "\\", "\\\\"), "<|", "<\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _escape_role(role: Column) -> Column:
    return _replace(escape(role), "\n", "\\n")


def _unescape_role(role: Column) -> Column:
    # Doubled backslashes are told apart from marks by cutting at them first.
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: _replace(_replace(p, "\\n", "\n"), "\\|", "|")), "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id of `turns` (conv_id, turn, role, text, ...): conv_id, formatted, and segments
    (text, loss), whose texts make up `formatted`.

    Null texts and roles are empty. Turns with equal numbers go by role, then text; repeated rows are
    turns of their own; null turn numbers come first; a null conv_id is a conversation.
    """
    rows = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Positions (from 1) where a block begins, and one past the end.
    starts = sorted_.withColumn("starts", F.expr(
        "filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role != turns[i - 2].role)"))
    blocks = starts.withColumn("blocks", F.expr(
        "transform(starts, (s, k) -> slice(turns, s, coalesce(get(starts, k + 1), size(turns) + 1) - s))"))

    def segment(text, loss=None):
        return F.struct(text.alias("text"), (F.lit(False) if loss is None else loss).alias("loss"))

    def of_block(block):
        role = block[0]["role"]
        texts = F.flatten(F.transform(block, lambda t, i: F.array(
            segment(F.when(i > 0, F.lit(SEPARATOR)).otherwise(F.lit(""))),
            segment(escape(t["text"]), role == TRAINED_ROLE))))
        return F.concat(F.array(segment(F.concat(F.lit(START), _escape_role(role), F.lit("\n")))), texts,
                        F.array(segment(F.lit(END + "\n"))))

    segments = blocks.select("conv_id", F.flatten(F.transform("blocks", of_block)).alias("segments"))
    return segments.select("conv_id", F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """Turns (role, text) of a formatted string."""
    def of_block(block):
        role = _unescape_role(F.substring_index(block, "\n", 1))
        body = F.substring_index(block, END, 1)
        body = F.substr(body, F.locate("\n", body) + 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, r"<\|im_start\|>")
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), of_block))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, counts and digests of what can be read back from `formatted` and its loss mask."""
    out = formatted.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
