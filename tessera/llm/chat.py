"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs, sorted, and adjacent turns of one role merged into a block:

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT<|im_end|>\\n

<|im_sep|> stands between the texts of merged turns, so merging loses nothing. Inside roles and texts a backslash
becomes two and ``<|`` becomes ``<\\|`` (and in roles a line feed ``\\n``): no text can hold a control string, and
`parse` restores every turn exactly.

Defined results: a null text or role is the empty string; turns sort by turn, role, text with nulls first, so ties
and repeated rows keep a fixed order and all of them; a null conv_id is one conversation; an empty table gives no
rows; other columns are ignored. A conversation becomes one row, so one conversation must fit a task; the time for it
grows in proportion to its text and turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CHUNK = 1024


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    halves = F.split(c, r"\\\\", -1)
    plain = F.transform(halves, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body's own lambdas read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(turns: Column, n: Column) -> Column:
    """Merge adjacent turns of one role: an array of (role, texts)."""
    firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def merged(first: Column) -> Column:
        texts = lambda s, k: F.slice(turns, s + 1, F.coalesce(F.get(first, k + 1), n) - s)
        return F.transform(first, lambda s, k: F.struct(F.get(turns, s)["role"].alias("role"), F.transform(texts(s, k), lambda t: escape(t["text"])).alias("texts")))

    return _let(firsts, merged)


def _offsets(lengths: Column) -> Column:
    """Where each of the pieces begins, given their lengths: running sums of groups, then inside each group."""
    group = 256
    sums = lambda xs, start: F.aggregate(xs, F.struct(start.cast("long").alias("pos"), F.expr("cast(array() as array<bigint>)").alias("out")), lambda acc, x: F.struct((acc["pos"] + x).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")))["out"]
    cut = lambda every: F.transform(F.sequence(F.lit(0), F.floor(F.size(every) / group).cast("int")), lambda g: F.slice(every, g * group + 1, F.lit(group)))
    totals = lambda groups: F.transform(groups, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x))
    return _let(lengths, lambda every: _let(cut(every), lambda groups: F.flatten(F.zip_with(groups, sums(totals(groups), F.lit(0)), sums))))


def _loss_spans(blocks: Column, trained: str) -> Column:
    """[start, end) code point ranges of the trained role's texts in the formatted string, in time linear in the turns."""
    def pieces(b: Column) -> Column:
        last = F.size(b["texts"]) - 1
        head = F.lit(len(START) + 1) + F.length(escape_role(b["role"]))
        return F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, head).otherwise(0).cast("long").alias("head"), F.length(t).cast("long").alias("own"), F.when(i == last, len(END) + 1).otherwise(len(SEP)).cast("long").alias("tail"), (b["role"] == trained).alias("trained")))

    def spans(every: Column) -> Column:
        starts = _offsets(F.transform(every, lambda p: p["head"] + p["own"] + p["tail"]))
        placed = F.zip_with(every, starts, lambda p, s: F.struct((s + p["head"]).alias("start"), (s + p["head"] + p["own"]).alias("end"), p["trained"].alias("trained")))
        return F.transform(F.filter(placed, lambda p: p["trained"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))

    return _let(F.flatten(F.transform(blocks, pieces)), spans)


def format_chats(rows: DataFrame, trained: str = "assistant", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans array<struct<start,end>> (code points)."""
    plain = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t"))
    sorted_turns = plain.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    merged = sorted_turns.withColumn("n_turns", F.size("turns").cast("long")).withColumn("blocks", _blocks(F.col("turns"), F.size("turns"))).drop("turns")
    piece = lambda b: F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END + "\n"))
    return merged.select("conv_id", "n_turns", F.array_join(F.transform("blocks", piece), "").alias("formatted"), _loss_spans(F.col("blocks"), trained).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role,text>>, merged turns apart again."""
    def turns(piece):
        role = unescape_role(F.substring_index(piece, "\n", 1))
        body = F.substring_index(F.substring(piece, F.length(F.substring_index(piece, "\n", 1)) + 2, F.length(piece)), END, 1)
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")
    return F.flatten(F.transform(pieces, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. Chunks of CHUNK code points spare each span a walk from the start."""
    def read(chunks: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / CHUNK).cast("int"), F.floor(s["end"] / CHUNK).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return unescape(F.substring(near, (s["start"] - F.lit(CHUNK) * first).cast("int") + 1, (s["end"] - s["start"]).cast("int")))

    chunks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return _let(chunks, lambda c: F.array_join(F.transform(spans, lambda s: read(c, s)), ""))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them."""
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
