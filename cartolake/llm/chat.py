"""Chat formatting: conversations as budgeted, turn-aligned windows with a loss mask.

Prefix sums of turn tokens place each turn in a window. Every window begins with the system
turn, then repeats the last turns of the window before it within a history budget, then has
its own turns. Only assistant turns of a window's own are under the loss, so a target that is
repeated as history is masked. DataFrame expressions and window functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolake.llm.common import WORD, saved, table

#: Tokens of a window, and of those the most that repeated history takes.
BUDGET, HISTORY = 2048, 256
#: Tokens that the marks of a turn take.
TURN_TOKENS = 6
OWN, PAST, TEXT, END = "<|turn|>", "<|past|>", "<|text|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """A backslash goes after each <, [ and backslash, so no control string is left in a text."""
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def tokens(text: Column) -> Column:
    """An estimate that needs no tokenizer: 4 tokens for 3 words, and a turn's marks."""
    return F.ceil(F.regexp_count(text, F.lit(WORD)) * 4 / 3).cast("long") + TURN_TOKENS


def _with_starts(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Adds n, at (place in the conversation), system, stride, start (tokens of the turns before it, without the system turn) and longs (turns before it longer than stride).

    Rows are range-sorted by conversation and order; each range adds up its own turns and takes
    what the ranges before it hold of the same conversation, at most one row a range.
    """
    order = ["turn", "role", "text"]
    t = rows.withColumn("n", tokens(F.col("text"))).repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    t = saved(t)
    conv, within = Window.partitionBy("conv"), Window.partitionBy("conv", "part")
    first = F.min(F.struct(*order, "n"))
    parts = t.groupBy("conv", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("sum"), first.alias("first"))
    opening = F.first("first").over(conv.orderBy("part"))
    parts = parts.withColumn("s", F.when(opening["role"] == "system", opening["n"]).otherwise(0))
    parts = parts.withColumn("stride", F.greatest(F.floor((budget - history - F.col("s")) / 2), F.lit(history)))
    # a range's long turns can be counted once the stride is known
    told = t.join(parts.select(F.col("conv").alias("p_conv"), F.col("part").alias("p_part"), "stride"), F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part")))
    longs = told.filter(F.col("n") > F.col("stride")).groupBy("conv", "part").agg(F.count("*").alias("longs"))
    longs = longs.select(F.col("conv").alias("l_conv"), F.col("part").alias("l_part"), "longs")
    parts = parts.join(longs, F.col("conv").eqNullSafe(F.col("l_conv")) & (F.col("part") == F.col("l_part")), "left")
    before = conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("rows", "sum", "longs")]
    parts = saved(parts.select(F.col("conv").alias("p_conv"), F.col("part").alias("p_part"), "s", "stride", *upto))
    t = t.join(parts, F.col("conv").eqNullSafe(F.col("p_conv")) & (F.col("part") == F.col("p_part"))).drop("p_conv", "p_part")
    sums = within.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("at", F.col("rows_before") + F.row_number().over(within.orderBy(*order)))
    t = t.withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
    t = t.withColumn("long", ~F.col("system") & (F.col("n") > F.col("stride")))
    start = F.col("sum_before") + F.coalesce(F.sum("n").over(sums), F.lit(0)) - F.when(F.col("system"), 0).otherwise(F.col("s"))
    # the system turn is no long turn, but counts among those of the ranges before
    counted = F.coalesce(F.sum(F.col("long").cast("long")).over(sums), F.lit(0)) + F.col("longs_before")
    counted = counted - ((F.col("rows_before") > 0) & (F.col("s") > F.col("stride"))).cast("long")
    return t.withColumns({"start": start, "longs": counted})


def place_turns(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """rows (conv, turn, role, text) as (conv, at, role, text, win, own): each turn once with own, and again where it is repeated.

    The system turn, the first one if its role is system, is in every window and is charged to
    each: half of what the budget leaves beside it and history is the stride. A turn starts at the
    sum of the tokens before it; windows are the strides that turns start in, and a turn longer
    than the stride has one of its own. So a window keeps to the budget, unless one turn doesn't
    fit beside the system turn and history, or the system turn leaves less than three times
    history; turns stay whole. win orders the windows of a conversation.
    """
    if not 0 < history <= (budget - history) // 2:
        raise ValueError("history must be positive and at most a third of the budget")
    t = _with_starts(rows, budget, history)
    section = F.col("longs") * 2 + F.col("long").cast("long")
    t = t.withColumn("win", section * F.lit(1 << 40) + F.floor(F.col("start") / F.col("stride")))
    t = saved(t.select("conv", "at", "role", "text", "start", "system", "win"))
    windows = t.groupBy("conv", "win").agg(F.min("start").alias("first_start"))
    by_win = Window.partitionBy("conv").orderBy("win")
    windows = windows.select(F.col("conv").alias("w_conv"), F.col("win").alias("w_win"), F.lead("win").over(by_win).alias("next_win"), F.lead("first_start").over(by_win).alias("next_start"), (F.row_number().over(by_win) > 1).alias("later"))
    windows = saved(windows)
    same = F.col("conv").eqNullSafe(F.col("w_conv"))
    near = ~F.col("system") & (F.col("start") >= F.col("next_start") - history)
    own = F.array(F.struct(F.col("win").alias("win"), F.lit(True).alias("own")))
    again = F.when(near, F.array(F.struct(F.col("next_win").alias("win"), F.lit(False).alias("own")))).otherwise(F.array().cast("array<struct<win:bigint,own:boolean>>"))
    turns = t.join(windows, same & (F.col("win") == F.col("w_win"))).select("conv", "at", "role", "text", F.explode(F.concat(own, again)).alias("w"))
    turns = turns.select("conv", "at", "role", "text", "w.win", "w.own")
    head = t.filter("system").join(windows.filter("later"), same).select("conv", "at", "role", "text", F.col("w_win").alias("win"), F.lit(False).alias("own"))
    return turns.union(head)


def format_chat(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each window: conv_id, win, formatted, mask (loss spans (start, end) in code points of formatted).

    Null roles and texts are empty; null turns come first, and turns of one number follow by role
    and text. Repeated rows are turns of their own. A null conv_id is one conversation.
    An empty table has no windows. Texts of any length stay whole; further columns are left out.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    placed = place_turns(rows, budget, history)
    head = F.concat(F.when(F.col("own"), OWN).otherwise(PAST), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    piece = F.struct("at", head.alias("head"), body.alias("body"), (F.col("own") & (F.col("role") == "assistant")).alias("loss"))
    windows = placed.groupBy("conv", "win").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    zero = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        start = a["upto"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct((end + len(END)).alias("upto"), F.when(p["loss"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    joined = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return windows.select(F.col("conv").alias(conv_col), "win", joined.alias("formatted"), F.aggregate("pieces", zero, step, lambda a: a["spans"]).alias("mask"))


def read_back(windows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Conversations from their windows: conv_id, turns (role, text) in order, loss (texts under the mask), formatted_chars.

    A conversation is one row, so one task holds its turns.
    """
    parts = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda p: p.startswith(OWN))

    def turn(p: Column) -> Column:
        marks = F.split(F.substring(p, F.lit(len(OWN) + 1), F.length(p)), r"<\|text\|>", 2)
        return F.struct(unescape(F.get(marks, F.lit(0))).alias("role"), unescape(F.get(marks, F.lit(1))).alias("text"))

    loss = F.transform("mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    rows = windows.select(conv_col, F.struct("win", F.transform(parts, turn).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    out = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return out.select(conv_col, F.flatten(F.col("ws.turns")).alias("turns"), F.flatten(F.col("ws.loss")).alias("loss"), F.aggregate(F.col("ws.chars"), F.lit(0).cast("long"), lambda a, b: a + b).alias("formatted_chars"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    out = read_back(saved(format_chat(rows.unionByName(two))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), "formatted_chars")


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         (ceil(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) * 4 / 3.0) + 6)::BIGINT AS n
  FROM c
), y AS (
  SELECT *, i = 1 AND role = 'system' AS sys, coalesce(max(CASE WHEN i = 1 AND role = 'system' THEN n END) OVER (PARTITION BY conv_id), 0) AS s FROM n
), s AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE sum(n) OVER (PARTITION BY conv_id ORDER BY i) - n - s END AS start,
         greatest(256, floor((2048 - 256 - s) / 2.0)::BIGINT) AS stride
  FROM y
), l AS (
  SELECT *, sum((NOT sys AND n > stride)::BIGINT) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM s
), w AS (
  SELECT *, (CASE WHEN NOT sys AND n > stride THEN 2 * upto - 1 ELSE 2 * upto END) * 1099511627776 + floor(start / stride::DOUBLE)::BIGINT AS win FROM l
), f AS (
  SELECT conv_id, win, min(start) AS first_start FROM w GROUP BY conv_id, win
), g AS (
  SELECT *, lead(first_start) OVER (PARTITION BY conv_id ORDER BY win) AS next_start,
         count(*) OVER (PARTITION BY conv_id ORDER BY win DESC) - 1 AS later
  FROM f
), r AS (
  SELECT w.*, CASE WHEN i = 1 AND role = 'system' THEN later WHEN w.start >= next_start - 256 THEN 1 ELSE 0 END AS again,
         24 + length(role) + length(text)
         + length(role) - length(replace(replace(replace(role, '<', ''), '[', ''), '\', ''))
         + length(text) - length(replace(replace(replace(text, '<', ''), '[', ''), '\', '')) AS chars
  FROM w JOIN g ON w.conv_id = g.conv_id AND w.win = g.win
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum((again + 1) * chars)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""
