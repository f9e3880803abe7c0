"""Chat formatting in budgeted windows: prefix sums of turn tokens choose turn-aligned spans; a window keeps the system turn, repeats a limited
history and masks what it repeats, so that every assistant turn is a target once. DataFrame functions only.

Template: a window opens with <s>; turns are [SYS]..[/SYS], [INST]..[/INST], [OUT]..</s> and, for other roles, [ROLE=hex]..[/ROLE]. A control
string inside a text gets a backslash after its first character, one more if it has some already, so that unescaping gives the text back.

Defined cases: a null text or role counts as empty; a turn over the budget is a window of its own, never cut; turns with the same number go by
role, then text, and repeated rows are repeated turns; null numbers come first; a null conv_id is a conversation; an empty table gives none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import chunks, cut, running_total, small

#: Tokens of a window and of its repeated history.
BUDGET, HISTORY = 1024, 192
#: Turns of a conversation that a task formats; longer conversations are split.
BLOCK = 4096
_CONTROL = r"/?(?:INST|SYS|OUT)\]|/?ROLE(?:=[0-9A-F]*)?\]|/?s>"
_PARSE = r"(?s)\[(SYS|INST|OUT|ROLE=[0-9A-F]*)\](.*?)(?:\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])"
_TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def _marks(role: Column) -> tuple[Column, Column]:
    known = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
    first, last = F.concat(F.lit("[ROLE="), F.hex(role), F.lit("]")), F.lit("[/ROLE]")
    for r, (a, b) in known.items():
        first, last = F.when(role == r, a).otherwise(first), F.when(role == r, b).otherwise(last)
    return first, last


def _role(mark: Column) -> Column:
    out = F.unhex(F.substring(mark, 6, 1 << 30)).cast("string")
    for m, r in (("SYS", "system"), ("INST", "user"), ("OUT", "assistant")):
        out = F.when(mark == m, r).otherwise(out)
    return out


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """turns with a column block: 0 in a conversation of up to `block` turns; longer ones are split into blocks of `block` turns by their places,
    whatever their numbers are. The turns of long conversations are dealt to tasks by ranges of their order; a turn's place is the one in its
    task, after the turns that earlier tasks have of its conversation."""
    order = ["turn", "role", "own"]
    long_ones = cut(turns.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > block).withColumnRenamed("key", "_k"))
    total = long_ones.agg(F.sum("_n")).first()[0]
    if not total:
        return turns.withColumn("block", F.lit(0).cast("long"))
    long_ones, on = small(long_ones.select("_k")), F.col("key") == F.col("_k")
    # The start of a text is enough to deal turns by; turns that share it stay together.
    dealt = turns.join(long_ones, on, "left_semi").repartitionByRange(min(20_000, chunks(total, block)), "key", "turn", "role", F.substring("own", 1, 64))
    dealt = cut(dealt.withColumn("_part", F.spark_partition_id()))
    totals = running_total(dealt.groupBy("key", "_part").agg(F.count("*").alias("_t")), ["key"], ["_part"], "_t", "_before")
    totals = small(cut(totals.select(F.col("key").alias("_k"), F.col("_part").alias("_p"), "_before")))
    place = F.row_number().over(Window.partitionBy("key", "_part").orderBy(*order))
    dealt = dealt.withColumn("_place", place).join(totals, on & (F.col("_part") == F.col("_p")))
    dealt = dealt.withColumn("block", (F.floor((F.col("_place") + F.col("_before") - 1) / block) + 1).cast("long"))
    short = turns.join(long_ones, on, "left_anti").withColumn("block", F.lit(0).cast("long"))
    return short.unionByName(dealt.select(short.columns))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """A row for each window: conv_id, window (rising from 0, by one within a block, the next block at the next multiple of 2^32), formatted,
    spans (begin and length of each target's characters), n_repeated (turns at the front that earlier windows have had), n_tokens and over
    (beyond the budget, by a single turn). A task holds a block of turns; the blocks of a long conversation hand on its system turn and the
    turns that the next one repeats."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = escape(text)
    first, last = _marks(role)
    turns = conversations.select(
        F.struct("conv_id").alias("key"), "turn", role.alias("role"), own.alias("own"), F.concat(first, own, last).alias("shown"), F.length(first).alias("lead"),
        (F.regexp_count(own, F.lit(_TOKEN)) + 2).cast("long").alias("tokens"),
    )
    turns = _blocks(turns, block)
    order = Window.partitionBy("key", "block").orderBy("turn", "role", "own")
    turns = turns.withColumns({"sum": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)), "at": F.row_number().over(order)})
    conv = turns.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("at", "role", "own", "shown", "lead", "tokens", "sum"))).alias("t"))
    # A row for each block: its last turns, which the next blocks may repeat, with sums over the whole conversation. A block has two tokens at least.
    total = F.col("t")[F.size("t") - 1]["sum"]
    ends = F.filter(F.slice("t", F.greatest(F.size("t") - history + 1, F.lit(1)), history), lambda x: total - x["sum"] + x["tokens"] <= history)
    along = Window.partitionBy("_key").orderBy("_block")
    edges = conv.select(F.col("key").alias("_key"), F.col("block").alias("_block"), F.when(F.col("t")[0]["role"] == "system", F.col("t")[0]).alias("_head"), ends.alias("_ends"), total.alias("_total"))
    edges = edges.withColumns({"head": F.first("_head").over(along), "nth": F.row_number().over(along), "base": F.coalesce(F.sum("_total").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    # The system turn is repeated on its own, not as history.
    ends = F.filter("_ends", lambda x: (F.col("nth") > 1) | F.col("head").isNull() | (x["at"] > 1))
    edges = edges.withColumn("_ends", F.transform(ends, lambda x: x.withField("sum", x["sum"] + F.col("base"))))
    tail = F.flatten(F.collect_list("_ends").over(along.rowsBetween(-max(1, history // 2), -1)))
    tail = F.filter(tail, lambda x: F.col("base") - x["sum"] + x["tokens"] <= history)
    edges = edges.withColumn("tail", F.transform(tail, lambda x: x.withField("sum", x["sum"] - F.col("base")))).drop("_head", "_ends", "_total", "base")
    conv = conv.join(edges, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block"))).drop("_key", "_block", "block")
    conv = conv.withColumn("sys", F.coalesce(F.col("head")["tokens"], F.lit(0).cast("long")))
    room = F.greatest(F.lit(budget - history) - F.col("sys"), F.lit(1))
    # The fold keeps where each window begins and the prefix sum before it.
    begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("base"))

    def step(s: Column, x: Column) -> Column:
        new = (x["at"] == 1) | (x["sum"] - s["base"] > F.when((F.col("nth") == 1) & (F.size(s["starts"]) <= 1), F.lit(budget)).otherwise(room))
        return F.struct(
            F.when(new, F.concat(s["starts"], F.array(x["at"]))).otherwise(s["starts"]).alias("starts"), F.when(new, x["sum"] - x["tokens"]).otherwise(s["base"]).alias("base")
        )

    conv = conv.withColumn("starts", F.aggregate("t", begin, step, lambda s: s["starts"]))
    rows = conv.select("key", "t", "tail", "head", "nth", "sys", "starts", F.posexplode("starts").alias("i", "a"))
    z = F.coalesce(F.get(F.col("starts"), F.col("i") + 1), F.size("t") + 1)
    rows = rows.withColumns({"new": F.slice("t", F.col("a"), z - F.col("a")), "u": F.concat("tail", "t"), "b": F.col("a") + F.size("tail")})
    lo = F.when((F.col("nth") == 1) & (F.col("sys") > 0), 2).otherwise(1)  # the first turn that can be history
    before = F.get(F.col("u"), F.col("b") - 2)["sum"]
    # History is the longest run of turns before the span that fits; only the last `history` turns can, as each has a token.
    near = F.slice("u", F.greatest(lo, F.col("b") - history), F.greatest(F.col("b") - F.greatest(lo, F.col("b") - history), F.lit(0)))
    old = F.filter(near, lambda x: before - x["sum"] + x["tokens"] <= history)
    later = (F.col("i") > 0) | (F.col("nth") > 1)
    again = F.when(later, F.concat(F.when(F.col("sys") > 0, F.array("head")).otherwise(F.slice("t", 1, 0)), old)).otherwise(F.slice("t", 1, 0))
    rows = rows.withColumn("again", again).select(
        F.col("key.conv_id").alias("conv_id"), (F.shiftleft(F.col("nth").cast("long") - 1, 32) + F.col("i")).alias("window"), F.size("again").alias("n_repeated"), F.concat("again", "new").alias("w")
    )
    spans = F.filter(
        F.transform(
            "w",
            lambda x, i: F.struct(
                (F.aggregate(F.slice("w", 1, i), F.lit(3), lambda n, y: n + F.length(y["shown"])) + x["lead"] + 1).alias("begin"), F.length(x["own"]).alias("length"), ((x["role"] == "assistant") & (i >= F.col("n_repeated"))).alias("target")
            ),
        ),
        lambda s: s["target"],
    )
    tokens = F.aggregate("w", F.lit(0).cast("long"), lambda n, y: n + y["tokens"])
    shown = F.concat(F.lit("<s>"), F.array_join(F.transform("w", lambda x: x["shown"]), ""))
    return rows.select("conv_id", "window", shown.alias("formatted"), F.transform(spans, lambda s: F.struct(s["begin"], s["length"])).alias("spans"), "n_repeated", tokens.alias("n_tokens"), (tokens > budget).alias("over"))


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, from the formatted windows and their masks alone. A digest of a whole conversation needs its text in one value."""
    turns = F.slice(F.arrays_zip(F.regexp_extract_all("formatted", F.lit(_PARSE), 1).alias("role"), F.regexp_extract_all("formatted", F.lit(_PARSE), 2).alias("text")), F.col("n_repeated") + 1, 1 << 30)
    said = F.array_join(F.transform(F.col("turns"), lambda x: F.concat(_role(x["role"]), F.lit("\n"), unescape(x["text"]), F.lit("\n"))), "")
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), s["begin"], s["length"]))), "")
    w = windows.withColumn("turns", turns).select("conv_id", "window", F.size("turns").alias("n"), said.alias("said"), loss.alias("loss"), F.length("formatted").alias("chars"))
    one = w.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    all_of = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    return one.select(
        "conv_id", "n_turns", F.sha2(all_of("said"), 256).alias("turns_sha256"), F.length(all_of("loss")).cast("long").alias("loss_chars"), F.sha2(all_of("loss"), 256).alias("loss_sha256"), "formatted_chars"
    )
