"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes training texts of at most ``budget`` tokens. Prefix sums of the turns' tokens
choose them: a window takes whole turns as long as they fit beside the system turn and ``history``
tokens; it begins with the system turn (the first turn, if its role is ``system``) and as many of
the turns just before it as fit into ``history``. These repeated turns are masked, so every
assistant text is a target exactly once. A turn that fits into no window gets one of its own.

Conversations of up to BLOCK tokens are cut in one group. Longer ones are laid out by ranges, cut
into blocks of BLOCK tokens by their prefix sums, and every block is a group: it also gets the turns
that its first windows may repeat, and the system turn. Each turn counts OVERHEAD tokens besides its
text, so a group has at most BLOCK / OVERHEAD turns and BLOCK tokens beside its last turn.

Template: ``<turn>role\\ntext</turn>\\n``. Within texts and roles a backslash becomes ``\\b``, the
``<`` of ``<turn>`` and ``</turn>`` becomes ``\\l``, in roles a line feed becomes ``\\n``; so marks
occur only as marks, and the way back is exact.

Cases: null text or role is empty; a null conversation id is a conversation of its own; turns are
taken in order, null first, those of one number by the SHA-256 of role and text; repeated rows are
turns of their own; an empty text is a turn without target; extra columns are ignored; an empty
table gives no windows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logwarden.llm import turns

BUDGET = 2048
HISTORY = 256
BLOCK = 1 << 16
OVERHEAD = 4
OPEN, CLOSE = "<turn>", "</turn>"
# Pieces as byte-level tokenizers cut them, words in parts of at most five letters.
PIECE = r" ?\p{L}{1,5}|\p{N}{1,3}|[^\s\p{L}\p{N}]|\s+"
LEAD, OWN = 0, 1


def token_count(text: Column) -> Column:
    """Tokens of a text, as counted by PIECE."""
    return F.regexp_count(text, F.lit(PIECE)).cast("long")


def escape(text: Column) -> Column:
    for what, with_ in (("\\", "\\b"), (OPEN, "\\l" + OPEN[1:]), (CLOSE, "\\l" + CLOSE[1:])):
        text = F.replace(text, F.lit(what), F.lit(with_))
    return text


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    lines = F.replace(F.replace(role, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))
    return F.replace(lines, F.lit("\\b"), F.lit("\\"))


def _rows(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), turns.name(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), turns.digest(role, text).alias("digest"))


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with computed columns. Later steps take their values: as plain projections Spark would
    merge them into the lambdas that use them, and compute them once for each element there."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _short_blocks(rows: DataFrame, tokens: Column) -> DataFrame:
    """One block for each conversation: its turns in order, with the tokens before each."""
    before = Window.partitionBy("conv").orderBy(*turns.ORDER).rowsBetween(Window.unboundedPreceding, -1)
    counted = rows.withColumn("tokens", tokens).withColumn("at", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    own = F.struct(F.lit(OWN).alias("kind"), "at", "tokens", "role", "text")
    return counted.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(own)).alias("rows")).withColumn(
        "first", F.lit(0).cast("long"))


def _long_blocks(rows: DataFrame, totals: DataFrame, tokens: Column, history: int, block: int) -> DataFrame:
    """Blocks of conversations that are too large for one group."""
    laid = turns.laid_out(rows, tokens).withColumn("own", F.floor(F.col("at") / block))
    near = (F.col("weight") <= history) & (F.floor((F.col("at") + history) / block) > F.col("own"))
    first = (F.col("place") == 0) & (F.col("role") == "system")
    marked = laid.withColumn("near", near & ~first).join(turns.sized(totals), "conv").withColumn(
        "last", F.when(first, F.floor((F.col("total") - 1) / block)).when(F.col("near"), F.col("own") + 1).otherwise(F.col("own")))
    dealt = marked.select("conv", "conv_id", F.explode(F.sequence("own", "last")).alias("block"), "own", "at", F.col("weight").alias("tokens"), "role", "text")
    kind = F.when(F.col("block") == F.col("own"), OWN).otherwise(LEAD).alias("kind")
    return dealt.select("*", kind).groupBy("conv", "block").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("kind", "at", "tokens", "role", "text"))).alias("rows"),
    ).withColumn("first", F.size(F.filter("rows", lambda r: r["kind"] == LEAD)).cast("long")).filter(F.size("rows") > F.col("first")).drop("block")


def _is_system(row: Column) -> Column:
    return (row["at"] == 0) & (row["role"] == "system")


def _cut(blocks: DataFrame, budget: int, history: int) -> DataFrame:
    """Windows of blocks; ``rows`` holds ``first`` rows to repeat, then the block's own."""
    most = history // OVERHEAD + 1
    system = F.filter("rows", _is_system)
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.get(F.col("system"), F.lit(0))["tokens"], F.lit(0)), F.lit(1))
    own = F.slice("rows", F.col("first").cast("int") + 1, F.greatest(F.size("rows") - F.col("first").cast("int"), F.lit(1)))
    charge = lambda r: F.when(_is_system(r), F.lit(0).cast("long")).otherwise(r["tokens"])
    walked = F.aggregate(
        "own", F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("k")),
        lambda held, r: F.when((held["k"] > 0) & (held["used"] + charge(r) <= F.col("room")), F.struct(
            held["starts"].alias("starts"), (held["used"] + charge(r)).alias("used"), (held["k"] + 1).alias("k")))
        .otherwise(F.struct(F.array_append(held["starts"], held["k"]).alias("starts"), charge(r).alias("used"), (held["k"] + 1).alias("k"))))
    cut = _with(_with(blocks, system=system, own=own), room=room).withColumn("starts", walked["starts"])
    window = cut.select("*", F.posexplode("starts").alias("n", "start")).withColumn(
        "stop", F.coalesce(F.get("starts", F.col("n") + 1), F.size("own")))
    new = F.slice("own", F.col("start") + 1, F.col("stop") - F.col("start"))
    before = F.col("first").cast("int") + F.col("start")  # rows of the block before the window
    nearest = F.slice("rows", F.greatest(before - most, F.lit(0)) + 1, F.least(before, F.lit(most)))
    since = F.get(F.col("own"), F.col("start"))["at"]
    past = F.filter(nearest, lambda r: ~_is_system(r) & (r["at"] >= since - history))
    again = F.when(since == 0, F.array().cast(blocks.schema["rows"].dataType)).otherwise(F.concat("system", "past"))
    return _with(_with(window, past=past), at=since, new=new, again=again).select("conv", "conv_id", F.col("at").alias("start"), "new", "again")


def _written(cut: DataFrame) -> DataFrame:
    def piece(loss: bool):
        return lambda r: F.struct(
            F.concat(F.lit(OPEN), escape_role(r["role"]), F.lit("\n")).alias("head"), escape(r["text"]).alias("body"), r["tokens"].alias("tokens"),
            (F.lit(loss) & (r["role"] == "assistant")).alias("loss"))

    pieces = _with(cut.select("conv", "conv_id", "start", F.size("again").alias("repeated"), "again", "new"),
                   pieces=F.concat(F.transform("again", piece(False)), F.transform("new", piece(True))))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "")
    walked = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")),
        lambda held, p: F.struct(
            (held["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE) + 1).alias("at"),
            F.when(p["loss"], F.array_append(held["spans"], F.struct(
                (held["at"] + F.length(p["head"])).alias("start"), (held["at"] + F.length(p["head"]) + F.length(p["body"])).alias("stop")))
            ).otherwise(held["spans"]).alias("spans")))
    tokens = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["tokens"])
    return _with(pieces, text=text, loss=walked["spans"], n=tokens).select("conv", "conv_id", "start", "repeated", "text", "loss", F.col("n").alias("tokens"))


def format_parts(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=token_count, block: int = BLOCK
) -> list[DataFrame]:
    """Windows as tables that share no conversation: (conv, conv_id, start, repeated, text, loss,
    tokens). ``start`` is the number of tokens of the turns before the first new one, ``repeated``
    the turns at the beginning that stood in an earlier window, ``loss`` the target spans in code
    points of ``text``. ``tokens`` counts a text column, by default as PIECE does."""
    if not 0 <= history < budget or history >= block:
        raise ValueError("the history must be smaller than the budget and the block")
    count = OVERHEAD + tokens(F.col("role")) + tokens(F.col("text"))
    found = turns.split(_rows(conversations), count, block)
    blocks = [_short_blocks(found.short, count)]
    if found.long is not None:
        blocks.append(_long_blocks(found.long, found.totals, count, history, block))
    return [_written(_cut(b, budget, history)) for b in blocks]


def format_windows(conversations: DataFrame, **options) -> DataFrame:
    """Windows of all conversations as one table."""
    parts = format_parts(conversations, **options)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss, formatted_chars) of each conversation, from its windows' texts alone:
    ``turns`` lists role, line feed, text, line feed of each turn, ``loss`` the texts under the mask."""
    pieces = F.split("text", CLOSE + "\n", -1)
    pieces = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    head = lambda p: F.instr(p, "\n")
    turn = F.transform(pieces, lambda p: F.concat(
        unescape_role(F.substring(p, F.lit(len(OPEN) + 1), F.instr(p, "\n") - len(OPEN) - 1)), F.lit("\n"),
        unescape(F.substring(p, head(p) + 1, F.length(p))), F.lit("\n")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["stop"] - s["start"])))
    read = windows.select("conv", "conv_id", "start", F.size(pieces).cast("long").alias("n"), F.length("text").cast("long").alias("chars"),
                          F.array_join(turn, "").alias("turns"), F.array_join(loss, "").alias("loss"))
    whole = read.groupBy("conv").agg(
        F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("start", "turns", "loss"))).alias("rows"))
    return whole.select("conv_id", "n_turns", F.array_join("rows.turns", "").alias("turns"), F.array_join("rows.loss", "").alias("loss"), "formatted_chars")
