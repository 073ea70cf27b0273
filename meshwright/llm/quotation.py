"""Quotation linking of conversations (operator 3), in DataFrame functions.

Mail and forum messages quote each other with leading '>' marks, one for each
level. Each message is cut into passages: runs of lines of the same level, with
blank lines between them left out. A message's own passages (level 0) and each
of their lines are normalised (lower case, letters and digits, single spaces)
and hashed; so are the quoted ones. A quoted hash is joined to the latest message
of the conversation before the quoting one that has it as its own. The message
replies to the one it quotes most lines of (level 1 counts before deeper levels,
which quote what the other had quoted; then the later one). Lines and passages of
fewer than LEAST_CHARS characters, which greetings are among, count at a level only
where no longer ones link to an earlier message. Texts lose their
quoted lines and the attribution line right before a quote.

Reply order: `thread` is the turn of the thread's first message and `depth` how
many replies lie between, by pointer doubling with two numbers a message, so a
long chain costs no more than its messages. A conversation's rows sorted by
thread and turn are in reply order, each after what it answers; the result is
sorted so over range partitions.

Only conversations in which anything is quoted are parsed. The latest earlier
message with a passage is found in blocks of BLOCK turns, with the last turn of
the blocks before carried on, so a passage that a third of all messages say or
quote makes no large group, and no conversation is collected in one place.

Defined results: null texts are empty; a message without quotes, or whose quotes
are found nowhere earlier in its conversation, starts a thread of its own; rows
of the same conversation and turn get the same reply and are all kept; a null
conv_id or turn is linked with nothing and has a thread of its turn alone; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.llm.shared import cut

MARKS = r"^[ \t]{0,3}((?:>[ \t]?)+)"
ATTRIBUTION = r"(?i)(^on .{1,200} wrote:$|^.{1,120} (wrote|writes|schrieb|a écrit|escribió) ?:$|^-{2,} ?original message ?-{2,}$)"
#: Passages of fewer normalised characters link only where no longer ones do.
LEAST_CHARS = 12
#: Turns among which the latest earlier message is looked for at once.
BLOCK = 4096
#: A text with a quoted line.
QUOTES = r"(^|\n)[ \t]{0,3}>"


def normal(text: Column) -> Column:
    """Letters and digits; of a text without any, all that isn't white space."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", plain).otherwise(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", ""))


def lines_of(text: str) -> Column:
    """level, body and attribution flag of each line."""
    return F.expr(
        f"""transform(split(coalesce({text}, ''), '\\r?\\n'), x -> named_struct(
            'level', length(regexp_replace(regexp_extract(x, '{MARKS}', 1), '[^>]', '')),
            'body', regexp_replace(x, '{MARKS}', '')))"""
    )


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines, own text, and how many lines are quoted.

    The own text leaves out quoted lines, and attributions that a quoted line follows.
    """
    df = messages.select("conv_id", "turn", "role", lines_of("text").alias("lines"))
    blank = "trim(y.body) = ''"
    own = f"""transform(filter(transform(lines, (x, i) -> named_struct('x', x, 'quote', x.level > 0 OR trim(x.body) RLIKE '{ATTRIBUTION}'
        AND coalesce(get(filter(slice(lines, i + 2, 3), y -> NOT ({blank})), 0).level > 0, false))), z -> NOT z.quote), z -> z.x.body)"""
    return df.withColumn("own", F.expr(own)).withColumn("n_quoted", F.expr("CAST(size(filter(lines, x -> x.level > 0)) AS long)"))


def passages(rows: DataFrame, lines: str) -> DataFrame:
    """conv_id, turn, level, hash and whether it is short, of each line in `lines`, and of each run of lines of one level (blank ones left out).

    Runs are found by joining the lines with one sign where the level stays and
    another where it changes, and splitting there: linear in a text of any length.
    """
    full = rows.select("conv_id", "turn", F.expr(f"transform(filter({lines}, x -> trim(x.body) <> ''), x -> named_struct('level', x.level, 'body', translate(x.body, '\\u0001\\u0002', '  ')))").alias("l"))
    signs = "concat(CASE WHEN i = 0 THEN concat(x.level, '\\u0002') WHEN l[i - 1].level = x.level THEN ' ' ELSE concat('\\u0001', x.level, '\\u0002') END, x.body)"
    full = full.withColumn("runs", F.expr(f"split(array_join(transform(l, (x, i) -> {signs}), ''), '\\u0001')"))
    each = full.select("conv_id", "turn", F.explode(F.expr("concat(transform(l, x -> concat(x.level, '\\u0002', x.body)), CASE WHEN size(l) > 1 THEN runs ELSE array() END)")).alias("p"))
    return each.select("conv_id", "turn", F.split("p", "\u0002").alias("p")).select("conv_id", "turn", F.col("p")[0].cast("int").alias("level"), normal(F.col("p")[1]).alias("body")).where("body <> ''").select("conv_id", "turn", "level", F.xxhash64("body").alias("hash"), (F.length("body") < LEAST_CHARS).alias("short"))


def latest(own: DataFrame, quotes: DataFrame) -> DataFrame:
    """conv_id, hash, turn and origin: the latest turn below `turn` that has the passage as its own, of each quoted one that has any."""
    key = ["conv_id", "hash", "block"]
    marks = own.select("conv_id", "hash", "turn", F.lit(True).alias("said")).distinct().unionByName(quotes.select("conv_id", "hash", "turn", F.lit(False).alias("said")).distinct())
    marks = marks.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("at", F.when(F.col("said"), F.col("turn")))
    # Within a block a window; of each block before it, only its last turn matters.
    before = Window.partitionBy(*key).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = marks.withColumn("origin", F.max("at").over(before)).where("NOT said").select(*key, "turn", "origin")
    lasts = marks.where("said").groupBy(*key).agg(F.max("at").alias("last"))
    wanted = inside.where("origin IS NULL").select(*key).distinct()
    carried = Window.partitionBy("conv_id", "hash").orderBy("block").rangeBetween(Window.unboundedPreceding, -1)
    above = wanted.join(lasts, key, "full").withColumn("carried", F.max("last").over(carried)).select(*key, "carried")
    found = inside.join(above, key, "left").select("conv_id", "hash", "turn", F.coalesce("origin", "carried").alias("origin"))
    return found.where("origin IS NOT NULL")


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn and reply_to of the messages that quote an earlier one of their conversation."""
    messages = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("turn", F.col("turn").cast("long"))
    quoting = messages.where(F.col("text").rlike(QUOTES))
    quotes = cut(passages(parsed(quoting), "lines").where("level > 0").groupBy("conv_id", "turn", "level", "hash", "short").count())
    said = parsed(messages.join(quotes.select("conv_id").distinct(), "conv_id", "left_semi"))
    own = passages(said.withColumn("own", F.transform("own", lambda x: F.struct(F.lit(0).alias("level"), x.alias("body")))), "own")
    own = own.join(quotes.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    hits = quotes.join(latest(own, quotes), ["conv_id", "hash", "turn"])
    lines = lambda which: F.sum(F.when(which, F.col("count")).otherwise(0))
    near, short = F.col("level") == 1, F.col("short")
    score = hits.groupBy("conv_id", "turn", "origin").agg(lines(near & ~short).alias("near"), lines(near & short).alias("near_short"), lines(~short).alias("all"), lines(short).alias("all_short"))
    order = F.struct("near", F.when(F.col("near") == 0, F.col("near_short")).otherwise(0), "all", F.when(F.col("all") == 0, F.col("all_short")).otherwise(0), "origin")
    return score.groupBy("conv_id", "turn").agg(F.max_by("origin", order).alias("reply_to"))


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread (the first message's turn) and depth of the rows of `replies`."""
    now = replies.select("conv_id", "turn", "reply_to", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"))
    while True:
        now = cut(now)
        above = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"), F.col("depth").alias("more"))
        joined = now.join(above, ["conv_id", "thread"], "left")
        if joined.where("next IS NOT NULL").isEmpty():
            return now
        now = joined.select("conv_id", "turn", "reply_to", F.coalesce("next", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def build(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, depth, thread, n_quoted and text of every row of `messages` (conv_id, turn, role, text, ...)."""
    known = threads(links(messages.select("conv_id", "turn", "role", "text")))
    # Lines are looked at only where there is a quote.
    plain, quoted = messages.where(~F.coalesce(F.col("text").rlike(QUOTES), F.lit(False))), messages.where(F.col("text").rlike(QUOTES))
    plain = plain.select("conv_id", "turn", "role", F.lit(0).cast("long").alias("n_quoted"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n", "\n").alias("text"))
    quoted = parsed(quoted).select("conv_id", "turn", "role", "n_quoted", F.array_join("own", "\n").alias("text"))
    rows = plain.unionByName(quoted).withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\n{3,}", "\n\n"), r"^[ \t\n]+|[ \t\n]+$", ""))
    rows = rows.withColumn("turn", F.col("turn").cast("long"))
    out = rows.join(known, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    out = out.select("conv_id", "turn", "role", "reply_to", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "thread", "n_quoted", "text")
    return out.orderBy("conv_id", "thread", "turn")
