"""Chat formatting by quotation linking.

Lines that begin with ``>`` signs are quotes; their number is the level.  Neighbouring quoted lines of one level are a
passage.  A passage is normalised (A-Z lower-cased, everything but letters and digits made single spaces) and hashed,
and so are the paragraphs and the whole of what each message says itself.  A message also says a passage when it holds
all of the passage's sentences (parts of lines) in order, as in a partial quote: passages meet messages by the sentence
that the fewest messages hold, and the sentences themselves are compared.  A passage is joined to the message that says
it: the latest earlier turn of its conversation that does, else the least other message.  The message quoted
at the lowest level is the one replied to.  Replies form threads, whose roots are found by pointer doubling; each
message is returned without its quotes, with its thread, its depth and whom it replies to.

Within a conversation a passage's sayers and quoters are read once, in turn order; of other conversations only the
least message that says it is kept, so a passage said by everyone joins once.

Defined results: a null text is empty; a null conversation or turn is a message that is never quoted; rows that repeat
(conversation, turn) are messages of their own and are quoted as one, by the least text; a passage nobody says links
nothing; messages whose links run in a ring belong to the least message met on the way, at depth 0; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomgraph.iterate import cut

QUOTE = r"^[ \t]{0,3}(>(?:[ \t]?>)*)"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """Lines with their quote level and the text behind the signs."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"),
        lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 1), r"[^>]", "")).alias("level"), F.regexp_replace(x, QUOTE + "[ \t]?", "").alias("line")),
    )


def _runs(rows: DataFrame, lines: str, out: str) -> DataFrame:
    """Rows with a column of the neighbouring lines of one level as (level, text), in order.

    Lines and the places where runs start are columns of their own, so that each line is worked out once.
    """
    level = lambda i: F.get(F.col(lines), i)["level"]
    starts = F.filter(F.transform(F.col(lines), lambda x, i: F.when((i == 0) | (x["level"] != level(i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("starts__", starts)
    size = lambda s, k: F.coalesce(F.get(F.col("starts__"), k + 1), F.size(lines)) - s
    text = lambda s, k: F.array_join(F.transform(F.slice(F.col(lines), s + 1, size(s, k)), lambda x: x["line"]), "\n")
    return rows.withColumn(out, F.transform(F.col("starts__"), lambda s, k: F.struct(level(s).alias("level"), text(s, k).alias("text")))).drop("starts__")


def _sentences(text: Column) -> Column:
    """Normalised sentences of each line, in order, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n|(?<=[.!?\u2026])[ \t]+"), normal), lambda s: s != "")


def _partial(base: DataFrame, passages: DataFrame) -> DataFrame:
    """(conv__, turn__, hash) of the messages that hold all sentences of a passage, in order."""
    asked = passages.groupBy("hash").agg(F.min("sentences").alias("sentences"))
    wanted = cut(asked.select("hash", "sentences", F.explode("sentences").alias("sentence")).withColumn("s__", F.xxhash64("sentence")))
    own = base.where("conv__ is not null and turn__ is not null").select("key__", F.explode(F.array_distinct(F.transform(_sentences(F.col("own__")), lambda s: F.xxhash64(s)))).alias("s__"))
    holds = cut(own.join(wanted.select("s__").distinct(), "s__", "left_semi").distinct())
    often = holds.groupBy("s__").agg(F.count(F.lit(1)).alias("k"))
    # A message that holds all of a passage holds its rarest sentence; one that nobody holds ends the passage.
    rarest = wanted.join(often, "s__", "left").groupBy("hash").agg(F.min("sentences").alias("sentences"), F.min(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "s__")).alias("m"))
    pairs = rarest.where("m.k > 0").select("hash", "sentences", F.col("m.s__").alias("s__")).join(holds, "s__")
    rows = pairs.join(base.select("key__", "conv__", "turn__", "own__").dropDuplicates(["key__"]), "key__")
    held = F.aggregate(_sentences(F.col("own__")), F.lit(0), lambda n, s: n + F.when(F.try_element_at("sentences", n + 1) == s, 1).otherwise(0))
    return rows.where(held == F.size("sentences")).select("conv__", "turn__", "hash")


def link(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (conversation, turn and role by default) of each message, with its text without quotes (text), n_quotes,
    quote_level (deepest), reply_conv and reply_turn (null if it replies to none), thread_conv and thread_turn (the first
    message of its thread) and depth (replies from there)."""
    keep = keep or [conv_col, turn_col, "role"]
    base = messages.select(*[F.col(c) for c in keep], F.col(conv_col).alias("conv__"), F.col(turn_col).alias("turn__"), F.col(text_col).cast("string").alias("text__"))
    quoted = F.coalesce(F.col("text__").rlike(r"(?m)^[ \t]{0,3}>"), F.lit(False))
    # Lines are told apart in messages that quote; the others are one line.
    base = base.withColumn("lines__", F.when(quoted, _lines(F.col("text__"))).otherwise(F.array(F.struct(F.lit(0).alias("level"), F.coalesce("text__", F.lit("")).alias("line")))))
    base = _runs(base, "lines__", "runs__").drop("lines__")
    base = base.withColumn("own__", F.array_join(F.transform(F.filter("runs__", lambda r: r["level"] == 0), lambda r: r["text"]), "\n")).withColumn("quotes__", F.filter("runs__", lambda r: r["level"] > 0)).drop("runs__", "text__")
    base = cut(base.withColumn("key__", F.xxhash64("conv__", "turn__", "own__", "quotes__")))
    # What each message says: its paragraphs and lines, and all of it.
    pieces = F.concat(F.split("own__", r"\n\s*\n"), F.split("own__", r"\n"), F.array(F.col("own__")))
    passages = base.select("conv__", "turn__", "key__", F.explode("quotes__").alias("q")).select("conv__", "turn__", "key__", F.col("q.level").alias("level"), normal(F.col("q.text")).alias("norm"), _sentences(F.col("q.text")).alias("sentences")).where("norm <> ''").withColumn("hash", F.xxhash64("norm"))
    asked = passages.select("hash").distinct()
    says = base.where("conv__ is not null and turn__ is not null").select("conv__", "turn__", F.explode(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(normal(p))))).alias("hash")).join(asked, "hash", "left_semi")
    says = cut(says.select("conv__", "turn__", "hash").union(_partial(base, passages)).distinct())
    anyone = says.groupBy("hash").agg(F.min(F.struct("conv__", "turn__")).alias("any"))
    # Where a turn quotes what its conversation has said, the latest earlier turn that said it: one pass in turn order.
    asks = passages.select("conv__", "turn__", "hash", F.lit(0).alias("says")).where("conv__ is not null and turn__ is not null").distinct()
    order = Window.partitionBy("conv__", "hash").orderBy("turn__", "says").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = asks.union(says.select("conv__", "turn__", "hash", F.lit(1))).withColumn("earlier", F.last(F.when(F.col("says") == 1, F.col("turn__")), ignorenulls=True).over(order)).where("says = 0").drop("says")
    found = passages.join(here, ["conv__", "turn__", "hash"], "left").join(anyone, "hash", "left")
    other = F.when(~((F.col("any.conv__").eqNullSafe(F.col("conv__"))) & (F.col("any.turn__") >= F.col("turn__"))), F.col("any"))
    found = found.select("key__", "level", F.when(F.col("earlier").isNotNull(), F.struct("conv__", F.col("earlier").alias("turn__"))).otherwise(other).alias("to")).where("to is not null")
    reply = found.groupBy("key__").agg(F.min(F.struct("level", "to")).alias("m")).select("key__", F.col("m.to").alias("to__"))
    linked = base.join(reply, "key__", "left").withColumn("deep__", F.coalesce(F.array_max(F.transform("quotes__", lambda q: q["level"])), F.lit(0)))
    linked = cut(linked)
    up = linked.where("to__ is not null and conv__ is not null and turn__ is not null").groupBy("conv__", "turn__").agg(F.min("to__").alias("to"))
    roots = _roots(up.select(F.struct("conv__", "turn__").alias("node"), "to")).toDF("at__", "root__", "depth__")
    out = linked.withColumn("node__", F.struct("conv__", "turn__")).join(roots, F.col("node__") == F.col("at__"), "left")
    return out.select(
        *keep, F.trim(F.regexp_replace(F.regexp_replace("own__", r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")).alias("text"), F.size("quotes__").alias("n_quotes"), F.col("deep__").alias("quote_level"),
        F.col("to__.conv__").alias("reply_conv"), F.col("to__.turn__").alias("reply_turn"), F.coalesce(F.col("root__.conv__"), F.col("conv__")).alias("thread_conv"), F.coalesce(F.col("root__.turn__"), F.col("turn__")).alias("thread_turn"), F.coalesce(F.col("depth__"), F.lit(0)).alias("depth"),
    )


def _roots(up: DataFrame) -> DataFrame:
    """(node, root, depth) by pointer doubling; where links run in a ring, the root is the least node met and the depth 0."""
    now = cut(up.select("node", F.col("to").alias("root"), F.lit(1).cast("long").alias("depth"), F.least("node", "to").alias("least"), F.lit(True).alias("moved")))
    for _ in range(now.count().bit_length() + 1):  # a chain has no more links than there are nodes
        step = now.select(F.col("node").alias("mid"), F.col("root").alias("next"), F.col("depth").alias("more"), F.col("least").alias("low"))
        now = cut(now.join(step, F.col("root") == F.col("mid"), "left").select("node", F.coalesce("next", "root").alias("root"), F.least(F.col("depth") + F.coalesce("more", F.lit(0)), F.lit(1 << 40)).alias("depth"), F.least("least", "low").alias("least"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            break
    return now.select("node", F.when(F.col("moved"), F.col("least")).otherwise(F.col("root")).alias("root"), F.when(F.col("moved"), 0).otherwise(F.col("depth")).alias("depth"))
