"""Conversations in reply order without quotations, by linking quoted passages to the messages they come from.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.llm._scale import materialise
from quakeloom.operators.ordered import carry_forward, global_rank

#: A line's quote marks: any number of ``>``, each with white space around it.
MARKS = r"^[ \t]*(?:>[ \t]?)+"
#: A line that introduces a quotation.
ATTRIBUTION = r"(?i)^\s*(?:on|am|le|el)\b.*\b(?:wrote|schrieb|a écrit|escribió)\b.*:\s*$"
#: Turns that one task puts in order at a time.
_PART = 1024


def _normal(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def _parsed(text: Column) -> Column:
    """Lines with their quote level and what follows the marks."""
    lines = F.split(text, "\r\n|\r|\n")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("body")
        ),
    )


def parse_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per different message: key, conv_id, turn, role, content, own (keys of its own words), quoted.

    ``quoted`` holds the passages of lines at one level: level, keys, and the characters of each key. A
    key is the hash of normalised text: of a whole passage and of each of its lines.
    """
    base = messages.select(
        F.col(conv_col).alias("conv_id"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).dropDuplicates()
    lines = base.withColumn("lines", _parsed(F.col("text"))).drop("text")
    quotes_next = lambda i: F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0
    kind = F.transform(
        "lines",
        lambda x, i: F.struct(
            F.when((x["level"] == 0) & x["body"].rlike(ATTRIBUTION) & quotes_next(i), F.lit(-1)).otherwise(x["level"]).alias("level"), x["body"].alias("body")
        ),
    )
    lines = lines.withColumn("lines", kind)
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"])
    content = F.regexp_replace(F.regexp_replace(F.array_join(own, "\n"), r"\n\s*\n(?:\s*\n)+", "\n\n"), r"^\s+|\s+$", "")
    # passages: a mark where the level changes, then split there
    changes = lambda x, i: (i == 0) | (F.get("lines", i - 1)["level"] != x["level"])
    joined = F.array_join(F.transform("lines", lambda x, i: F.concat(F.when(changes(x, i), "\u0001").otherwise("\n"), F.replace(x["body"], F.lit("\u0001"), F.lit(" ")))), "")
    levels = F.filter(F.transform("lines", lambda x, i: F.when(changes(x, i), x["level"])), lambda x: x.isNotNull())
    passages = F.zip_with(F.slice(F.split(joined, "\u0001"), 2, 1_000_000_000), levels, lambda t, level: F.struct(level.alias("level"), t.alias("body")))

    def keys(body: Column) -> Column:
        normal = F.filter(F.transform(F.array_union(F.array(body), F.split(body, "\n")), _normal), lambda x: x != "")
        return F.transform(F.array_distinct(normal), lambda x: F.struct(F.xxhash64(x).alias("key"), F.length(x).alias("weight")))

    quoted = F.transform(
        F.filter(passages, lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), keys(x["body"]).alias("keys"))
    )
    return lines.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("\u0000")).alias("key"),
        "conv_id", "turn", "role", content.alias("content"), F.transform(keys(content), lambda x: x["key"]).alias("own"), quoted.alias("quoted"),
    )


def link_quotes(parsed: DataFrame) -> DataFrame:
    """(key, turn, level, origin, weight): the message from which a message quotes most at a level.

    The origin of a passage or line is the first message of the conversation with those own words; only
    earlier messages count. Of origins with equally many characters quoted the latest is taken.
    """
    quotes = parsed.filter(F.size("quoted") > 0).select("key", "turn", F.explode("quoted").alias("q"))
    quotes = quotes.select("key", "turn", "q.level", F.explode("q.keys").alias("k")).select("key", "turn", "level", F.col("k.key").alias("h"), "k.weight")
    origins = (
        parsed.join(quotes.select("key").distinct(), "key", "left_semi")
        .select("key", "turn", F.explode("own").alias("h"))
        .groupBy("key", "h")
        .agg(F.min("turn").alias("origin"))
    )
    found = quotes.join(origins, ["key", "h"]).filter("origin < turn").groupBy("key", "turn", "level", "origin").agg(F.sum("weight").alias("weight"))
    best = found.groupBy("key", "turn", "level").agg(F.max(F.struct("weight", "origin")).alias("b"))
    return best.select("key", "turn", "level", "b.origin", "b.weight")


def reply_targets(links: DataFrame) -> DataFrame:
    """(key, turn, origin): the message that a message replies to, from the links of all its levels.

    The lowest level with an origin decides. At the first level that is the message quoted. Where only deeper
    words are found, as when the first level was edited, the reply is to whoever quoted them one
    level less: the latest such message before it, carried forward over the conversation's turns, else to
    their author.
    """
    lowest = links.groupBy("key", "turn").agg(F.min(F.struct("level", "origin")).alias("l")).select("key", "turn", "l.level", "l.origin")
    deep = lowest.filter("level > 1")
    # at one turn who asks comes before who quotes, so only earlier turns are found
    quoting = links.select("key", "origin", "level", "turn", F.lit(1).alias("quotes"), F.col("turn").alias("by"))
    asking = deep.select("key", "origin", (F.col("level") - 1).alias("level"), "turn", F.lit(0).alias("quotes"), F.lit(None).cast("long").alias("by"))
    needed = quoting.join(asking.select("key", "origin", "level").distinct(), ["key", "origin", "level"], "left_semi")
    found = carry_forward(needed.unionByName(asking), ["key", "origin", "level"], ["turn", "quotes"], {"last": F.col("by")}).filter("quotes = 0")
    answered = found.select("key", "turn", F.coalesce("last", "origin").alias("origin"))
    return lowest.filter("level = 1").select("key", "turn", "origin").unionByName(answered)


def format_chats(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = 64
) -> DataFrame:
    """Training text of conversations in reply order: conv_id, thread_turn, block, piece, reply_to, n_messages, n_quotes, text.

    A message that quotes another than the one before it replies to the quoted one and begins a thread;
    so does one whose turn before is missing. See :func:`reply_targets` for nested quotations. Other messages continue their thread. A row holds at most
    ``block`` turns of a thread, in order, each as ``<|role|>`` and its own words; ``reply_to`` is the
    turn that the thread's first message replies to. Quoted lines and the line that introduces them
    are gone from the text, counted in ``n_quotes`` by passage.

    Null text is empty, a null role ``unknown``, a null turn -1; rows with a null conversation are one
    conversation; equal rows are one message; different messages of one turn stand in order of role and
    text. Where a turn has more than ``block`` different messages (null turns, say), the messages of its
    block are numbered in that order, across range partitions, and cut into pieces of ``block`` messages,
    numbered from 0; elsewhere piece is 0.
    A conversation of any length is handled in parts of 1024 turns, never gathered.
    """
    # read three times below; parsing is most of the work
    parsed = materialise(parse_quotes(messages, conv_col, turn_col, role_col, text_col), "parsed")
    links = reply_targets(materialise(link_quotes(parsed), "links"))
    turns = parsed.groupBy("key", "turn").agg(F.count("*").alias("n"))
    before = turns.select("key", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("follows"))
    flow = turns.join(before, ["key", "turn"], "left").join(links, ["key", "turn"], "left")
    starts = F.col("follows").isNull() | (F.coalesce(F.col("origin"), F.col("turn") - 1) != F.col("turn") - 1)
    flow = flow.select("key", "turn", "n", "origin", F.when(starts, F.col("turn")).alias("start"), F.floor(F.col("turn") / _PART).alias("part"))
    carried = flow.groupBy("key", "part").agg(F.max("start").alias("last"))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("key", "part", F.max("last").over(earlier).alias("carried"))
    within = Window.partitionBy("key", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    threads = (
        flow.withColumn("own_start", F.max("start").over(within))
        .join(carried, ["key", "part"])
        .select("key", "turn", "n", "origin", F.coalesce("own_start", "carried").alias("thread_turn"))
    )
    rows = parsed.select("key", "conv_id", "turn", "role", "content", F.size("quoted").alias("quotes")).join(threads, ["key", "turn"])
    rows = rows.withColumn("block", F.floor((F.col("turn") - F.col("thread_turn")) / block))
    place = ["key", "thread_turn", "block"]
    crowded = materialise(threads.filter(F.col("n") > block).select("key", "thread_turn", F.floor((F.col("turn") - F.col("thread_turn")) / block).alias("block")).distinct(), "crowded")
    ordered = global_rank(rows.join(crowded, place, "left_semi"), place, ["turn", "role", "content"], "rank").withColumn("piece", F.floor(F.col("rank") / block)).drop("rank")
    rows = rows.join(crowded, place, "left_anti").withColumn("piece", F.lit(0).cast("long")).unionByName(ordered)
    grouped = rows.groupBy(*place, "piece").agg(
        F.first("conv_id").alias("conv_id"),
        F.min(F.when(F.col("turn") == F.col("thread_turn"), F.col("origin"))).alias("reply_to"),
        F.count("*").alias("n_messages"),
        F.sum("quotes").alias("n_quotes"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"),
    )
    text = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["content"])), "\n")
    return grouped.select("conv_id", "thread_turn", "block", "piece", "reply_to", "n_messages", "n_quotes", text.alias("text"))
