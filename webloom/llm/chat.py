"""Chat formatting with a prefix tree: turns that conversations share are emitted once, depth-first.

Conversations that begin with equal turns share the nodes of these turns. A node is known by a digest over all turns up
to it. Sorted by the digests of their turns, conversations come in depth-first order, and a conversation shares with
earlier ones exactly what it shares with the one before it; it emits the rest as one chunk. A tree is the sequence of its
chunks. A chunk carries its place in the tree, the position ids of its characters (as if the conversation stood alone)
and the intervals of the tree that hold its ancestors: a character attends to these and to what precedes it in the chunk.

The order comes from a range partitioning by the digests, so one first turn that a third of all conversations share is
spread over many tasks; places are running sums within partitions plus the sums of the partitions before. The unit that
is handled as one row is a conversation; its digests, places and pieces are made in about linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import stored

# The template.
START, END = "<|im_start|>", "<|im_end|>\n"
ANSWERS = "assistant"

#: Items that ``scan`` folds before it starts another array.
RUN = 128
SPAN = "struct<start:bigint,end:bigint>"


def escape(text: Column) -> Column:
    """No control string can stand in the result, and ``unescape`` gives the text back."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("&lt;|"), F.lit("<|")), F.lit("&#10;"), F.lit("\n")),
                     F.lit("&amp;"), F.lit("&"))


def scan(items: Column, start: Column, step, kind: str) -> Column:
    """All states of a fold, without the first: ``step(state, item)`` for each item, states of SQL type ``kind``.

    An array that grows by one is copied whole each time, so states are collected in runs of ``RUN`` items, and the runs
    are put together at the end.
    """
    states = F.array().cast(f"array<{kind}>")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")),
                       lambda i: F.slice(items, i * RUN + 1, F.lit(RUN)))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def over(run: Column, first: Column) -> Column:
        return F.aggregate(run, states, lambda acc, x: F.concat(
            acc, F.array(step(F.when(F.size(acc) > 0, last(acc)).otherwise(first), x))))

    empty = F.struct(start.cast(kind).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("done"))
    step_run = lambda acc, run: F.transform(F.array(over(run, acc["state"])), lambda got: F.struct(
        last(got).alias("state"), F.concat(acc["done"], F.array(got)).alias("done")))[0]
    folded = F.aggregate(runs, empty, step_run, lambda acc: F.flatten(acc["done"]))
    return F.when(F.size(items) > 0, folded).otherwise(states)


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
                 ) -> tuple[DataFrame, DataFrame]:
    """Chunks of the prefix trees, and which chunk ends each conversation.

    Chunks: ``chunk`` (digest of the conversation it ends), ``tree`` (digest of the first turn), ``start`` (in the
    tree), ``position`` (of its first character), ``text``, ``attend`` (array of (start, end) in the tree, one for each
    ancestor node, from the first), ``nodes`` (array of (start, end), one for each turn it holds) and ``loss`` (array of
    (start, end): the answers' texts). Members: the conversation id and ``chunk``.

    Turns are ordered by turn (nulls first), then role and text, and repeated rows are repeated turns. Null roles and
    texts count as empty; rows without a conversation id are one conversation. Extra columns are ignored.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    convs = df.groupBy(F.col(conv_id).alias("conv")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    rendered = F.transform("turns", lambda t: F.concat(
        F.lit(START), _escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END)))
    convs = convs.select("conv", rendered.alias("rendered"),
                         F.transform("turns", lambda t: t["role"] == ANSWERS).alias("answers"))
    path = scan(F.col("rendered"), F.lit(""), lambda digest, t: F.md5(F.concat(digest, t)), "string")
    convs = convs.withColumn("path", path).withColumn("chunk", F.element_at("path", -1))
    convs = stored(convs, "conversations")
    members = convs.select(F.col("conv").alias(conv_id), "chunk")

    # Equal conversations become one; what is carried belongs to the digest, so any of them will do.
    ways = convs.groupBy("chunk").agg(F.first(F.struct("path", "rendered", "answers")).alias("w")).select(
        "chunk", "w.*").withColumn("key", F.array_join("path", ""))
    ways = stored(ways.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ways")
    in_part = Window.partitionBy("part").orderBy("key")
    ends = ways.groupBy("part").agg(F.max_by("path", "key").alias("last"))
    # One row for each partition.
    ends = ends.select((F.col("part")).alias("of"), "last").withColumn("part", F.lead("of").over(
        Window.partitionBy(F.lit(0)).orderBy("of"))).where("part is not null").select("part", "last")
    rows = ways.withColumn("previous", F.lag("path").over(in_part)).join(ends, "part", "left").withColumn(
        "shared", F.size(F.array_intersect("path", F.coalesce("previous", "last", F.array().cast("array<string>")))))
    lengths = F.transform("rendered", F.length)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda x, y: x + y)
    rows = rows.withColumn("lengths", lengths).select(
        "part", "key", "chunk", "path", "shared",
        F.slice("rendered", F.col("shared") + 1, F.size("rendered")).alias("pieces"),
        F.slice("answers", F.col("shared") + 1, F.size("answers")).alias("answers"),
        F.slice("lengths", F.col("shared") + 1, F.size("lengths")).alias("own"),
        total(F.slice("lengths", F.lit(1), F.col("shared"))).alias("position"))
    rows = stored(rows.withColumn("length", total("own")), "chunks")
    running = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("at", F.sum("length").over(running) - F.col("length")).withColumn(
        "begins", F.last(F.when(F.col("shared") == 0, F.col("at")), ignorenulls=True).over(running))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("part").agg(F.sum("length").alias("sum"), F.max("begins").alias("begun"))
    sums = sums.withColumn("base", F.coalesce(F.sum("sum").over(before), F.lit(0))).withColumn(
        "open", F.last(F.col("base") + F.col("begun"), ignorenulls=True).over(before)).select("part", "base", "open")
    placed = placed.join(sums, "part").withColumn(
        "start", F.col("base") + F.col("at") - F.coalesce(F.col("base") + F.col("begins"), F.col("open")))
    spans = scan(F.col("own"), F.struct(F.col("start").alias("start"), F.col("start").alias("end")), lambda before, n: F.struct(
        before["end"].alias("start"), (before["end"] + n).alias("end")), SPAN)
    head = len(START) + len(ANSWERS) + 1
    placed = placed.withColumn("nodes", spans).withColumn("loss", F.filter(
        F.zip_with("nodes", "answers", lambda s, a: F.when(a, F.struct(
            (s["start"] + head).alias("start"), (s["end"] - len(END)).alias("end")))), lambda s: s.isNotNull()))
    placed = stored(placed.select(
        "chunk", F.element_at("path", 1).alias("tree"), "start", "position", F.array_join("pieces", "").alias("text"),
        "path", "shared", "nodes", "loss"), "chunks")

    nodes = placed.select(F.explode(F.arrays_zip(
        F.slice("path", F.col("shared") + 1, F.size("path")).alias("node"), F.col("nodes").alias("span"))).alias("n")
    ).select("n.node", "n.span")
    upper = placed.where("shared > 0").select("chunk", F.posexplode(F.slice("path", F.lit(1), F.col("shared"))).alias(
        "depth", "node")).join(nodes, "node").groupBy("chunk").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("depth", "span"))), lambda x: x["span"]).alias("attend"))
    chunks = placed.drop("path", "shared").join(upper, "chunk", "left").withColumn(
        "attend", F.coalesce("attend", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    return chunks, members


def read_chats(chunks: DataFrame, members: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Put each conversation together again from the emitted chunks: what its last character attends to, in order.

    ``conv_id``, ``turns`` (array of (role, text)), ``answers`` (all text under the loss mask, unescaped),
    ``formatted`` (the whole formatted text).
    """
    chunks = stored(chunks, "emitted")
    # No text holds a control string, so the pieces end where one does; substrings would count from the chunk's begin.
    pieces = F.split("text", r"(?<=<\|im_end\|>\n)")
    # Answers lie in the order of the nodes, at most one in each: the next one, if it ends inside.
    following = lambda at, s: F.when(F.get(F.col("loss"), at)["end"] <= s["end"], F.get(F.col("loss"), at))
    masked = scan(F.col("nodes"), F.struct(F.lit(0).alias("next"), F.lit(None).cast(SPAN).alias("span")), lambda a, s: F.struct(
        (a["next"] + following(a["next"], s).isNotNull().cast("int")).alias("next"),
        following(a["next"], s).alias("span")), f"struct<next:int,span:{SPAN}>")
    nodes = chunks.select("tree", F.explode(F.arrays_zip(
        F.col("nodes").alias("node"), F.slice(pieces, F.lit(1), F.size("nodes")).alias("piece"),
        masked.alias("answer"))).alias("n")).select(
        "tree", F.col("n.node.start").alias("at"), "n.piece", F.col("n.answer.span").alias("span")).select(
        "tree", "at", "piece", F.when(F.col("span").isNotNull(), F.array(F.substring(
            F.col("piece"), (F.col("span.start") - F.col("at") + 1).cast("int"),
            (F.col("span.end") - F.col("span.start")).cast("int")))).otherwise(F.array().cast("array<string>")).alias("answers"))
    steps = chunks.select("chunk", "tree", F.posexplode(F.concat("attend", "nodes")).alias("depth", "span")).select(
        "chunk", "tree", "depth", F.col("span.start").alias("at"))
    whole = steps.join(nodes, ["tree", "at"]).groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("depth", "piece", "answers"))).alias("n"))
    body = lambda x: F.substring(x["piece"], F.lit(len(START) + 1), F.length(x["piece"]) - len(START) - len(END))
    turns = F.transform("n", lambda x: F.struct(
        _unescape_role(F.substring_index(body(x), "\n", 1)).alias("role"),
        unescape(F.substring(body(x), F.instr(body(x), "\n") + 1, F.length(body(x)))).alias("text")))
    whole = whole.select("chunk", turns.alias("turns"), F.array_join(F.transform("n", lambda x: x["piece"]), "").alias(
        "formatted"), F.array_join(F.transform(F.flatten(F.transform("n", lambda x: x["answers"])), unescape), "").alias(
        "answers"))
    return members.join(whole, "chunk").select(conv_id, "turns", "answers", "formatted")
