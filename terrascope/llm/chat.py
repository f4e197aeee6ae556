"""Reply trees to conversations.

Messages point at the message they answer. Self-joins that double the distance give every message its depth, the score
and the length of the text on its way from the root; a tree of depth d takes log2(d) rounds. Leaves are ranked by the
score of their path. The chosen paths are expanded with the same distances, each message once per path, and each path
becomes one conversation.

Template: `### role: text</turn>` and a line feed per turn. In texts a backslash becomes `\\0`, three hashes become
`\\1\\1\\1` and `</turn>` becomes `\\2/turn>`; in roles a colon also becomes `\\3`. No text can hold a mark.

Defined results: a null role or text is empty; a message whose parent is missing starts a tree; a message id that is
there twice in a conversation is an error, and so are a message without an id and a circle of replies; a null
conversation id is a conversation of its own; ties of score go to the smaller leaf; other columns are ignored; an empty
table gives no rows; a path, however long its texts, is one row and is put together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

HEAD, COLON, END = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"


def escaped(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\0"))
    return F.replace(F.replace(c, F.lit("###"), F.lit("\\1\\1\\1")), F.lit("</turn>"), F.lit("\\2/turn>"))


def unescaped(c: Column) -> Column:
    for code, plain in (("\\3", ":"), ("\\2", "<"), ("\\1", "#"), ("\\0", "\\")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def turn_head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.replace(escaped(role), F.lit(":"), F.lit("\\3")), F.lit(COLON))


def _same(left: str, left_id: str, right: str, right_id: str) -> Column:
    return F.col(f"{left}.conv").eqNullSafe(F.col(f"{right}.conv")) & (F.col(f"{left}.{left_id}") == F.col(f"{right}.{right_id}"))


def reply_paths(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, msg, depth, score, chars) summed from the root, and for each k the (conv, msg, up) 2^k replies apart.

    `links`: conv, msg, parent, score, chars of each message. Every round joins the messages with themselves by their
    present ancestor, on ids that are unique, so no key is crowded; a message that has reached its root drops out.
    """
    known = links.select("conv", "msg", F.lit(True).alias("known"))
    level = staged(
        links.alias("a").join(known.alias("b"), _same("a", "parent", "b", "msg"), "left").select(
            "a.conv", "a.msg", F.when(F.col("b.known"), F.col("a.parent")).alias("up"), F.lit(1).alias("depth"),
            "a.score", "a.chars"), "chat-paths")
    total, ids, nameless = level.agg(
        F.count(F.lit(1)), F.count_distinct(F.struct("conv", "msg")), F.count_if(F.col("msg").isNull())).first()
    if nameless:
        raise ValueError(f"{nameless} messages have no id")
    if total != ids:
        raise ValueError("a message id is there twice in one conversation")
    jumps, reach, done = [], 1, level.filter(F.col("up").isNull())
    active = level.filter(F.col("up").isNotNull())
    while active.limit(1).count():
        if reach > 2 * total:
            raise ValueError("messages answer one another in a circle")
        jumps.append(active.select("conv", "msg", "up"))
        joined = active.alias("a").join(done.unionByName(active).alias("b"), _same("a", "up", "b", "msg"))
        level = staged(joined.select(
            "a.conv", "a.msg", "b.up", *[(F.col(f"a.{c}") + F.col(f"b.{c}")).alias(c) for c in ("depth", "score", "chars")],
        ), "chat-paths")
        done = done.unionByName(level.filter(F.col("up").isNull()))
        active = level.filter(F.col("up").isNotNull())
        reach *= 2
    return done.drop("up"), jumps


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """conv, leaf, rank, score, n_turns, formatted, loss_spans (start and length in code points, from 0).

    `messages`: conv, msg, parent, role, text, score. `branches` keeps the best paths of each conversation; None keeps
    all. The loss mask covers the texts of the assistant's turns.
    """
    turns = messages.select(
        "conv", "msg", "parent", F.coalesce("role", F.lit("")).alias("role"),
        turn_head(F.col("role")).alias("head"), escaped(F.col("text")).alias("body"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    chars = (F.char_length("head") + F.char_length("body") + len(END)).cast("bigint")
    paths, jumps = reply_paths(turns.select("conv", "msg", "parent", "score", chars.alias("chars")))

    answered = turns.filter(F.col("parent").isNotNull()).select("conv", "parent")
    leaves = paths.alias("a").join(answered.alias("b"), _same("a", "msg", "b", "parent"), "left_anti")
    best = F.row_number().over(W.partitionBy("conv").orderBy(F.desc("score"), "msg"))
    ranked = leaves.select("conv", F.col("msg").alias("leaf"), "msg", "score", best.alias("rank"))
    if branches is not None:
        ranked = ranked.filter(F.col("rank") <= branches)
    ranked = staged(ranked, "chat-leaves")

    members = ranked.select("conv", "leaf", "msg")
    for jump in jumps:
        further = members.alias("a").join(jump.alias("b"), _same("a", "msg", "b", "msg")).select(
            "a.conv", "a.leaf", F.col("b.up").alias("msg"))
        members = staged(members.unionByName(further), "chat-members")

    placed = paths.select("conv", "msg", "depth", "chars")
    start = F.col("d.chars") - F.char_length("t.body") - len(END)
    pieces = (
        members.alias("m").join(placed.alias("d"), _same("m", "msg", "d", "msg"))
        .join(turns.alias("t"), _same("m", "msg", "t", "msg"))
        .select(
            "m.conv", "m.leaf", F.col("d.depth").alias("depth"),
            F.concat("t.head", "t.body", F.lit(END)).alias("piece"),
            F.when(F.col("t.role") == LOSS_ROLE, F.struct(
                start.cast("bigint").alias("start"), F.char_length("t.body").cast("bigint").alias("length"))).alias("span"))
    )
    whole = pieces.groupBy("conv", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("depth", "piece", "span"))).alias("turns"))
    formatted = whole.select(
        "conv", "leaf", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"))
    order = ranked.select("conv", "leaf", "rank", "score")
    return formatted.alias("f").join(order.alias("r"), _same("f", "leaf", "r", "leaf")).select(
        "f.conv", "f.leaf", "r.rank", "r.score", "f.n_turns", "f.formatted", "f.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.filter(F.split(formatted, END, -1), lambda part: part != "")

    def parse(part: Column) -> Column:
        colon = F.instr(part, ":")
        return F.struct(
            unescaped(F.substring(part, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)).alias("role"),
            unescaped(F.substring(part, colon + len(COLON), F.char_length(part))).alias("text"))

    return F.transform(parts, parse)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chained(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of plain conversations: every turn answers the turn before it."""
    place = F.row_number().over(W.partitionBy(conv).orderBy(turn, "role", "text"))
    return rows.select(
        F.col(conv).alias("conv"), place.alias("msg"), "role", "text", F.lit(0.0).alias("score"),
    ).withColumn("parent", F.when(F.col("msg") > 1, F.col("msg") - 1))
