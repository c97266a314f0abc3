r"""Chat formatting: reply trees become conversations, one for each chosen root-to-leaf path.

Messages name their parent. Pointer doubling (a self-join per power of two, so about ``log2(depth)`` of them)
gives each message its root, its depth and the score of the path down to it, and keeps each jump table; the
best leaves of a root are ranked by score, and the jump tables, taken in turn, list the messages of a chosen
path without ever holding a path in a row. Only then are texts joined and each path written as one string::

    ### role: text </turn>\n

``\``, ``#`` and ``<`` in a text get a backslash behind them, in a role ``:`` too, so that neither ``###``
nor ``</turn>`` can occur in either, and taking one backslash from behind each gives the text back. The loss
mask is an array of spans (start, length, in code points) of the assistant's escaped texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyflow.llm.common import stage, text_or_empty

TURN, END = "### ", " </turn>\n"


def escape(col: Column, also: str = "") -> Column:
    return F.regexp_replace(col, rf"([\\#<{also}])", r"$1\\")


def unescape(col: Column, also: str = "") -> Column:
    return F.regexp_replace(col, rf"([\\#<{also}])\\", "$1")


def messages_of_turns(rows: DataFrame) -> DataFrame:
    """Linear conversations (``conv_id, turn, role, text``) as messages whose parent is the turn before.

    Turns are numbered in the order of turn, role and text (nulls first), so repeated rows are turns of their
    own; a null conv_id is a conversation like any other.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("tree"),
        (F.row_number().over(order).cast("bigint") - 1).alias("id"),
        "role",
        "text",
    ).select("tree", "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), "role", "text",
             F.lit(0.0).alias("score"))


def tree_key() -> Column:
    """The tree as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("null")).alias("k")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, leaf, rank, depth, id`` for the messages on the ``branches`` best root-to-leaf paths of a root.

    ``messages``: ``tree, id, parent, score``, with ``(tree, id)`` unique. A path's score is the sum of its
    messages' scores (null counts as 0); ties go to the longer path, then to the smaller leaf. A message whose
    parent is null or missing is a root; messages on a cycle have no root and are left out.
    """
    m = messages.select(tree_key(), "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = m.select("k", F.col("id").alias("parent"), F.lit(True).alias("known"))
    m = stage(
        m.join(ids, ["k", "parent"], "left").select("k", "id", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"),
        "messages",
    )
    # ``depth`` counts the replies up to ``jump``, or to the root once that is null; ``sum`` the scores passed.
    state = m.select(
        "k", "id", F.col("parent").alias("jump"), F.col("id").alias("root"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("score").alias("sum"),
    )
    jumps, size = [], m.count()
    step = 0
    while (1 << step) <= size and not state.where("jump is not null").isEmpty():
        jumps.append(state.where("jump is not null").select("k", "id", "jump"))
        up = state.select(
            "k", F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("root").alias("up_root"),
            F.col("depth").alias("up_depth"), F.col("sum").alias("up_sum"),
        )
        moved = state.where("jump is not null").join(up, ["k", "jump"])
        state = stage(
            state.where("jump is null").union(
                moved.select(
                    "k", "id", F.col("next").alias("jump"), F.col("up_root").alias("root"),
                    (F.col("depth") + F.col("up_depth")).alias("depth"),
                    (F.col("sum") + F.col("up_sum")).alias("sum"),
                )
            ),
            "jumps",
        )
        step += 1
    inner = m.where("parent is not null").select("k", F.col("parent").alias("id")).distinct()
    leaves = state.where("jump is null").join(inner, ["k", "id"], "left_anti")
    if branches == 1:
        best = leaves.groupBy("k", "root").agg(
            F.max(F.struct("sum", "depth", (-F.col("id")).alias("less"), "id")).alias("b"), F.lit(1).alias("rank")
        ).select("k", F.col("b.id").alias("leaf"), "rank", F.col("b.depth").alias("leaf_depth"))
    else:
        by = Window.partitionBy("k", "root").orderBy(F.desc("sum"), F.desc("depth"), "id")
        best = leaves.select(
            "k", F.col("id").alias("leaf"), F.row_number().over(by).alias("rank"), F.col("depth").alias("leaf_depth")
        ).where(F.col("rank") <= branches)
    path = best.select("k", "leaf", "rank", F.col("leaf_depth").alias("depth"), F.col("leaf").alias("id"))
    path = stage(path, "paths")
    for i, jump in enumerate(jumps):
        # Every distance is a sum of different powers of two in one way only: no message comes twice.
        above = path.join(jump, ["k", "id"]).select("k", "leaf", "rank", F.col("depth") - (1 << i), F.col("jump"))
        path = stage(path.union(above), "paths")
    return path.withColumnRenamed("k", "tree")


def format_paths(messages: DataFrame, paths: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``tree, leaf, rank, formatted, loss_spans``: one string for each path, and what of it is trained on.

    A path's messages meet in one row because its text is one value; paths are as large as that and no larger.
    """
    texts = messages.select(
        "tree", tree_key(), "id",
        F.concat(F.lit(TURN), escape(text_or_empty("role"), ":"), F.lit(": ")).alias("head"),
        escape(text_or_empty("text")).alias("body"),
        F.coalesce(F.col("role") == trained_role, F.lit(False)).alias("trained"),
    )
    path = ("tree", "leaf", "rank")
    before = Window.partitionBy(*path).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    length = (F.length("head") + F.length("body") + len(END)).cast("bigint")
    placed = paths.withColumnRenamed("tree", "k").join(texts, ["k", "id"]).select(
        *path, "depth", "head", "body", "trained",
        (F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head")).alias("start"),
    )
    span = F.struct("start", F.length("body").cast("bigint").alias("length"))
    turn = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("turn"))
    return placed.groupBy(*path).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["turn"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), span))).alias("loss_spans"),
    )


def read_turns(formatted: str) -> Column:
    """The turns of a formatted conversation: an array of ``role, text``."""
    raw = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    return F.transform(
        raw,
        lambda x: F.struct(
            unescape(F.substring_index(x.substr(F.lit(len(TURN) + 1), F.length(x)), ": ", 1), ":").alias("role"),
            unescape(
                x.substr(
                    F.length(F.substring_index(x.substr(F.lit(len(TURN) + 1), F.length(x)), ": ", 1)) + len(TURN) + 3,
                    F.length(x),
                )
            ).alias("text"),
        ),
    )


def read_loss(formatted: str, spans: str) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws(
        "", F.transform(spans, lambda s: unescape(F.col(formatted).substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    )
