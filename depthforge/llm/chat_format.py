"""Chat formatting of reply trees, in DataFrame operations only.

Messages (tree, node, parent, role, text, score) are joined to themselves: in round k every node
learns its ancestor 2**k steps up, the score of the path so far and its depth, until all have
reached a root. Leaves are then the ends of root-to-leaf paths; the paths of a tree are ranked
by score, and each chosen one is walked back through the same jumps, again in a number of joins
that is the logarithm of its depth, and formatted as one conversation.

Template: a turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In a text, every ``<`` that is followed
by any number of backslashes and a ``|`` gets one more backslash, so no text holds ``<|``; the
inverse takes it away. In a role ``%``, line feeds and ``<`` are written as %25, %0A and %3C.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def rank_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of each tree: (tree, path_rank, leaf, node, up).

    ``messages`` has tree, node, parent, score. A row of the result is a node of a chosen path,
    ``up`` steps above its leaf. A path's score is the mean score of its nodes (null: 0); ties go
    to the longer path, then to the smaller leaf. A node whose parent is null, missing or itself is
    a root. Nodes in a cycle have no root and are on no path. ``node`` must be unique in a tree.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    ids = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    real = F.col("known").isNotNull() & ~F.col("node").eqNullSafe(F.col("parent"))
    state = materialize(nodes.join(ids, ["tree", "parent"], "left").select("tree", "node", F.when(real, F.col("parent")).alias("anc"), F.when(real, F.lit(True)).alias("more"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("n")), "jumps")
    limit = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    jumps, reach = [], 1
    while True:
        jumps.append(state.filter("more").select("tree", "node", "anc"))
        if reach > limit or jumps[-1].isEmpty():
            jumps.pop()  # nobody has an ancestor this far up
            break
        up = state.select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc2"), F.col("more").alias("more2"), F.col("total").alias("total2"), F.col("n").alias("n2"))
        held = state.filter("more").join(up, ["tree", "anc"])
        done = state.filter("more is null")
        state = materialize(done.unionByName(held.select("tree", "node", F.col("anc2").alias("anc"), F.col("more2").alias("more"), (F.col("total") + F.col("total2")).alias("total"), (F.col("n") + F.col("n2")).alias("n"))), "jumps")
        reach *= 2
    parents = state.limit(0).select("tree", "node") if not jumps else jumps[0].select("tree", F.col("anc").alias("node")).distinct()
    # a node's root is its last ancestor; paths are ranked in the whole tree
    leaves = state.filter("more is null").join(parents, ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("n")), F.desc("n"), "node")
    chosen = leaves.withColumn("path_rank", F.row_number().over(order)).filter(F.col("path_rank") <= top)
    walked = chosen.select("tree", "path_rank", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    for k, jump in reversed([*enumerate(jumps)]):
        # a distance from the leaf is a sum of powers of two, so each ancestor comes once; long jumps go first, while there are few rows
        both = walked.join(jump, ["tree", "node"], "left")
        here, there = F.struct("node", "up"), F.struct(F.col("anc").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        stops = F.when(F.col("anc").isNull(), F.array(here)).otherwise(F.array(here, there))
        walked = both.select("tree", "path_rank", "leaf", F.explode(stops).alias("s")).select("tree", "path_rank", "leaf", "s.node", "s.up")
    return walked


def format_conversations(messages: DataFrame, top: int = 1) -> DataFrame:
    """Format the ``top`` best paths of each reply tree.

    ``messages``: tree, node, parent, role, text, score. Returns a row for each path: tree,
    path_rank, leaf, formatted (string) and segments, an array of (text, loss) whose texts in a row
    are ``formatted``; loss is true on the texts of assistants and nowhere else.
    Null roles and texts count as empty. Other columns are ignored. An empty table gives no rows.
    """
    paths = rank_paths(messages, top)
    turns = paths.join(messages.select("tree", "node", turn_fields("role", "text")), ["tree", "node"])
    turns = turns.select("tree", "path_rank", "leaf", F.struct((-F.col("up")).alias("at"), "m.head", "m.body", "m.loss").alias("turn"))
    grouped = turns.groupBy("tree", "path_rank", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    parts = F.flatten(F.transform("turns", lambda t: F.array(segment(t["head"], F.lit(False)), segment(t["body"], t["loss"]), segment(F.lit(END), F.lit(False)))))
    out = grouped.select("tree", "path_rank", "leaf", parts.alias("segments"))
    return out.select("tree", "path_rank", "leaf", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def turn_fields(role: str, text: str) -> Column:
    """Head, escaped text and loss flag of a turn."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.struct(F.concat(F.lit(START), escape_role(r), F.lit("\n")).alias("head"), escape_text(t).alias("body"), (r == "assistant").alias("loss")).alias("m")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) that a formatted conversation holds."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2_000_000_000)
    at = lambda p: F.locate("\n", p)
    return F.transform(parts, lambda p: F.struct(unescape_role(F.substring(p, F.lit(1), at(p) - 1)).alias("role"), unescape_text(F.substring(p, at(p) + 1, F.length(p) - at(p) - len(END))).alias("text")))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text): each turn answers the one before it.

    Turns that share a number come in the order of role and text; repeated rows are kept.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    node = F.row_number().over(order)
    return rows.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
