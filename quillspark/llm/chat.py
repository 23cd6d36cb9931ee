"""Reply trees to training conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

#: The marks of the template. Texts cannot hold them, as they hold no < or [ once escaped.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What starts a control string, and its escape; ~ itself comes first on the way in and last on the way out.
ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2")]


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def one_of_each_node(nodes: DataFrame) -> DataFrame:
    """One row of each (tree, node): of repeated ones the least by parent (null first), role, text and score. Null nodes are left out."""
    rest = F.struct("parent", "role", "text", "score")
    return nodes.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min(rest).alias("r")).select("tree", "node", "r.*")


def reply_paths(nodes: DataFrame, top: int = 1, unique: bool = False) -> DataFrame:
    """Root-to-leaf paths of reply trees: (tree, path, rank, turn, role, text), the best `top` paths of each tree; path is its leaf.

    nodes: tree, node, parent (null at a root), role, text, score; other columns are ignored. Self-joins on (tree, node) double the
    distance that every node looks up, with the scores on the way, so a thread of n turns takes log2(n) rounds of narrow
    rows, and one long thread is spread over all tasks. Leaves are ranked by the sums of their paths' scores (null counts
    as 0), ties by the smaller leaf; only chosen paths are then listed node by node, and only their texts are read.

    A node whose parent is missing is a root. Nodes on a cycle, and those that hang off one, have no root and give no path: they
    leave as soon as they look up further than their tree has nodes. Of repeated nodes one stays (one_of_each_node;
    pass unique=True where there are none); null nodes are left out, null trees are one tree. An empty table gives no path.
    """
    nodes = nodes if unique else one_of_each_node(nodes)
    narrow = cut(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    key = lambda df, *more: df.select(F.col("tree").alias("t"), F.col("node").alias("n"), *more)
    at = lambda c: F.col("tree").eqNullSafe(F.col("t")) & (F.col(c) == F.col("n"))
    sizes = narrow.groupBy(F.col("tree").alias("t")).agg(F.count("*").alias("size"))
    begin = narrow.join(key(narrow), at("parent"), "left").select("tree", "node", F.col("n").alias("to"), F.when(F.col("n").isNull(), 0).otherwise(1).alias("steps"), F.col("score").alias("total"))
    # total: the scores from the node up to the one before `to`
    state = cut(begin.join(sizes, F.col("tree").eqNullSafe(F.col("t"))).drop("t"))
    jumps = []
    while True:
        live = state.where(F.col("to").isNotNull())
        if live.isEmpty():
            break
        jumps.append(live.select(F.col("tree").alias("t"), F.col("node").alias("n"), "to"))
        over = key(state, F.col("to").alias("on"), F.col("steps").alias("more"), F.col("total").alias("above"))
        moved = live.join(over, at("to")).select("tree", "node", F.col("on").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("above")).alias("total"), "size")
        state = cut(state.where(F.col("to").isNull()).unionByName(moved.where(F.col("to").isNull() | (F.col("steps") < F.col("size")))))
    parents = narrow.where(F.col("parent").isNotNull()).select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = state.join(parents, at("node"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node"))
    best = leaves.select("tree", F.col("node").alias("path"), "steps", rank.alias("rank")).where(F.col("rank") <= top)
    # from the longest jump to the shortest, every ancestor is met once: its distance has one binary form
    pieces = [cut(best.select("tree", "path", "rank", F.col("path").alias("node"), F.col("steps").alias("turn")))]
    for r in reversed(range(len(jumps))):
        paths = reduce(DataFrame.unionByName, pieces)
        pieces.append(cut(paths.join(jumps[r], at("node")).select("tree", "path", "rank", F.col("to").alias("node"), (F.col("turn") - (1 << r)).alias("turn"))))
    chosen = reduce(DataFrame.unionByName, pieces)
    return chosen.join(key(nodes, "role", "text"), at("node")).select("tree", "path", "rank", "turn", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """One row per path: formatted (template text), loss_spans (code point ranges of assistant texts, end exclusive).

    Null role or text is empty. Other columns are ignored; an empty table gives an empty table.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = paths.select("tree", "path", "rank", "turn", (role == "assistant").alias("learn"), F.concat(F.lit(TURN), escape(role), F.lit(TEXT)).alias("head"), escape(text).alias("body"))
    before = Window.partitionBy("tree", "path").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END)
    parts = parts.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("turn", F.concat("head", "body", F.lit(END)).alias("line"), "at", (F.col("at") + F.length("body")).alias("to"), "learn")
    turns = parts.groupBy("tree", "path", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["at"].cast("long").alias("start"), t["to"].cast("long").alias("end")))
    return turns.select("tree", "path", "rank", F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, as they were; empty texts stay, null gives null."""
    parts = F.array_remove(F.split(formatted, r"<\|end\|>"), "")
    halves = F.transform(parts, lambda p: F.split(F.substring(p, len(TURN) + 1, 1 << 30), r"<\|text\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(F.get(h, F.lit(0))).alias("role"), unescape(F.get(h, F.lit(1))).alias("text")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formats linear conversations (conv_id, turn, role, text) as reply trees of one branch each.

    Rows of a conversation follow by turn (then role, text): each replies to the one before, so repeated rows and tied
    turns all stay. Null text or role is empty; null conv_id is a conversation of its own. Extra columns are ignored; an
    empty table gives an empty table. Returns conv_id, formatted, loss_spans.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = stored(conversations.select("conv_id", "role", "text", F.row_number().over(order).alias("node")))
    nodes = rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
    return format_paths(reply_paths(nodes, unique=True)).select(F.col("tree").alias("conv_id"), "formatted", "loss_spans")
