"""Chat formatting of reply trees, native: DataFrame functions only.

Nodes name their parent. Self-joins that double the step enumerate every root-to-leaf path; a tree's
paths are ranked by the sum of their nodes' scores, and each chosen path becomes one conversation.

Template, a turn: <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>. Inside roles and texts every control string
(these, and the common ones of other templates) gets one more backslash after its first character than it
had, and loses one when read; so only the template's own marks stand in the output. Loss spans (start and
length in code points) cover the texts of the assistant, as they stand there.

Scale: joins and groups are by tree and node; paths need log2(depth) rounds, each cut by a table in the
shared folder. A conversation becomes one row, so its length bounds a task's largest group; ranking cuts
before the shuffle. Defined cases: null text and null role are empty; a null conversation id is one
conversation of its own; rows that repeat a turn stand one after the other, by role and text; a missing
parent makes a root; a cycle raises ValueError; an empty table gives an empty result; other columns of the
turns or nodes are not looked at and not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that must not stand in a text as they are; fixed values of common templates.
CONTROL = (START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>")
_REST = "|".join(c[1:].replace("|", "[|]").replace("]", "[]]") if c[0] == "[" else c[1:].replace("|", "[|]") for c in CONTROL)
#: A first character, backslashes, and the rest of a control string.
ESCAPE = rf"([<\[])(\\*)({_REST})"
UNESCAPE = rf"([<\[])\\(\\*)({_REST})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE), F.lit("$1$2$3"))


def threads(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text rows as nodes of unbranched trees: each turn answers the one before. A
    node's score is the length of its text."""
    turns = turns.select("conv_id", "turn", "role", "text")
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    nodes = turns.withColumn("tree", tree).withColumn("node", F.row_number().over(order))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return nodes.select("tree", F.col("node").cast("long"), parent.cast("long").alias("parent"), "conv_id", "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """tree, leaf, node, back: every node on the way from each leaf to its root, and its distance."""
    known = stored(nodes.select("tree", "node", "parent"))
    ids = known.select("tree", F.col("node").alias("parent"))
    up = stored(known.join(ids, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above")))
    leaves = known.join(up.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti")
    reached = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    most = known.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while not up.isEmpty():
        if step > most:
            raise ValueError("the replies of a tree form a cycle")
        above = up.withColumnRenamed("above", "far")
        more = reached.join(up, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("back") + step).alias("back"))
        reached = stored(reached.unionByName(more))
        up = stored(up.join(above.withColumnRenamed("node", "above"), ["tree", "above"]).select("tree", "node", F.col("far").alias("above")))
        step *= 2
    return reached


def format_trees(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """A row for each chosen path: tree, conv_id, leaf, n_turns, formatted and loss_spans. best: the paths
    chosen of each tree, with path_score and branch, the rank in the tree; None: all, unranked."""
    nodes = stored(nodes.select("tree", "node", "parent", "conv_id", "role", "text", "score"))
    way = paths(nodes)
    if best is not None:
        scored = way.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"))
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
        scored = scored.withColumn("branch", rank).filter(F.col("branch") <= best)
        way = way.join(scored.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    turns = way.join(nodes.select("tree", "node", "conv_id", "role", "text"), ["tree", "node"])
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(START), escaped(role), F.lit(SEP))
    body = escaped(text)
    turns = turns.select("tree", "leaf", "back", "conv_id", head.alias("head"), body.alias("body"), (role == "assistant").alias("loss"))
    size = F.length("head") + F.length("body") + len(END)
    onward = Window.partitionBy("tree", "leaf").orderBy(F.desc("back")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(onward), F.lit(0)) + F.length("head"))
    turn = F.struct((-F.col("back")).alias("order"), F.concat("head", "body", F.lit(END)).alias("piece"), F.col("at").alias("start"), F.length("body").cast("long").alias("length"), "loss")
    rows = turns.groupBy("tree", "leaf").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(turn)).alias("turns"))
    if best is not None:
        rows = rows.join(scored, ["tree", "leaf"])
    return rows.select(
        "tree", "conv_id", "leaf", *(["path_score", "branch"] if best is not None else []), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.start.alias("start"), t.length.alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The role and text structs that a formatted conversation holds."""
    pieces = F.split(formatted, END.replace("|", "[|]"))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.substring(F.substring_index(p, SEP, 1), len(START) + 1, 2**31 - 1)).alias("role"),
            unescaped(F.substring_index(p, SEP, -1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")
