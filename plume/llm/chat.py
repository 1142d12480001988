"""Chat formatting of reply trees.

Messages form trees by their parents.  Paths from root to leaf come from
iterative self-joins with doubling: after round i every message knows its
ancestor 2^i replies up, with the sum of scores on the way, so a tree of any
depth takes a logarithm of rounds.  Leaves are ranked per tree by the mean
score of their branch; the messages of the chosen branches are gathered by
going through the rounds' ancestor tables once more, and each branch becomes
one conversation.

The template marks every turn with ``<s>`` and ``</s>``: a user's text stands
in ``[INST] ... [/INST]``, an assistant's stands bare, any other role is named
in ``<<...>>`` before its text.  Inside texts and roles ``&``, ``<``, ``>`` and
``[`` become ``&amp;``, ``&lt;``, ``&gt;`` and ``&#91;``, so no control string
can come from a text and reading back is exact.  The loss mask is the list of spans (code
points of the formatted text) of the assistants' texts.

Scale: DataFrame operations only.  The rounds carry ids and scores, no text.
A conversation is one row of the result, so its turns meet in one task; that
is the one group that cannot be split.

Defined cases: null text and role are empty; an orphan is a root; messages
under a cycle have no root and are left out; of messages that repeat a tree
and id the first by role, text and parent counts; ties in score go to the
smaller leaf id; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plume.llm import common as C

OPEN, CLOSE = "<s>", "</s>"
USER = ("[INST] ", " [/INST]")
ROLE = ("<<", ">>")


#: In this order, and read back in the reverse one.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&#91;")]


def escape(c: Column) -> Column:
    for plain, safe in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(plain))
    return c


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``nodes`` (tree, node, parent, score) to (tree, leaf, node, depth): the
    messages of the best ``branches`` branches of each tree, root at depth 0."""
    count = nodes.count()
    here = nodes.select("tree", "node", "parent", "score")
    known = here.select(F.col("tree").alias("up_tree"), F.col("node").alias("up"))
    # a parent that is not there makes a root
    state = here.join(known, _same("parent", "up"), "left").select(
        "tree", "node", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("length"))
    state = C.checkpoint(state)
    rounds, done = [], [state.filter("up IS NULL")]
    while 2 ** len(rounds) <= 2 * max(1, count):
        rising = state.filter("up IS NOT NULL")
        if rising.isEmpty():
            break
        rounds.append(rising.select("tree", "node", "up"))
        # only messages that have not reached their root go on; those that have are looked up
        above = _all(done).unionByName(rising).select(F.col("tree").alias("up_tree"), F.col("node").alias("up_node"), F.col("up").alias("up_up"),
                             F.col("total").alias("up_total"), F.col("length").alias("up_length"))
        state = C.checkpoint(rising.join(above, _same("up", "up_node")).select(
            "tree", "node", F.col("up_up").alias("up"), (F.col("total") + F.col("up_total")).alias("total"),
            (F.col("length") + F.col("up_length")).alias("length")))
        done.append(state.filter("up IS NULL"))
    ended = _all(done)  # what still goes up after that many rounds is under a cycle
    parents = nodes.select(F.col("tree").alias("up_tree"), F.col("parent").alias("up_node")).distinct()
    leaves = ended.join(parents, _same("node", "up_node"), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches)
    found = chosen.select("tree", F.col("node").alias("leaf"), "node")
    for jump in reversed(rounds):
        step = jump.select(F.col("tree").alias("up_tree"), F.col("node").alias("up_node"), "up")
        found = found.unionByName(found.join(step, _same("node", "up_node")).select("tree", "leaf", F.col("up").alias("node")))
        found = C.checkpoint(found)
    depth = ended.select(F.col("tree").alias("up_tree"), F.col("node").alias("up_node"), (F.col("length") - 1).alias("depth"))
    return found.join(depth, _same("node", "up_node")).select("tree", "leaf", "node", "depth")


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _same(node: str, up: str) -> Column:
    return F.col("tree").eqNullSafe(F.col("up_tree")) & (F.col(node) == F.col(up))


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages`` (tree, node, parent, role, text, score) to one row per
    chosen branch: (tree, leaf, formatted, loss: array of start and end)."""
    first = F.min(F.struct("role", "text", "parent", "score")).alias("m")
    messages = C.checkpoint(messages.groupBy("tree", "node").agg(first).select("tree", "node", "m.*"))
    chosen = paths(messages, branches)
    said = messages.select(F.col("tree").alias("up_tree"), F.col("node").alias("up_node"),
                           escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    turns = chosen.join(said, _same("node", "up_node"))
    user, loss = F.col("role") == "user", F.col("role") == "assistant"
    before = F.when(user, OPEN + USER[0]).when(loss, OPEN).otherwise(F.concat(F.lit(OPEN + ROLE[0]), "role", F.lit(ROLE[1])))
    after = F.when(user, USER[1] + CLOSE).otherwise(CLOSE)
    turns = turns.select("tree", "leaf", "depth", F.concat(before, "body", after).alias("piece"),
                         F.length(before).alias("head"), F.length("body").alias("size"), loss.alias("loss"))
    order = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(order), F.lit(0)) + F.col("head")
    turns = turns.withColumn("start", start)
    listed = F.array_sort(F.collect_list(F.struct("depth", "piece", "start", (F.col("start") + F.col("size")).alias("end"), "loss")))
    grouped = turns.groupBy("tree", "leaf").agg(listed.alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"], t["end"]))
    return grouped.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
                          spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, CLOSE, -1)
    inside = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))

    def turn(p: Column) -> Column:
        user = F.startswith(p, F.lit(USER[0]))
        named = F.startswith(p, F.lit(ROLE[0]))
        end = F.locate(ROLE[1], p)
        role = F.when(user, "user").when(named, F.substring(p, F.lit(len(ROLE[0]) + 1), end - len(ROLE[0]) - 1)).otherwise("assistant")
        text = (F.when(user, F.substring(p, F.lit(len(USER[0]) + 1), F.length(p) - sum(map(len, USER))))
                .when(named, F.substring(p, end + len(ROLE[1]), F.length(p))).otherwise(p))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(inside, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    parts = F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(parts, "")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees of one branch: each
    row replies to the one before it by turn (then role and text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return rows.select(F.col("conv_id").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text",
                       F.lit(0.0).alias("score"))


def digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text."""
    done = format_trees(chains(conversations)).select(F.col("tree").alias("conv_id"), "formatted", "loss")
    read = done.withColumn("turns", read_back(F.col("formatted"))).withColumn("under", loss_text(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
