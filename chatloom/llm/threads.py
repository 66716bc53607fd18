"""Rebuilding conversations from message rows.

Method: parent pointers resolved by iterative pointer-jumping joins, with orphans and cycles detected; root-to-leaf paths come out as ordered
conversations. Two kinds of pointers are resolved together. By time a message points to the one before it in its chat unless the gap is reached:
its root is the opening of its conversation. By number a message points to the number before its own: where that number is absent
from the table the message is an orphan, so two messages have the same root exactly if no number between them is absent.

Scale: before pointers are made, messages of one chat and one UTC day are contracted to runs, and unbroken numbers of a block to
chains, in windows of at most 1440 minutes and BLOCK numbers; pointers connect these, and each round of joins doubles the distance covered. Only nodes
that aren't resolved yet are carried on. No task holds a chat, and no message takes part in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.sessions import DAY, runs_of_day
from chatloom.session import materialize

BLOCK = 4096


def resolve_parents(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """Root and depth of each node by pointer jumping: columns `node`, `root`, `depth`, `state`.

    State: `ok`; `orphan` if the path ends at a parent that isn't there (root is the last node there is); `cycle` if it never
    ends (root and depth null). A null parent is a root. Nodes must be unique and not null; rows with a null node are left out, of rows
    with the same node one stays. An empty table gives an empty result. Each round writes the nodes that are still open, and those that it resolved,
    to the shared folder; a path longer than the number of open nodes runs in a circle, so the rounds are at most its logarithm.
    """
    one = nodes.filter(F.col(node).isNotNull()).groupBy(node).agg(F.min(parent).alias(parent))
    there = one.select(F.col(node).alias("_p"))
    linked = materialize(one.join(there.withColumn("_there", F.lit(True)), F.col(parent) == F.col("_p"), "left").select(F.col(node).alias("node"), F.col(parent).alias("jump"), F.coalesce("_there", F.lit(False)).alias("there")), "linked")
    ends = linked.filter(~F.col("there")).select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.col("jump").isNotNull().alias("orphan"))
    left = linked.filter("there").select("node", "jump", F.lit(1).cast("bigint").alias("depth"))
    done, n, distance = ends, left.count(), 1
    limit, n_open = n, n
    while n_open and distance <= 2 * limit:
        to = done.select(F.col("node").alias("_n"), F.col("root").alias("_root"), F.lit(None).cast(left.schema["jump"].dataType).alias("_jump"), F.col("depth").alias("_depth"), F.col("orphan").alias("_orphan"))
        to = to.unionByName(left.select(F.col("node").alias("_n"), F.lit(None).cast(left.schema["jump"].dataType).alias("_root"), F.col("jump").alias("_jump"), F.col("depth").alias("_depth"), F.lit(False).alias("_orphan")))
        moved = left.join(to, F.col("jump") == F.col("_n")).select("node", F.col("_jump").alias("jump"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_orphan").alias("orphan"))
        moved = materialize(moved, "jump")
        done = done.unionByName(moved.filter(F.col("jump").isNull()).drop("jump"))
        left = moved.filter(F.col("jump").isNotNull()).select("node", "jump", "depth")
        n_open, distance = left.count(), distance * 2
    circle = left.select("node", F.lit(None).cast(left.schema["jump"].dataType).alias("root"), F.lit(None).cast("bigint").alias("depth"), F.lit("cycle").alias("state"))
    return done.select("node", "root", "depth", F.when(F.col("orphan"), "orphan").otherwise("ok").alias("state")).unionByName(circle)


def messages_in_chains(rows: DataFrame) -> DataFrame:
    """One row per distinct (chat_id, msg_id), notices and undated ones too: chat_id, block, msg_id, minute, who, visible, system, chain.

    Copies count once and give each other what one lacks. `who` is the 64-bit hash of the person, null for none; `chain` the lowest number from which on
    none is absent up to this one within its block of BLOCK numbers.
    """
    block = ["chat_id", "block"]
    spread = rows.select("chat_id", F.floor(F.col("msg_id") / BLOCK).alias("block"), "msg_id", "minute", F.when(F.col("person").isNotNull(), F.xxhash64("person")).alias("who"), "visible", "system").repartition(*block)
    one = spread.groupBy(*block, "msg_id").agg(F.min("minute").alias("minute"), F.min("who").alias("who"), F.max("visible").alias("visible"), F.max("system").alias("system"))
    order = Window.partitionBy(*block).orderBy("msg_id")
    first = ~F.coalesce(F.col("msg_id") - F.lag("msg_id").over(order) == 1, F.lit(False))
    return one.withColumn("_first", first).withColumn("chain", F.max(F.when(F.col("_first"), F.col("msg_id"))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def _node(kind: str, number):
    return F.struct(F.col("chat_id"), F.lit(kind).alias("kind"), number.alias("at"))


def _chains(messages: DataFrame) -> DataFrame:
    """Chains with their node, named by their highest number, and the number before their lowest as parent; none for the first of a chat."""
    chains = messages.groupBy("chat_id", "block", "chain").agg(F.max("msg_id").alias("high"))
    lowest = chains.groupBy("chat_id").agg(F.min("chain").alias("lowest"))
    parent = F.when(F.col("chain") != F.col("lowest"), _node("number", F.col("chain") - 1))
    return chains.join(lowest, "chat_id").select("chat_id", "chain", _node("number", F.col("high")).alias("node"), parent.alias("parent"))


def rebuild(rows: DataFrame, gap: int = 120) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations of dated rows (see operators.timeline): messages, runs, links, each stored or read from what is.

    Messages are those of `messages_in_chains`. Runs: the messages of one conversation and one UTC day, with `conversation`, the minute at which it opens,
    `run`, their place in it, and what decides about it. Links: the states of all pointers, `node` (chat_id, kind, at), `root`, `depth`, `state`.
    """
    messages = materialize(messages_in_chains(rows), "messages")
    day = ["chat_id", "day"]
    told = messages.filter(F.col("minute").isNotNull() & ~F.col("system")).withColumn("day", F.floor(F.col("minute") / DAY))
    seen = F.when(F.col("visible"), F.col("who"))
    low_high = lambda c: [F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi")]
    minutes = told.withColumn("seen", seen).groupBy(*day, "minute").agg(F.count("*").alias("n"), *low_high("msg_id"), *low_high("seen"), *low_high("chain"))
    spread = runs_of_day(minutes.repartition(*day), day, gap)
    runs = spread.groupBy(*day, "run_start").agg(
        F.max("minute").alias("run_end"), F.sum("n").alias("n"), F.max(F.when(F.col("minute") == F.col("run_start"), F.col("msg_id_lo"))).alias("first_msg_id"),
        F.max(F.when(F.col("ends"), F.col("msg_id_hi"))).alias("last_msg_id"),
        *[f(f"{c}_{end}").alias(f"{c}_{end}") for c in ("seen", "chain") for f, end in ((F.min, "lo"), (F.max, "hi"))],
    )
    # runs of a chat: at most 1440 / gap a day
    by_chat = Window.partitionBy("chat_id").orderBy("run_start")
    near = F.coalesce(F.col("run_start") - F.lag("run_end").over(by_chat) < gap, F.lit(False))
    before = F.lag("run_start").over(by_chat)
    leaf = F.coalesce(F.lead("run_start").over(by_chat) - F.col("run_end") >= gap, F.lit(True))
    runs = materialize(runs.withColumns({"parent": F.when(near, _node("time", before)), "leaf": leaf, "node": _node("time", F.col("run_start"))}).drop("day"), "runs")
    chains = materialize(_chains(messages), "chains")
    links = resolve_parents(runs.select("node", "parent").unionByName(chains.select("node", "parent")), "node", "parent")
    links = materialize(links, "links")
    of_run = links.filter("node.kind = 'time'").select("node", F.col("root.at").alias("conversation"), F.col("depth").alias("run"))
    of_chain = chains.join(links.select("node", F.col("root.at").alias("whole")), "node").select("chat_id", "chain", "whole")
    placed = runs.join(of_run, "node").drop("node", "parent")
    for end in ("lo", "hi"):
        placed = placed.join(of_chain.withColumnsRenamed({"chain": f"chain_{end}", "whole": f"whole_{end}"}), ["chat_id", f"chain_{end}"])
    return messages, placed, links


def conversations(runs: DataFrame) -> DataFrame:
    """One row per conversation with what decides whether it is kept.

    `kept` needs two persons who wrote visible text and no absent number between its lowest and highest: the chains of both have the same root. Messages without a
    known person take part in the order and the counts but are nobody's.
    """
    return runs.groupBy("chat_id", "conversation").agg(
        F.max(F.when(F.col("run") == 0, F.col("first_msg_id"))).alias("first_msg_id"),
        F.max(F.when(F.col("leaf"), F.col("last_msg_id"))).alias("last_msg_id"),
        F.sum("n").alias("n_messages"),
        (F.min("whole_lo") == F.max("whole_hi")).alias("whole"),
        F.coalesce(F.min("seen_lo") != F.max("seen_hi"), F.lit(False)).alias("answered"),
    ).withColumn("kept", F.col("whole") & F.col("answered"))


def turns(messages: DataFrame, runs: DataFrame, gap: int = 120) -> DataFrame:
    """Root-to-leaf order: the turns of kept conversations with their place and role (opener, replier)."""
    day = ["chat_id", "day"]
    kept = conversations(runs).filter("kept").select("chat_id", "conversation", "first_msg_id")
    told = messages.filter(F.col("minute").isNotNull() & ~F.col("system")).withColumn("day", F.floor(F.col("minute") / DAY))
    minutes = runs_of_day(told.groupBy(*day, "minute").agg(F.count("*").alias("n")).repartition(*day), day, gap)
    run = Window.partitionBy(*day, "run_start").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.withColumn("in_run", F.coalesce(F.sum("n").over(run), F.lit(0))).drop("n", "ends")
    earlier = Window.partitionBy("chat_id", "conversation").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("chat_id", "run_start", "conversation", "before").join(kept, ["chat_id", "conversation"])
    opener = told.select("chat_id", F.col("msg_id").alias("first_msg_id"), F.col("who").alias("opener"))
    sizes = sizes.join(opener, ["chat_id", "first_msg_id"])
    in_minute = F.row_number().over(Window.partitionBy(*day, "minute").orderBy("msg_id"))
    placed = told.withColumn("in_minute", in_minute).join(minutes, [*day, "minute"]).join(sizes, ["chat_id", "run_start"])
    role = F.when(F.col("who").eqNullSafe(F.col("opener")), "opener").otherwise("replier")
    turn = (F.col("before") + F.col("in_run") + F.col("in_minute")).cast("bigint")
    return placed.select("chat_id", "first_msg_id", turn.alias("turn"), "msg_id", role.alias("role"))


def broken_links(links: DataFrame) -> DataFrame:
    """How the pointers of each chat end: chat_id, kind (time, number), state, n."""
    return links.groupBy(F.col("node.chat_id").alias("chat_id"), F.col("node.kind").alias("kind"), "state").agg(F.count("*").alias("n"))
