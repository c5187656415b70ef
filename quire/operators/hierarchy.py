"""Parent-child links to full hierarchies.

The rows are an adjacency list: an id and the id of its parent. The result has,
for each node, its state, root, depth, full path and an entry-exit interval
from which ancestors and descendants are read.

Method
------
1. *Peeling leaves.* Nodes that are nobody's parent are removed round by
   round. What is left when nothing changes is exactly the nodes on cycles.
   Chains deeper than ``peel_rounds`` are cut short by pointer doubling over
   what is left: only nodes whose 2^k-th ancestor still exists can lie on or
   below a cycle, and the image of the doubled pointer is the cycles.
2. *Anchors of cycles.* Pointer doubling with a running minimum over the nodes
   on cycles only.
3. *Euler tours.* Real roots, orphans (parent unknown) and all nodes on cycles
   start tours. Each node has an entry and an exit arc; a successor is known
   from first child and next sibling alone.
4. *Parallel list ranking.* Lists are contracted: each arc throws a coin by hash, and
   an arc of heads behind one of tails is spliced out, its weight going to the arc
   before it. A round removes a quarter of the arcs, so all rounds together
   cost a few times the first. What is left is ranked, and the arcs spliced out
   get their ranks back, last first. The sum of +1 per entry and -1 per exit up to the
   tour's end gives depth, the number of arcs the position, the last arc the root.
5. *Intervals.* Entry and exit positions nest as the tree does. A sweep over the
   positions of a tour, in stretches that know the intervals open at their start,
   gives each node's path, and with it ancestors and descendants.

Once at most ``in_task`` links or arcs are left, peeling and ranking end in one task,
which needs no more rounds; that many fit its memory at any size of the input.

No step collects a tree, and no key of a join repeats: an arc has one
predecessor. Siblings of a parent with very many children are chained in salted
runs, so no task sorts all children of one node.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import cut, release

#: Children of one parent that a single task may sort; more are chained in salted runs.
SIBLINGS_PER_RUN = 100_000
#: Links or arcs that one task may finish.
IN_TASK = 400_000
#: Positions of a tour in one stretch of the sweep.
SWEEP = 8_192


def clean_parent(c: Column) -> Column:
    """A parent id without outer blanks and in lower case; null where nothing is left."""
    trimmed = F.lower(F.regexp_replace(c, r"^[\s ​　﻿]+|[\s ​　﻿]+$", ""))
    return F.when(trimmed != "", trimmed)


def links(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(node_id, parent) with one row per id.

    Rows without an id are no nodes and are left out. Where copies of an id
    disagree, the smallest parent counts; a parent beats none.
    """
    return (
        rows.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("node_id"), clean_parent(F.col(parent_col)).alias("parent"))
        .groupBy("node_id")
        .agg(F.min("parent").alias("parent"))
    )


def _double(active: DataFrame) -> DataFrame:
    """Each pointer goes twice as far; rows whose target is gone end here and leave."""
    far = active.select(F.col("node_id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("low").alias("_low"))
    return active.join(far, "ptr").select("node_id", F.col("_ptr").alias("ptr"), F.least("low", "_low").alias("low"))


def _cycles(t: pa.Table) -> pa.Table:
    """node_id, anchor of the nodes on cycles among the links of one task."""
    parent = dict(zip(t.column("node_id").to_pylist(), t.column("parent").to_pylist()))
    children = Counter(parent.values())
    leaves = [x for x in parent if not children[x]]
    while leaves:
        above = parent.pop(leaves.pop())
        children[above] -= 1
        if not children[above] and above in parent:
            leaves.append(above)
    found: dict[str, str] = {}
    for x in parent:
        if x not in found:
            ring = [x]
            while (up := parent[ring[-1]]) != x:
                ring.append(up)
            found |= dict.fromkeys(ring, min(ring))
    return pa.table([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.string())], ["node_id", "anchor"])


def cycle_nodes(edges: DataFrame, peel_rounds: int = 8, in_task: int = IN_TASK) -> DataFrame:
    """(node_id, anchor) of all nodes on cycles; edges: (node_id, parent), parent known and not null."""
    left = cut(edges)
    n = left.count()
    peeled = False
    for _ in range(peel_rounds):
        if n <= in_task:
            return left.groupBy().applyInArrow(_cycles, "node_id string, anchor string")
        left = cut(left.join(left.select(F.col("parent").alias("node_id")).distinct(), "node_id", "left_semi"))
        # a node whose parent was peeled cannot be: parents of remaining nodes remain
        n, before = left.count(), n
        if n == before:
            peeled = True
            break
    core = left.select("node_id", F.col("parent").alias("ptr"), F.col("node_id").alias("low"))
    if n and not peeled:
        walk = core
        for _ in range(max(1, math.ceil(math.log2(n + 1)))):
            walk = cut(_double(walk))
        on = walk.select(F.col("ptr").alias("node_id")).distinct()
        core = cut(core.join(on, "node_id", "left_semi"))
    if not n:
        return core.select("node_id", F.col("low").alias("anchor"))
    low = core
    while True:
        doubled = cut(_double(low).join(low.select("node_id", F.col("low").alias("_was")), "node_id"))
        changed = doubled.where(F.col("low") != F.col("_was")).limit(1).count()
        low = doubled.drop("_was")
        if not changed:
            return low.select("node_id", F.col("low").alias("anchor"))


def _siblings(children: DataFrame, per_run: int) -> tuple[DataFrame, DataFrame]:
    """(node_id, next) and (parent, first): the order of children under each parent.

    A parent with more than per_run children has them in several runs by hash;
    a run is sorted by id, and the runs follow each other.
    """
    hot = children.groupBy("parent").count().where(F.col("count") > per_run)
    runs = children.join(hot, "parent", "left").withColumn(
        "run", F.coalesce(F.pmod(F.xxhash64("node_id"), F.ceil(F.col("count") / per_run)), F.lit(0))
    )
    w = Window.partitionBy("parent", "run").orderBy("node_id")
    chained = runs.select("node_id", "parent", "run", F.lead("node_id").over(w).alias("next"))
    heads = runs.groupBy("parent", "run").agg(F.min("node_id").alias("head"), F.max("node_id").alias("tail"))
    over = Window.partitionBy("parent").orderBy("run")
    joints = (
        heads.select("tail", F.lead("head").over(over).alias("after"))
        .where(F.col("after").isNotNull())
        .select(F.col("tail").alias("node_id"), "after")
    )
    following = chained.join(joints, "node_id", "left").select("node_id", F.coalesce("next", "after").alias("next"))
    first = heads.groupBy("parent").agg(F.min_by("head", "run").alias("first"))
    return following, first


def euler_tour(forest: DataFrame, per_run: int = SIBLINGS_PER_RUN) -> DataFrame:
    """Arcs of the Euler tours of a forest (node_id, parent; parent null at roots).

    Rows: node_id, arc (0 entry, 1 exit), succ_id, succ_arc; the successor is
    null at the exit of a root.
    """
    children = forest.where(F.col("parent").isNotNull())
    following, first = _siblings(children, per_run)
    whole = forest.join(following, "node_id", "left").join(
        first.select(F.col("parent").alias("node_id"), "first"), "node_id", "left"
    )
    entry = F.struct(
        F.lit(0).alias("arc"),
        F.coalesce("first", "node_id").alias("succ_id"),
        F.when(F.col("first").isNull(), 1).otherwise(0).alias("succ_arc"),
    )
    leave = F.struct(
        F.lit(1).alias("arc"),
        F.coalesce("next", "parent").alias("succ_id"),
        F.when(F.col("next").isNotNull(), 0).when(F.col("parent").isNotNull(), 1).alias("succ_arc"),
    )
    return whole.select("node_id", F.inline(F.array(entry, leave)))


def _coin(node_id: Column, arc: Column, level: int) -> Column:
    return F.pmod(F.xxhash64(node_id, arc, F.lit(level)), F.lit(2))


def _ranks(t: pa.Table) -> pa.Table:
    """Ranks of the lists of one task, by pointer doubling over places."""
    arc, succ = t.column("arc").to_numpy(), t.column("succ_arc").to_pandas().fillna(0).to_numpy(np.int64)
    code = pd.Index(t.column("node_id").to_pandas())
    at = pd.Series(np.arange(len(code)), index=pd.MultiIndex.from_arrays([code, arc]))
    open_ = np.asarray(pc.is_valid(t.column("succ_id")))
    ptr = np.full(len(code), -1)
    ptr[open_] = at.index.get_indexer(pd.MultiIndex.from_arrays([t.column("succ_id").to_pandas()[open_], succ[open_]]))
    after, rise, end = t.column("after").to_numpy().copy(), t.column("rise").to_numpy().copy(), np.arange(len(code))
    while len(i := np.nonzero(ptr >= 0)[0]):
        k = ptr[i]
        add, up, far, last = after[k], rise[k], ptr[k], end[k]
        after[i] += add
        rise[i] += up
        ptr[i], end[i] = far, last
    return pa.table([t.column("node_id"), t.column("arc"), pa.array(after), pa.array(rise), t.column("end_id").take(pa.array(end))], ["node_id", "arc", "after", "rise", "end_id"])


def rank_lists(arcs: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """List ranking by contraction.

    For each arc: after (number of arcs from it to the end of its list, itself
    included), rise (sum of +1 per entry and -1 per exit over these arcs) and
    end_id (node of the last arc).
    """
    weights = {"after": F.lit(1).cast("long"), "rise": F.when(F.col("arc") == 0, 1).otherwise(-1).cast("long"), "end_id": F.col("node_id")}
    state = cut(arcs.select("node_id", F.col("arc").cast("long").alias("arc"), "succ_id", F.col("succ_arc").cast("long").alias("succ_arc"), *(c.alias(k) for k, c in weights.items())))
    spliced: list[DataFrame] = []
    goes_on = F.col("succ_id").isNotNull()
    n, level = state.where(goes_on).count(), 0
    while n > in_task:
        own, next_ = _coin(F.col("node_id"), F.col("arc"), level), _coin(F.col("succ_id"), F.col("succ_arc"), level)
        before = F.col("succ_id").isNotNull() & (own == 0) & (next_ == 1)
        ahead = state.where(before).select(*(F.col(c).alias(f"p_{c}") for c in state.columns))
        behind = state.where(own == 1)
        met = behind.join(ahead, (F.col("node_id") == F.col("p_succ_id")) & (F.col("arc") == F.col("p_succ_arc")), "left")
        met = cut(met)
        joined = met.where(F.col("p_node_id").isNotNull())
        longer = joined.select(
            F.col("p_node_id").alias("node_id"), F.col("p_arc").alias("arc"), "succ_id", "succ_arc", (F.col("p_after") + F.col("after")).alias("after"), (F.col("p_rise") + F.col("rise")).alias("rise"), "end_id"
        )
        alone = met.where(F.col("p_node_id").isNull()).select(*state.columns)
        old, state = state, cut(state.where((own == 0) & ~F.coalesce(before, F.lit(False))).unionByName(longer).unionByName(alone))
        release(old)
        spliced.append(joined.select(*state.columns))
        n, level = state.where(goes_on).count(), level + 1
    # an arc without successor has its rank; those that others lead to go into the task with them
    going = state.where(goes_on)
    met = going.select(F.col("succ_id").alias("node_id"), F.col("succ_arc").alias("arc"))
    ends = state.where(~goes_on)
    small = going.unionByName(ends.join(met, ["node_id", "arc"], "left_semi").select(*state.columns))
    rest = ends.join(met, ["node_id", "arc"], "left_anti").select("node_id", "arc", "after", "rise", "end_id")
    ranked = small.groupBy().applyInArrow(_ranks, "node_id string, arc long, after long, rise long, end_id string").unionByName(rest)
    for gone in reversed(spliced):
        ranked = cut(ranked)
        known = ranked.select(F.col("node_id").alias("succ_id"), F.col("arc").alias("succ_arc"), F.col("after").alias("_after"), F.col("rise").alias("_rise"), F.col("end_id").alias("_end"))
        back = gone.join(known, ["succ_id", "succ_arc"], "left").select(
            "node_id", "arc", (F.col("after") + F.coalesce("_after", F.lit(0))).alias("after"), (F.col("rise") + F.coalesce("_rise", F.lit(0))).alias("rise"), F.coalesce("_end", "end_id").alias("end_id")
        )
        ranked = ranked.unionByName(back)
    return cut(ranked)


def hierarchy(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", peel_rounds: int = 8, per_run: int = SIBLINGS_PER_RUN, in_task: int = IN_TASK) -> DataFrame:
    """State, root, depth and interval of every node.

    Columns: node_id; parent (cleaned, null at roots); state ``rooted``,
    ``orphan`` (the chain ends at a node whose parent is unknown), ``cycle`` or
    ``below_cycle``; anchor_id (the root, the orphan at the chain's end, or the
    smallest id on the cycle); steps (links to the root, to that orphan, or to the
    first node on the cycle); start_id (where the node's tour starts: the root,
    the orphan, or the node on the cycle first met); entry and exit (positions in
    the tour of start_id, from 0); descendants (their number within that tour).

    Null ids are left out, repeated rows count once, an empty table gives an
    empty result, and other columns are never looked at.
    """
    edges = cut(links(rows, id_col, parent_col))
    ids = edges.select(F.col("node_id").alias("parent"), F.lit(True).alias("known"))
    marked = edges.join(ids, "parent", "left").withColumn(
        "kind", F.when(F.col("parent").isNull(), "root").when(F.col("known").isNull(), "orphan").otherwise("inner")
    )
    marked = cut(marked.select("node_id", "parent", "kind"))
    cycles = cycle_nodes(marked.where(F.col("kind") == "inner").select("node_id", "parent"), peel_rounds, in_task)
    marked = cut(
        marked.join(cycles, "node_id", "left").withColumn("kind", F.when(F.col("anchor").isNotNull(), "cycle").otherwise(F.col("kind")))
    )
    forest = marked.select("node_id", F.when(F.col("kind") == "inner", F.col("parent")).alias("parent"))
    ranked = rank_lists(euler_tour(forest, per_run), in_task)
    sides = ranked.groupBy("node_id").agg(
        F.max(F.when(F.col("arc") == 0, F.col("after"))).alias("after_in"),
        F.max(F.when(F.col("arc") == 1, F.col("after"))).alias("after_out"),
        F.max(F.when(F.col("arc") == 0, -F.col("rise"))).alias("steps"),
        F.first("end_id").alias("start_id"),
    )
    starts = sides.where(F.col("node_id") == F.col("start_id")).select("start_id", F.col("after_in").alias("size"))
    kinds = marked.where(F.col("kind") != "inner").select(F.col("node_id").alias("start_id"), F.col("kind").alias("start_kind"), "anchor")
    placed = sides.join(starts.join(kinds, "start_id"), "start_id")
    state = (
        F.when(F.col("start_kind") == "root", "rooted")
        .when(F.col("start_kind") == "orphan", "orphan")
        .when(F.col("steps") == 0, "cycle")
        .otherwise("below_cycle")
    )
    return placed.join(marked.select("node_id", "parent"), "node_id").select(
        "node_id",
        "parent",
        state.alias("state"),
        F.coalesce("anchor", "start_id").alias("anchor_id"),
        F.col("steps").cast("int").alias("steps"),
        "start_id",
        (F.col("size") - F.col("after_in")).alias("entry"),
        (F.col("size") - F.col("after_out")).alias("exit"),
        ((F.col("after_in") - F.col("after_out") - 1) / 2).cast("long").alias("descendants"),
    )


def _sweep(t: pa.Table) -> pa.Table:
    """node_id, path of the nodes that enter in one stretch of a tour."""
    rows = sorted(zip(t.column("entry").to_pylist(), t.column("exit").to_pylist(), t.column("node_id").to_pylist(), t.column("own").to_pylist()))
    open_: list[str] = []
    ends: list[int] = []
    ids, out = [], []
    for entry, leave, node, own in rows:
        while ends and ends[-1] < entry:
            ends.pop()
            open_.pop()
        ends.append(leave)
        open_.append(node)
        if own:
            ids.append(node)
            out.append(open_.copy())
    return pa.table([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.string()))], ["node_id", "path"])


def paths(placed: DataFrame, step: int = SWEEP) -> DataFrame:
    """node_id, path (ids from start_id to the node), from the intervals of hierarchy().

    A stretch of a tour gets the nodes that enter in it and, from the stretches before, those
    that are still open at its start.
    """
    at = placed.select("node_id", "start_id", "entry", "exit", F.floor(F.col("entry") / step).alias("stretch"), F.floor(F.col("exit") / step).alias("_last"))
    own = at.select("node_id", "start_id", "entry", "exit", "stretch", F.lit(True).alias("own"))
    through = at.where(F.col("_last") > F.col("stretch")).select(
        "node_id", "start_id", "entry", "exit", F.explode(F.sequence(F.col("stretch") + 1, F.col("_last"))).alias("stretch"), F.lit(False).alias("own")
    )
    return own.unionByName(through).groupBy("start_id", "stretch").applyInArrow(_sweep, "node_id string, path array<string>")


def closure(with_paths: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for every node and every proper ancestor; from paths()."""
    n = F.size("path")
    return with_paths.select("node_id", n.alias("_n"), F.posexplode("path").alias("_at", "ancestor_id")).where(F.col("_at") < F.col("_n") - 1).select(
        "ancestor_id", "node_id", (F.col("_n") - 1 - F.col("_at")).cast("int").alias("distance")
    )


def descendants_of(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ancestor_id, node_id) of all proper descendants of the wanted ids (column node_id), from hierarchy()."""
    top = wanted.select(F.col("node_id").alias("ancestor_id")).distinct()
    return closure(paths(placed)).join(top, "ancestor_id", "left_semi").select("ancestor_id", "node_id")


def unrooted(placed: DataFrame) -> DataFrame:
    """node_id, state, anchor_id, steps of the nodes whose chain never ends at a root."""
    return placed.where(F.col("state") != "rooted").select("node_id", "state", "anchor_id", "steps")
