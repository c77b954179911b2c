"""Parent-child links to full hierarchies by leaf peeling.

Each round takes the nodes whose children have all reported (the leaves of
what is left) and sends their subtree sizes to the parents, pre-aggregated per
parent.  Where leaves are few, as on long chains, a round takes nodes with one
child out of the chain instead, no two beside each other: the child hangs from
the node's parent then, and the edge keeps the distance, what it passed over
and the smallest id.  So a tree of any shape is gone after a number of rounds
in proportion to the logarithm of its size, and a loop, which never has a leaf,
shrinks to one node that is its own parent.  In reverse order every batch takes
root and depth from its parents.

After the first round, what is left is counted, and as soon as it fits one task
(``finish_rows``) that task peels it in the same way, since jobs over a handful
of nodes cost more than they do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.workspace import settle

#: A round of leaves is followed by a round on chains where it took less than one node in so many.
FEW = 4
#: The most nodes that one task peels.
FINISH_ROWS = 150_000
_DONE = "id long, parent_id long, root_id long, depth int, subtree_size long, on_loop boolean, ancestors array<long>"


def _finish(paths: bool):
    """Peels a bounded rest of the forest within one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rest = pa.Table.from_batches(parts)
        ids, ups, parents, size, pending, steps, passed, low = (rest.column(c).to_pylist() for c in ("id", "up", "parent_id", "size", "pending", "steps", "passed", "low"))
        at = {v: k for k, v in enumerate(ids)}
        parent = [at.get(p, -1) for p in parents]
        order = [k for k, n in enumerate(pending) if n == 0]
        for k in order:
            p = parent[k]
            if p >= 0:
                size[p] += size[k] + passed[k]
                pending[p] -= 1
                if pending[p] == 0:
                    order.append(p)
        peeled = [False] * len(ids)
        for k in order:
            peeled[k] = True
        root, depth, above = [0] * len(ids), [0] * len(ids), [None] * len(ids)
        for k in range(len(ids)):
            if not peeled[k] and depth[k] == 0:
                loop, x = [], k
                while depth[x] == 0:
                    depth[x] = -1
                    loop.append(x)
                    x = parent[x]
                least = min(min(ids[x], low[x]) if low[x] is not None else ids[x] for x in loop)
                for x in loop:
                    root[x] = least
        for k in reversed(order):
            p = parent[k]
            if p < 0:
                root[k], depth[k], above[k] = ids[k], 0, [] if paths else None
            else:
                root[k], depth[k] = root[p], -1 if depth[p] < 0 else depth[p] + steps[k]
                # below a loop from its member down
                above[k] = (above[p] or []) + [ids[p]] if paths else None
        long = pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array(ids, long), pa.array(ups, long), pa.array(root, long), pa.array(depth, pa.int32()), pa.array(size, long), pa.array([not x for x in peeled]), pa.array(above, pa.list_(long))], names=["id", "parent_id", "root_id", "depth", "subtree_size", "on_loop", "ancestors"])

    return run

def hierarchy(links: DataFrame, id_col: str, parent_col: str, paths: bool = True, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Root, depth, ancestors and subtree size of every node.

    ``links`` has one row per node; a null parent makes a root.  Rows with a
    null id are ignored, repeated ids count once (smallest parent, so a given
    parent beats none), a parent that is no node makes its child a root, an
    empty table gives an empty one and other columns are ignored.

    Result: id, parent_id, root_id, depth (0 for a root; -1 on or below a
    loop, with the smallest id of the loop as root_id), subtree_size (the node
    and all below it; on a loop the node and the trees that hang from it),
    on_loop, ancestors (ids from the root down to the parent; below a loop from
    the loop's member down to the parent, and null on a loop).

    Without ``paths`` ancestors are null and chains are shortened, so the
    number of rounds is in proportion to the logarithm of the nodes; with them
    it is that of the levels, as the paths themselves grow with them.
    """
    nodes = links.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent_id")).filter("id is not null").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    children = nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("pending")).withColumnRenamed("parent_id", "id")
    counted = nodes.join(children, "id", "left")
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("__known"))
    start = counted.join(known, "parent_id", "left").select("id", F.expr("if(__known, parent_id, null)").alias("parent_id"), F.coalesce("pending", F.lit(0)).cast("long").alias("pending"), F.lit(1).cast("long").alias("size"))
    return peel(settle(start), paths, finish_rows)


def _peel_leaves(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves, and what is left once they have reported to their parents."""
    leaves = state.filter("pending = 0").select("id", "up", "parent_id", "steps", "size")
    mail = state.filter("pending = 0 and parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("got"), F.sum(F.col("size") + F.col("passed")).alias("more"))
    rest = state.filter("pending > 0").join(mail, "id", "left")
    return leaves, settle(rest.select("id", "up", "parent_id", (F.col("pending") - F.coalesce("got", F.lit(0))).alias("pending"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), "steps", "passed", "low"))


def _shorten(state: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with one child that are taken out of their chain, each with that child, and what is left.

    A coin is thrown for each such node; it goes where its coin says so and its
    parent doesn't go as well, so no two of them are beside each other.
    """
    thrown = state.filter((F.col("pending") == 1) & (F.col("parent_id") != F.col("id")) & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0))
    chosen = settle(thrown.join(thrown.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "up", "parent_id", "size", "steps", "passed", "low"))
    over = chosen.select(F.col("id").alias("parent_id"), F.col("parent_id").alias("__up"), F.col("size").alias("__size"), F.col("steps").alias("__steps"), F.col("passed").alias("__passed"), F.least("id", "low").alias("__low"))
    rest = state.join(chosen.select("id"), "id", "left_anti").join(over, "parent_id", "left")
    gone = F.col("__up").isNotNull()
    left = rest.select(
        "id",
        "up",
        F.when(gone, F.col("__up")).otherwise(F.col("parent_id")).alias("parent_id"),
        "pending",
        "size",
        F.when(gone, F.col("steps") + F.col("__steps")).otherwise(F.col("steps")).alias("steps"),
        F.when(gone, F.col("passed") + F.col("__size") + F.col("__passed")).otherwise(F.col("passed")).alias("passed"),
        F.least("low", "__low").alias("low"),
    )
    child = state.select(F.col("parent_id").alias("id"), F.col("id").alias("child_id"), F.col("passed").alias("child_passed"))
    return settle(chosen.select("id", "up", "parent_id", "steps", "size").join(child, "id")), settle(left)


def peel(state: DataFrame, paths: bool = True, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Peel a settled table of id, parent_id (a node or null), pending (number of children) and size."""
    batches: list[DataFrame] = []
    # of the edge upwards: its length in links, the sizes of the nodes taken out of it, and the smallest of their ids
    state = settle(state.select("id", F.col("parent_id").alias("up"), "parent_id", "pending", "size", F.lit(1).cast("long").alias("steps"), F.lit(0).cast("long").alias("passed"), F.lit(None).cast("long").alias("low")))
    count = lambda df: df.agg(F.count("*").alias("n"), F.count_if((F.col("pending") == 1) & (F.col("parent_id") == F.col("id"))).alias("own")).first()
    now, turn = count(state), 0
    # nodes that are their own parents and have no other child are what loops shrink to
    while now["n"] > now["own"] and (turn == 0 or now["n"] > finish_rows):
        turn += 1
        leaves, state = _peel_leaves(state)
        before, now = now, count(state)
        if taken := before["n"] - now["n"]:
            batches.append(leaves)
        if now["n"] > max(now["own"], finish_rows) and (taken == 0 if paths else taken * FEW < before["n"]):
            spliced, state = _shorten(state, turn)
            batches.append(spliced)
            now = count(state)
    if now["n"] > now["own"]:
        parts = [settle(state.coalesce(1).mapInArrow(_finish(paths), _DONE))]
    else:
        parts = [settle(state.select("id", F.col("up").alias("parent_id"), F.least("id", "low").alias("root_id"), F.lit(-1).alias("depth"), F.col("size").alias("subtree_size"), F.lit(True).alias("on_loop"), F.lit(None).cast("array<long>").alias("ancestors")))]
    for k, batch in enumerate(reversed(batches), 1):
        done = reduce(DataFrame.unionByName, parts)
        solved = _resolve(batch, done, paths)
        # the last, which is the most of the nodes, goes straight to who asks
        parts.append(solved if k == len(batches) else settle(solved))
    return reduce(DataFrame.unionByName, parts)


def _resolve(batch: DataFrame, done: DataFrame, paths: bool) -> DataFrame:
    """Root, depth and size of a batch whose parents, and children on shortened chains, are done."""
    top = done.select(F.col("id").alias("parent_id"), F.col("root_id").alias("__root"), F.col("depth").alias("__depth"), F.col("ancestors").alias("__above"))
    rows = batch.join(top, "parent_id", "left")
    size, looped = F.col("size"), F.lit(False)
    if "child_id" in batch.columns:
        rows = rows.join(done.select(F.col("id").alias("child_id"), F.col("on_loop").alias("__looped"), F.col("subtree_size").alias("__below")), "child_id")
        looped = F.col("__looped")
        size = F.when(looped, size).otherwise(size + F.col("child_passed") + F.col("__below"))
    above = F.expr("case when parent_id is null then array() else array_append(coalesce(__above, array()), parent_id) end") if paths else F.lit(None)
    return rows.select(
        "id",
        F.col("up").alias("parent_id"),
        F.coalesce("__root", "id").alias("root_id"),
        F.expr("case when parent_id is null then 0 when __depth < 0 then -1 else __depth + steps end").cast("int").alias("depth"),
        size.alias("subtree_size"),
        looped.alias("on_loop"),
        F.when(~looped, above.cast("array<long>")).alias("ancestors"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """One row per node and node below it: ancestor_id, id, distance.  No shuffle.

    Below a loop, the loop's member from which a tree hangs is the uppermost
    ancestor; the members themselves are below no node.
    """
    at = tree.select("id", F.posexplode("ancestors").alias("level", "ancestor_id"), F.size("ancestors").alias("n"))
    return at.select("ancestor_id", "id", (F.col("n") - F.col("level")).alias("distance"))
