"""Connected components by repeated contraction, for links between near-duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, release, settle

#: Links that the union-find of one block holds at once (about 100 MB).
BLOCK = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace links by a spanning forest of stars, block by block of at most BLOCK links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def out() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_pydict({"hi": pa.array([p[0] for p in pairs], pa.int64()), "lo": pa.array([p[1] for p in pairs], pa.int64())})

    held = 0
    for batch in batches:
        for hi, lo in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if hi not in parent:
                parent[hi] = hi
            if lo not in parent:
                parent[lo] = lo
            a, b = find(hi), find(lo)
            if a != b:
                parent[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= BLOCK:
            yield out()
            parent.clear()
            held = 0
    if parent:
        yield out()


def connected_components(links: DataFrame) -> DataFrame:
    """Components of the graph whose links are the rows of two long columns.

    Returns (node, component), component being the smallest node reachable,
    for every node that some link joins to another one. Links with a null end
    and links from a node to itself add nothing; repeated links count once; no
    links give no rows.

    Each task first replaces its links by a spanning forest. Fewer than BLOCK
    links that are left are joined in one task; more of them go through rounds
    that hook every node to its smallest neighbour, shorten the chains, and
    relabel the links, which merges nodes. No node's links are ever gathered
    in one task (the minimum is combined before the shuffle, the joins are
    between a side with unique keys and one that adaptive execution may split).
    """
    a, b = links.columns[:2]
    e = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo"))
    forest = lambda df: df.mapInArrow(frugal(_forest), "hi long, lo long")
    e = settle(forest(e), "links", few=True)
    labels, left = None, e.count()
    while left:
        if left < BLOCK:
            hook = settle(forest(e.repartition(1)), "hooks", few=True)
        else:
            hook = e.groupBy("hi").agg(F.min("lo").alias("lo"))
            for _ in range(2):
                up = hook.select(F.col("hi").alias("lo"), F.col("lo").alias("top"))
                hook = hook.join(up, "lo", "left").select("hi", F.coalesce("top", "lo").alias("lo"))
            hook = settle(hook, "hooks", few=True)
        to = hook.select(F.col("hi").alias("node"), F.col("lo").alias("to"))
        if labels is None:
            new = to.select("node", F.col("to").alias("component"))
        else:
            new = labels.join(to.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            # Nodes that were hooked for the first time in this round
            new = new.unionByName(to.join(labels, "node", "left_anti").select("node", F.col("to").alias("component")))
        if left < BLOCK and labels is None:
            labels = new
            break
        labels = settle(new, "labels", few=True, drop=labels)
        if left < BLOCK:
            break
        r = e.join(to.withColumnRenamed("node", "hi"), "hi", "left").select(F.coalesce("to", "hi").alias("hi"), "lo")
        r = r.join(to.withColumnRenamed("node", "lo"), "lo", "left").select("hi", F.coalesce("to", "lo").alias("lo"))
        r = r.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
        e = settle(forest(r), "links", few=True, drop=e)
        left = e.count()
        release(hook)
    if labels is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    # A component's smallest node is never hooked: it stands for itself
    roots = labels.select(F.col("component").alias("node")).distinct()
    return labels.unionByName(roots.select("node", F.col("node").alias("component")))
