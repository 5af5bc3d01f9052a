"""Connected components by randomised contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.llm.common import materialize

#: Up to so many remaining edges (counted first) one task joins them by union-find, in about 200 MB.
LOCAL_EDGES = 500_000


def _union_find(batches):
    """(u, r): each node of the edges with the smallest one it is linked with."""
    up: dict = {}

    def find(x):
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    kind = None
    for b in batches:
        kind = b.column(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    if kind is not None:
        nodes = list(up)
        for at in range(0, len(nodes), 50_000):
            part = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], names=["u", "r"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", native: bool = True, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Every round each node moves to the node of least hash among itself and its
    neighbours; edges are renamed, loops and repeats go. A constant share of the nodes
    disappears each round whatever the ids' order, so the rounds are logarithmic, and a
    hub costs no more than its edges: its least neighbour is a partially aggregated
    minimum, and the renaming join may be split by the skew-join rule. Each round is
    written to the shared folder. Not ``native``, at most ``LOCAL_EDGES`` edges are left
    to one task. Nulls and loops link nothing; repeated edges count once.
    """
    one = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    one = materialize(one.where(F.col("u").isNotNull()), "cc-edges")
    n = one.count()
    if not n:
        return one.select(F.col("u").alias("node"), F.col("v").alias("component"))
    kind = one.schema["u"].dataType
    out = T.StructType([T.StructField("u", kind), T.StructField("r", kind)])
    if not native and n <= LOCAL_EDGES:
        return one.coalesce(1).mapInArrow(_union_find, out).toDF("node", "component")
    both = one.union(one.select("v", "u"))
    moves: list[DataFrame] = []
    for seed in range(max_rounds):
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("n"))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        move = materialize(best.select("u", F.least(F.col("m"), rank("u")).getField("n").alias("r")), "cc-move")
        moves.append(move)
        half = both.join(move.withColumnRenamed("r", "ru"), "u").select("ru", "v")
        whole = half.join(move.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v").select("ru", "rv")
        both = materialize(whole.where("ru <> rv").distinct().toDF("u", "v"), "cc-edges")
        n = both.count()
        if not n:
            break
        if not native and n <= 2 * LOCAL_EDGES:
            moves.append(both.coalesce(1).mapInArrow(_union_find, out))
            break
    else:
        raise RuntimeError("connected components didn't converge")
    label = moves[-1]
    for move in reversed(moves[:-1]):
        later = label.select(F.col("u").alias("r"), F.col("r").alias("last"))
        label = move.join(later, "r", "left").select("u", F.coalesce("last", "r").alias("r"))
    label = materialize(label, "cc-label")
    least = label.groupBy("r").agg(F.min("u").alias("component"))
    return label.join(least, "r").select(F.col("u").alias("node"), "component")
