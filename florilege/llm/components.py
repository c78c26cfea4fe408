"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.session import stage

PART = 200_000  # links contracted by one task


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as stars: each node with the smallest node it reaches by them."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    for b in batches:
        for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = find(s), find(t)
            if a != c:
                root[max(a, c)] = min(a, c)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(v) for v in root], pa.int64())], ["v", "l"])


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, part: int = PART) -> DataFrame:
    """``v, l``: each linked node and the smallest node it can reach.

    Links are dealt to tasks of ``part`` each, which contract theirs to stars. With one task that is the result;
    with more, labels of the contracted links fall to the smallest label among the neighbours, then jump to
    their own label's label, so a path halves each round. Every round is written to shared storage, so
    lineage stays short. A hub's neighbours are reduced by a map-side minimum."""
    plain = stage(links.select(F.col(a).alias("s"), F.col(b).alias("t")).where("s <> t"), "cc-links")
    tasks = max(1, -(-plain.count() // part))
    stars = stage(plain.repartition(tasks).mapInArrow(_contract, "v long, l long"), "cc-stars")
    if tasks == 1:
        return stars
    plain = stars.where("v <> l").select(F.col("v").alias("s"), F.col("l").alias("t"))
    both = stage(plain.unionByName(plain.select(F.col("t").alias("s"), F.col("s").alias("t"))).distinct(), "cc-links")
    label = stage(both.groupBy(F.col("s").alias("v")).agg(F.least(F.min("t"), F.col("s")).alias("l")), "cc-labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("v").alias("t"), "l"), "t").groupBy(F.col("s").alias("v")).agg(F.min("l").alias("m"))
        # the node's label and its root learn of the smaller one
        fall = label.join(near, "v").select("v", "l", F.least("l", "m").alias("m"))
        root = fall.groupBy(F.col("l").alias("v")).agg(F.min("m").alias("r"))
        low = fall.join(root, "v", "left").select("v", "l", F.least("m", F.coalesce("r", "m")).alias("m"))
        jump = low.select(F.col("v").alias("m"), F.col("m").alias("j"))
        new = stage(low.join(jump, "m", "left").select("v", F.col("l").alias("old"), F.least("m", F.coalesce("j", "m")).alias("l")), "cc-labels")
        label = new.select("v", "l")
        if not new.where("old <> l").limit(1).count():
            return label
    raise RuntimeError("components did not settle")
