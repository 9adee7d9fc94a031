"""Connected components of an edge table by minimum labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

ROWS_IN_FILE = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (u, v: long); component is the smallest id reachable.

    Each round a node takes the smallest label among itself and its neighbours, then the label of its
    label, so that the number of rounds grows with the logarithm of a component's diameter. Labels are
    written after each round. Hubs cost nothing extra: minima combine before the shuffle, and the joins
    are plain equi-joins which adaptive execution may split. Null ends and self-loops are ignored; an
    empty table gives an empty table.
    """
    pairs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    # Both directions from one reading, as what makes the edges may be costly.
    either = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    both = cut(pairs.select(either.alias("e")).select("e.u", "e.v").distinct(), "edges")
    # Tables in files of a useful size, so that the planner sees how small they are and need not shuffle small ones.
    parts = both.count() // ROWS_IN_FILE + 1
    packed = cut(both.coalesce(parts), "edges")
    drop_cut(both)
    both = packed
    labels = cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("label")).coalesce(parts), "labels")
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("label").alias("near"))
        own = labels.join(near, labels.id == near.u).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("at"), F.col("label").alias("up"))
        new = own.join(up, own.label == up["at"], "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label"))
        new = cut(new.coalesce(parts), "labels")
        moved = new.where("label <> old").limit(1).count()
        drop_cut(labels)
        labels = new.select("id", "label")
        if not moved:
            return labels.select("id", F.col("label").alias("component"))
