"""Connected components as joins: smallest label of the neighbourhood, then pointer jumping, until nothing changes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Edges up to which one task joins them up; more take the rounds.
ONE_TASK = 250_000


def components(edges: DataFrame, one_task: int | None = None) -> DataFrame:
    """edges (a, b) of any orderable type, in either direction: (node, component), the component being its least node.

    A set of edges that is known to fit a task is joined up by one. A larger one goes through rounds, each of which
    halves the depth of the label trees and is written to the shared folder, so lineage stays short. What a node gathers
    is a minimum, which is combined before the shuffle; nothing is gathered as a list or on the driver."""
    edges = edges.select("a", "b")
    if edges.count() <= (ONE_TASK if one_task is None else one_task):
        return stored(_in_one_task(edges), "components")
    both = stored(edges.union(edges.select("b", "a")).distinct(), "components-both")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "components")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        root = labels.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = stored(lower.join(root, "component").select("node", "was", F.least("component", "root").alias("component")), "components")
        labels = new.select("node", "component")
        if new.where(F.col("was") != F.col("component")).isEmpty():
            return labels


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["a"].dataType

    def run(batches):
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        schema = None
        for batch in batches:
            schema = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        if parent:
            nodes = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, schema), pa.array([find(x) for x in nodes], schema)], ["node", "component"])

    return edges.repartition(1).mapInArrow(run, T.StructType().add("node", kind).add("component", kind))
