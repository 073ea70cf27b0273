"""Edge-featured graph attention.

For head t: g = h W_node, f = efeat W_edge, score = leaky(A . concat(g_dst, g_src, f)),
alpha = softmax of the scores over a node's incoming edges, z = sum of alpha g_src.
The score is split into a part of the source, one of the destination and one of
the edge, each computed once where it belongs, so only heads numbers a node meet
at an edge. The softmax takes one pass over the edges: a score is written as a whole
number e of STEPs plus a rest below STEP, so the exponential of the rest can't
overflow, and the exponentials and their products are summed up by node and the
heads' e, combined on the map side. Each node's few sums are then brought to the
scale of its greatest e and divided.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions.arrays import activate, leaky, zeros
from meshwright.graph import Graph
from meshwright.layers import EGATLayer
from meshwright.matrix import DenseMatrix
from meshwright.operators.transform import linear

#: Scores are split into whole steps of this size.
STEP = 32


def _score_weights(layer: EGATLayer) -> tuple[DenseMatrix, DenseMatrix, DenseMatrix]:
    """Matrices (out x heads for nodes, F_e x heads for edges) of the three parts of the scores."""
    d, heads = layer.out_dim // layer.heads, layer.heads
    parts = []
    for p in range(3):
        a = np.zeros((layer.out_dim, heads))
        for t in range(heads):
            a[t * d : (t + 1) * d, t] = layer.w_attn.values[p * d : (p + 1) * d, t]
        parts.append(a)
    return DenseMatrix(parts[0]), DenseMatrix(parts[1]), DenseMatrix(layer.w_edge.values @ parts[2])


def attend(graph: Graph, features: DataFrame, layer: EGATLayer) -> DataFrame:
    """id and h of every node; the zero vector (activated) without incoming edges. Each of several equal edges is an entry of its own."""
    if "efeat" not in graph.edges.columns:
        raise ValueError("the layer requires edge features")
    heads, d = layer.heads, layer.out_dim // layer.heads
    at_dst, at_src, at_edge = _score_weights(layer)
    # One map gives g and both score parts: h (W A) = (h W) A.
    w = layer.w_node.values
    nodes = linear(features, [("h", DenseMatrix(np.concatenate([w, w @ at_dst.values, w @ at_src.values], axis=1)))])
    nodes = nodes.select("id", F.slice("h", 1, layer.out_dim).alias("h"), F.slice("h", layer.out_dim + 1, 2 * heads).alias("s"))
    src = nodes.select(F.col("id").alias("src"), "h", F.slice("s", heads + 1, heads).alias("from_src"))
    dst = nodes.select(F.col("id").alias("dst"), F.slice("s", 1, heads).alias("from_dst"))
    # An edge has few features, so its part is a short unrolled product in generated code.
    own = F.array(*(sum((F.col("efeat")[k].cast("double") * F.lit(at_edge.values[k, t]) for k in range(at_edge.rows)), F.lit(0.0)) for t in range(heads)))
    edges = graph.edges.select("src", "dst", own.alias("from_edge")).join(src, "src").join(dst, "dst")
    raw = [leaky(F.col("from_dst")[t] + F.col("from_src")[t] + F.col("from_edge")[t], layer.slope) for t in range(heads)]
    # Each head's score as a whole number of STEPs and what is left; the exponential of that and its products are the sums' terms.
    names = [f"e{t}" for t in range(heads)]
    split = edges.select("dst", "h", *(x.alias(f"raw{t}") for t, x in enumerate(raw))).withColumns({e: F.floor(F.col(f"raw{t}") / STEP) for t, e in enumerate(names)})
    weighted = split.select("dst", *names, "h", *(F.exp(F.col(f"raw{t}") - F.col(e) * STEP).alias(f"w{t}") for t, e in enumerate(names)))
    term = lambda i: F.col(f"w{i}") if i < heads else F.col(f"w{(i - heads) // d}") * F.col("h")[i - heads]
    sums = weighted.groupBy("dst", *names).agg(*(F.sum(term(i)).alias(f"s{i}") for i in range(heads + layer.out_dim)))
    # A few rows a node, brought to the scale of each head's greatest; what is far below it becomes 0.
    top = Window.partitionBy("dst")
    few = sums.repartition("dst").withColumns({f"x{t}": F.exp((F.col(e) - F.max(e).over(top)) * F.lit(float(STEP))) for t, e in enumerate(names)})
    total = [F.sum(F.col(f"s{i}") * F.col(f"x{i if i < heads else (i - heads) // d}")) for i in range(heads + layer.out_dim)]
    z = F.array(*(total[heads + i] / total[i // d] for i in range(layer.out_dim)))
    out = graph.nodes.select("id").join(few.groupBy(F.col("dst").alias("id")).agg(z.alias("h")), "id", "left")
    return out.select("id", F.transform(F.coalesce("h", zeros(layer.out_dim)), lambda x: activate(x, layer.activation)).alias("h"))
