"""Which strategy a layer is cheapest with, by counts of the graph.

A cost is in bytes: what is shuffled or copied, and the messages of the busiest task
times the number of tasks, since a stage ends with its slowest. Sums that leave the
map side are at most one for each node and task. All numbers are whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from meshwright.functions.storage import cut
from meshwright.graph import Graph
from meshwright.operators.aggregate import BROADCAST_BYTES, HUBS

#: Bytes of an edge's two ids, and of a row's other parts.
EDGE = 16
CHOICES = ("edge", "vertex", "split")


@dataclass(frozen=True)
class Statistics:
    nodes: int
    edges: int
    most_in: int
    most_out: int
    #: Sources of more than one edge in HUBS.
    hubs: int

    @classmethod
    def of(cls, graph: Graph) -> Statistics:
        """Counted in two passes over the edges' ids."""
        ins = graph.edges.groupBy("dst").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        counts = cut(graph.edges.groupBy("src").agg(F.count("*").alias("n")))
        out = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.col("n") * HUBS > F.lit(ins[1]))).first()
        return cls(graph.num_nodes(), ins[1], ins[0], out[0], out[1])


def row_bytes(width: int) -> int:
    return 8 * width + EDGE


def costs(s: Statistics, width: int, tasks: int, machines: int = 1) -> dict[str, int]:
    """The cost of each strategy that can run; `tasks` is the number of shuffle partitions."""
    row = row_bytes(width)
    sums = min(s.edges, s.nodes * tasks) * row
    out = {"edge": s.nodes * row + s.edges * EDGE + max(s.edges, s.most_out * tasks) * row + sums}
    if s.nodes * width * 8 <= BROADCAST_BYTES:
        out["vertex"] = s.edges * EDGE + s.nodes * row * machines + max(s.edges, s.most_in * tasks) * row
    # Edges meet the hubs first, and then their share of each hub's features.
    out["split"] = s.nodes * row + 2 * s.edges * EDGE + s.hubs * tasks * row + s.edges * row + sums
    return out


def choose(s: Statistics, width: int, tasks: int, machines: int = 1) -> str:
    """The cheapest strategy, the first of equals in the order of CHOICES."""
    found = costs(s, width, tasks, machines)
    return min((x for x in CHOICES if x in found), key=lambda x: found[x])
