"""PageRank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.rounds import checkpointed, settle, union_all
from vertexloom.functions.skew import join_spread
from vertexloom.operators.adjacency import Adjacency

LOGGED = 10  # rounds whose gains are kept apart before they are summed up


def pagerank(
    edges: DataFrame,
    tol: float = 1e-4,
    reset: float = 0.15,
    max_iter: int | None = None,
    group_cols: Sequence[str] = (),
    hot_rows: int | None = None,
) -> DataFrame:
    """``(id, pagerank double)`` with r(v) = reset + (1 - reset) * sum over u->v of r(u) / outdegree(u).

    Ranks are not normalised and the rank of a sink is not handed out again. Parallel edges and self-loops count.
    Every end point of an edge is listed.

    Ranks grow from ``reset`` by what the previous round added: a vertex passes on its last gain only, and only while
    that gain exceeds ``tol``. A round joins the gains passed on with the resting edges, which hold the share that goes
    along each, and writes the gains that arrive: late rounds move and write a few rows. Ranks are sums over the log of
    gains, which is summed up every ``LOGGED`` rounds. With ``max_iter`` the tolerance is ignored and exactly that many
    rounds are run.
    """
    groups = list(group_cols)
    keys = [*groups, "id"]
    threshold = tol if max_iter is None else 0.0

    plain = edges.select(*groups, "src", "dst")
    sides = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")),
                              F.struct(F.col("dst").alias("id"), F.lit(0).alias("out"))))
    ends = plain.select(*groups, sides.alias("end")).select(*groups, "end.id", "end.out")
    vertices = checkpointed(ends.groupBy(*keys).agg(F.sum("out").alias("outdegree")))
    shares = vertices.filter("outdegree > 0").select(
        *groups, F.col("id").alias("src"), ((1.0 - reset) / F.col("outdegree")).alias("share"))
    adjacency = Adjacency(join_spread(plain, shares, [*groups, "src"], hot_rows=hot_rows), "src", groups, hot_rows)

    gains = vertices.select(*keys, F.lit(reset).alias("gain"))
    log, done, top = [gains], 0, reset
    try:
        while top > threshold if max_iter is None else done < max_iter:
            moved = adjacency.attach(gains.filter(F.col("gain") > threshold))
            arrived = moved.groupBy(*groups, F.col("dst").alias("id")).agg(F.sum(F.col("gain") * F.col("share")).alias("gain"))
            gains, row = settle(arrived, top=F.coalesce(F.max("gain"), F.lit(0.0)))
            done, top = done + 1, row["top"]
            log.append(gains)
            if len(log) > LOGGED:
                log = [checkpointed(_summed(log, keys))]
    finally:
        adjacency.release()
    return _summed(log, keys).select(*keys, F.col("gain").alias("pagerank"))


def _summed(log: list[DataFrame], keys: list[str]) -> DataFrame:
    return union_all(log).groupBy(*keys).agg(F.sum("gain").alias("gain"))
