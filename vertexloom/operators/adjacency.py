"""Edges laid out for repeated joins on one end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from vertexloom.functions.skew import SALT, hot_keys, repeated, salted


class Adjacency:
    """Edges kept hash-partitioned on one end, so that each round of a loop moves only its vertex rows.

    ``spark.sql.shuffle.partitions`` is the partition count on both sides of the join, hence the cached edges never
    move again; a lost cache block is read and shuffled anew from the source of ``edges``. The edges of a hub fall into
    several join keys (``functions.skew``), so no task holds more than about ``hot_rows`` edges of one vertex.
    """

    def __init__(
        self,
        edges: DataFrame,
        key: str = "src",
        group_cols: Sequence[str] = (),
        hot_rows: int | None = None,
        rows: int | None = None,
    ) -> None:
        self.key = key
        self.far = "dst" if key == "src" else "src"
        self.keys = [*group_cols, key]
        self.hubs = hot_keys(edges, self.keys, hot_rows, rows)
        self.join_keys = self.keys if self.hubs is None else [*self.keys, SALT]
        laid_out = edges if self.hubs is None else salted(edges, self.keys, self.hubs)
        partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.edges = laid_out.repartition(partitions, *self.join_keys).persist()

    def attach(self, state: DataFrame, id_col: str = "id") -> DataFrame:
        """Edges whose key end occurs in ``state``, together with the other columns of ``state``.

        ``state`` may hold any number of rows per vertex; its ``id_col`` becomes the key column of the edges.
        """
        left = state.withColumnRenamed(id_col, self.key)
        if self.hubs is not None:
            left = repeated(left, self.keys, self.hubs)
        return left.join(self.edges, self.join_keys).drop(SALT)

    def release(self) -> None:
        self.edges.unpersist()
