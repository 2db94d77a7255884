"""User-written vertex programs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.rounds import checkpointed, settle
from vertexloom.functions.skew import SALT, hot_keys, repeated, salted
from vertexloom.operators.adjacency import Adjacency
from vertexloom.operators.graph import Graph, neighbors

MESSAGE = "message"


def src(name: str) -> Column:
    """Attribute ``name`` of the source vertex, for message expressions."""
    return F.col(f"src_attr.{name}")


def dst(name: str) -> Column:
    """Attribute ``name`` of the destination vertex, for message expressions."""
    return F.col(f"dst_attr.{name}")


def edge(name: str) -> Column:
    """Column ``name`` of the edge (``src`` and ``dst`` included), for message expressions."""
    return F.col(name)


def message() -> Column:
    """The message: the input of ``combine`` (an aggregate) and of the update expressions."""
    return F.col(MESSAGE)


class _MessagePass:
    """The edges of a graph, ready for any number of supersteps."""

    def __init__(self, edges: DataFrame, groups: list[str], reads: Sequence[str], hot_rows: int | None) -> None:
        self.groups = groups
        self.reads = set(reads)
        self.edge_cols = edges.columns
        self.first = "src" if "src" in self.reads else "dst"
        self.adjacency = Adjacency(edges, self.first, groups, hot_rows)
        self.far_keys = [*groups, self.adjacency.far]
        self.far_hot = hot_keys(edges, self.far_keys, hot_rows) if len(self.reads) > 1 else None

    def send(
        self, vertices: DataFrame, to_src: Column | None, to_dst: Column | None, combine: Column
    ) -> DataFrame:
        """``(id, message)``: the combined message of every vertex that is sent one. A null message is not sent."""
        state = [name for name in vertices.columns if name not in (*self.groups, "id", "_active")]
        flag = F.col("_active") if "_active" in vertices.columns else F.lit(True)

        def end(name: str) -> list[Column]:
            return [F.struct(F.lit(0).alias("_"), *state).alias(f"{name}_attr"), flag.alias(f"_{name}_active")]

        if len(self.reads) == 1:
            # Only one end is read, so the edges of the vertices changed last round are all that can send.
            awake = vertices.filter(flag).select(*self.groups, "id", end(self.first)[0])
            rows = self.adjacency.attach(awake)
        else:
            rows = self.adjacency.attach(vertices.select(*self.groups, "id", *end(self.first)))
            other = vertices.select(*self.groups, F.col("id").alias(self.adjacency.far), *end(self.adjacency.far))
            if self.far_hot is None:
                rows = rows.join(other, self.far_keys)
            else:
                rows = salted(rows, self.far_keys, self.far_hot, by=[self.first])
                rows = rows.join(repeated(other, self.far_keys, self.far_hot), [*self.far_keys, SALT]).drop(SALT)
            rows = rows.filter(F.col("_src_active") | F.col("_dst_active"))

        targets = [(name, column) for name, column in (("src", to_src), ("dst", to_dst)) if column is not None]
        if not targets:
            raise ValueError("a program must send messages to src, to dst or to both")
        sent = F.array(*[F.struct(F.col(name).alias("id"), column.alias(MESSAGE)) for name, column in targets])
        sent_rows = rows.select(*self.groups, F.explode(sent).alias("_m"))
        sent_rows = sent_rows.select(*self.groups, "_m.id", f"_m.{MESSAGE}").filter(F.col(MESSAGE).isNotNull())
        return sent_rows.groupBy(*self.groups, "id").agg(combine.alias(MESSAGE))


def aggregate_messages(
    g: Graph,
    combine: Column,
    to_src: Column | None = None,
    to_dst: Column | None = None,
    reads: Sequence[str] = ("src", "dst"),
    hot_rows: int | None = None,
) -> DataFrame:
    """One superstep: ``(id, message)`` for every vertex that is sent at least one message.

    ``to_src`` and ``to_dst`` are expressions over ``src()``, ``dst()`` and ``edge()``; null sends nothing. ``combine``
    is an aggregate of ``message()``. ``reads`` says which ends the expressions look at; naming a single end saves the
    join with the other.
    """
    passing = _MessagePass(g.edges, list(g.group_cols), reads, hot_rows)
    result = checkpointed(passing.send(g.vertices, to_src, to_dst, combine))
    passing.adjacency.release()
    return result


def pregel(
    g: Graph,
    combine: Column,
    update: Mapping[str, Column],
    to_src: Column | None = None,
    to_dst: Column | None = None,
    initial_message: Column | None = None,
    max_iter: int | None = None,
    reads: Sequence[str] = ("src", "dst"),
    hot_rows: int | None = None,
) -> DataFrame:
    """Run a vertex program until no message is sent, or for ``max_iter`` supersteps; returns the vertices.

    A superstep sends messages along the edges (see ``aggregate_messages``), combines them per receiver with the
    aggregate ``combine`` and gives every receiver the new attributes in ``update``, expressions over its attributes
    and ``message()``. Other vertices stay as they are. After the first superstep only edges with an end that received
    a message in the previous one may send. ``initial_message`` is delivered to every vertex before the first.
    Parallel edges send once each. ``combine`` may be a pandas aggregate; built-in aggregates combine before the shuffle.
    """
    groups = list(g.group_cols)
    keys = [*groups, "id"]
    attributes = [name for name in g.vertices.columns if name not in keys]
    unknown = set(update) - set(attributes)
    if unknown:
        raise ValueError(f"update of attributes the vertices do not have: {sorted(unknown)}")

    passing = _MessagePass(g.edges, groups, reads, hot_rows)
    state = g.vertices
    if initial_message is not None:
        state = state.withColumn(MESSAGE, initial_message).withColumns(dict(update)).drop(MESSAGE)
    state = checkpointed(state.withColumn("_active", F.lit(True)))

    done = 0
    while max_iter is None or done < max_iter:
        inbox = passing.send(state, to_src, to_dst, combine)
        received = state.drop("_active").join(inbox.withColumn("_active", F.lit(True)), keys, "left")
        got = F.coalesce("_active", F.lit(False))
        changed = {name: F.when(got, update[name]).otherwise(F.col(name)) for name in update}
        state, row = settle(received.withColumns({**changed, "_active": got}).drop(MESSAGE), any=F.max("_active"))
        done += 1
        if not row["any"]:
            break
    passing.adjacency.release()
    return state.select(*keys, *attributes)


def propagate_max(g: Graph, value: str, hot_rows: int | None = None) -> DataFrame:
    """Every vertex gets the largest ``value`` of any vertex that reaches it along directed edges, itself included.

    Values below 0 become 0: the program starts by delivering 0 to every vertex.
    """
    keys = [*g.group_cols, "id"]
    numbers = Graph(g.vertices.select(*keys, value), g.edges.select(*g.group_cols, "src", "dst"), g.group_cols)
    return pregel(
        numbers,
        to_dst=F.when(src(value) > dst(value), src(value)),
        combine=F.max(message()),
        update={value: F.greatest(F.col(value), message())},
        initial_message=F.lit(0),
        hot_rows=hot_rows,
    )


def collect_successors(g: Graph) -> DataFrame:
    """``(id, successors)``: the sorted set of out-neighbours; empty for a vertex without any."""
    keys = [*g.group_cols, "id"]
    lists = neighbors(g.edges, "out", g.group_cols).withColumnRenamed("neighbors", "successors")
    empty = F.array().cast(lists.schema["successors"].dataType)
    return g.vertices.select(*keys).join(lists, keys, "left").withColumn("successors", F.coalesce("successors", empty))
