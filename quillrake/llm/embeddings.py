"""Near-duplicate vectors by cosine: an epsilon grid order join.

Vectors become unit vectors; cosine at least t is distance at most epsilon = sqrt(2 - 2 t). They are rotated to the
principal axes of a bounded sample and sorted by their grid cells of side epsilon on the leading axes. The sequence is
cut into intervals; two intervals whose bounding boxes lie over epsilon apart hold no link. The others meet in one task
per pair of intervals, to which a vector goes only if it lies within epsilon of the other interval's box. A task splits
both sequences and joins the halves recursively, again skipping boxes that are provably distant, until blocks are small.
Boxes span the leading axes and the length of what lies beyond them, whose difference bounds the distance there. In a
block a product of the leading parts alone bounds each cosine (what lies beyond adds at most the product of its lengths);
only pairs that this bound leaves are computed in full.

Equal vectors are one entry with a weight, so copies cost nothing; a task returns link counts per entry and a spanning
forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrake.llm.common import staged
from quillrake.llm.components import components
from quillrake.llm.simhash import Forest

#: Vectors of the sample that gives the axes and interval bounds; leading axes of the grid and of the bound in blocks;
#: side of a block; intervals at most.
SAMPLE, AXES, BOUND_AXES, BLOCK, INTERVALS = 8_192, 8, 16, 512, 1_024
#: Cosines this near the threshold are computed again, component by component.
EDGE = 1e-9


def cells(projected: np.ndarray, epsilon: float) -> np.ndarray:
    """One sortable number per vector: its cells on the leading axes, first axis first, six bits each."""
    code = np.zeros(len(projected), np.int64)
    for axis in range(projected.shape[1]):
        code = code << 6 | np.clip(np.floor(projected[:, axis] / epsilon) + 32, 0, 63).astype(np.int64)
    return code


def _raw(column: pa.Array, dim: int) -> np.ndarray:
    """Rows scaled to a largest component of 1, which cosines do not notice and squares cannot overflow."""
    raw = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return raw / np.abs(raw).max(axis=1, keepdims=True) if len(raw) else raw


def _units(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _gap(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """The squared distance of boxes, over the last axis."""
    gap = np.maximum(0, np.maximum(lo_b - hi_a, lo_a - hi_b))
    return (gap * gap).sum(axis=-1)


def _slack(epsilon: float) -> float:
    """What a squared distance must exceed to be surely beyond epsilon, rounding included."""
    return epsilon * epsilon * (1 + 1e-9) + 1e-12


class Frame:
    """Principal axes of a sample: leading coordinates of unit vectors, and the length of the rest."""

    def __init__(self, sample: np.ndarray):
        mean = sample.mean(axis=0)
        _, axes = np.linalg.eigh(sample.T @ sample / len(sample) - np.outer(mean, mean))
        self.axes = np.ascontiguousarray(axes[:, ::-1])

    def lead(self, units: np.ndarray, many: int) -> np.ndarray:
        """(n, many + 1): the leading coordinates, and the length of what lies beyond them."""
        lead = units @ self.axes[:, :many]
        return np.column_stack([lead, np.sqrt(np.maximum(0, 1 - (lead * lead).sum(axis=1)))])


class _Join:
    """pairs: met by blocks in all; ruled_out: of these by boxes; bounded: by the leading parts; looked: computed in full."""

    def __init__(self, raw: np.ndarray, units: np.ndarray, lead: np.ndarray, wide: np.ndarray, weights: np.ndarray, cosine: float):
        self.raw, self.units, self.lead, self.weights, self.cosine = raw, units, lead, weights, cosine
        self.wide = wide.astype(np.float32)  # a product of rows is that of the leading parts plus that of the lengths beyond
        self.slack = _slack(float(np.sqrt(2 - 2 * cosine)))
        self.counts, self.forest = np.zeros(len(units), np.int64), Forest(len(units))
        self.pairs = self.ruled_out = self.looked = 0

    def run(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Joins two sequences in grid order; same: they are one sequence."""
        if not len(a) or not len(b):
            return
        la, lb = self.lead[a], self.lead[b]
        if not same and _gap(la.min(axis=0), la.max(axis=0), lb.min(axis=0), lb.max(axis=0)) > self.slack:
            self.pairs += len(a) * len(b)
            self.ruled_out += len(a) * len(b)
            return
        if len(a) <= BLOCK and len(b) <= BLOCK:
            self.block(a, b, same)
        elif same:
            h = len(a) // 2
            self.run(a[:h], a[:h], True)
            self.run(a[h:], a[h:], True)
            self.run(a[:h], a[h:], False)
        elif len(a) >= len(b):
            h = len(a) // 2
            self.run(a[:h], b, False)
            self.run(a[h:], b, False)
        else:
            h = len(b) // 2
            self.run(a, b[:h], False)
            self.run(a, b[h:], False)

    def block(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        self.pairs += len(a) * len(b)
        near = np.flatnonzero((self.wide[a] @ self.wide[b].T).ravel() >= np.float32(self.cosine - 1e-4))  # 32-bit rounding stays far below
        if not len(near):
            return
        i, j = near // len(b), near % len(b)
        if same:
            i, j = i[i < j], j[i < j]
        self.looked += len(i)
        if len(i) * 8 > len(a) * len(b):
            cos = (self.units[a] @ self.units[b].T)[i, j]
        else:
            cos = np.einsum("ij,ij->i", self.units[a[i]], self.units[b[j]])
        hit = cos >= self.cosine
        for k in np.flatnonzero(np.abs(cos - self.cosine) <= EDGE):
            x, y = self.raw[a[i[k]]], self.raw[b[j[k]]]
            hit[k] = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= self.cosine
        i, j = a[i[hit]], b[j[hit]]
        np.add.at(self.counts, i, self.weights[j])
        np.add.at(self.counts, j, self.weights[i])
        self.forest.link(i, j)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept (id = component_id).

    Two vectors link when their cosine in double precision is at least `cosine`. Null, empty and zero vectors and those
    that hold null or non-finite components link with nothing, nor do vectors of different length. Repeated rows are
    rows of their own: each counts as a link of the other. Rows without an id are returned with no links and a null
    component, and link with nothing. An empty table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    good = source.where("id is not null and v is not null").where(fine)
    distinct = staged(good.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("weight")), "vectors")
    empty = spark.createDataFrame([], "node long, links long, a long, b long")
    found = empty
    for row in distinct.groupBy(F.size("v").alias("dim")).count().collect():  # one row for each length of vector
        found = found.unionByName(_links(distinct.where(F.size("v") == row["dim"]), row["dim"], row["count"], cosine))
    found = staged(found, "vector-links")
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("a is not null").select("a", "b"))
    nodes = staged(distinct.join(counts, "node", "left").join(groups, "node", "left").select("v", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "vector-groups")
    linked = good.join(nodes, "v").select("id", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.col("component").alias("component_id"))
    rest = source.where(F.col("id").isNull() | v.isNull() | ~F.coalesce(fine, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(distinct: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    """Rows (node, links, -, -) of link counts and (-, -, a, b) of spanning forests, for vectors of one length."""
    spark, epsilon = distinct.sparkSession, float(np.sqrt(2 - 2 * cosine))
    sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    units = _units(_raw(sample["v"].combine_chunks(), dim))
    frame, axes = Frame(units), min(AXES, dim)
    # Interval bounds: quantiles of the sample in grid order; within a cell the order goes on along the first axis.
    many = int(np.clip(np.sqrt(n / 800), 1, INTERVALS))
    lead = frame.lead(units, axes)[:, :-1]
    order = np.lexsort((lead[:, 0], cells(lead, epsilon)))
    at = order[[len(order) * i // many for i in range(1, many)]]
    bounds = list(zip(cells(lead, epsilon)[at].tolist(), lead[at, 0].tolist(), strict=True))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = frame.lead(_units(_raw(batch.column(0), dim)), axes)
            code = cells(lead[:, :-1], epsilon)
            interval = np.zeros(batch.num_rows, np.int64)
            for c, x in bounds:
                interval += (code > c) | ((code == c) & (lead[:, 0] >= x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(interval), pa.array(lead.tolist(), pa.list_(pa.float64()))], ["v", "node", "weight", "interval", "lead"])

    placed = staged(distinct.select("v", "node", "weight").mapInArrow(place, "v array<double>, node long, weight long, interval long, lead array<double>"), "intervals")
    axis = range(axes + 1)
    boxes = placed.groupBy("interval").agg(F.array(*(F.min(F.col("lead")[i]) for i in axis)).alias("lo"), F.array(*(F.max(F.col("lead")[i]) for i in axis)).alias("hi")).collect()  # INTERVALS rows at most
    numbers = np.array([r.interval for r in boxes], np.int64)
    low, high = (np.array([r[side] for r in boxes]).reshape(len(boxes), axes + 1) for side in ("lo", "hi"))
    shipped, slack = spark.sparkContext.broadcast((frame, numbers, low, high)), _slack(epsilon)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its own interval's task, and to those with intervals whose box it lies within epsilon of."""
        _, numbers, low, high = shipped.value
        for batch in batches:
            lead = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, axes + 1)
            own = batch.column(3).to_numpy()
            for k, n in enumerate(numbers.tolist()):
                at = np.flatnonzero(_gap(lead, lead, low[k], high[k]) <= slack)
                if len(at):
                    pair = np.minimum(own[at], n) * INTERVALS + np.maximum(own[at], n)
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(pair)], ["v", "node", "weight", "interval", "pair"])

    def join(got: pa.Table) -> pa.Table:
        key = got["pair"][0].as_py()
        raw = _raw(got["v"].combine_chunks(), dim)
        units = _units(raw)
        frame = shipped.value[0]
        lead = frame.lead(units, axes)
        run = _Join(raw, units, lead, frame.lead(units, min(BOUND_AXES, dim)), got["weight"].to_numpy(), cosine)
        order = np.lexsort((lead[:, 0], cells(lead[:, :-1], epsilon)))
        side = got["interval"].to_numpy()[order]
        a, b = order[side == key // INTERVALS], order[side == key % INTERVALS]
        run.run(a, b, key // INTERVALS == key % INTERVALS)
        nodes = got["node"].to_numpy()
        least = np.full(len(nodes), np.iinfo(np.int64).max)
        np.minimum.at(least, run.forest.label, nodes)
        to = least[run.forest.label]
        some, tied = run.counts > 0, to != nodes
        return pa.table(
            {
                "node": pa.array(nodes[some].tolist() + [None] * int(tied.sum()), pa.int64()),
                "links": pa.array(run.counts[some].tolist() + [None] * int(tied.sum()), pa.int64()),
                "a": pa.array([None] * int(some.sum()) + nodes[tied].tolist(), pa.int64()),
                "b": pa.array([None] * int(some.sum()) + to[tied].tolist(), pa.int64()),
            }
        )

    met = placed.mapInArrow(send, "v array<double>, node long, weight long, interval long, pair long")
    return met.groupBy("pair").applyInArrow(lambda t: join(t), "node long, links long, a long, b long")
