"""Groups of near-equal vectors by an epsilon grid order join.

Unit vectors whose cosine is ``c`` lie ``sqrt(2 - 2c)`` apart, which is the
epsilon of the join. Vectors are sorted by the grid cells, one epsilon wide, of
their leading principal coordinates and cut into runs of bounded size. A run's
bounding box, and that of any interval of runs, bounds the distance to other
intervals from below, as the coordinates are a projection on orthonormal axes.
Pairs of intervals are refined from the whole sequence down to pairs of runs,
and further inside a task down to a few hundred vectors; pairs of boxes more
than epsilon apart are skipped on the way. What is left is compared by exact
cosines. Axes are fitted on a bounded sample: they decide how much is skipped,
never what is found.

Equal vectors are one vector with a count. A task returns counts per vector and
a spanning forest of its links instead of the links, so a dense group costs rows
in proportion to its vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, materialize_counted
from .common import bound_batches
from .components import connected_components

#: Numbers of the sample of vectors on which the axes are fitted (16 MB).
SAMPLE_VALUES = 1 << 21
#: Leading principal dimensions of the grid.
AXES = 6
#: Numbers in a run of vectors (8 MB), and its vectors at most.
RUN_VALUES, RUN_ROWS = 1 << 20, 1 << 14
#: Vectors that are compared without asking their boxes again.
LEAF = 384
#: Children of an interval: two bits of the run's number.
FAN_BITS = 2
#: Room for rounding in what is skipped.
SLACK = 1e-9


def _sound(vector: Column) -> Column:
    """A vector of finite numbers that is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _units(vectors) -> np.ndarray:
    """Rows of unit length in double precision; scaled first, so that squares of
    very large or small numbers stay finite."""
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _principal_axes(groups: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Per number of dimensions, orthonormal axes along which vectors of one label
    vary most, from at most ``SAMPLE_VALUES`` numbers."""
    widths = groups.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(16).collect()
    axes = {}
    for dims, n in ((row["dims"], row["n"]) for row in widths):
        wanted = max(1, SAMPLE_VALUES // (dims * len(widths)))
        # a share of hashes slightly below the bound, cut at it
        share = min(1.0, 0.9 * wanted / n)
        chosen = groups.filter((F.col("dims") == dims) & (F.pmod(F.xxhash64("least", "vector"), F.lit(1 << 20)) < int(share * (1 << 20))))
        sample = chosen.select("label", "vector").limit(wanted).toPandas()
        if len(sample) < 2:
            continue
        units = _units(sample["vector"])
        _, label = np.unique(sample["label"].to_numpy(), return_inverse=True)
        means = np.zeros((label.max() + 1, dims))
        np.add.at(means, label, units)
        units -= (means / np.bincount(label)[:, None])[label]
        _, vectors = np.linalg.eigh(units.T @ units)
        axes[dims] = np.ascontiguousarray(vectors[:, ::-1][:, :AXES])
    return axes


def _projected(axes: dict[int, np.ndarray], units: np.ndarray) -> np.ndarray:
    """Coordinates; vectors of a rare length use their first numbers."""
    dims = units.shape[1]
    return units @ axes[dims] if dims in axes else units[:, :AXES]


def _with_cells(axes: dict[int, np.ndarray], epsilon: float):
    def run(frames):
        for frame in frames:
            cells = np.zeros((len(frame), AXES), np.int32)
            for _, at in frame.groupby("dims").indices.items():
                coordinates = _projected(axes, _units(frame["vector"].iloc[at]))
                cells[at, : coordinates.shape[1]] = np.floor(coordinates / epsilon)
            yield frame.assign(cells=list(cells))

    return run


def _with_runs(axes: dict[int, np.ndarray], run_rows: int):
    """Sorted rows get the number of their run, counted from 0 in each partition,
    and their place in it. A run has rows of one label and length."""

    def run(frames):
        current, number, place = None, -1, 0
        for frame in frames:
            runs, places = np.zeros(len(frame), np.int32), np.zeros(len(frame), np.int32)
            keys = list(zip(frame["label"], frame["dims"]))
            for i, key in enumerate(keys):
                size = max(1, min(run_rows, RUN_VALUES // key[1]))
                if key != current or place == size:
                    current, number, place = key, number + 1, 0
                runs[i], places[i] = number, place
                place += 1
            low = np.zeros((len(frame), AXES))
            for _, at in frame.groupby("dims").indices.items():
                coordinates = _projected(axes, _units(frame["vector"].iloc[at]))
                low[at, : coordinates.shape[1]] = coordinates
            yield frame.drop(columns="cells").assign(run=runs, place=places, at=list(low))

    return run


def _apart(a: str, b: str) -> Column:
    """Squared distance of two boxes, each a struct of ``low`` and ``high``."""
    gaps = F.zip_with(F.col(f"{a}.low"), F.col(f"{b}.high"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    other = F.zip_with(F.col(f"{b}.low"), F.col(f"{a}.high"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    return F.aggregate(F.concat(gaps, other), F.lit(0.0), lambda total, x: total + x * x)


def _merged(rows: DataFrame, keys: list[str], low, high) -> DataFrame:
    lows = F.array(*[F.min(low(i)) for i in range(AXES)]).alias("low")
    highs = F.array(*[F.max(high(i)) for i in range(AXES)]).alias("high")
    return rows.groupBy(*keys).agg(lows, highs).select(*keys, F.struct("low", "high").alias("box"))


def _run_pairs(boxes: DataFrame, bits: int, epsilon: float) -> DataFrame:
    """Pairs (a, b) of runs, a <= b, that are not provably apart.

    A run's number orders it within the sequence, so its leading bits name the
    interval it lies in. The join starts at whole labels and goes down ``FAN_BITS`` bits at
    a time: an interval pair becomes the pairs of their parts that are near.
    """
    key = ["label", "dims"]
    levels = [boxes]
    while bits > 0:
        finer = levels[-1].withColumn("run", F.shiftright("run", FAN_BITS))
        levels.append(_merged(finer, [*key, "run"], lambda i: F.col("box.low")[i], lambda i: F.col("box.high")[i]))
        bits -= FAN_BITS
    near = F.lit(epsilon * epsilon + SLACK)
    pairs = levels[-1].select(*key, F.col("run").alias("a"), F.col("run").alias("b"))
    for level in reversed(levels[:-1]):
        part = level.withColumn("parent", F.shiftright("run", FAN_BITS))
        left = part.select(*key, F.col("parent").alias("a"), F.col("run").alias("a_part"), F.col("box").alias("a_box"))
        right = part.select(*key, F.col("parent").alias("b"), F.col("run").alias("b_part"), F.col("box").alias("b_box"))
        finer = pairs.join(left, [*key, "a"]).join(right, [*key, "b"])
        finer = finer.filter((F.col("a_part") <= F.col("b_part")) & (_apart("a_box", "b_box") <= near))
        pairs = finer.select(*key, F.col("a_part").alias("a"), F.col("b_part").alias("b"))
    return pairs.select("a", "b")


class Joined:
    """Link counts and connected parts of the vectors of two runs (or of one)."""

    def __init__(self, left, right, similarity: float):
        self.units, self.at, self.copies = zip(left, right) if right is not None else ((left[0],) * 2, (left[1],) * 2, (left[2],) * 2)
        self.same = right is None
        self.similarity, self.near = similarity, 2 - 2 * similarity + SLACK
        self.shift = 0 if self.same else len(left[0])
        self.links = np.zeros(self.shift + len(self.units[1]), np.int64)
        self.parent = np.arange(len(self.links))

    def apart(self, a: slice, b: slice) -> bool:
        x, y = self.at[0][a], self.at[1][b]
        gap = np.maximum(np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)), 0)
        return gap @ gap > self.near

    def join(self) -> None:
        todo = [(0, len(self.units[0]), 0, len(self.units[1]))]
        while todo:
            a, a_end, b, b_end = todo.pop()
            if self.same and b_end <= a or self.apart(slice(a, a_end), slice(b, b_end)):
                continue
            if a_end - a <= LEAF and b_end - b <= LEAF:
                self.compare(a, a_end, b, b_end)
            elif a_end - a >= b_end - b and not (self.same and a == b):
                middle = (a + a_end) // 2
                todo += [(a, middle, b, b_end), (middle, a_end, b, b_end)]
            elif self.same and a == b and a_end == b_end:
                middle = (a + a_end) // 2
                todo += [(a, middle, a, middle), (a, middle, middle, a_end), (middle, a_end, middle, a_end)]
            else:
                middle = (b + b_end) // 2
                todo += [(a, a_end, b, middle), (a, a_end, middle, b_end)]

    def compare(self, a: int, a_end: int, b: int, b_end: int) -> None:
        linked = self.units[0][a:a_end] @ self.units[1][b:b_end].T >= self.similarity
        if self.same:
            linked &= np.arange(a, a_end)[:, None] < np.arange(b, b_end)[None, :]
        if not linked.any():
            return
        self.links[a:a_end] += linked @ self.copies[1][b:b_end]
        self.links[self.shift + b : self.shift + b_end] += self.copies[0][a:a_end] @ linked
        rows, columns = np.nonzero(linked)
        self.unite(rows + a, columns + b + self.shift)

    def roots(self) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if np.array_equal(above, self.parent):
                return above
            self.parent = above

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        """Hooks the larger root of every link below the smaller until none differ."""
        while len(x):
            root = self.roots()
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            open_ = low < high
            x, y, low, high = x[open_], y[open_], low[open_], high[open_]
            np.minimum.at(self.parent, high, low)


def _join_task(similarity: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for _, side in rows.sort_values(["run", "place"], kind="stable").groupby("run"):
            sides.append((_units(side["vector"]), np.stack(side["at"]), side["copies"].to_numpy(), side["node"].to_numpy()))
        left, right = sides[0], sides[1] if len(sides) > 1 else None
        joined = Joined(left[:3], None if right is None else right[:3], similarity)
        joined.join()
        nodes = left[3] if right is None else np.concatenate([left[3], right[3]])
        hit = np.flatnonzero(joined.links)
        return pd.DataFrame({"node": nodes[hit], "links": joined.links[hit], "root": nodes[joined.roots()[hit]]})

    return run


def near_vectors(
    embeddings: DataFrame,
    similarity: float = 0.93,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept), a row per row of ``embeddings``.

    Two vectors are linked if they have one label, which is not null, as many
    numbers, and a cosine of ``similarity`` or more. Vectors that are null, zero
    or hold null or non-finite numbers, and those without label, link with
    nothing. ``component_id`` is the smallest id reachable; rows without id are
    linked and counted but name a component only if it has no other id. Rows
    that repeat are vectors of their own. ``kept`` marks the row with the
    component's id. An empty table gives no rows; other columns are not read.
    ``run_rows`` bounds the vectors of a run, so of a side of one task.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    bound_batches(embeddings.sparkSession)
    epsilon = float(np.sqrt(2 - 2 * similarity)) or 1e-6
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    linkable = F.col("label").isNotNull() & _sound(F.col("vector"))
    # a third of all rows may be one vector: they are combined before the shuffle
    groups, total = materialize_counted(
        rows.filter(linkable)
        .groupBy("label", "vector")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dims", F.size("vector")),
        "vectors",
    )
    if total == 0:
        found = rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    else:
        found = _components(rows, linkable, groups, total, similarity, epsilon, run_rows)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", kept)


def _sorted_runs(groups: DataFrame, axes: dict[int, np.ndarray], epsilon: float, run_rows: int) -> DataFrame:
    """Vectors in epsilon grid order with the number of their run and their place."""
    fields = [f for f in groups.schema.fields]
    celled = groups.mapInPandas(_with_cells(axes, epsilon), _schema(fields, "cells array<int>"))
    order = ["label", "dims", "cells", "least", "vector"]
    placed = celled.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.mapInPandas(_with_runs(axes, run_rows), _schema(fields, "run int, place int, at array<double>"))
    # parts follow the sort order: part and number give a run's place in the sequence
    return materialize(placed.withColumn("part", F.spark_partition_id()), "vector-runs")


def _schema(fields, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + more


def _components(rows: DataFrame, linkable: Column, groups: DataFrame, total: int, similarity: float, epsilon: float, run_rows: int) -> DataFrame:
    axes = _principal_axes(groups, total)
    placed = _sorted_runs(groups, axes, epsilon, run_rows)
    parts, most = placed.agg(F.max("part"), F.max("run")).first()
    within = int(most).bit_length()
    bits = int(parts).bit_length() + within
    run = F.shiftleft(F.col("part").cast("bigint"), within) + F.col("run")
    nodes = placed.withColumns({"run": run, "node": F.shiftleft(run, run_rows.bit_length()) + F.col("place")}).drop("part")
    boxes = _merged(nodes, ["label", "dims", "run"], lambda i: F.col("at")[i], lambda i: F.col("at")[i])
    boxes = materialize(boxes, "vector-boxes")
    pairs = materialize(_run_pairs(boxes, bits, epsilon), "vector-pairs")
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("run"))
    meeting = sides.join(nodes.select("run", "node", "place", "vector", "at", "copies"), "run")
    linked = meeting.groupBy("a", "b").applyInPandas(_join_task(similarity), "node long, links long, root long")
    linked = materialize(linked, "vector-links")

    counted = linked.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")))
    members = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    named = nodes.select("node", "least").join(members, "node")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    component = named.join(least, "root").select("node", "component")
    judged = (
        nodes.select("node", "label", "vector", "least", "copies")
        .join(counted, "node", "left")
        .join(component, "node", "left")
        .select(
            "label",
            "vector",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
            F.coalesce("component", "least").alias("component_id"),
        )
    )
    alone = rows.filter(~F.coalesce(linkable, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    # many rows may share one vector: the other side has it once, so that the join may be split
    return rows.filter(linkable).join(judged, ["label", "vector"]).select("id", "n_links", "component_id").union(alone)


#: The same by all pairs of a label in DuckDB, links followed step by step.
SQL = """
WITH RECURSIVE sound AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.row AS u, b.row AS v FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.row <> b.row
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reached AS (
  SELECT row AS u, row AS v FROM sound
  UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
named AS (SELECT r.u, min(s.vec_id) AS component_id FROM reached r JOIN sound s ON s.row = r.v GROUP BY 1),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT s.vec_id, coalesce(c.n, 0) AS n_links, n.component_id, s.vec_id = n.component_id AS kept
FROM sound s JOIN named n ON n.u = s.row LEFT JOIN counted c ON c.u = s.row
UNION ALL
SELECT vec_id, 0, vec_id, TRUE FROM embeddings e
WHERE NOT coalesce(label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0, FALSE)
"""
