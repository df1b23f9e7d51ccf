"""Embedding near-dedup (operator 5): an exact metric range join.

On unit vectors a cosine of ``c`` or more is a Euclidean distance of at most
``r = sqrt(2 - 2 c)``, so the join is a range join in a metric space.  Equal
vectors of a label are one class.  A label with more than ``cell`` classes gets
pivots from its own vectors.  A class lives in the cell of its nearest pivot
``p`` and is copied to the cell of ``q`` unless that cell's members are too far:
by the triangle inequality one within ``r`` needs ``d(x, q) - d(x, p) <= 2 r``,
and on the other side of the plane between ``q`` and any pivot ``t`` that is near
``x``, ``(d(x, q)^2 - d(x, t)^2) / (2 d(t, q)) <= r``.  Copies only go to cells
with a lesser number than the own one, so two classes within ``r`` meet once: in
their cell, or in the lesser one of their two.  Cells join independently, in
pairs of blocks: the members at home with each other and with the copies, never
copies with copies.  Link counts and forest edges leave a task, never pairs.

Where pivots tell nothing (many dimensions without structure), a class is copied
to every lesser cell; cells hold about a block, so this is no more than all pairs
of blocks take.

At most ``MOST_PIVOTS`` pivots with ``NUMBERS`` components in all are broadcast,
however many vectors there are.  A task works in tiles of ``ROWS`` vectors.

Defined results: see ``embedding_dedup``; each row gives a row; rows with one id
are one vector (the least by label and components); a null id has no links and
is not kept; ids may be of any type that has an order; vectors of different
lengths never link; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import Numbered, components
from tidemark.llm.ngram_join import _grouped
from tidemark.llm.scratch import Scratch

#: Classes of a cell; vectors and components in a block; pivots; components of all pivots; vectors of a tile; pivots near a vector.
CELL, BLOCK, BLOCK_NUMBERS, MOST_PIVOTS, NUMBERS, ROWS, NEAR = 8192, 8192, 1 << 20, 8192, 1 << 20, 256, 4
#: Copies that a task holds.
HELD = 8192


def _unit(values) -> np.ndarray:
    v = np.asarray(values, np.float64)
    # A power of two changes no digit and keeps squares of huge and tiny components in range.
    v = np.ldexp(v, -np.frexp(np.abs(v).max(-1, keepdims=True))[1])
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))


def reached(far: np.ndarray, apart: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each vector, and for each cell whether it is that or a lesser one in which a vector within ``radius`` may live; from distances to pivots and between them."""
    home = far.argmin(1)
    near = np.argpartition(far, min(NEAR, far.shape[1]) - 1, axis=1)[:, :NEAR]
    rows, square = np.arange(len(far)), far * far
    reach = far - far[rows, home][:, None] <= 2 * radius + 1e-9
    for t in (home, *near.T):
        reach &= square - square[rows, t][:, None] <= 2 * np.maximum(apart[t], 1e-12) * (radius + 1e-9) + 1e-9
    reach &= np.arange(far.shape[1]) < home[:, None]
    reach[rows, home] = True
    return home, reach


def _cells(pivots, radius: float):
    """Own cell and boundary copies of each class."""
    kinds = {"label": pa.string(), "cell": pa.int32(), "node": pa.int64(), "copies": pa.int64(), "home": pa.bool_(), "vector": pa.binary()}

    def run(batches):
        by_label = {key: _unit(np.array(vectors)) for key, vectors in pivots.value.items()}
        apart = {key: _distances(p, p) for key, p in by_label.items()}

        def sent(key, own, units, cells, which, home):
            packed = pa.array([u.tobytes() for u in units], pa.binary())
            nodes, copies = (np.array([x[i] for x in own], np.int64) for i in (0, 1))
            for at in range(0, len(which), HELD):
                i, q = which[at : at + HELD], cells[at : at + HELD]
                columns = [pa.array([key] * len(i), pa.string()), pa.array(q.astype(np.int32)), pa.array(nodes[i]), pa.array(copies[i]), pa.array(q == home[i]), packed.take(pa.array(i))]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))

        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                groups: dict[str, list] = {}
                for label, node, copies, vector in zip(*(c.to_pylist() for c in batch.slice(begin, ROWS).columns), strict=True):
                    groups.setdefault(f"{label}/{len(vector)}", []).append((node, copies, vector))
                for key, own in groups.items():
                    units = _unit([x[2] for x in own])
                    if key in by_label:
                        home, reach = reached(_distances(units, by_label[key]), apart[key], radius)
                        which, cells = np.nonzero(reach)
                    else:
                        which, cells, home = np.arange(len(own)), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
                    yield from sent(key, own, units, cells, which, home)

    return run


def _tasks(placed: DataFrame) -> DataFrame:
    """Each row once for every pair of blocks ``one``, ``two`` that its own one is in: of blocks at home, and of one at home with one of copies."""
    size = F.sum(F.octet_length("vector")) / (8 * BLOCK_NUMBERS)
    blocks = placed.groupBy("label", "cell", "home").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(size)).cast("int").alias("n"))
    blocks = blocks.groupBy("label", "cell").agg(*(F.coalesce(F.max(F.when(F.col("home") == home, F.col("n"))), F.lit(0)).alias(name) for home, name in ((True, "homes"), (False, "guests"))))
    rows = placed.join(blocks, ["label", "cell"])
    hashed = F.xxhash64("node", F.lit("block"))
    own = F.when(F.col("home"), F.pmod(hashed, F.col("homes"))).otherwise(F.col("homes") + F.pmod(hashed, F.greatest("guests", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("home"), F.col("homes") + F.col("guests")).otherwise(F.col("homes")) - 1)
    rows = rows.withColumn("own", own).filter("homes > 0").withColumn("other", F.explode(others))
    return rows.select("label", "cell", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node", "copies", "own", "vector")


def _links(cosine: float):
    """Link weights between the classes of a block, or of two, and forest edges."""

    def run(batches):
        for (_, _, one, two), rows in _grouped(batches, 4):
            nodes = [r[0] for r in rows]
            weight = np.array([r[1] for r in rows], np.float64)
            own = np.array([r[2] for r in rows])
            units = np.frombuffer(b"".join([r[3] for r in rows]), np.float64).reshape(len(rows), -1)
            weights, group, edges = np.zeros(len(rows)), np.arange(len(rows)), []
            del rows
            # Within a block all rows with all; between two those of one with those of the other.
            left = np.flatnonzero(own == one)
            right = left if one == two else np.flatnonzero(own == two)
            across, theirs = units[right], weight[right]
            for at in range(0, len(left), ROWS):
                mine = left[at : at + ROWS]
                linked = units[mine] @ across.T >= cosine
                if one == two:
                    linked[np.arange(len(mine)), at + np.arange(len(mine))] = False
                found = np.flatnonzero(linked.any(1))
                if not len(found):
                    continue
                weights[mine[found]] += linked[found] @ theirs
                if one != two:
                    weights[right] += weight[mine[found]] @ linked[found]
                for i in found.tolist():
                    others = right[linked[i]]
                    heads, first = np.unique(group[others], return_index=True)
                    new = heads != group[mine[i]]
                    if new.any():  # a forest: one edge for each group that is met
                        edges += [(nodes[mine[i]], nodes[j]) for j in others[first[new]].tolist()]
                        group[np.isin(group, heads)] = group[mine[i]]
            found = np.flatnonzero(weights).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in found] + [a for a, _ in edges], pa.int64()), pa.array([None] * len(found) + [b for _, b in edges], pa.int64()), pa.array([int(weights[i]) for i in found] + [0] * len(edges), pa.int64())], ["node", "other", "links"])

    return run


def _pivots(classes: DataFrame, cell: int) -> dict[str, list]:
    """By label and length, of those with more than ``cell`` classes; at most MOST_PIVOTS with NUMBERS components."""
    sizes = classes.groupBy(F.concat_ws("/", "label", F.size("vector")).alias("key"), F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
    # Cells grow with the table where pivots would be more than may be broadcast.
    row = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dim")).alias("numbers")).first()
    per_cell = max(cell, math.ceil((row["n"] or 0) / MOST_PIVOTS), math.ceil((row["numbers"] or 0) / NUMBERS))
    wanted = sizes.withColumn("pivots", F.floor(F.col("n") / per_cell)).filter("pivots > 1")
    drawn = classes.withColumn("key", F.concat_ws("/", "label", F.size("vector"))).join(wanted, "key")
    drawn = drawn.groupBy("key", F.pmod(F.xxhash64("node"), F.col("pivots")).alias("part")).agg(F.min_by("vector", F.xxhash64("node", F.lit("pivot"))).alias("vector"))
    found: dict[str, list] = {}
    for row in drawn.orderBy("key", "part").collect():
        found.setdefault(row["key"], []).append(row["vector"])
    return found


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, cell: int = CELL) -> DataFrame:
    """One row for each row: id, ``n_links`` (other vectors of its label with a cosine of ``cosine`` or more), ``component_id`` (least id that links reach) and ``kept`` (the id is its component's).

    Vectors that are null, zero or hold null or non-finite components, and rows
    without a label, link with nothing.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    numbered = Numbered(rows, scratch)
    out = numbered.back(_joined(numbered.rows, cosine, cell, scratch), ["component_id"])
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _joined(rows: DataFrame, cosine: float, cell: int, scratch: Scratch) -> DataFrame:
    """``id``, ``n_links`` and ``component_id`` of each long id of the rows (id, label, vector)."""
    radius = math.sqrt(2 - 2 * cosine)
    rows = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.label", "v.vector")
    fine = F.col("label").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = scratch.table(rows.withColumn("fine", fine))
    classes = scratch.table(rows.filter("fine").groupBy("label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("copies")))

    sent = rows.sparkSession.sparkContext.broadcast(_pivots(classes, cell))
    placed = scratch.table(classes.select("label", "node", "copies", "vector").mapInArrow(_cells(sent, radius), "label string, cell int, node long, copies long, home boolean, vector binary"))
    linked = scratch.table(_tasks(placed).repartition("label", "cell", "one", "two").sortWithinPartitions("label", "cell", "one", "two", "node").mapInArrow(_links(cosine), "node long, other long, links long"))
    scratch.drop(placed)
    links = linked.filter(F.col("other").isNull()).groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(linked.filter(F.col("other").isNotNull()).select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)

    told = classes.join(links, "node", "left").join(groups, "node", "left").select(F.col("label").alias("t_label"), F.col("vector").alias("t_vector"), F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.join(told, F.col("fine") & (F.col("label") == F.col("t_label")) & (F.col("vector") == F.col("t_vector")), "left")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
