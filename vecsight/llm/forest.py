"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors are one node with a number of copies.  Every tree splits its nodes level by level:
each level has a random direction, a node is cut at the median of its vectors' projections (an
aggregate over all of them), and vectors close to the cut go to both sides.  Nodes of at most
``leaf`` vectors are leaves.  A direction that would send most of a node to
both sides is passed over, and so is one along which the node is hardly wider than a pair at the
threshold: cuts of such a cluster would separate its links.  Vectors are compared within leaves, in
double precision; a node that no cut takes apart (a cluster) is compared in blocks, all pairs of
blocks, so no pair of a leaf is left out.  Other trees find nearly the same cluster again: what
most of its vectors were compared in before is not compared again.  The deeper the trees, the more
of them are grown, so that the links found do not become fewer with the size of the table.

A pair that meets in several leaves counts in the first of them: every vector carries the list of
its leaves.  So leaves send counts and a spanning forest of their links, never their pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different length never link; rows that share an id are rows of their
own, each counts as a link; a null id is never the smallest unless all are; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsight.llm.common import cut, few
from vecsight.llm.components import components
from vecsight.llm.vectors import groups, matrix, packed

_TREE = 1 << 48


def _project(nodes: DataFrame, trees: int, levels: int, seed: int) -> DataFrame:
    """(node, tree, dim, along): per tree the projections of the unit vector on its directions, in
    units of their usual spread."""
    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                directions = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), trees * levels))
                along = matrix(some.column("raw"), unit=True) @ directions
                flat = pa.array(along.astype(np.float32).ravel())
                n = some.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.asarray(some.column("node")), trees)), pa.array(np.tile(np.arange(trees, dtype=np.int32), n)),
                     pa.array(np.full(n * trees, dim, np.int32)),
                     pa.ListArray.from_arrays(pa.array(np.arange(n * trees + 1, dtype=np.int32) * levels), flat)],
                    ["node", "tree", "dim", "along"])

    return nodes.select("node", "dim", "raw").mapInArrow(run, "node long, tree int, dim int, along array<float>")


def trees_for(depth: float, spill: float, gap: float, least: int = 8, loss: float = 0.005) -> int:
    """So many trees that a pair at the threshold, ``gap`` apart, is parted in all of them with a chance
    of at most ``loss``, if every tree cuts ``depth`` times and spreads vectors as random ones."""
    c = 2 * spill / gap
    over = 2 * gap * (math.exp(-c * c / 2) / math.sqrt(2 * math.pi) - c * math.erfc(c / math.sqrt(2)) / 2)
    parted = 1 - (1 - min(0.5, over / math.sqrt(2 * math.pi))) ** depth
    return max(least, math.ceil(math.log(loss) / math.log(parted)) if parted > 0 else least)


def grow(nodes: DataFrame, trees: int, leaf: int, spill: float, gap: float, seed: int = 0) -> DataFrame:
    """(node, leaves): the leaves a vector lies in, as (id, size) sorted by id; ids rise by tree.
    ``gap`` is how far apart the vectors of a pair at the threshold lie, ``trees`` the least number."""
    halvings = math.log2(max(2, nodes.count() / leaf))
    levels = math.ceil(1.7 * halvings) + 4
    trees = trees_for(1.2 * halvings, spill, gap, trees)
    tight = max(spill, 0.75 * gap)  # p70 - p50 of a cluster whose own pairs lie 1.4 to 2 gaps apart
    state = _project(nodes, trees, levels, seed).withColumn("path", F.lit(1).cast("long"))
    done = []
    for level in range(levels + 1):
        state = cut(state, "forest")
        x = F.col("along")[min(level, levels - 1)]
        points = F.percentile_approx(x, [0.3, 0.5, 0.7], 1000)
        cuts = state.groupBy("tree", "dim", "path").agg(F.count("*").alias("n"), points.alias("p")).select(
            "tree", "dim", "path", "n", F.col("p")[1].alias("at"),
            ((F.col("p")[2] > F.col("p")[1] + tight) & (F.col("p")[0] < F.col("p")[1] - tight)).alias("apart"))
        placed = state.join(cuts, ["tree", "dim", "path"])
        ends = F.lit(True) if level == levels else F.col("n") <= leaf
        done.append(placed.where(ends).select("node", (F.col("tree") * F.lit(_TREE) + F.col("path")).alias("leaf"), "n"))
        if level == levels:
            break
        # a direction that would send most vectors to both sides or part links is passed over
        sides = F.array_compact(F.array(F.when(~F.col("apart") | (x <= F.col("at") + spill), F.col("path") * 2),
                                        F.when(F.col("apart") & (x > F.col("at") - spill), F.col("path") * 2 + 1)))
        state = placed.where(~ends).select("node", "tree", "dim", "along", F.explode(sides).alias("path"))
        if cuts.where(F.col("n") > leaf).isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("leaf", "n"))).alias("leaves"))


def _links(batches, least: float):
    """Per leaf and pair of blocks: how often each vector is linked, and edges that span the links."""
    for table in groups(batches, 3):
        table = table.combine_chunks()
        one, other = table.column("one")[0].as_py(), table.column("other")[0].as_py()
        own = np.asarray(table.column("block"))
        order = np.argsort(own, kind="stable")
        ids = np.asarray(table.column("node"))[order]
        unit = matrix([table.column("raw")[int(k)].as_py() for k in order], unit=True)
        cut_at = int((own == one).sum()) if one != other else 0
        linked = unit @ unit.T >= least
        np.fill_diagonal(linked, False)
        if cut_at:  # two blocks: only pairs across
            linked[:cut_at, :cut_at] = linked[cut_at:, cut_at:] = False
        some = np.flatnonzero(linked.any(1))
        if not len(some):
            continue
        linked, ids = linked[np.ix_(some, some)], ids[some]
        copies = np.asarray(table.column("copies"))[order][some]
        here = table.column("leaf")[0].as_py()
        leaves = [table.column("leaves")[int(k)].as_py() for k in order[some]]
        earlier = {x: k for k, x in enumerate(sorted({x for l in leaves for x in l if x < here}))}
        member = np.zeros((len(some), len(earlier)), np.float32)
        for r, l in enumerate(leaves):
            member[r, [earlier[x] for x in l if x < here]] = 1
        counted = linked & ~((member @ member.T) > 0)
        label = np.arange(len(some))
        while True:  # smallest position reachable
            new = np.minimum(label, np.where(linked, label[None, :], len(some)).min(1))
            new = new[new]
            if (new == label).all():
                break
            label = new
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label]), pa.array(counted @ copies)], ["a", "b", "n"])


def near_duplicates(vectors: DataFrame, least: float = 0.9, trees: int = 8, leaf: int = 2000, spill: float = 0.12,
                    seed: int = 0) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable), kept."""
    rows = cut(packed(vectors), "vectors")
    nodes = cut(rows.where("raw IS NOT NULL").groupBy("raw", "dim").agg(F.count("*").alias("copies"))
                .withColumn("node", F.monotonically_increasing_id()), "nodes")
    leaves = cut(grow(nodes, trees, leaf, spill, math.sqrt(2 * (1 - least)), seed), "leaves")
    # a vector's home is its first leaf of several blocks; there it is compared with all others
    home = F.get(F.filter("leaves", lambda x: x["n"] > leaf), F.lit(0))["leaf"]
    before = F.when(F.col("home") < F.col("at.leaf"), F.col("home"))
    homes = (leaves.select(home.alias("home"), F.explode("leaves").alias("at")).where(F.col("at.n") > leaf)
             .groupBy(F.col("at.leaf").alias("in"), before.alias("known")).agg(F.count("*").alias("m"))
             .where("known IS NOT NULL").groupBy("in").agg(F.max(F.struct("m", "known")).alias("most")))
    zero = F.lit(0).cast("long")
    met = F.coalesce(F.col("home") == F.col("most.known"), F.lit(False))  # not compared among themselves again
    old = F.coalesce(F.ceil(F.col("most.m") / leaf), zero)
    new = F.ceil((F.col("at.n") - F.coalesce("most.m", zero)) / leaf)
    own = F.pmod(F.xxhash64("node"), F.when(met, old).otherwise(new))
    spread = (nodes.join(leaves, "node")
              .select("node", "raw", "copies", home.alias("home"), F.col("leaves.leaf").alias("leaves"), F.explode("leaves").alias("at"))
              .where("at.n > 1").join(few(homes), F.col("at.leaf") == F.col("in"), "left").where(new > 0)
              .withColumn("block", F.when(met, new + own).otherwise(own))
              .withColumn("mate", F.explode(F.sequence(zero, F.when(met, new).otherwise(new + old) - 1)))
              .select(F.col("at.leaf").alias("leaf"), F.least("block", "mate").alias("one"), F.greatest("block", "mate").alias("other"),
                      "block", "node", "raw", "copies", "leaves"))
    found = cut(spread.repartition("leaf", "one", "other").sortWithinPartitions("leaf", "one", "other")
                .mapInArrow(lambda batches: _links(batches, least), "a long, b long, n long"), "found")
    groups_of = components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    known = (nodes.join(counts, "node", "left").join(groups_of, "node", "left")
             .select("raw", "dim", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "node").alias("cls")))
    joined = rows.where("raw IS NOT NULL").join(known, ["raw", "dim"])
    smallest = joined.groupBy("cls").agg(F.min("vec_id").alias("component_id"))
    full = joined.join(smallest, "cls").select("vec_id", "n_links", "component_id")
    alone = rows.where("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return full.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
