"""Near-duplicate embeddings by E8 lattice hashing.

In each of several tables unit vectors are projected onto random orthonormal
directions, eight at a time, scaled, and decoded to the nearest points of the E8
lattice: these points are the vector's cell.  Every vector is filed in its own
cell and looks into that cell and the neighbouring cells nearest to its projection.
Cells get finer with the number of vectors, by their width and by the number
of points that name them, so that chance meetings stay in proportion to the
vectors; the number of tables follows from the chance, measured on drawn pairs, that a
pair at the border cosine meets (``design``).

Equal vectors are one node with a multiplicity.  Nodes within half the
border angle of the first node of a cell form a group with it: all of a group
are linked by the triangle inequality, and are counted instead of listed.
Groups meet by their members' cells, once for each cell.  Leaders that meet are compared by 64 sign
bits, which drop chance meetings, and then by cosine in double precision.  Two
groups are linked throughout, not at all, or member by member against the other
leader; only members whose angle leaves it open are compared with
the members one by one, in blocks.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .workspace import Workspace

COSINE = 0.9
PROBES = 16
MISSED = 0.002  # share of pairs at the border that no table may bring together
MOST_POINTS = 6  # lattice points that name a cell; six do for 2**60 vectors
SIGN_SIGMAS = 4.5  # sign bits that may differ beyond the expected, in standard deviations
TURNS = 3  # rounds in which nodes may join a leader
BLOCK = 1024  # members or visitors of a group that a task compares at once
MARGIN = 1e-6  # radians; what is nearer to a bound is compared itself
SEED = 811


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer components of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: D8 or D8 moved by one half in all components."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(maxsize=1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    roots = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            root = np.zeros(8)
            root[[i, j]] = a, b
            roots.append(root)
    roots += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(c < 0 for c in s) % 2 == 0]
    return np.array(roots)


def _projections(size: int, tables: int, points: int, first: int = 0) -> list[list[np.ndarray]]:
    """Orthonormal directions of each table and lattice point (as many as there are components, at most eight)."""
    width = min(8, size)
    out = []
    for table in range(first, first + tables):
        rng = np.random.default_rng([SEED, size, table])
        out.append([np.linalg.qr(rng.standard_normal((size, width)))[0] for _ in range(points)])
    return out


def _mixed(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of lattice points."""
    with np.errstate(over="ignore"):
        out = np.full(len(points), np.uint64(salt), dtype=np.uint64)
        for column in (2 * points).astype(np.int64).T.astype(np.uint64):
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def _table_cells(unit: np.ndarray, directions: list[np.ndarray], scale: float, salt: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cell and, in rows, the ``probes`` nearest others of one table: cells in which one point gives way to a neighbour."""
    n, whole, at, near, toward = len(unit), np.zeros(len(unit), dtype=np.uint64), [], [], []
    for number, plane in enumerate(directions):
        x = np.zeros((n, 8))
        x[:, : plane.shape[1]] = unit @ plane / scale
        near.append(nearest_e8(x))
        at.append(_mixed(near[-1], 64 * salt + number))
        whole ^= at[-1]
        toward.append((x - near[-1]) @ neighbours().T)
    best = np.argpartition(-np.hstack(toward), probes, axis=1)[:, :probes]
    others = np.empty((n, probes), dtype=np.uint64)
    for number in range(len(directions)):
        row, column = np.nonzero(best // 240 == number)
        moved = near[number][row] + neighbours()[best[row, column] % 240]
        others[row, column] = whole[row] ^ at[number][row] ^ _mixed(moved, 64 * salt + number)
    return whole.view(np.int64), others.view(np.int64)


@lru_cache(maxsize=64)
def design(n_bits: int, size: int, cosine: float = COSINE, probes: int = PROBES) -> tuple[int, float, int]:
    """``(points, scale, tables)`` for ``2**n_bits`` vectors of ``size`` components.

    With ``k`` points to a cell, each is so wide that two random vectors share a
    cell with probability ``2**-n_bits``.  Drawn pairs at the border cosine
    tell how likely one table brings them together; the tables suffice to miss at most
    ``MISSED`` of them.  The number of points that needs the fewest tables is taken.
    """
    rng = np.random.default_rng([SEED, size])
    x = rng.standard_normal((600, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)
    found = []
    for points in range(1, MOST_POINTS + 1):
        spread = math.sqrt(2 ** (n_bits / points / 4) / (4 * math.pi))  # of a component, in units of the lattice
        scale = 1 / (spread * math.sqrt(max(size, 8)))
        met = []
        for table, directions in enumerate(_projections(size, 4, points)):
            (a, around_a), (b, around_b) = (_table_cells(v, directions, scale, table, probes) for v in (x, y))
            met.append((a == b) | (around_a == b[:, None]).any(axis=1) | (around_b == a[:, None]).any(axis=1))
        chance = min(max(np.mean(met), 1e-4), 1 - 1e-9)
        found.append((max(2, math.ceil(math.log(MISSED) / math.log(1 - chance))), points, scale))
    tables, points, scale = min(found)
    return points, scale, tables


@lru_cache(maxsize=8)
def _laid_out(n_bits: int, size: int, cosine: float, probes: int) -> tuple[list[list[np.ndarray]], float, np.ndarray]:
    points, scale, tables = design(n_bits, size, cosine, probes)
    return _projections(size, tables, points), scale, np.random.default_rng([SEED, size, 1]).standard_normal((size, 64))


def codes(unit: np.ndarray, n_bits: int, cosine: float = COSINE, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sign bits, own cells (a column a table) and all visited cells of unit vectors."""
    n, size = unit.shape
    tables, scale, signs = _laid_out(n_bits, size, cosine, probes)
    bits = np.packbits(unit @ signs > 0, axis=1).view(">i8").ravel().astype(np.int64)
    cells = [_table_cells(unit, directions, scale, size * 1_000_003 + table, probes) for table, directions in enumerate(tables)]
    return bits, np.stack([own for own, _ in cells], axis=1), np.hstack([np.hstack([own[:, None], others]) for own, others in cells])


def _coded(classes: DataFrame, n_bits: int, cosine: float, probes: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                for rows, x in _by_length(part.column(1)):
                    bits, own, visited = codes(x / np.linalg.norm(x, axis=1, keepdims=True), n_bits, cosine, probes)
                    columns = [pa.array(ids[rows], pa.int64()), pa.array(bits, pa.int64()), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(visited), pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "bits", "own", "visited"])

    return classes.select("node", "vector").mapInArrow(run, "node long, bits long, own array<long>, visited array<long>")


def _by_length(vectors: pa.Array):
    """Row numbers and a matrix, scaled to a largest component of 1, for each length of vectors."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), size)
        yield rows, x / np.abs(x).max(axis=1, keepdims=True)


def _compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (u, v: nodes) with ``cosine``, in double precision; vectors of different length have none and go."""

    def run(batches):
        for batch in batches:
            first, second = batch.column(2), batch.column(3)
            same = np.flatnonzero(first.value_lengths().to_numpy(zero_copy_only=False) == second.value_lengths().to_numpy(zero_copy_only=False))
            kept = batch.take(pa.array(same))
            found = np.zeros(len(same))
            for (rows, x), (_, y) in zip(_by_length(kept.column(2)), _by_length(kept.column(3)), strict=True):
                dot = lambda a, b: np.einsum("ij,ij->i", a, b)
                found[rows] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(found)], names=["u", "v", "cosine"])

    first = classes.select(F.col("node").alias("u"), F.col("vector").alias("x"))
    second = classes.select(F.col("node").alias("v"), F.col("vector").alias("y"))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long, cosine double")


def _angle(cosine: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def _sign_bits(angle: Column) -> Column:
    """Most differing sign bits of vectors at an angle: the expected number and ``SIGN_SIGMAS`` standard deviations."""
    share = F.least(angle, F.lit(math.pi / 2)) / F.lit(math.pi)
    return 64 * share + SIGN_SIGMAS * F.sqrt(64 * share * (1 - share))


def _groups(ws: Workspace, classes: DataFrame, coded: DataFrame, cosine: float) -> DataFrame:
    """``(node, leader, angle)`` of every node: within half the border angle of its leader, or its own leader.

    In each turn the nodes of a cell meet its first one by a random order, and of
    those that are near enough each chooses the first.  Who chose a node
    that chose nobody has joined it; others who chose try again.
    """
    half = math.acos(cosine) / 2 - MARGIN
    order = F.xxhash64("node")
    ready, joined = coded.select("node", "bits", "own", F.lit(1).alias("late")), []
    for turn in range(TURNS):
        seen = ready.select("node", "bits", "late", F.explode("own").alias("cell"))
        heads = seen.groupBy("cell").agg(F.min(F.struct("late", order.alias("order"), "node", "bits")).alias("head"))
        near = F.bit_count(F.col("bits").bitwiseXOR(F.col("head.bits"))) <= _sign_bits(F.lit(half))
        met = seen.filter("late = 1").join(heads, "cell").filter((F.col("node") != F.col("head.node")) & near)
        met = met.select(F.col("node").alias("u"), F.col("head.node").alias("v"), F.struct("head.late", "head.order").alias("rank")).distinct()
        close = _compared(met.select("u", "v"), classes).withColumn("angle", _angle(F.col("cosine"))).filter(F.col("angle") <= half)
        chosen = met.join(close, ["u", "v"]).groupBy("u").agg(F.min(F.struct("rank", F.col("v").alias("leader"), "angle")).alias("best"))
        chosen = ws.save(chosen.select(F.col("u").alias("node"), "best.leader", "best.angle"), f"chosen-{turn}")
        joins = ws.save(chosen.join(chosen.select(F.col("node").alias("leader")), "leader", "left_anti").select("node", "leader", "angle"), f"joined-{turn}")
        joined.append(joins)
        others = chosen.join(joins, "node", "left_anti").select("node", F.lit(1).alias("late"))
        if others.isEmpty():
            break
        leaders = joined[0].select("leader")
        for more in joined[1:]:
            leaders = leaders.unionByName(more.select("leader"))
        again = others.unionByName(leaders.distinct().select(F.col("leader").alias("node"), F.lit(0).alias("late")))
        ready = coded.select("node", "bits", "own").join(again, "node")
    all_joined = joined[0]
    for more in joined[1:]:
        all_joined = all_joined.unionByName(more)
    grouped = coded.select("node").join(all_joined, "node", "left")
    return ws.save(grouped.select("node", F.coalesce("leader", "node").alias("leader"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "groups")


def _near_groups(ws: Workspace, classes: DataFrame, coded: DataFrame, groups: DataFrame, facts: DataFrame, cosine: float) -> DataFrame:
    """``(u, v, cosine, angle, ru, rv, wu, wv, mu, mv)``: pairs of leaders with their radii, weights and member counts, whose groups may be linked."""
    border = math.acos(cosine)
    placed = coded.select("node", "own", "visited").join(groups.select("node", "leader"), "node")

    def cells(at, side):  # a group's cells once each, before the leader's facts join them
        known = facts.select(F.col("leader").alias(side), F.col("bits").alias("b" + side), F.col("radius").alias("r" + side))
        return placed.select(F.col("leader").alias(side), F.explode(at).alias("cell")).distinct().join(known, side)

    filed, looking = cells("own", "u"), cells("visited", "v")
    bits = F.bit_count(F.col("bu").bitwiseXOR(F.col("bv"))) <= _sign_bits(F.lit(border) + F.col("ru") + F.col("rv"))
    met = filed.join(looking, "cell").filter("u <> v").filter(bits)
    pairs = ws.save(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    side = lambda s: facts.select(F.col("leader").alias(s), F.col("radius").alias("r" + s), F.col("weight").alias("w" + s), F.col("members").alias("m" + s))
    known = _compared(pairs, classes).withColumn("angle", _angle(F.col("cosine"))).join(side("u"), "u").join(side("v"), "v")
    return ws.save(known.filter(F.col("angle") <= border + F.col("ru") + F.col("rv") + MARGIN), "near")


def _counted_in_blocks(ws: Workspace, classes: DataFrame, groups: DataFrame, open_visits: DataFrame, cosine: float) -> DataFrame:
    """``(node, own, other, links)``: links of visiting nodes to the members of other groups; ``open_visits``: (node, own, other)."""
    cuts = lambda counts, by: counts.groupBy(by).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("cuts"))
    visited = open_visits.select("other").distinct()
    members = ws.save(groups.select(F.col("leader").alias("other"), "node").join(visited, "other", "left_semi").join(classes, "node").select("other", "node", "n", "vector"), "visited")
    both = cuts(open_visits, "other").withColumnRenamed("cuts", "a").join(cuts(members, "other").withColumnRenamed("cuts", "b"), "other")
    block = lambda parts: F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = open_visits.join(both, "other").join(classes.select("node", "vector"), "node").select("other", block("a").alias("a"), every("b").alias("b"), "node", "own", "vector")
    right = members.join(both, "other").select(every("a").alias("a"), block("b").alias("b"), "n", F.col("vector").alias("vector_"), F.col("other").alias("other_"))
    right = right.toDF("a_", "b_", "n_", "vector_", "other_")

    def run(visits, held):
        if not len(visits) or not len(held):
            return pd.DataFrame({"node": [], "own": [], "other": [], "links": []}, dtype="int64")
        unit = lambda vectors: (m := np.stack([v / np.abs(v).max() for v in vectors])) / np.linalg.norm(m, axis=1, keepdims=True)
        linked = unit(visits["vector"]) @ unit(held["vector_"]).T >= cosine
        out = visits[["node", "own", "other"]].assign(links=linked @ held["n_"].to_numpy(dtype=np.int64))
        return out[out["links"] > 0].astype("int64")

    return left.groupBy("other", "a", "b").cogroup(right.groupBy("other_", "a_", "b_")).applyInPandas(run, "node long, own long, other long, links long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Null, empty and zero vectors and those with a null or non-finite component
    have no link and are their own component.  Vectors of different length
    never link.  Repeated rows are vectors of their own and link with each
    other.  A null id is never the smallest of a component unless all are
    null.  An empty table gives no rows; other columns are not read.
    """
    ws = Workspace(vectors.sparkSession, "embeddings")
    border = math.acos(cosine)
    vector = F.col(vector_col).cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    sound = F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda c: c != 0), F.lit(False))
    # 0.0 + c turns -0.0 into 0.0, so that equal vectors are equal keys
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, F.transform(vector, lambda c: c + F.lit(0.0))).alias("vector"))
    grouped = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = ws.save(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    n_bits = max(10, classes.count().bit_length())
    coded = ws.save(_coded(classes, n_bits, cosine, probes), "codes")
    groups = _groups(ws, classes, coded, cosine)
    sized = groups.join(classes.select("node", "n"), "node")
    facts = sized.groupBy("leader").agg(F.max("angle").alias("radius"), F.sum("n").alias("weight"), F.count("*").alias("members"))
    facts = ws.save(facts.join(coded.select(F.col("node").alias("leader"), "bits"), "leader"), "facts")
    near = _near_groups(ws, classes, coded, groups, facts, cosine)

    alone = (F.col("mu") == 1) & (F.col("mv") == 1)
    whole = F.when(alone, F.col("cosine") >= cosine).otherwise(F.col("angle") + F.col("ru") + F.col("rv") <= border - MARGIN)
    split = near.withColumn("whole", whole)
    between = split.filter("whole").select("u", "v", "wu", "wv")
    part = split.filter(~F.col("whole") & ~alone)
    turned = part.select(F.col("u").alias("own"), F.col("v").alias("other"), F.col("rv").alias("radius"), F.col("wv").alias("weight")).unionByName(
        part.select(F.col("v").alias("own"), F.col("u").alias("other"), F.col("ru").alias("radius"), F.col("wu").alias("weight"))
    )
    visits = ws.save(turned.join(groups.select("node", F.col("leader").alias("own")), "own"), "visits")
    seen = _compared(visits.select(F.col("node").alias("u"), F.col("other").alias("v")), classes)
    seen = visits.join(seen.select(F.col("u").alias("node"), F.col("v").alias("other"), _angle(F.col("cosine")).alias("angle")), ["node", "other"])
    seen = ws.save(seen.filter(F.col("angle") - F.col("radius") <= border + MARGIN), "seen")
    sure = F.col("angle") + F.col("radius") <= border - MARGIN
    singly = seen.filter(sure).select("node", "own", "other", F.col("weight").alias("links"))
    open_visits = ws.save(seen.filter(~sure).select("node", "own", "other"), "open")
    singly = ws.save(singly.unionByName(_counted_in_blocks(ws, classes, groups, open_visits, cosine)), "singly")

    links = between.select("u", "v").unionByName(singly.select(F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v")).distinct())
    roots = connected_components(ws, links).withColumnRenamed("node", "leader")
    groupwise = between.select(F.col("u").alias("leader"), F.col("wv").alias("w")).unionByName(between.select(F.col("v").alias("leader"), F.col("wu").alias("w")))
    groupwise = groupwise.groupBy("leader").agg(F.sum("w").alias("beyond"))
    nodewise = singly.groupBy("node").agg(F.sum("links").alias("others"))
    known = groups.select("node", "leader").join(facts.select("leader", "weight"), "leader").join(groupwise, "leader", "left").join(roots, "leader", "left")
    known = known.join(nodewise, "node", "left").join(classes, "node").withColumn("root", F.coalesce("root", "leader"))
    smallest = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    n_links = F.col("weight") - 1 + F.coalesce("beyond", F.lit(0)) + F.coalesce("others", F.lit(0))
    known = known.join(smallest, "root").select("vector", n_links.alias("n_links"), "component_id")
    found = rows.join(known, "vector", "left")
    single = F.col("vector").isNull()
    component = F.when(single, F.col("vec_id")).otherwise(F.col("component_id"))
    out = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
