"""Six-connected components of every label of every case.

Space is cut into tiles of fixed size. Inside a tile, columns of voxels along z
are bits, and their runs are labelled by a small vectorised helper; a tile can never hold more than its
own volume, so no task depends on the size of a case or label. Only components
that reach a tile face enter the distributed part: an edge table between tile
components, merged over blocks of twice the edge at each level. What is left
beyond the largest blocks is contracted by alternating large-star and
small-star steps.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from instqc.functions.quantiles import cumulative, value_counts
from instqc.functions.skew import hub_join
from instqc.session import cut_lineage

TILE = (32, 32, 256)
BITS = 21  # bits per coordinate in a packed run id
#: Labels of a tile are labelled together up to about so many voxel columns.
COLUMNS = 4096
#: Blocks of tiles are merged in one task up to this edge, in voxels; what crosses larger blocks is contracted by rounds.
BLOCK = 2048
NODE = ["case_id", "label"]
PARTS = (
    "case_id string, label int, rep long, size long, "
    "x int, y int, z0 int, z1 int"
)


def pack(x, y, z):
    """Collision-free id of a voxel position (coordinates below 2**21)."""
    to_long = lambda c: F.col(c).cast("long") if isinstance(c, str) else c.cast("long")
    return (
        F.shiftleft(to_long(x), 2 * BITS) + F.shiftleft(to_long(y), BITS) + to_long(z)
    )


def z_runs(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal z runs (keys, z0, z1): gaps and islands inside one voxel column."""
    column = Window.partitionBy(*keys).orderBy("z")
    return (
        voxels.withColumn("_island", F.col("z") - F.row_number().over(column))
        .groupBy(*keys, "_island")
        .agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
        .drop("_island")
    )


def label_runs(voxels: DataFrame) -> DataFrame:
    """Run-length encoding along z per (case, label, x, y)."""
    return z_runs(voxels, ["case_id", "label", "x", "y"])


def run_edges(runs: DataFrame) -> DataFrame:
    """Pairs of touching runs in face-neighbouring columns.

    An equi-join on the neighbouring column with an interval condition; a
    column holds at most half its height in runs.
    """
    steps = F.array(F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy")),
                    F.struct(F.lit(0).alias("dx"), F.lit(1).alias("dy")))
    a = runs.withColumn("_s", F.explode(steps)).select(
        "case_id", "label",
        F.col("x").alias("xa"), F.col("y").alias("ya"),
        F.col("z0").alias("za"), F.col("z1").alias("_za1"),
        (F.col("x") + F.col("_s.dx")).alias("xb"), (F.col("y") + F.col("_s.dy")).alias("yb"),
    )
    b = runs.select(
        "case_id", "label",
        F.col("x").alias("xb"), F.col("y").alias("yb"),
        F.col("z0").alias("zb"), F.col("z1").alias("_zb1"),
    )
    return (
        a.join(b, ["case_id", "label", "xb", "yb"])
        .filter("za <= _zb1 AND zb <= _za1")
        .drop("_za1", "_zb1")
    )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index of every node's connected set."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        while True:
            jump = nxt[nxt]
            if np.array_equal(jump, nxt):
                break
            nxt = jump
        if np.array_equal(nxt, root):
            return root
        root = nxt


def _tile_parts(tile: tuple[int, int, int]):
    """Grouped function: the columns of one tile -> its parts and border runs."""
    tx, ty, tz = tile
    n_words = -(-tz // 64)
    lowest = (1 << BITS) - 1

    def label_columns(cols: np.ndarray, words: np.ndarray, corner: list[int]) -> tuple[tuple, tuple]:
        """Parts and border runs of whole labels, given their columns in order of label, x and y."""
        used = max(1, int(np.flatnonzero(words.any(axis=0))[-1]) + 1)
        held = np.unpackbits(np.ascontiguousarray(words[:, :used]).astype("<i8").view(np.uint8), axis=1, bitorder="little").astype(bool)
        # Runs in order of x, y and z: a voxel without one below it begins a run.
        begins, ends = held.copy(), held.copy()
        begins[:, 1:] &= ~held[:, :-1]
        ends[:, :-1] &= ~held[:, 1:]
        column, first = np.nonzero(begins)
        last = np.nonzero(ends)[1]
        run = (np.cumsum(begins, dtype=np.int32) - 1).reshape(begins.shape)
        label, place = np.divmod(cols, tx * ty)
        x, y = np.divmod(place, ty)
        left, right = [], []
        for step, inside in ((ty, x < tx - 1), (1, y < ty - 1)):
            one = np.flatnonzero(inside)
            two = np.searchsorted(cols, cols[one] + step)
            meet = two < len(cols)
            one, two = one[meet], two[meet]
            meet = cols[two] == cols[one] + step
            one, two = one[meet], two[meet]
            # Where two runs begin to touch, one of them begins.
            touch = held[one] & held[two] & (begins[one] | begins[two])
            left.append(run[one][touch])
            right.append(run[two][touch])
        root = _roots(len(first), np.concatenate(left), np.concatenate(right))
        label, x, y = label[column], corner[0] + x[column], corner[1] + y[column]
        z0, z1 = corner[2] + first, corner[2] + last
        rep = ((x << 2 * BITS) + (y << BITS) + z0)[root]
        sizes = np.bincount(root, weights=last - first + 1, minlength=len(root)).astype(np.int64)
        at = np.flatnonzero(sizes)
        face = (
            (x % tx == 0) | (x % tx == tx - 1) | (y % ty == 0) | (y % ty == ty - 1)
            | (z0 % tz == 0) | (z1 % tz == tz - 1)
        )
        return (label[at], rep[at], sizes[at]), tuple(c[face] for c in (label, rep, x, y, z0, z1))

    def label_tile(key: tuple, table: pa.Table) -> pa.Table:
        take = lambda name: table.column(name).to_numpy()
        packed = key[1].as_py()
        corner = [t * (packed >> (2 - axis) * BITS & lowest) for axis, t in enumerate(tile)]
        cols = take("_col")
        order = np.argsort(cols)
        cols, words = cols[order], np.stack([take(f"_w{k}") for k in range(n_words)], axis=1)[order]
        # Labels are taken together up to some columns; a label has at most one per place of the tile's floor.
        starts = np.flatnonzero(np.diff(cols // (tx * ty), prepend=cols[0] // (tx * ty) - 1))
        chunks = starts[np.flatnonzero(np.diff(starts // COLUMNS, prepend=-1))]
        told = [label_columns(c, w, corner) for c, w in zip(np.split(cols, chunks[1:]), np.split(words, chunks[1:]))]
        label, rep, size = map(np.concatenate, zip(*(heads for heads, _ in told)))
        face_label, face_rep, *face = map(np.concatenate, zip(*(border for _, border in told)))
        n, m = len(label), len(face_label)
        either = lambda a, b, kind: pa.concat_arrays([pa.nulls(n, kind) if a is None else pa.array(a, kind), pa.nulls(m, kind) if b is None else pa.array(b, kind)])
        return pa.table({
            "case_id": pa.repeat(pa.scalar(key[0].as_py(), pa.string()), n + m),
            "label": either(label, face_label, pa.int32()), "rep": either(rep, face_rep, pa.int64()), "size": either(size, None, pa.int64()),
            **{name: either(None, values, pa.int32()) for name, values in zip(("x", "y", "z0", "z1"), face)},
        })

    return label_tile


def tile_parts(voxels: DataFrame, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """Parts of components inside tiles, and the runs on tile faces.

    Rows with ``size`` are parts (their smallest run id is ``rep``); rows with
    coordinates are border runs. One shuffle by tile serves the gathering of
    columns and the labelling alike. A label's voxel column is one row of bits,
    so what a task aggregates and sorts are columns of fixed width.
    """
    key = ["case_id", "_tile"]
    tx, ty, tz = tile

    def checked(axis: str) -> Column:
        # Larger ones would run into the bits of the next coordinate and join what does not touch.
        fits = F.col(axis).between(0, (1 << BITS) - 1)
        return F.when(fits, F.col(axis)).otherwise(F.raise_error(F.lit(f"coordinate {axis} is outside 0 to {(1 << BITS) - 1}")).cast("int")).alias(axis)

    # Narrow rows: the tile is one number, label and place on its floor another.
    tiled = voxels.select("case_id", "label", *map(checked, "xyz")).select(
        "case_id", pack(*[F.floor(F.col(a) / t) for a, t in zip("xyz", tile)]).alias("_tile"),
        F.expr(f"label * {tx * ty}L + (x % {tx}) * {ty} + y % {ty} AS _col"), F.expr(f"z % {tz} AS _z"),
    ).repartition(*key)
    words = [
        F.expr(f"coalesce(bit_or(IF(_z DIV 64 = {k}, shiftleft(1L, _z % 64), NULL)), 0L) AS _w{k}")
        for k in range(-(-tz // 64))
    ]
    columns = tiled.groupBy(*key, "_col").agg(*words)
    return columns.groupBy(*key).applyInArrow(_tile_parts(tile), PARTS)


def part_edges(parts: DataFrame, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """Distinct pairs (a, b) of parts that touch across a tile face."""
    border = parts.filter(F.col("size").isNull())
    span = ["rep", "x", "y", "z0", "z1"]
    a = border.select(*NODE, *[F.col(c).alias(f"a_{c}") for c in span])
    b = border.select(*NODE, *[F.col(c).alias(f"b_{c}") for c in span])

    def across(axis: str, other: str, size: int) -> DataFrame:
        left = a.filter(F.pmod(f"a_{axis}", F.lit(size)) == size - 1)
        right = b.filter(F.pmod(f"b_{axis}", F.lit(size)) == 0)
        left = left.withColumn("_p", F.col(f"a_{axis}") + 1).withColumn("_q", F.col(f"a_{other}"))
        right = right.withColumn("_p", F.col(f"b_{axis}")).withColumn("_q", F.col(f"b_{other}"))
        return left.join(right, [*NODE, "_p", "_q"]).filter("a_z0 <= b_z1 AND b_z0 <= a_z1")

    low = a.filter(F.pmod("a_z1", F.lit(tile[2])) == tile[2] - 1).select(
        *NODE, F.col("a_rep"), F.col("a_x").alias("_p"), F.col("a_y").alias("_q"),
        (F.col("a_z1") + 1).alias("_z"),
    )
    high = b.filter(F.pmod("b_z0", F.lit(tile[2])) == 0).select(
        *NODE, F.col("b_rep"), F.col("b_x").alias("_p"), F.col("b_y").alias("_q"),
        F.col("b_z0").alias("_z"),
    )
    pairs = [
        across("x", "y", tile[0]), across("y", "x", tile[1]),
        low.join(high, [*NODE, "_p", "_q", "_z"]),
    ]
    edges = None
    for pair in pairs:
        pair = pair.select(*NODE, F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
        edges = pair if edges is None else edges.unionByName(pair)
    return edges.filter("a <> b").distinct()


def _star(edges: DataFrame, large: bool, hub_degree: int) -> DataFrame:
    """One star step: link neighbours to the smallest node around a centre."""
    if large:
        around = edges.unionByName(edges.select(*NODE, F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(
            *NODE, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
    centre = around.groupBy(*NODE, "a").agg(
        F.least(F.min("b"), F.col("a")).alias("_low"), F.count(F.lit(1)).alias("_degree")
    )
    linked = hub_join(around, centre, [*NODE, "a"], "_degree", hub_degree)
    if large:
        moved = linked.filter("b > a").select(*NODE, F.col("b").alias("a"), F.col("_low").alias("b"))
    else:
        moved = linked.select(*NODE, F.col("b").alias("a"), F.col("_low").alias("b")).unionByName(
            centre.select(*NODE, "a", F.col("_low").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def contract(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(case_id, label, a, b): every node ``a`` with the smallest node ``b`` of its set.

    Each round is written to the shared folder, so lineage stays short and a
    lost executor costs one re-read. Only a count and a hash sum reach the
    driver. A hub is a node holding more than a 100,000th of the edges (and
    over 100,000 of them), hence the broadcast hub table has at most 200,000
    rows.
    """
    def state(df: DataFrame):
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64(*NODE, "a", "b").cast("decimal(38,0)")).alias("h"),
        ).first()
        return row["n"], row["h"]

    current = cut_lineage(edges)
    seen = state(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            return current
        hub_degree = max(100_000, seen[0] // 100_000)
        # Written between the steps: each reads its edges once, and not the step before again for every use.
        current = cut_lineage(_star(cut_lineage(_star(current, True, hub_degree)), False, hub_degree))
        now = state(current)
        if now == seen:
            return current
        seen = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _merge_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges inside one block of tiles -> every node that is not the smallest of its set, with the smallest."""
    out = []
    for label, pairs in pdf.groupby("label", sort=True):
        nodes, ends = np.unique(pairs[["a", "b"]].to_numpy(np.int64), return_inverse=True)
        ends = ends.reshape(-1, 2)
        root = _roots(len(nodes), ends[:, 0], ends[:, 1])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        out.append(pd.DataFrame({"label": label, "a": nodes[moved], "b": nodes[root[moved]]}))
    result = pd.concat(out, ignore_index=True)
    result.insert(0, "case_id", pdf["case_id"].iloc[0])
    return result


def _renamed(df: DataFrame, stars: DataFrame, column: str) -> DataFrame:
    """``df`` with the nodes in ``column`` replaced by the smallest of their sets."""
    new = stars.select(*NODE, F.col("a").alias(column), F.col("b").alias("_new"))
    return df.join(new, [*NODE, column], "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def contract_blocks(edges: DataFrame, tile: tuple[int, int, int] = TILE, block: int = BLOCK) -> DataFrame:
    """(case_id, label, a, b): nodes with the smallest node of their set, for edges between parts of tiles.

    Level by level, eight neighbouring blocks become one. The edges inside the
    new block are merged in one task; those across its faces go up, with their
    ends replaced by what stands for them. A task sees only the edges across
    the planes that its block has just swallowed, so its size is bounded by
    the area of a block's face. Edges across the largest blocks, in grids
    beyond them, are contracted by rounds. A level is two tables written; one
    without edges is skipped.
    """
    def inside(level: int) -> tuple[list[Column], Column]:
        mask = (1 << BITS) - 1
        at = lambda node, axis: F.floor(F.shiftright(node, (2 - axis) * BITS).bitwiseAND(F.lit(mask)) / (tile[axis] << level)).cast("int")
        return [at("a", k).alias(f"_b{k}") for k in range(3)], reduce(Column.__and__, [at("a", k) == at("b", k) for k in range(3)])

    rest = cut_lineage(edges)
    stars = None
    level = 1
    while rest.take(1) and (min(tile) << level) <= block:
        keys, here = inside(level)
        merged = rest.filter(here).select(*NODE, "a", "b", *keys).groupBy("case_id", "_b0", "_b1", "_b2").applyInPandas(
            lambda pdf: _merge_block(pdf), "case_id string, label int, a long, b long")
        merged = cut_lineage(merged)
        if merged.take(1):
            up = _renamed(_renamed(rest.filter(~here), merged, "a"), merged, "b")
            rest = cut_lineage(up.filter("a <> b").select(*NODE, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
            stars = merged if stars is None else cut_lineage(_renamed(stars, merged, "b").select(*merged.columns).unionByName(merged))
        level += 1
    if not rest.take(1):
        return rest if stars is None else stars
    last = contract(rest)
    return last if stars is None else _renamed(stars, last, "b").select(*last.columns).unionByName(last)


def components(voxels: DataFrame, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """(case_id, label, component, size): one row per connected component.

    ``component`` is the packed position of the component's first run.
    Coordinates must be in 0 to 2**21 - 1.
    """
    parts = cut_lineage(tile_parts(voxels, tile))
    stars = contract_blocks(part_edges(parts, tile), tile).withColumnRenamed("a", "rep")
    return (
        parts.filter(F.col("size").isNotNull())
        .select(*NODE, "rep", "size")
        .join(stars, [*NODE, "rep"], "left")
        .groupBy(*NODE, F.coalesce("b", "rep").alias("component"))
        .agg(F.sum("size").alias("size"))
    )


def ranked_components(comps: DataFrame) -> DataFrame:
    """Adds size_rank: 1 is the dominant component of its label.

    Noise can leave very many components of equal small size in one label, so
    nothing is sorted by label: sizes are ranked as counted classes, and the
    order by id inside a class comes from the bucketed ranking.
    """
    keys = [*NODE, "size"]
    classes = comps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    larger = Window.partitionBy(*NODE).orderBy(F.desc("size")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    classes = classes.withColumn("_larger", F.coalesce(F.sum("_n").over(larger), F.lit(0))).drop("_n")
    exact = comps.withColumn("_id", F.col("component").cast("decimal(20,0)"))
    peers = cumulative(value_counts(exact, keys, "_id"), keys)
    return peers.join(classes, keys).select(
        *keys, F.col("value").cast("long").alias("component"),
        (F.col("_larger") + F.col("below") + 1).alias("size_rank"),
    )


def component_rows(comps: DataFrame, grids: DataFrame) -> DataFrame:
    """One row per component: (case_id, label, component, size_rank, size, volume_mm3)."""
    ranked = ranked_components(comps).join(grids.select("case_id", "sx", "sy", "sz"), "case_id")
    volume = F.col("size") * (F.col("sx") * F.col("sy") * F.col("sz"))
    return ranked.select(*NODE, "component", "size_rank", "size", volume.alias("volume_mm3"))


def count_of(sizes: str | Column) -> Column:
    """Number of components in a list of (size, n)."""
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda t, s: t + s["n"])


def summary(comps: DataFrame, grids: DataFrame, min_fragment_voxels: int = 0) -> DataFrame:
    """Component counts, sizes and stray volume per (case, label).

    Sizes are counted: each list has an entry (size, n) per different size,
    largest first, of which a label of V voxels has fewer than sqrt(2 * V). The
    components one by one are in component_rows.
    """
    counted = comps.groupBy(*NODE, "size").agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.groupBy(*NODE).agg(
        F.sum("n").alias("component_count"),
        F.max("size").alias("largest"),
        F.sum(F.col("size") * F.col("n")).alias("total"),
        F.sort_array(F.collect_list(F.struct("size", "n")), False).alias("component_sizes"),
    )
    volume = F.col("sx") * F.col("sy") * F.col("sz")
    largest_fraction = F.col("largest") / F.col("total")
    # All but one of the largest.
    stray = F.filter(
        F.transform("component_sizes", lambda s, i: F.struct(s["size"].alias("size"), (s["n"] - F.when(i == 0, 1).otherwise(0)).alias("n"))),
        lambda s: s["n"] > 0,
    )
    df = grouped.join(grids.select("case_id", "sx", "sy", "sz"), "case_id")
    return df.select(
        *NODE, "component_count", "component_sizes",
        F.transform("component_sizes", lambda s: F.struct((s["size"] * volume).alias("volume_mm3"), s["n"].alias("n"))).alias("component_volumes_mm3"),
        largest_fraction.alias("largest_component_fraction"),
        largest_fraction.alias("fragmentation_index"),
        F.filter("component_sizes", lambda s: s["size"] < min_fragment_voxels).alias("small_fragments"),
        (F.col("component_count") - 1).alias("stray_component_count"),
        stray.alias("stray_component_sizes"),
        ((F.col("total") - F.col("largest")) * volume).alias("stray_volume_mm3"),
        (1.0 - largest_fraction).alias("stray_volume_fraction"),
    )
