"""Varied subsets of fixed size from pools whose shapes occur unevenly often.

Kinds of shapes come from the pocket distances: conformers at a distance of at most 1 (in features
standardized over their pool) are of one kind, and so on along chains. Records are aggregated into
category combinations twice. First by the cells of a grid over all features: only cells that touch
in every feature can hold a near pair, so pairs are sought between the few occupied neighbouring
combinations, never between all records of a pool. Then by (kind of shape, source type): a
minimum-cost flow over these combinations, with balanced targets for either category and convex
penalties for overuse, says how many records each combination gives, and a deterministic rank picks
them.

The near pairs (``near_pairs``) are what over-represents a shape; the subset doesn't list them. It
works on cells so fine that all records of one are near each other (``shape_kinds``), and compares
records only between cells that nothing else links.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.components import contract
from scorelake.storage import materialize

#: Features by which beginnings of cells are extended at a time when touching ones are sought, and how often; further features are compared then.
STRIDE, LEVELS = 3, 2
#: Records of one cell that one task pairs at a time.
BLOCK = 512


def standardized(conformers: DataFrame) -> DataFrame:
    """Stored rows (pool_id, conformer_id, features): each feature standardized over the distinct conformers of the pool that have features.

    Of a conformer's repeated rows in a pool the greatest features count. Features with nulls or NaN
    are none. A feature that is constant in a pool becomes 0. Rows without pool or id are left out.
    """
    usable = F.col("pocket_features").isNotNull() & (F.size("pocket_features") > 0) & F.forall("pocket_features", lambda x: x.isNotNull() & ~F.isnan(x))
    rows = conformers.where(usable & F.col("pool_id").isNotNull() & F.col("conformer_id").isNotNull())
    once = rows.groupBy("pool_id", "conformer_id").agg(F.max("pocket_features").alias("raw"))
    each = once.select("pool_id", F.posexplode("raw").alias("at", "x")).groupBy("pool_id", "at").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    stats = each.groupBy("pool_id").agg(F.array_sort(F.collect_list(F.struct("at", "mean", "sd"))).alias("stats"))
    scale = lambda x, s: F.when(s["sd"] > 0, (x - s["mean"]) / s["sd"]).otherwise(0.0)
    return materialize(once.join(stats, "pool_id").select("pool_id", "conformer_id", F.zip_with("raw", "stats", scale).alias("features")), "features")


def _distance(a: str, b: str) -> Column:
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.round(F.sqrt(square), 6)


def _steps(i: int) -> list[int]:
    return [(i // 3**k) % 3 - 1 for k in range(STRIDE)]


def touching(combos: DataFrame) -> DataFrame:
    """Rows (pool_id, combo, combo_b): unordered pairs of cells of a pool, each with itself too, that differ by at most 1 in each feature.

    ``combos``: pool_id, combo (id), cell (array of int), a stored table. Cells are compared as a
    tree: pairs of beginnings that touch are extended by the next features, so no key gathers more
    than the cells that share a beginning; what then remains are pairs of hardly shared beginnings,
    whose further features are compared. A pool's features are taken in the order in which they
    tell cells apart; a constant one comes last.
    """
    each = combos.select("pool_id", F.posexplode("cell").alias("at", "c")).groupBy("pool_id", "at", "c").agg(F.count("*").alias("n"))
    spread = each.groupBy("pool_id", "at").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("same"))
    order = spread.groupBy("pool_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("same", "at"))), lambda x: x["at"]).alias("order"))
    cells = combos.join(order, "pool_id").select("pool_id", "combo", F.transform("order", lambda i: F.get("cell", i)).alias("cell"))
    dims = combos.agg(F.max(F.size("cell"))).first()[0] or 1
    levels = min(LEVELS, math.ceil(dims / STRIDE))
    # Ids of the beginnings: of the root, and after each extension. Cells of other lengths never meet.
    ids = cells.withColumn("p0", F.size("cell").cast("long"))
    for k in range(levels):
        own = F.slice("cell", k * STRIDE + 1, STRIDE)
        ids = ids.withColumn(f"s{k}", own).withColumn(f"p{k + 1}", F.xxhash64(f"p{k}", own) if k < levels - 1 else F.xxhash64(f"p{k}", "cell", F.lit("combo")))
    ids = materialize(ids.withColumn("rest", F.slice("cell", levels * STRIDE + 1, max(1, dims))).drop("cell"), "cells")
    near = F.array(*(F.array(*(F.lit(x) for x in _steps(i))) for i in range(3**STRIDE)))
    pairs = ids.select("pool_id", F.col("p0").alias("a"), F.col("p0").alias("b")).distinct()
    for k in range(levels):
        children = ids.select("pool_id", f"p{k}", f"s{k}", f"p{k + 1}").distinct()
        left = pairs.join(children.select("pool_id", F.col(f"p{k}").alias("a"), F.col(f"p{k + 1}").alias("a_next"), F.col(f"s{k}").alias("own")), ["pool_id", "a"])
        moved = F.array_distinct(F.transform(near, lambda step: F.slice(F.zip_with("own", step, lambda x, y: x + y), 1, F.size("own"))))
        left = left.select("pool_id", "b", (F.col("a") == F.col("b")).alias("same"), "a_next", F.explode(moved).alias("own"))
        right = children.select("pool_id", F.col(f"p{k}").alias("b"), F.col(f"p{k + 1}").alias("b_next"), F.col(f"s{k}").alias("own"))
        met = left.join(right, ["pool_id", "b", "own"]).where(~F.col("same") | (F.col("a_next") <= F.col("b_next")))
        pairs = met.select("pool_id", F.col("a_next").alias("a"), F.col("b_next").alias("b"))
    last = ids.select("pool_id", "combo", "rest", F.col(f"p{levels}").alias("a"))
    named = pairs.join(last, ["pool_id", "a"]).join(last.select("pool_id", F.col("a").alias("b"), F.col("combo").alias("combo_b"), F.col("rest").alias("rest_b")), ["pool_id", "b"])
    return named.where(F.forall(F.zip_with("rest", "rest_b", lambda x, y: F.abs(x - y)), lambda d: d <= 1)).select("pool_id", "combo", "combo_b")


def _close(rows: DataFrame, pairs: DataFrame, most: float) -> DataFrame:
    """Rows (pool_id, combo, combo_b, id, id_b) at a distance of at most ``most``, of ``rows`` (pool_id, combo, id, features) for pairs of cells; within a cell each pair once.

    Cells with many records are cut into blocks that different tasks pair.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sizes = rows.groupBy("pool_id", "combo").agg(F.count("*").alias("n")).select("pool_id", "combo", blocks.alias("blocks"))
    cut = pairs.join(sizes, ["pool_id", "combo"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = cut.join(rows.select("pool_id", F.col("id").alias("id_b"), F.col("features").alias("features_b"), F.col("combo").alias("combo_b")), ["pool_id", "combo_b"])
    sized = rows.join(sizes, ["pool_id", "combo"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    both = sized.join(other, ["pool_id", "combo", "block"]).where((F.col("combo") != F.col("combo_b")) | (F.col("id") < F.col("id_b")))
    return both.where(_distance("features", "features_b") <= most).select("pool_id", "combo", "combo_b", "id", "id_b")


def near_pairs(features: DataFrame, most: float = 1.0) -> DataFrame:
    """Rows (pool_id, conformer_id_a, conformer_id_b): pairs of one pool at a distance of at most ``most``, a before b.

    Cells have the width ``most`` (and a bit, for rounding), so a pair's cells differ by at most 1
    in each feature.
    """
    width = most * (1 + 1e-5)
    cells = features.withColumn("cell", F.transform("features", lambda x: F.floor(x / width).cast("int"))).withColumn("combo", F.xxhash64("pool_id", "cell"))
    combos = materialize(cells.select("pool_id", "combo", "cell").distinct(), "combos")
    rows = cells.select("pool_id", "combo", F.col("conformer_id").alias("id"), "features")
    close = _close(rows, touching(combos), most)
    return close.select("pool_id", F.least("id", "id_b").alias("conformer_id_a"), F.greatest("id", "id_b").alias("conformer_id_b"))


def _links(vertex: str, other: str) -> list[Column]:
    return [F.struct("pool_id", F.col(vertex).alias("id")).alias("u"), F.struct("pool_id", F.col(other).alias("id")).alias("v")]


def shape_kinds(features: DataFrame, most: float = 1.0) -> DataFrame:
    """Rows (pool_id, conformer_id, shape): the smallest conformer of its kind names a shape.

    Records of a cell whose diagonal is ``most`` are all near each other, so the cell's smallest
    record stands for them. Cells are linked where their smallest records are near. Only cells of
    different kinds that have records near enough for a link then compare their records. So a shape
    of any number of conformers costs as much as the cells it fills, and no pairs are listed.
    """
    dims = F.size("features")
    width = F.lit(most * (1 - 1e-9)) / F.sqrt(dims)
    fine = features.withColumn("fine", F.transform("features", lambda x: F.floor(x / width).cast("long")))
    cells = fine.groupBy("pool_id", "fine").agg(F.min("conformer_id").alias("id"), F.min_by("features", "conformer_id").alias("features"), F.count("*").alias("n"))
    # Whole fine cells lie in one coarse cell, which is wider than ``most``.
    coarse = F.transform("fine", lambda x: F.floor(x / (F.floor(F.sqrt(dims)) + 1)).cast("int"))
    cells = materialize(cells.withColumn("cell", coarse).withColumn("combo", F.xxhash64("pool_id", "cell")), "cells")
    combos = materialize(cells.select("pool_id", "combo", "cell").distinct(), "combos")
    met = materialize(touching(combos), "touching")
    near = _close(cells.select("pool_id", "combo", "id", "features"), met, most)
    first = materialize(contract(near.select(*_links("id", "id_b"))), "linked")
    kind = F.coalesce("root.id", "id")
    named = cells.join(first, F.struct("pool_id", "id") == F.col("vertex"), "left").select("pool_id", "fine", "id", "combo", "n", kind.alias("kind"))
    named = materialize(named, "kinds")
    # Cells of different kinds whose boxes come within ``most`` of each other: their records decide.
    side = lambda t: named.select("pool_id", F.col("combo").alias("combo" + t), F.col("id").alias("id" + t), F.col("kind").alias("kind" + t), F.col("fine").alias("fine" + t), F.col("n").alias("n" + t))
    gap = F.aggregate(F.zip_with("fine", "fine_b", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0))), F.lit(0).cast("long"), lambda s, d: s + d * d)
    open_pairs = met.join(side(""), ["pool_id", "combo"]).join(side("_b"), ["pool_id", "combo_b"]).where("kind <> kind_b AND n + n_b > 2").where(gap <= F.size("fine") * (1 + 1e-5))
    open_pairs = materialize(open_pairs.select("pool_id", F.col("id").alias("combo"), F.col("id_b").alias("combo_b")), "open")
    members = fine.join(cells.select("pool_id", "fine", F.col("id").alias("combo")), ["pool_id", "fine"])
    late = _close(members.select("pool_id", "combo", F.col("conformer_id").alias("id"), "features"), open_pairs, most)
    kinds = named.select("pool_id", "id", "kind")
    again = late.select("pool_id", "combo", "combo_b").distinct().join(kinds.select("pool_id", F.col("id").alias("combo"), F.col("kind").alias("u_kind")), ["pool_id", "combo"]).join(kinds.select("pool_id", F.col("id").alias("combo_b"), F.col("kind").alias("v_kind")), ["pool_id", "combo_b"])
    second = contract(again.select(*_links("u_kind", "v_kind")))
    final = named.join(second, F.struct("pool_id", F.col("kind").alias("id")) == F.col("vertex"), "left").select("pool_id", "fine", "id", F.coalesce("root.id", "kind").alias("kind"))
    names = final.groupBy("pool_id", "kind").agg(F.min("id").alias("shape"))
    return fine.join(final.select("pool_id", "fine", "kind"), ["pool_id", "fine"]).join(names, ["pool_id", "kind"]).select("pool_id", "conformer_id", "shape")


def flow_quotas(counts: dict[tuple[str, str], int], size: int) -> dict[tuple[str, str], int]:
    """How many records each (shape, type) gives, for ``size`` in all or as many as there are.

    Minimum-cost flow source - shapes - combinations - types - sink by shortest augmenting paths.
    The j-th unit through a shape or type costs the growth of (units - target)**2, scaled by the
    target, so overuse gets dearer with each unit; rarer use of ranks breaks ties: larger shapes,
    then names.
    """
    size = min(size, sum(counts.values()))
    total: dict[str, int] = {}
    kinds: dict[str, int] = {}
    held: dict[str, list[str]] = {}
    for (shape, kind), n in counts.items():
        total[shape] = total.get(shape, 0) + n
        kinds[kind] = kinds.get(kind, 0) + n
        held.setdefault(shape, []).append(kind)
    shapes, types = sorted(total, key=lambda s: (-total[s], s)), sorted(kinds)
    want_s, want_t = max(1.0, size / len(shapes)) if shapes else 1.0, size / max(1, len(types))
    step = lambda used, want: (2 * used + 1 - 2 * want) / want
    used: dict[tuple[str, str], int] = dict.fromkeys(counts, 0)
    by_s, by_t = dict.fromkeys(shapes, 0), dict.fromkeys(types, 0)
    rank = {s: i for i, s in enumerate(shapes)}
    cost = lambda s: 1000.0 * step(by_s[s], want_s) + 1e-3 * rank[s]
    # The cheapest shape with records left, by type; costs only grow, so old entries are renewed when met.
    heaps = {t: [] for t in types}
    for s in shapes:
        for t in held[s]:
            heaps[t].append((cost(s), rank[s]))
    for h in heaps.values():
        heapq.heapify(h)
    # Shapes that use one type and have records of another left: a unit of theirs may change over.
    change: dict[tuple[str, str], set[str]] = {(a, b): set() for a in types for b in types if a != b}

    def note(s: str) -> None:
        for a in held[s]:
            for b in held[s]:
                if a != b:
                    (change[a, b].add if used[s, a] > 0 and used[s, b] < counts[s, b] else change[a, b].discard)(s)

    def cheapest(t: str) -> tuple[float, str | None]:
        h = heaps[t]
        while h:
            s = shapes[h[0][1]]
            if used[s, t] >= counts[s, t]:
                heapq.heappop(h)
            elif h[0][0] != cost(s):
                heapq.heapreplace(h, (cost(s), rank[s]))
            else:
                return h[0][0], s
        return float("inf"), None

    for _ in range(size):
        first = {t: cheapest(t) for t in types}
        far, came = {t: first[t][0] for t in types}, dict.fromkeys(types)
        for _ in types:
            moved = False
            for (a, b), able in change.items():
                if able and far[a] < far[b] - 1e-9:
                    far[b], came[b], moved = far[a], a, True
            if not moved:
                break
        end = min(types, key=lambda t: (far[t] + 10.0 * step(by_t[t], want_t), t))
        by_t[end] += 1
        while came[end] is not None:
            s = min(change[came[end], end], key=rank.__getitem__)
            used[s, end] += 1
            used[s, came[end]] -= 1
            heapq.heappush(heaps[came[end]], (cost(s), rank[s]))
            note(s)
            end = came[end]
        s = first[end][1]
        used[s, end] += 1
        by_s[s] += 1
        note(s)
    return {k: n for k, n in used.items() if n}


def select_varied(conformers: DataFrame, requests: list[tuple[str, int]]) -> DataFrame:
    """Rows (request_id, pool_id, conformer_id, shape, source_type, rank): for each request and pool the chosen conformers.

    A pool with fewer usable conformers than asked gives all of them. Conformers without features
    aren't chosen; a null source type is a type of its own. Within a combination, eligible ones come
    first, then the finer resolution (nulls last), then the id. Of shapes with the same source types
    only the largest are needed for a flow of the greatest size, so a task gets a bounded number of
    combinations of a pool, whatever the pool's size.
    """
    most = max([n for _, n in requests], default=0)
    features = standardized(conformers)
    kinds = materialize(shape_kinds(features), "kinds")
    facts = conformers.groupBy("pool_id", "conformer_id").agg(F.min(F.struct((F.coalesce(F.lower("status"), F.lit("")) != "eligible").alias("later"), F.coalesce("resolution_angstrom", F.lit(float("inf"))).alias("resolution"), F.coalesce("source_type", F.lit("")).alias("source_type"))).alias("f"))
    rows = kinds.join(facts, ["pool_id", "conformer_id"]).select("pool_id", "conformer_id", "shape", "f.*")
    place = Window.partitionBy("pool_id", "shape", "source_type").orderBy("later", "resolution", "conformer_id")
    ranked = materialize(rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most), "ranked")
    combos = rows.groupBy("pool_id", "shape", "source_type").agg(F.count("*").alias("n"))
    patterns = combos.groupBy("pool_id", "shape").agg(F.array_sort(F.collect_set("source_type")).alias("pattern"), F.sum("n").alias("size"))
    needed = patterns.withColumn("i", F.row_number().over(Window.partitionBy("pool_id", "pattern").orderBy(F.desc("size"), "shape"))).where(F.col("i") <= most)
    small = combos.join(needed.select("pool_id", "shape"), ["pool_id", "shape"])
    lists = small.groupBy("pool_id").agg(F.collect_list(F.struct("shape", "source_type", "n")).alias("combos"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                counts = {(c["shape"], c["source_type"]): int(c["n"]) for c in sorted(r.combos, key=lambda c: (c["shape"], c["source_type"]))}
                for request, size in requests:
                    out += [(request, r.pool_id, s, t, n) for (s, t), n in flow_quotas(counts, size).items()]
            yield pd.DataFrame(out, columns=["request_id", "pool_id", "shape", "source_type", "quota"])

    quotas = lists.mapInPandas(run, "request_id string, pool_id string, shape string, source_type string, quota int")
    chosen = ranked.join(quotas, ["pool_id", "shape", "source_type"]).where(F.col("place") <= F.col("quota"))
    return chosen.select("request_id", "pool_id", "conformer_id", "shape", F.nullif("source_type", F.lit("")).alias("source_type"), F.col("place").alias("rank"))
