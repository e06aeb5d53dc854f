"""Positions of a hypergraph's nodes for drawing: rings around each hyperedge, then rounds in which near ones push each other apart.

A ring's capacity grows with its radius, so a key's ring and place on it follow from its number by running sums that are the same
for all groups. Pushing looks for neighbours in a grid whose cells are as wide as the least distance: a node meets those of
its own and the eight cells around, never all others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .running import running_sums


def ring_plan(n: int, inner: float, spacing: float) -> list[tuple[int, float, int, int]]:
    """(ring, radius, first number, capacity) of the rings that n keys take; a ring holds as many as its girth has room for, three at least."""
    out, first, r = [], 0, inner
    while first < n:
        room = max(3, int(2 * math.pi * r / max(spacing, 1e-6)))
        out.append((len(out), r, first, room))
        first, r = first + room, r + spacing
    return out


def on_rings(members: DataFrame, centres: DataFrame, inner: float = 0.6, spacing: float = 0.3) -> DataFrame:
    """hub, key, x, y: the members of each hub in the order of their keys on rings around its centre.

    members: hub, key; centres: hub, x, y, and turn, the angle of the first place, where it isn't 0. On each ring places are evenly apart; those of every other ring are turned by half a
    place. Rings of the largest hub are a few hundred rows at most (their number grows with the root of its members).
    """
    placed = members.withColumn("_n", F.row_number().over(Window.partitionBy("hub").orderBy("key")) - 1).withColumn("_all", F.count("*").over(Window.partitionBy("hub")))
    rings = ring_plan(members.groupBy("hub").count().agg(F.max("count")).first()[0] or 0, inner, spacing)
    ring = F.size(F.filter(F.array(*[F.lit(first) for _, _, first, _ in rings] or [F.lit(0)]), lambda f: f <= F.col("_n"))) - 1
    of = lambda at: F.get(F.array(*[F.lit(r[at]) for r in rings] or [F.lit(0)]), F.col("ring"))
    joined = placed.withColumn("ring", ring).withColumns({"radius": of(1), "first": of(2), "room": of(3)})
    here = F.least("room", F.col("_all") - F.col("first"))
    angle = F.when(F.col("ring") % 2 == 1, F.lit(math.pi) / here).otherwise(0.0) + F.lit(2 * math.pi) * (F.col("_n") - F.col("first")) / here
    around = joined.select("hub", "key", F.col("radius").alias("_r"), angle.alias("_a")).join(centres.select("hub", F.col("x").alias("_x"), F.col("y").alias("_y"), (F.col("turn") if "turn" in centres.columns else F.lit(0.0)).alias("_turn")), "hub")
    a = F.col("_a") + F.col("_turn")
    return around.select("hub", "key", (F.col("_x") + F.col("_r") * F.cos(a)).alias("x"), (F.col("_y") + F.col("_r") * F.sin(a)).alias("y"))


def _cell(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width).cast("long")


def _near(at: DataFrame, other: DataFrame, width: float) -> DataFrame:
    """Pairs of a row of `at` and one of `other` (key, x, y) that may be nearer than width."""
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    around = at.withColumn("_s", F.explode(shifts)).withColumns({"_cx": _cell("x", width) + F.col("_s.i"), "_cy": _cell("y", width) + F.col("_s.j")}).drop("_s")
    there = other.select(F.col("key").alias("_key"), F.col("x").alias("_ox"), F.col("y").alias("_oy"), _cell("x", width).alias("_cx"), _cell("y", width).alias("_cy"))
    return around.join(there, ["_cx", "_cy"])


def separated(positions: DataFrame, fixed: DataFrame | None = None, least: float = 0.25, rounds: int = 80, step: float = 0.12) -> DataFrame:
    """key, x, y: rows moved until no two are nearer than `least`, or the rounds are over; keys are distinct.

    In a round every pair that is too near pushes apart by half of what lacks each, a fixed position by all of it (five
    hundredths more), no row moves farther than `step`, and all move at once. Rows in one place go by their keys' hashes. The
    rounds end once none moves a thousandth. Each round is written; a crowd in one cell thins out by its pushes.
    """
    now = written(positions.select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "positions")
    still = fixed.select("key", "x", "y") if fixed is not None else None
    turn = lambda k: F.pmod(F.xxhash64(k), F.lit(7)) + 1
    for _ in range(rounds):
        pairs = _near(now, now, least).filter(F.col("key") != F.col("_key"))
        sign = F.when(F.col("key") < F.col("_key"), 1.0).otherwise(-1.0)
        low, high = F.least("key", "_key"), F.greatest("key", "_key")
        pushes = _push(pairs, least, F.lit(0.5), sign * 0.01 * turn(low), sign * 0.01 * turn(high))
        if still is not None:
            pushes = pushes.unionByName(_push(_near(now, still, least * 1.05), least * 1.05, F.lit(1.0), F.lit(0.02), F.lit(0.01)))
        total = pushes.groupBy("key").agg(F.sum("dx").alias("dx"), F.sum("dy").alias("dy"))
        length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
        total = total.withColumn("_m", length).withColumn("_f", F.when(F.col("_m") > step, F.lit(step) / F.col("_m")).otherwise(1.0))
        moved = now.join(total, "key", "left").withColumns({"_dx": F.coalesce(F.col("dx") * F.col("_f"), F.lit(0.0)), "_dy": F.coalesce(F.col("dy") * F.col("_f"), F.lit(0.0)), "_m": F.least(F.coalesce("_m", F.lit(0.0)), F.lit(step))})
        moved = written(moved.select("key", (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"), "_m"), "positions")
        now = moved.drop("_m")
        if (moved.agg(F.max("_m")).first()[0] or 0.0) < 1e-3:
            break
    return now


def _push(pairs: DataFrame, least: float, share: Column, same_x: Column, same_y: Column) -> DataFrame:
    dx, dy = F.col("x") - F.col("_ox"), F.col("y") - F.col("_oy")
    rows = pairs.withColumns({"_dx": dx, "_dy": dy}).withColumn("_same", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) < 1e-9)
    rows = rows.withColumns({"_dx": F.when(F.col("_same"), same_x).otherwise(F.col("_dx")), "_dy": F.when(F.col("_same"), same_y).otherwise(F.col("_dy"))})
    rows = rows.withColumn("_d", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))).filter(F.col("_d") < least)
    push = share * (F.lit(least) - F.col("_d")) / F.col("_d")
    return rows.select("key", (F.col("_dx") * push).alias("dx"), (F.col("_dy") * push).alias("dy"))


#: Sizes of the drawing: a hyperedge's radius, half a chunk's side, the room between entities.
HYPEREDGE, CHUNK, SPACING = 0.55, 0.28, 0.42


def _bubbles(hubs: DataFrame, chunks: DataFrame, alone: DataFrame) -> DataFrame:
    """hub, bubble: how far what belongs to each hyperedge reaches: its chunks, and the rings of the entities of its own or of its chunks, whichever are more."""
    bodies = chunks.groupBy("hub").agg(F.count("*").alias("_bodies"))
    on_hub = alone.filter("kind = 'he'").groupBy(F.col("anchor").alias("hub")).agg(F.count("*").alias("_own"))
    on_body = alone.filter("kind = 'ch'").join(chunks.select(F.col("chunk").alias("anchor"), "hub"), "anchor").groupBy("hub").agg(F.count("*").alias("_theirs"))
    rows = hubs.select("hub")
    for part in (bodies, on_hub, on_body):
        rows = rows.join(part, "hub", "left")
    rows = written(rows.na.fill(0, ["_bodies", "_own", "_theirs"]).withColumn("_most", F.greatest("_own", "_theirs", F.lit(1))), "bubbles")
    rings = ring_plan(rows.agg(F.max("_most")).first()[0] or 1, CHUNK + SPACING, SPACING)
    ring = F.size(F.filter(F.array(*[F.lit(first) for _, _, first, _ in rings]), lambda f: f < F.col("_most"))) - 1
    reach = F.when(F.col("_own") + F.col("_theirs") > 0, F.get(F.array(*[F.lit(r) for _, r, _, _ in rings]), ring)).otherwise(0.0)
    base = F.when(F.col("_bodies") > 0, HYPEREDGE + 1.0 + 0.15 * F.greatest(F.lit(0), F.col("_bodies") - 4)).otherwise(HYPEREDGE + 0.55)
    return rows.select("hub", (base + reach + 0.35).alias("bubble"))


def _hubs_on_circle(bubbles: DataFrame) -> DataFrame:
    """hub, number, bubble, x, y: hyperedges in the order of their ids around a circle, each with an arc as wide as its bubble; the first at the bottom.

    The circle is so large that neighbours of the largest bubble fit side by side. Running sums give the arcs.
    """
    whole = bubbles.agg(F.count("*").alias("n"), F.max("bubble").alias("most"), F.sum(F.greatest("bubble", F.lit(0.5))).alias("total")).first()
    if whole.n <= 1:
        return bubbles.select("hub", F.lit(0).cast("long").alias("number"), "bubble", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    radius = (2 * whole.most + SPACING * 1.5) / (2 * math.sin(math.pi / whole.n))
    rows = running_sums(bubbles.withColumn("_w", F.greatest("bubble", F.lit(0.5))), ["hub"], "_w", "_before")
    rows = running_sums(rows, ["hub"], None, "number")
    turn = F.lit(2 * math.pi / whole.total) * (F.col("_before") + F.col("_w") / 2)
    first = rows.filter("number = 0").select((F.lit(2 * math.pi / whole.total) * F.col("_w") / 2).alias("_first"))
    angle = turn - math.pi / 2 - F.col("_first")
    return rows.crossJoin(F.broadcast(first)).select("hub", "number", "bubble", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


def hypergraph_positions(hyperedges: DataFrame, chunks: DataFrame, memberships: DataFrame, rounds: int = 120) -> DataFrame:
    """kind (he, ch or ent), key (text), x, y of everything that is drawn of a hypergraph.

    hyperedges: hub; chunks: chunk, hub (bodies; a hyperedge is its own head); memberships: name, kind (he or ch), anchor: what an
    entity is tied to. Hyperedges stand around a circle, chunks on rings around them, an entity with one anchor on rings around
    that, all turned outward. One with several stands on a spiral around the middle of its anchors, and is then pushed off all
    others. Bubbles of very different sizes may touch: they have arcs by their sizes, but aren't pushed apart.
    """
    ties = memberships.distinct()
    of = ties.groupBy("name").agg(F.count("*").alias("_n"), F.first("kind").alias("kind"), F.first("anchor").alias("anchor"))
    alone = written(of.filter("_n = 1").select("name", "kind", "anchor"), "alone")
    hubs = written(_hubs_on_circle(_bubbles(hyperedges.select("hub").distinct(), chunks, alone)), "hubs")
    outward = lambda x, y, still: F.when((x != 0) | (y != 0), F.atan2(y, x)).otherwise(F.lit(still))
    turned = hubs.withColumn("turn", outward(F.col("x"), F.col("y"), -math.pi / 2) + 0.05 * F.col("number"))
    bodies = on_rings(chunks.select("hub", F.col("chunk").alias("key")), turned, HYPEREDGE + CHUNK + 0.75, max(SPACING * 1.5, CHUNK * 2.8))
    bodies = written(bodies.select("hub", F.col("key").alias("chunk"), "x", "y"), "bodies")
    near_hub = hubs.select("hub", "x", "y", outward(F.col("x"), F.col("y"), 0.0).alias("turn"))
    near_body = bodies.join(hubs.select("hub", F.col("x").alias("_hx"), F.col("y").alias("_hy")), "hub").select(F.col("chunk").alias("hub"), "x", "y", F.atan2(F.col("y") - F.col("_hy"), F.col("x") - F.col("_hx")).alias("turn"))
    own = lambda kind: alone.filter(F.col("kind") == kind).select(F.col("anchor").alias("hub"), F.col("name").alias("key"))
    single = on_rings(own("he"), near_hub, HYPEREDGE + SPACING * 0.7, SPACING).unionByName(on_rings(own("ch"), near_body, CHUNK + SPACING * 0.85, SPACING))
    anchors = hubs.select(F.lit("he").alias("kind"), F.col("hub").alias("anchor"), "x", "y").unionByName(bodies.select(F.lit("ch").alias("kind"), F.col("chunk").alias("anchor"), "x", "y"))
    still = anchors.select("kind", F.col("anchor").cast("string").alias("key"), "x", "y").unionByName(single.select(F.lit("ent").alias("kind"), F.col("key").cast("string").alias("key"), "x", "y"))
    still = written(still, "still")
    between = ties.join(of.filter("_n > 1").select("name"), "name", "left_semi").join(anchors, ["kind", "anchor"])
    text = F.concat("kind", F.lit(":"), F.col("anchor").cast("string"))
    chunk_ties = F.count_if(F.col("kind") == "ch")
    middles = between.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set(text)), ",").alias("group"), F.avg("x").alias("_x"), F.avg("y").alias("_y"), chunk_ties.alias("_chunks"))
    groups = running_sums(middles.select("group").distinct(), ["group"], None, "_g")
    placed = middles.join(groups, "group").withColumn("_j", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("_chunks"), "name")) - 1)
    spiral = F.col("_j") * (math.pi * (3.0 - math.sqrt(5.0))) + F.col("_g") * 0.37
    away = SPACING * (0.55 + 0.45 * F.sqrt(F.col("_j") + 0.5))
    start = placed.select(F.col("name").cast("string").alias("key"), (F.col("_x") + away * F.cos(spiral)).alias("x"), (F.col("_y") + away * F.sin(spiral)).alias("y"))
    apart = separated(start, still.select("key", "x", "y"), least=SPACING * 0.95, rounds=rounds, step=SPACING * 0.35)
    return still.unionByName(apart.select(F.lit("ent").alias("kind"), "key", "x", "y"))
