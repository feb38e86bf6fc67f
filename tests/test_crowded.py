"""Slabs in which most boxes overlap are tested in blocks; the pairs are those of brute force, whichever way a slab takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.operators import crowded, screening

CFG = screening.Screening(radius_km=0.05, cell_km=0.1, max_cells_per_object=8)
PATH = [f"{n}{a}" for n in ("p0", "p1") for a in "xyz"]


def made(n, spread, slab, seed, long=True):
    random = np.random.default_rng(seed)
    p = random.normal(0, spread, (n, 6))
    if not long:
        p[:, 3:] = p[:, :3] + random.normal(0, 0.05, (n, 3))
    return [(slab, f"o{i}", 10.0, *map(float, x)) for i, x in enumerate(p)], p


@pytest.fixture(scope="module")
def two(spark):
    """A crowded slab, a sparse one of as many objects, and an object without a place."""
    (dense, p), (thin, q) = made(800, 0.12, 1, 5), made(800, 0.5, 2, 6, False)
    schema = "slab long, id string, seconds double, " + ", ".join(f"{c} double" for c in PATH)
    return spark.createDataFrame([*dense, *thin, (1, "none", 10.0, *[None] * 6)], schema), p, q


def brute(p):
    """(boxes overlap, distance) of all pairs, and the pairs as ids."""
    i, j = np.triu_indices(len(p), 1)
    lo, hi = np.minimum(p[:, :3], p[:, 3:]) - 0.025000001, np.maximum(p[:, :3], p[:, 3:]) + 0.025000001
    over = ((lo[i] <= hi[j]) & (lo[j] <= hi[i])).all(1)
    r = p[j, :3] - p[i, :3]
    d = p[j, 3:] - p[i, 3:] - r
    at = np.clip(-(r * d).sum(1) / (d * d).sum(1), 0, 1)
    ids = [tuple(sorted((f"o{x}", f"o{y}"))) for x, y in zip(i, j, strict=True)]
    return over, np.sqrt(((r + d * at[:, None]) ** 2).sum(1)), ids


@pytest.mark.parametrize("block", [crowded.BLOCK, 150])
def test_both_ways(two, block, monkeypatch):
    monkeypatch.setattr(crowded, "BLOCK", block)
    monkeypatch.setattr(crowded, "ROWS", 1000)
    states, *tables = two
    assert [(r.slab, r.blocks) for r in screening.crowds(states, CFG).collect()] == [(1, -(-801 // block))]
    met = [(r.slab, r.a, r.b) for r in screening.box_pairs(states, CFG, paths=False).select("slab", F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect()]
    near = {(r.slab, r.a, r.b): r.distance_km for r in screening.candidates(states, CFG).collect()}
    assert len(met) == len(set(met))
    for slab, p in enumerate(tables, 1):
        over, distance, ids = brute(p)
        assert {x[1:] for x in met if x[0] == slab} == {ids[k] for k in np.flatnonzero(over)}
        want = {ids[k]: distance[k] for k in np.flatnonzero(distance <= 0.05 + 1e-9)}
        assert {k[1:] for k in near if k[0] == slab} == set(want)
        assert all(abs(near[(slab, *k)] - v) < 1e-12 for k, v in want.items())
    assert len(near) > 10_000


def test_paths_are_those_of_the_ids(two):
    states, p, _ = two
    for r in screening.near_pairs(states.where("slab = 1"), CFG, paths=True).limit(200).collect():
        for side in (r.a, r.b):
            assert [side[c] for c in PATH] == p[int(side.id[1:])].tolist()


def test_slabs_with_no_finite_place_keep_to_cells(two):
    states, *_ = two
    assert not screening.crowds(states.withColumn("p0x", F.when(F.col("id") == "o3", float("nan")).otherwise(F.col("p0x"))), CFG).count()


@pytest.mark.parametrize("block", [crowded.BLOCK, 150])
def test_tiles_of_a_part_of_a_block(two, block, monkeypatch):
    for name, value in (("BLOCK", block), ("TILE", 1000), ("WIDE", 90)):
        monkeypatch.setattr(crowded, name, value, raising=False)
    states, *tables = two
    near = [(r.slab, r.a.id, r.b.id) for r in screening.near_pairs(states, CFG).collect()]
    assert len(near) == len(set(near))
    for slab, p in enumerate(tables, 1):
        _, distance, ids = brute(p)
        assert {x[1:] for x in near if x[0] == slab} == {ids[k] for k in np.flatnonzero(distance <= 0.05 + 1e-9)}


def test_pairs_of_blocks_are_refined_in_their_tasks(two):
    """Candidates grow with the square of a slab: none goes through a shuffle on its way to the refinement."""
    from perigee.plans import queries

    states, p, _ = two
    dense = states.where("slab = 1")
    found = queries._refined(screening.near_pairs(dense, CFG, paths=True), 0.04)
    plan = found._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert len(plan) == 3 and "Exchange" not in plan[1] and "Exchange" in plan[2]
    _, distance, ids = brute(p)
    got = {tuple(sorted((r.a, r.b))): r.miss_km for r in found.where("tca_ms is not null").collect()}
    want = {ids[k]: distance[k] for k in range(len(ids)) if distance[k] <= 0.04}
    assert set(want) ^ set(got) <= {ids[k] for k in range(len(ids)) if abs(distance[k] - 0.04) < 1e-6}
    assert len(got) > 10_000 and all(abs(got[k] - want[k]) < 1e-4 for k in set(want) & set(got))


def test_even_pairs_are_the_same(two):
    states, *_ = two
    rows = lambda even: sorted((r.slab, r.a.id, r.b.id, r.distance_km) for r in screening.near_pairs(states, CFG, even=even).collect())
    assert rows(True) == rows(False)


def test_copies_of_a_row_do_not_follow_the_slab(spark):
    """A row goes to as many pairs of blocks as there are blocks: with twice the objects there are not twice as many."""
    blocks = []
    for n in (90_000, 180_000):
        path = [(F.col("id") % 1000 * (i + 1) / 100_000).alias(c) for i, c in enumerate(PATH)]
        states = spark.range(n).select(F.lit(1).cast("long").alias("slab"), "id", F.lit(10.0).alias("seconds"), *path)
        blocks += [r.blocks for r in screening.crowds(states, CFG).collect()]
    assert len(blocks) == 2 and blocks[1] <= max(blocks[0], 4)
