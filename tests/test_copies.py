"""Polygons that many rows share are tested once, and every row still has its result."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_geometry import box

from cubeframe.functions import geometry as G
from cubeframe.operators import spatial
from cubeframe.plans.queries import QUERIES

KIND = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


@pytest.fixture
def tested(spark, monkeypatch):
    """Counts the pairs of polygons that are tested."""
    n, meets = spark.sparkContext.accumulator(0), G.meets

    def counted(a, b):
        tally = F.pandas_udf(lambda x: (n.add(len(x)), x)[1], "boolean")
        return tally(meets(a, b))

    monkeypatch.setattr(G, "meets", counted)
    return n


@pytest.fixture
def copies(spark, tmp_path):
    """40 parts of one place, every second one smaller; 30 suppliers of one place, which touch only the larger parts."""
    part = [(1 + i * 6120, 3 if i % 2 else 0) for i in range(40)]  # at (37, 53), half widths 4 and 1
    spark.createDataFrame(part, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    key, far = next((k, far) for k in range(1, 6121) if 7 <= (far := abs(k * 91 % 360 - 37) + abs(k * 29 % 170 - 53)) <= 11)
    spark.createDataFrame([(key + i * 6120, far - 7) for i in range(30)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path), [k for k, size in part if size], key


def test_cell_coverage_of_copies(spark, tested, copies):
    folder, large, _ = copies
    rows = QUERIES["cell_coverage"](spark, folder).collect()
    assert sorted(map(tuple, rows)) == [(k, 30) for k in large] and tested.value <= 2


def test_coverage_of_repeated_and_null_rows(spark):
    left = spark.createDataFrame([(1, box(0, 0, 1, 1)), (1, box(5, 5, 6, 6)), (None, box(0, 0, 1, 1)), (2, None), (3, box(9, 9, 9.5, 9.5))], f"id int, rings {G.RINGS}")
    right = spark.createDataFrame([("a", box(1, 1, 5, 5)), ("a", box(1, 1, 5, 5)), (None, box(0, -0.0, 2, 2)), ("b", None)], f"id string, rings {G.RINGS}")
    assert {(r["id"], r["n"]) for r in spatial.coverage(left, right, 2.0).collect()} == {(1, 5), (None, 3)}


def test_many_at_once_as_one_by_one():
    r = random.Random(3)
    ring = lambda: [{"x": float(r.randint(0, 6)), "y": r.choice([r.uniform(0, 6), float(r.randint(0, 6))])} for _ in range(r.choice([3, 4, 5]))]
    some = [[ring() for _ in range(r.choice([1, 1, 2]))] for _ in range(300)]
    a, b = pa.array([[], None, *some], KIND).slice(1), pa.array([[], box(0, 0, 1, 1), *some[::-1]], KIND).slice(1)
    met = G._by_pair(a, b, G._meet_many, bool, lambda n, m: 4 * n * m).to_pylist()
    shared = G._by_pair(a, b, G._common_many, float, lambda n, m: (n + m) ** 3).to_pylist()
    assert not met[0] and shared[0] == 0 and met[1:] == [G.meet(p, q) for p, q in zip(some, some[::-1], strict=True)]
    assert shared[1:] == pytest.approx([G.common_area([p], [q])[2] for p, q in zip(some, some[::-1], strict=True)])
    windows = [r.choice([box(1, 1, 4, 4), [box(1, 1, 4, 4)[0][::-1]], [box(0, 0, 5, 5)[0][:3]]]) for _ in some]
    assert G._clip(pa.array(some, KIND), pa.array(windows, KIND)).to_pylist() == [[c for c in (G.clipped(x, w[0]) for x in p) if c] for p, w in zip(some, windows, strict=True)]


def test_uncovered_cells_of_copies(spark, tested, copies):
    folder, large, _ = copies
    assert [r["id"] for r in QUERIES["uncovered_cells"](spark, folder).collect()] == large[:1] and tested.value <= 4


def test_uncovered_judges_rows(spark):
    hole = [*box(0, 0, 4, 4), *box(1, 1, 3, 3)]
    rows = [("1", box(0, 0, 4, 4)), ("2", box(0, 0, 1, 1)), ("2", box(7, 7, 8, 8)), ("3", hole), ("1", box(1, 1, 2, 2)), (None, box(0, 0, 1, 1)), ("4", None)]
    cells = spark.createDataFrame(rows, f"id string, rings {G.RINGS}").withColumn("more", F.lit(1))
    kept = spatial.uncovered(cells, 2.0)
    assert kept.columns == ["id", "rings", "more"]
    assert {(r["id"], r["rings"][0][0]["x"] if r["rings"] else None) for r in kept.collect()} == {("1", 0), ("2", 7), ("1", 1), (None, 0), ("4", None)}


def test_field_overlay_of_copies(spark, tested, copies):
    folder, large, key = copies
    rows = QUERIES["field_overlay"](spark, folder).collect()
    assert rows == [] and tested.value <= 2  # they only touch
    tiles = spark.createDataFrame([(i, box(0, 0, 2, 2)) for i in range(20)], f"id int, rings {G.RINGS}")
    made = spatial.overlay(tiles, tiles.withColumn("rings", F.array(F.transform(F.col("rings")[0], lambda p: F.struct((p["x"] + 1).alias("x"), p["y"].alias("y"))))), 2.0, area=G.ring_area(F.col("rings")[0]))
    assert {(r["a_id"], r["b_id"], r["area"]) for r in made.collect()} == {(i, j, 2.0) for i in range(20) for j in range(20)} and tested.value <= 3


def test_polygon_join_of_copies(spark, tested, copies):
    folder, large, key = copies
    rows = QUERIES["polygon_join"](spark, folder).collect()
    assert sorted(map(tuple, rows)) == sorted((k, key + i * 6120) for k in large for i in range(30)) and tested.value <= 2
