"""Training rows, outputs, requests and stored files, on small fixtures."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cubeframe.operators import requests as R
from cubeframe.operators import training as L
from cubeframe.sources import files


def test_stack_guard(spark):
    rows = spark.createDataFrame([("a", 0, 0, "B04", 1, "10"), ("a", 0, 0, "B08", 2, "20")], "cube string, row int, col int, band string, dn int, grid string")
    with pytest.raises(Exception, match="different grids"):
        L.stacked(rows, ["cube"], ["B04", "B08"]).collect()
    assert [tuple(r) for r in L.stacked(rows, ["cube"], ["B04"]).collect()] == [("a", 0, 0, 1)]


def test_aggregates(spark):
    rows = spark.createDataFrame([(1, "x", [1.0, 5.0]), (1, "x", [3.0, 7.0]), (2, "y", [4.0, 4.0])], "id int, label string, features array<double>")
    most = lambda pdf: pd.DataFrame({"id": pdf["id"][:1], "label": pdf["label"][:1], "features": [np.stack(pdf["features"]).max(0).tolist()]})
    by = lambda how: sorted((r.id, r.label, list(r.features)) for r in L.aggregated(rows, "id", how).collect())
    assert len(by(None)) == 3
    assert by("median_per_id") == [(1, "x", [2.0, 6.0]), (2, "y", [4.0, 4.0])]
    assert by(most) == [(1, "x", [3.0, 7.0]), (2, "y", [4.0, 4.0])]
    with pytest.raises(ValueError):
        L.aggregated(rows, "id", "mean")


def test_crop_with_hole(spark):
    ring = lambda a, b: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((a, a), (b, a), (b, b), (a, b))])
    got = L.crop(spark.range(10).select(F.col("id")), F.array(ring(1, 8), ring(3, 5)), F.col("id") + F.lit(0.5), F.col("id") + F.lit(0.5))
    assert sorted(r.id for r in got.collect()) == [1, 2, 5, 6, 7]


def test_outputs(spark):
    rows = spark.createDataFrame([(1, "A", 0, 0, 0.0), (2, "A", 0, 0, 3.0), (3, "B", 0, 1, 4.0)], "seq int, crs string, x int, y int, v double")
    with pytest.raises(Exception, match="A, B"):
        L.merge_outputs(rows, "v", F.lit(0.0)).collect()
    assert [tuple(r) for r in L.merge_outputs(rows.where("crs = 'A'"), "v", F.lit(0.0)).collect()] == [("A", 0, 0, 3.0)]
    assert [tuple(r) for r in L.output_bands(rows.where("seq = 2"), ["x"], "v", "int").collect()] == [(0, 1, 3)]


def test_requests(spark):
    one = spark.range(1)
    read = lambda column: one.select(column.alias("d")).first().d
    assert read(R.declaration(F.lit('{"nodata": 7}'))).asDict() == {"offset": 0, "nodata": 7, "scale": 0.0001}
    for text, said in (('{"colour": 1}', "colour"), ('{"version": 2}', "newer"), ("[", "no declaration")):
        with pytest.raises(Exception, match=said):
            read(R.declaration(F.lit(text)))
    with pytest.raises(Exception, match="without a declaration"):
        read(R.resolved(F.lit(None).cast("string"), F.lit(None).cast("string"), False).getField("offset"))
    same = lambda **k: read(R.identity({n: F.lit(v).cast("string") for n, v in k.items()}))
    assert same(a="1", b="2") == same(b="2", a="1")
    assert len({same(a="1"), same(a=None), same(a=""), same(a="-"), same(b="1")}) == 5
    shapes = spark.createDataFrame([(1, 5)], "k int, seq int")
    with pytest.raises(Exception, match="no work units"):
        R.work_units(spark.createDataFrame([], "k int, id int, ts timestamp"), shapes, "k").collect()


def test_files(spark, tmp_path):
    cube = tmp_path / "one"
    cube.mkdir()
    a = np.arange(6, dtype="<u2").reshape(2, 3)
    np.save(cube / "a.npy", a)
    np.save(cube / "none.npy", a[:0])
    got = files.arrays(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.value for r in got] == a.ravel().tolist() and {tuple(r["shape"]) for r in got} == {(2, 3)}
    (cube / "reads.jsonl").write_text('{"file": "x.tif", "start": 1.0, "end": 2.5, "bytes": 9}\n{"file": "y.tif", "start": 2.0, "end": 3.0, "bytes": 1}\n')
    (cube / "timings.json").write_text(json.dumps({"total": 3.0, "phases": {"load": 1.0, "save": 2.0}}, indent=1))
    assert sorted((r.cube, r.file, r.bytes) for r in files.reads(spark, str(tmp_path)).collect()) == [("one", "x.tif", 9), ("one", "y.tif", 1)]
    assert sorted(map(tuple, files.timings(spark, str(tmp_path)).collect())) == [("one", "load", 1.0), ("one", "save", 2.0)]
    units = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "seq int, id string")
    files.write_manifest(units, str(tmp_path / "list"))
    assert sorted(map(tuple, files.manifest(spark, str(tmp_path / "list"), "seq int, id string").collect())) == [(1, "a"), (2, "b"), (3, "c")]
