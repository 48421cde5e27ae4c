"""Readers, writers and streaming forms on files of their own."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmere.functions import parsing
from gridmere.sources import storage
from gridmere.streaming import events


def test_csv_with_converters_and_names(spark, tmp_path):
    (tmp_path / "ls7_2019_objects.csv").write_text("id,area,border_vals\n1,2.5,[0 3 4]\n2,NaN,[]\n")
    (tmp_path / "ls8_2020_objects.csv").write_text("id,area,border_vals\n3,1.0,[7]\n")
    df = storage.csv(spark, str(tmp_path / "*.csv"), "id long, area double, border_vals string", border_vals=parsing.number_array)
    assert sorted((r["id"], r["area"], r["border_vals"]) for r in df.collect()) == [(1, 2.5, [3, 4]), (2, None, []), (3, 1.0, [7])]
    named = storage.named_files(spark.read.schema("id long, area double, border_vals string").csv(str(tmp_path), header=True))
    assert sorted((r["id"], r["satellite"], r["year"]) for r in named.collect()) == [(1, "ls7", 2019), (2, "ls7", 2019), (3, "ls8", 2020)]


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("5,x\n6,y\n")
    assert sorted(map(tuple, storage.csv(spark, str(tmp_path / "a.csv"), "n int, s string", header=False).collect())) == [(5, "x"), (6, "y")]
    (tmp_path / "b.csv").write_text(",2010,,2020,\nkey,a,b,a,b\nm1,1,2,3,-\nm2,5,6,7,8\n")
    two = storage.csv_two_headers(spark, str(tmp_path / "b.csv"), {"2010_a": "double", "2010_b": "double", "2020_a": "double", "2020_b": "double"})
    assert two.columns == ["key", "2010_a", "2010_b", "2020_a", "2020_b"]
    assert sorted(map(tuple, two.collect())) == [("m1", 1.0, 2.0, 3.0, None), ("m2", 5.0, 6.0, 7.0, 8.0)]


def test_json_and_geojson(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in ({"ID": "a", "Skipped": False, "Label": {"objects": [{"instanceURI": "u1"}, {"instanceURI": "u2"}]}}, {"ID": "b", "Skipped": True, "Label": {"objects": [{"instanceURI": "u3"}]}})))
    assert sorted(map(tuple, storage.json_labels(spark, str(tmp_path / "l.json")).collect())) == [("a", "u1"), ("a", "u2")]
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    features = [{"type": "Feature", "properties": {"name": n}, "geometry": {"type": t, "coordinates": c}} for n, t, c in (("p", "Polygon", [square]), ("m", "MultiPolygon", [[square], [square]]))]
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = storage.geojson(spark, str(tmp_path / "g.geojson"), "name: string").collect()
    assert sorted((r["name"], r["part"], len(r["rings"][0])) for r in got) == [("m", 0, 5), ("m", 1, 5), ("p", 0, 5)]


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "x.npy", np.arange(6).reshape(2, 3))
    row = storage.arrays(spark, str(tmp_path / "x.npy")).first()
    assert row["shape"] == [2, 3] and row["values"] == [0, 1, 2, 3, 4, 5]


def test_steps_that_are_done_are_not_done_again(spark, tmp_path):
    one, two = spark.range(3), spark.range(5)
    assert storage.write_once(one, str(tmp_path / "t")).count() == 3
    assert storage.write_once(two, str(tmp_path / "t")).count() == 3
    (tmp_path / "died" / "_temporary" / "0").mkdir(parents=True)  # what a job that was killed leaves
    (tmp_path / "died" / "part-00000.parquet").write_bytes(b"half")
    assert storage.write_once(one, str(tmp_path / "died")).count() == 3
    storage.append_csv(one, str(tmp_path / "c"))
    storage.append_csv(two, str(tmp_path / "c"))
    assert storage.csv(spark, str(tmp_path / "c"), "id long").count() == 8
    assert sorted(r["id"] for r in storage.pending(two, one, ["id"]).collect()) == [3, 4]


def test_windows_read_only_their_tiles(spark, tmp_path):
    cells = spark.range(400).select(F.floor(F.col("id") / 20).alias("row"), (F.col("id") % 20).alias("col"), F.col("id").alias("value")).select("*", F.floor(F.col("row") / 5).cast("int").alias("tile_row"), F.floor(F.col("col") / 5).cast("int").alias("tile_col"))
    storage.write_tiles(cells, str(tmp_path / "r"))
    window = storage.read_window(spark, str(tmp_path / "r"), 3, 8, 4, 3, 5)
    assert sorted((r["row"], r["col"]) for r in window.collect()) == [(r, c) for r in range(3, 7) for c in range(8, 11)]
    assert len(window.inputFiles()) <= 4 or "PartitionFilters" in window._jdf.queryExecution().executedPlan().toString()
    boxes = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0), (2, 5.0, 6.0, 5.0, 6.0)], "id long, x_min double, x_max double, y_min double, y_max double")
    assert [r["id"] for r in storage.in_box(boxes, 0.5, 0.5, 2.0, 2.0).collect()] == [1]
    assert storage.draw(spark.range(1000), 100, 3).count() > 50


def test_streams(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = lambda: spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, df, batch in (
        ("w", events.tumbling(source(), "ts", "1 day", "1 hour", "event_type"), table.groupBy(F.window("ts", "1 day"), "event_type").count()),
        ("s", events.sessions(source(), "ts", "30 minutes", "1 hour", "user_id"), table.groupBy("user_id", F.session_window("ts", "30 minutes")).count()),
    ):
        q = df.writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        got = spark.sql(f"SELECT sum(n), count(*) FROM {name}").first()
        if name == "w":
            assert tuple(got) == (table.count(), batch.count())
        else:
            assert got[1] <= batch.count()
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):  # a second start finds nothing to do
        events.resumable(source(), lambda b: b.groupBy("event_type").count(), out, mark).awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("count")).first()[0] == table.count()


def test_geojson_lines_round_trip(spark, tmp_path):
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 1.5), (0.0, 0.0))]
    shapes = spark.createDataFrame([(1, "a", ring), (2, None, ring[::-1])], "id int, name string, ring array<struct<x: double, y: double>>")
    storage.write_geojson(shapes, str(tmp_path / "shapes"))
    got = storage.geojson(spark, str(tmp_path / "shapes"), "id: int, name: string", lines=True).orderBy("id").collect()
    assert [(r["id"], r["name"], r["part"]) for r in got] == [(1, "a", 0), (2, None, 0)]
    assert [[(p["x"], p["y"]) for p in r["rings"][0]] for r in got] == [[(p["x"], p["y"]) for p in r] for r in (ring, ring[::-1])]


def test_files_are_listed_in_order(spark, tmp_path):
    for name in ("b.bin", "a.bin", "c.txt"):
        (tmp_path / name).write_bytes(name.encode() * 3)
    got = storage.listed(spark, str(tmp_path / "*.bin")).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["length"]) for r in got] == [("a.bin", 15), ("b.bin", 15)]
