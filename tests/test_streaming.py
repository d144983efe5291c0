"""Streams of points against the same files read as a whole."""

from plotwright.sources import files
from plotwright.streaming import points as P


def test_streamed_points_equal_whole_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("x,y\n1,2\n3,4\nbad,5\n")
    (folder / "b.csv").write_text("10,20\n,1\n")

    def run(name, frame, mode="append"):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert query.awaitTermination(120)
        return spark.table(name)

    stream = P.read_points(spark, str(folder))
    got = run("points", stream)
    whole = files.read_points(spark, str(folder))
    key = lambda rows: sorted((r.curve_id.split("/")[-1], r.x, r.y) for r in rows.collect())
    assert key(got) == key(whole) == [("a.csv", 1.0, 2.0), ("a.csv", 3.0, 4.0), ("b.csv", 10.0, 20.0)]
    mapped = run("mapped", P.to_data(stream, (0.0, 0.0, 5.0, 10.0), (0.0, 1.0, 0.0, 100.0))).orderBy("pixel_x").collect()
    assert [(r.x, r.y, r.outside) for r in mapped] == [(0.2, 80.0, False), (0.6, 60.0, False), (2.0, -100.0, True)]
    found = {r.curve_id.split("/")[-1]: r for r in run("summaries", P.summaries(stream), "complete").collect()}
    assert (found["a.csv"].points, found["a.csv"].x_min, found["a.csv"].y_max, found["a.csv"].x_mean) == (2, 1.0, 4.0, 2.0)
