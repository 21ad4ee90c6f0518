import struct

import pytest
from pyspark.sql import functions as F

from tessitura.functions.warping import Warp
from tessitura.sources import files
from tessitura.streaming import queries as streams


def test_text_formats(spark, tmp_path):
    (tmp_path / "a b.pitch").write_text("0.0\t0.0\n0.5\t100.25\n1.0\t-1e3\n")
    (tmp_path / "c.pitch").write_text("0.0\t7.0\n")
    rows = files.read_series(spark, str(tmp_path / "*.pitch")).orderBy("rec_id", "idx").collect()
    assert [tuple(r) for r in rows] == [("a%20b" if "%20" in rows[0].rec_id else "a b", 0, 0.0, 0.0), (rows[0].rec_id, 1, 0.5, 100.25), (rows[0].rec_id, 2, 1.0, -1000.0), ("c", 0, 0.0, 7.0)]
    (tmp_path / "x.motif").write_text("1.0 2.0 3.0 4.0 5.5 7 8\n0 0 0 0 340282346638528859811704183484516925440.0 -1 -1\n")
    found = files.read_queries(spark, str(tmp_path / "x.motif"), "motifs").orderBy("query").collect()
    assert [tuple(r) for r in found] == [("x", 0, 1.0, 2.0), ("x", 1, 3.0, 4.0)]
    (tmp_path / "y.anot").write_text("1.0 2.5 sa re\n0.5 0.25 ga\n")
    assert [(r.s_time, r.e_time) for r in files.read_queries(spark, str(tmp_path / "y.anot"), "annotation").orderBy("query").collect()] == [(0.5, 0.75), (1.0, 3.5)]
    (tmp_path / "p.txt").write_text("DTWBand: 0.1\nname:  x y \n")
    assert files.read_parameters(spark, str(tmp_path / "p.txt")) == {"DTWBand": "0.1", "name": "x y"}
    assert {(r.rec, r.lines) for r in files.count_lines(spark, str(tmp_path / "x.motif")).collect()} == {("x", 2)}
    present = {r.rec: (r.motif, r.anot) for r in files.file_presence(spark, str(tmp_path), ["motif", "anot"]).collect()}
    assert present["x"] == (1, 0) and present[None] == (1, 1)


def test_binary_subsequences(spark, tmp_path):
    (tmp_path / "d.patternData").write_bytes(struct.pack("<6d", *range(6)))
    found = files.read_subsequences(spark, str(tmp_path / "*.patternData"), 3).orderBy("row").collect()
    assert [(r.row, r.data) for r in found] == [(0, [0.0, 1.0, 2.0]), (1, [3.0, 4.0, 5.0])]


def test_arff_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1.5, None, "b"), (2.0, 3.0, "a")], "x double, y double, label string")
    lines = [r.value for r in files.arff_lines(rows, "label").orderBy("n").collect()]
    (tmp_path / "f.arff").write_text("\n".join(lines) + "\n")
    back = files.read_arff(spark, str(tmp_path / "f.arff"))
    assert back.dtypes == [("x", "double"), ("y", "double"), ("label", "string")]
    assert sorted(map(tuple, back.collect())) == [(1.5, None, "b"), (2.0, 3.0, "a")]


def test_textgrid_round_trip(spark, tmp_path):
    rows = [("r", "notes", 0.0, 1.0, 'a "b"'), ("r", "notes", 1.0, 2.5, ""), ("r", "words", 0.0, 2.5, "x")]
    text = files.textgrid_text(spark.createDataFrame(rows, "rec string, tier string, s_time double, e_time double, label string")).first()
    (tmp_path / "r.TextGrid").write_text(text.text)
    assert sorted(map(tuple, files.read_textgrids(spark, str(tmp_path / "r.TextGrid")).collect())) == sorted(rows)


def test_pajek_and_wide_search(spark):
    lines = [r.value for r in files.pajek_lines(spark.createDataFrame([(7, 9), (3, 9)], "a long, b long")).orderBy("section", "n").collect()]
    assert lines == ["*Vertices 3", '1 "3"', '2 "7"', '3 "9"', "*Edges", "1 3 1.0", "2 3 1.0"]
    found = spark.createDataFrame([(1, 1, 0.0, 1.0, 2.0, 3.0, 0.5, 4.0)], "query int, rank int, q_s double, q_e double, m_s double, m_e double, dist double, file_id double")
    assert files.wide_search(found, 2).columns == ["rank", *[f"1_{c}" for c in ("q_s", "q_e", "m_s", "m_e", "dist", "file_id")]]


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(r, 1_700_000_000 + 60 * i + (7200 if i >= 20 else 0), float((i * 7 + r) % 10)) for r in range(3) for i in range(40)]
    table = spark.createDataFrame(rows, "rec_id long, s long, value double").select("rec_id", F.timestamp_seconds("s").alias("time"), "value")
    table.orderBy("time").coalesce(1).write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "in"))
    made = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def finish(df, mode="append"):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table("out")

    return table, made, finish


def test_stream_phrases_and_histogram(spark, stream):
    table, made, finish = stream
    found = finish(streams.session_phrases(made, "30 minutes", "0 seconds")).collect()
    assert {(r.rec_id, r.n) for r in found} == {(r, 20) for r in range(3)}  # the last session of each is still open


def test_stream_histogram(spark, stream):
    table, made, finish = stream
    found = finish(streams.stream_histogram(made, "1 hour", "0 seconds", 5.0), "update").groupBy("start", "bin").agg(F.max("n").alias("n"))
    want = table.groupBy(F.window("time", "1 hour").start.alias("start"), F.floor(F.col("value") / 5).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}


def test_stream_search_equals_batch(spark, stream):
    table, made, finish = stream
    queries = [[0.0, 7.0, 4.0], [1.0, 8.0, 5.0, 2.0]]
    found = {(r.rec_id, r.query, r.end.timestamp()) for r in finish(streams.stream_search(made, queries, 0.5, Warp(band=0))).collect()}
    want = set()
    for r in range(3):
        mine = [(x.time.timestamp(), x.value) for x in table.where(F.col("rec_id") == r).orderBy("time").collect()]
        for n, q in enumerate(queries):
            for i in range(len(mine) - len(q) + 1):
                if sum((a - b) ** 2 for a, (_, b) in zip(q, mine[i : i + len(q)], strict=True)) < 0.5:
                    want.add((r, n, mine[i + len(q) - 1][0]))
    assert found == want and want
