"""Numbered lines of files that several tasks share."""

import pytest
from pyspark.sql import functions as F

from skein.sources.exports import read_event_files
from skein.sources.lines import line_counts, numbered_lines


def wanted(folder):
    out = []
    for p in sorted(folder.rglob("*")):
        if p.is_file():
            parts = p.read_bytes().decode().split("\n")
            out += [(p.name, i + 1, x[:-1] if x.endswith("\r") else x) for i, x in enumerate(parts[:-1] if parts[-1] == "" else parts)]
    return out


def found(df):
    return sorted((r.file.rpartition("/")[2], r.line, r.text) for r in df.collect())


def test_small_files_and_splits(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.jsonl").write_bytes(b'{"a":1}\r\n\n\n{"a":2}\n')
    (tmp_path / "b.jsonl").write_bytes(b"no end")
    (tmp_path / "deep" / "c.jsonl").write_bytes(b"\n")
    (tmp_path / "deep" / "d.jsonl").write_bytes(b"")
    (tmp_path / "deep" / "er" / "e.jsonl").write_bytes("".join(f"line {i} é \r{'x' * (i % 90)}\n" + "\n" * (i % 4 == 0) for i in range(3000)).encode())
    for size in ("128m", "4k", "777"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        try:
            rows = numbered_lines(spark, str(tmp_path))
            assert found(rows) == sorted(wanted(tmp_path))
            if size != "128m":
                assert rows.where("file like '%e.jsonl'").select(F.spark_partition_id()).distinct().count() > 5
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found(read_event_files(spark, str(tmp_path))) == sorted(x for x in wanted(tmp_path) if x[2])
    assert {r.file.rpartition("/")[2]: r.lines for r in line_counts(spark, str(tmp_path)).collect()} == {"a.jsonl": 4, "b.jsonl": 1, "c.jsonl": 1, "e.jsonl": 3750}
    assert found(numbered_lines(spark, str(tmp_path), "b*")) == [("b.jsonl", 1, "no end")]


def test_large_file_runs_in_several_tasks(spark, tmp_path):
    with open(tmp_path / "big.jsonl", "w") as out:
        for i in range(100_000):
            out.write(f'{{"n":{i},"pad":"{"y" * 1000}"}}\n')
            if i % 1000 == 0:
                out.write("\n")
        out.write("z" * 33_000_000)
    assert (tmp_path / "big.jsonl").stat().st_size > 100_000_000
    rows = numbered_lines(spark, str(tmp_path))
    n = F.get_json_object("text", "$.n").cast("long")
    out = rows.select("line", F.spark_partition_id().alias("part"), n.alias("n"), F.length("text").alias("size")).agg(F.countDistinct("part").alias("parts"), F.count("*").alias("all"), F.max("line").alias("last"), F.countDistinct("line").alias("lines"), F.count(F.when(F.col("n").isNotNull() & (F.col("line") != F.col("n") + 1 + F.ceil(F.col("n") / 1000)), 1)).alias("wrong"), F.max("size").alias("size"))
    assert tuple(out.first())[1:] == (100_101, 100_101, 100_101, 0, 33_000_000) and out.first().parts > 2


def test_changed_splits_are_an_error(spark, tmp_path):
    (tmp_path / "f.txt").write_text("line\n" * 5000)
    rows = numbered_lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        with pytest.raises(Exception, match="splits of the files changed"):
            rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
