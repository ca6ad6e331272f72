"""Tables that grow by parts: repeated parts, merges, parts of a job that died, late rows."""

from pyspark.sql import functions as F

from ctxlens.sources.parts import Parts
from ctxlens.sources.sinks import append_once, read_facts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_part_counts_once(spark, tmp_path):
    parts = Parts(spark, f"{tmp_path}/t")
    assert parts.read("k string, n long").count() == 0 and parts.live() == []
    one = spark.createDataFrame([("a", 1)], "k string, n long")
    assert parts.append(one, "1") and not parts.append(one, "1") and parts.append(one, "2") and parts.append(one)
    assert rows(parts.read()) == [("a", 1)] * 3
    # Rows that no ledger names are not there.
    one.write.parquet(f"{tmp_path}/t/part_id=lost")
    assert parts.read().count() == 3
    # Two writers of one key at the same time: one counts, the same for all readers.
    parts._add(one, "3", 0, [], ())
    parts._add(one, "3", 0, [], ())
    assert parts.read().count() == 4 and parts.has("3") and not parts.has("4")


def test_parts_are_merged_by_levels(spark, tmp_path):
    parts = Parts(spark, f"{tmp_path}/t")
    add_up = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    for i in range(10):
        parts.append(spark.createDataFrame([("a", 1), (f"k{i % 2}", i)], "k string, n long"), str(i))
        parts.merge(add_up, fan=3)
        assert len(parts.live()) <= 5
    assert rows(add_up(parts.read())) == [("a", 10), ("k0", 20), ("k1", 25)]
    assert all(parts.has(str(i)) for i in range(10)) and not parts.append(parts.read(), "0")
    assert parts.vacuum() > 5
    assert rows(add_up(parts.read())) == [("a", 10), ("k0", 20), ("k1", 25)]


def test_facts_appended_again_stay_the_same(spark, tmp_path):
    facts = spark.range(60).withColumn("ts", F.timestamp_seconds(F.col("id") % 3 * 86400))
    for i in range(10):
        append_once(facts.where(F.col("id") % 10 == i), f"{tmp_path}/f", f"run-{i}")
        assert not append_once(facts, f"{tmp_path}/f", f"run-{i}")
    read = read_facts(spark, f"{tmp_path}/f")
    assert rows(read.select("id", "ts")) == rows(facts)
    assert {r.day.isoformat(): r["count"] for r in read.groupBy("day").count().collect()} == {
        "1970-01-01": 20, "1970-01-02": 20, "1970-01-03": 20,
    }
    assert len(Parts(spark, f"{tmp_path}/f").live()) == 3
