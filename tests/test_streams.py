"""Session state of a stream: late and future-dated rows, empty batches, rows without a key."""

import random

import numpy as np
from pyspark.sql import functions as F

from ctxlens.operators import sessions
from ctxlens.streaming import turns

ROWS = "k string, s bigint, id bigint"


def brute_turns(batches, gap):
    """Runs as sets of times: a request joins all runs that it lies near to."""
    state, out = {}, {}
    for batch in batches:
        for k, t, i in sorted(batch, key=lambda r: (r[1] is None, r[1], r[2])):
            if k is None or t is None:
                out[i] = 0
                continue
            runs = state.setdefault(k, [])
            near = [r for r in runs if min(r) - gap <= t <= max(r) + gap]
            state[k] = [r for r in runs if r not in near] + [[t, *(x for r in near for x in r)]]
            out[i] = len(state[k][-1])
    return out


def test_runs_of_one_session():
    rng = random.Random(2)
    for _ in range(400):
        gap, runs, n = rng.randint(0, 6), turns.Runs({}, 0), 0
        batches = [[("a", rng.randrange(60), (n := n + 1)) for _ in range(rng.randrange(9))] for _ in range(5)]
        runs.gap = gap
        got = {}
        for batch in batches:
            batch = sorted(batch, key=lambda r: r[1:])
            numbers = runs.add(np.array([t for _, t, _ in batch], np.int64))
            got |= {i: int(n) for (_, _, i), n in zip(batch, numbers, strict=True)}
        assert got == brute_turns(batches, gap)


def _streamed(spark, folder, batches, gap):
    """Each batch arrives as a file of its own, in a run of the query of its own."""
    stream = spark.readStream.schema(ROWS).parquet(f"{folder}/in/*").select(
        "k", F.timestamp_seconds("s").alias("ts"), "id"
    )
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{folder}/in/{i}")
        numbered = turns.turn_stream(stream, "k", "ts", "id", gap)
        writer = numbered.writeStream.format("parquet").option("path", f"{folder}/out")
        query = writer.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
    return {r.id: r.turn_count for r in spark.read.parquet(f"{folder}/out").collect()}


def test_state_takes_rows_as_they_come(spark, tmp_path):
    rng = random.Random(3)
    batches = [
        [("hot", rng.randrange(3000), i) for i in range(200)] + [("a", 100, 900), ("b", 100, 901), (None, 5, 902), ("a", None, 903)],
        [("z", 10**10, 904)],  # a clock far ahead: nobody else's session ends
        [],
        [("a", 150, 905), ("b", 90, 906), ("z", 200, 907), ("z", 10**10 + 5, 908), ("hot", 2500, 909), (None, None, 910)],
        [("a", 5000, 911), ("a", 160, 912), ("b", 400, 913), ("b", 250, 914)],  # late beside on time; 250 connects 100 and 400
    ]
    got = _streamed(spark, str(tmp_path), batches, 300)
    assert got == brute_turns(batches, 300)
    assert got[905] == 2 and got[907] == 1 and got[908] == 2 and got[912] == 3 and got[911] == 1


def test_rows_in_order_get_the_numbers_of_a_whole_table(spark, tmp_path):
    rng = random.Random(4)
    rows = sorted((rng.choice("aab"), rng.randrange(20_000), i) for i in range(300))
    cuts = [0, 6000, 6100, 20_000]
    batches = [[r for r in rows if lo <= r[1] < hi] for lo, hi in zip(cuts, cuts[1:])]  # noqa: B905
    df = spark.createDataFrame(rows, ROWS).withColumn("ts", F.timestamp_seconds("s"))
    want = {r.id: r.turn_count for r in sessions.turn_counts(df, "k", "ts", "id", 300).collect()}
    assert _streamed(spark, str(tmp_path), batches, 300) == want
