"""Shards against a sequential sort and running sum, and as written files."""

import random
from collections import Counter

from pyspark.sql import functions as F

from contactlake.llm import sharding


def test_shards_equal_running_sum(spark):
    rng = random.Random(3)
    rows = [(i * 7 - 50, "ä" * rng.choice([0, 1, 5, 40, 900])) for i in range(400)]
    rng.shuffle(rows)
    got = {
        r.doc_id: (r.size, r.shard, r.slot)
        for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), 7).collect()
    }
    sizes = {k: len(t.encode()) + 8 for k, t in rows}
    total, before, slots = sum(sizes.values()), 0, Counter()
    for key in sorted(sizes):
        shard = (2 * before + sizes[key]) * 7 // (2 * total)
        assert got[key] == (sizes[key], shard, slots[shard])
        slots[shard] += 1
        before += sizes[key]


def test_written_shards_keep_every_row(spark, tmp_path):
    rows = [(None, "a", 1), (None, "a", 2), (3, "b", 3), (3, "b", 4), (3, None, 5), (4, "", 6), (4, "", 6), (9, "x" * 500, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, seq int").withColumn("slot", F.lit("old"))
    sharding.write_shards(docs, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    kept = back.collect()
    assert Counter((r.doc_id, r.text, r.seq) for r in kept) == Counter(rows)
    for shard in {r.shard for r in kept}:
        assert sorted(r.slot for r in kept if r.shard == shard) == list(range(sum(r.shard == shard for r in kept)))
