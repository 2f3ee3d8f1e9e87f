"""Every operator on nulls, empty and long texts, repeated rows, extra columns and empty tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactlake.llm import bpe, chat, decontam, linefreq, pii, repeats, sharding, simhash, tokens, toxicity
from contactlake.session import Scratch
from tests.llm.conftest import edge_pairs, prose

PAIRS = edge_pairs()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 1, int(i == 5)) for i in range(1, 9)] + [(None, 0, 1), (3, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, prose(8, 70)), (2, None), (None, prose(1, 90)), (3, ""), (4, "short"), (5, prose(77, 30))]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_tokens(spark, edges, empty):
    file = public_tokenizers.path("word_bpe_49k.json")
    path = Scratch(spark, "t").path("store")
    tokens.write_tokens(edges, path, file)
    rows = tokens.read_tokens(spark, path).collect()
    assert len(rows) == len(PAIRS)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((i for i, _ in PAIRS), key=lambda i: -1 if i is None else i)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(ordered, ordered[1:]))
    assert all(np.frombuffer(r.ids, "<u4")[-1] == tokens.END_ID for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3, 4)] == [1, 1, 1]
    some = tokens.read_documents(spark, path, [5, 8]).collect()
    assert sorted(r.doc_id for r in some) == [5, 8, 8, 8]
    other = Scratch(spark, "t").path("store")
    tokens.write_tokens(empty, other, file)
    assert tokens.read_tokens(spark, other).count() == 0


def test_toxicity(edges, empty, labels, spark):
    rows = toxicity.score_documents(edges, labels).collect()
    assert len(rows) == len(PAIRS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert {r.predicted for r in toxicity.score_documents(edges, labels.limit(0)).collect()} == {0}
    assert set(toxicity.reject_toxic(edges, labels).columns) == set(edges.columns)


def test_sharding(edges, empty):
    rows = sharding.assign_shards(edges, 3).collect()
    assert len(rows) == len(PAIRS) and all(0 <= r.shard < 3 for r in rows)
    for shard in range(3):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.size for r in rows if r.doc_id in (2, 3)} == {8}
    assert sharding.assign_shards(empty).count() == 0


def test_bytebpe(spark, edges, empty):
    codec = bpe.ByteBpe(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = bpe.round_trip(edges, codec).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for _, t in PAIRS)
    assert bpe.round_trip(empty, codec).count() == 0


def test_decontam(edges, empty, benchmark):
    rows = decontam.contaminated(edges, benchmark).collect()
    assert [(r.doc_id, r.n_items, r.least_edits) for r in rows] == [(8, 1, 0)]
    left = decontam.remove_contaminated(edges, benchmark)
    assert left.columns == edges.columns and left.count() == len(PAIRS) - 2
    assert decontam.contaminated(empty, benchmark).count() == 0
    assert decontam.contaminated(edges, benchmark.limit(0)).count() == 0


def test_simhash(edges, empty):
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == len(PAIRS)
    by_key = {r.doc_id: r for r in rows}
    assert by_key[2].fingerprint == "0" * 16 and by_key[2].component_id == 2 == by_key[4].component_id
    assert by_key[7].component_id == 1
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted(
        {r.component_id or 0 for r in rows} | {0}
    ) or kept.count() == len({r.fingerprint for r in rows})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_linefreq(edges, empty):
    rows = linefreq.line_quality(edges).collect()
    assert len(rows) == len(PAIRS)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words == 0)
    assert {r.n_words for r in rows if r.doc_id == 5} == {40_000}
    assert linefreq.line_quality(empty).count() == 0


def test_pii(spark, edges, empty, corpus):
    rows = pii.find(edges, Scratch(spark, "t")).collect()
    assert len(rows) == len(PAIRS) and all(len(r.strict) == 0 for r in rows)
    assert pii.find(empty, Scratch(spark, "t")).count() == 0
    given = corpus([(1, "a@b.co, +1 (017) 555-7713 é 4111 1111 1111 1111"), (2, None)])
    assert [r.text for r in pii.redact(given).orderBy("doc_id").collect()] == ["<EMAIL>, <PHONE> é <CARD>", None]
    assert pii.redact(edges).columns == edges.columns


def test_repeats(edges, empty):
    rows = repeats.remove_repeats(edges).collect()
    assert len(rows) == len(PAIRS)
    whole = {1: 0, 7: 1, 12: 1}
    assert all(len(r.spans) == whole[r.doc_id] for r in rows if r.doc_id in whole)
    assert [bytes(r.kept) for r in rows if r.doc_id == 7] == [b""]
    assert repeats.remove_repeats(empty).count() == 0


def test_chat(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, speaker int, masks string"
    rows = [
        (1, 0, "system", "rules"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "ann", "again"), (1, None, "bob", "first"),
        (1, 1, "ann", "hi"), (2, 0, None, "x"), (None, 0, "ann", "null key"), (3, 0, "a b", "say <|im_end|> now"),
    ]
    turns = spark.createDataFrame([(*r, 1, "m") for r in rows], schema)
    out = {(r.conv_id, r.speaker): r for r in chat.rotate(turns).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (None, "ann"), (3, "a b")}
    ann = out[1, "ann"]
    assert ann.text.startswith("<|im_start|>user name=bob\nfirst<|im_end|>\n<|im_start|>system\nrules<|im_end|>\n")
    assert [ann.text[m.start : m.end] for m in ann.masks] == ["hi<|im_end|>", "hi<|im_end|>", "again<|im_end|>"]
    bob = out[1, "bob"]
    assert [bob.text[m.start : m.end] for m in bob.masks] == ["first<|im_end|>", "<|im_end|>"]
    assert out[3, "a b"].text == "<|im_start|>assistant\nsay <| im_end |> now<|im_end|>\n"
    assert chat.rotate(turns.limit(0)).count() == 0
    many = spark.range(1500).select(
        F.lit(9).alias("conv_id"), (F.col("id") % 2).alias("turn"), F.lit("ann").alias("role"), F.col("id").cast("string").alias("text")
    )
    crowded = chat.rotate(many).collect()
    assert sum(r.n_turns for r in crowded) == 1500 and max(r.n_turns for r in crowded) < 600
    long = spark.range(700).select(
        F.lit(9).alias("conv_id"), F.col("id").alias("turn"), F.lit("ann").alias("role"), F.lit("t").alias("text")
    )
    assert sorted((r.block, r.n_turns) for r in chat.rotate(long).collect()) == [(0, 256), (1, 256), (2, 188)]


def test_stages(spark, edges, empty, tmp_path, labels, benchmark):
    folder = str(tmp_path)
    labels.write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    for docs in (edges, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            out.collect()


def test_bytes_match_digests(edges):
    """What the query reports is derived from the operator's real output."""
    row = repeats.remove_repeats(edges).select("kept", F.sha2("kept", 256).alias("d")).head()
    assert hashlib.sha256(bytes(row.kept)).hexdigest() == row.d
