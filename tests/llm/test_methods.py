"""The operators against brute force, round trips and held-out accuracy."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from contactlake.llm import bpe, decontam, oracles, pii, queries, repeats, simhash, tokens, toxicity
from contactlake.llm.rindex import RunIndex
from tests.llm.conftest import prose
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@needs_data
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, name):
    assert compare(spark, connect(SF), SF, queries.QUERIES[name], oracles.ORACLES[name])[0] == ""


@needs_data
def test_op1_equals_the_tokenizer(spark, texts):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    rows = {r.doc_id: r for r in queries.op1_tokens(spark, SF).collect()}
    for key in sorted(texts):
        ids = np.array([*whole.encode(texts[key], add_special_tokens=False).ids, 2], "<u4")
        assert (rows[key].start, rows[key].n_tokens, rows[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


ODD = st.text(alphabet="aAb's.,1²一éé́ßİΣ \x1c\x85 \n\t\r-_<|>", max_size=30)


@pytest.fixture(scope="module")
def word_encoders():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return tokens.WordEncoder(open(path, encoding="utf-8").read()), whole


@settings(max_examples=300, deadline=None)
@given(text=ODD)
def test_op1_words(word_encoders, text):
    words, whole = word_encoders
    assert np.frombuffer(words.encode([text])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_op1_forgets_and_remembers(word_encoders, monkeypatch):
    words, whole = word_encoders
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    for seed in range(6):
        text = prose(seed, 30)
        assert np.frombuffer(words.encode([text])[0], "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_op1_dictionary_is_needed(spark, corpus):
    from contactlake.session import Scratch

    path = Scratch(spark, "t").path("store")
    tokens.write_tokens(corpus([(i, prose(i, 50)) for i in range(300)]), path, public_tokenizers.path("word_bpe_49k.json"))
    sha, content, _ = spark.read.parquet(f"{path}/dictionary").head()
    assert hashlib.sha256(bytes(content)).hexdigest() == sha
    assert {r[0] for r in spark.read.parquet(f"{path}/blocks").select("dictionary_sha256").collect()} == {sha}


@pytest.fixture(scope="module")
def byte_encoders():
    vocabulary = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ours = bpe.Encoder(bpe.serialise_model(vocabulary), public_tokenizers.PATTERN)
    ranks = {t: i for i, t in enumerate(vocabulary)}
    return ours, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=ODD)
def test_op4_equals_rank_merges(byte_encoders, text):
    ours, theirs = byte_encoders
    assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == theirs.encode_ordinary(text)


@needs_data
def test_op4_query(spark, texts, byte_encoders):
    for r in queries.op4_bytebpe(spark, SF).collect():
        ids = np.array(byte_encoders[1].encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@needs_data
def test_op3_law(spark, texts):
    rows = queries.op3_sharding(spark, SF).collect()
    largest = max(r.size for r in rows)
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(24)]
    assert max(sums) - min(sums) <= 2 * largest and sum(sums) == sum(len(t.encode()) + 8 for t in texts.values())
    order = [(r.shard, r.slot) for r in sorted(rows, key=lambda r: r.doc_id)]
    assert order == sorted(order)


def _components(prints: dict[int, int]) -> dict[int, int]:
    root = {k: k for k in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in keys}


@needs_data
def test_op6_query(spark, texts):
    rows = queries.op6_simhash(spark, SF).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert all(prints[k] == simhash.fingerprint(t) for k, t in texts.items())
    assert {r.doc_id: r.component_id for r in rows} == _components(prints)


def test_op6_crowded_entries(spark, monkeypatch):
    """Links are the same whether entries are paired or the other segment's ball is enumerated."""
    from contactlake.session import Scratch

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(8)} | set(base)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    for crowded in (simhash.CROWDED, 2):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        found = simhash.links(frame, Scratch(spark, "t"))
        assert {(r.a, r.b) for r in found.collect()} == want


def test_op6_fingerprint_of_few_words():
    import xxhash

    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One TWO") == xxhash.xxh64_intdigest(b"one two", 42)


def _edits_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_op5_equals_alignment():
    rng = random.Random(3)
    items = [(i, 0, decontam.normalise("".join(rng.choice("abcdeé ") for _ in range(n)))) for i, n in enumerate((40, 72, 75, 100, 150))]
    index = decontam._windows(items)
    for _ in range(60):
        copy = list(rng.choice(items)[2])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "zz"])
        text = decontam.normalise("".join(rng.choice("abcdeé ") for _ in range(rng.randint(0, 100))) + "".join(copy))
        want = {i for i, c in enumerate(index.codes) if _edits_within("".join(map(chr, c)), text) <= index.edits[i]}
        assert set(index.search(text)[0].tolist()) == want


def test_op5_blocks_and_pieces(spark, corpus, monkeypatch):
    """A benchmark of many blocks, and texts longer than one piece."""
    bench = spark.createDataFrame([(i, prose(100 + i, 25)) for i in range(12)], "item_id bigint, text string")
    docs = corpus([(i, prose(500 + i, 200 * (i + 1)) + " " + prose(100 + i, 25) + "\n" + prose(900 + i, 100)) for i in range(8)])
    want = {(r.key, r.item) for r in decontam.matches(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 300)
    assert {(r.key, r.item) for r in decontam.matches(docs, bench).collect()} == want >= {(i, i) for i in range(8)}
    monkeypatch.setattr(decontam, "TEXT_CHARS", 97)
    parts = [(joined, marks) for joined, _, marks in decontam._batches(["a" * 500, "", "b" * 20])]
    assert sum(len(m) for _, m in parts) >= 3


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            twice = sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, digits[::-1])))
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and twice % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_op9_strict_spans(spark, corpus):
    from contactlake.session import Scratch

    rng = random.Random(4)
    odd = ["".join(rng.choice("ab1234567890@.+- ()%_é😀,") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    odd += ["".join(rng.choice("41 -.+@a") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    odd += [" ".join(["1.2.3.4 +1 234 567 8901 x@y.z 4111111111111111"] * 200), "7" * 50_000 + "@" + "a" * 50_000]
    found = pii.find(corpus(list(enumerate(odd))), Scratch(spark, "t")).collect()
    for r in found:
        if len(odd[r.doc_id]) < 50_000:
            assert [(s.start, s.rank, s.end, s.kind) for s in r.strict] == _base(odd[r.doc_id])
        assert set(map(tuple, r.strict)) <= set(map(tuple, r.spans))


def test_op9_reliabilities():
    """Two good labelers outvote a poor one."""
    rng, counts = random.Random(1), {}
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = tuple(int(truth if rng.random() < q else not truth) for q in (0.95, 0.9, 0.55))
        counts[votes] = counts.get(votes, 0) + 1
    share, tables = pii.reliabilities(sorted(counts.items()))
    assert abs(share - 0.4) < 0.06 and tables[0][1][1] > 0.85 > 0.7 > tables[2][1][1]
    assert pii.posterior((1, 1, 0), share, tables) > 0.9 > 0.1 > pii.posterior((0, 0, 1), share, tables)


def test_op9_added_spans(spark, corpus):
    from contactlake.session import Scratch

    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    docs = corpus([(i, f"{prose(i, 20)} {secret[:20]}{i:04d}{secret[24:]} page 1234567 {prose(i + 50, 20)}") for i in range(40)])
    kinds = {s.kind for r in pii.find(docs, Scratch(spark, "t")).collect() for s in r.spans}
    assert kinds == {"secret"}


def _removed(pairs):
    seen, out = set(), {}
    for key in sorted({k for k, _ in pairs}):
        own = set()
        for k, data in pairs:
            if k == key:
                covered = np.zeros(len(data), bool)
                for at in range(len(data) - 49):
                    own.add(data[at : at + 50])
                    if data[at : at + 50] in seen:
                        covered[at : at + 50] = True
                out[k] = np.frombuffer(data, np.uint8)[~covered].tobytes()
        seen |= own
    return out


def _families(n):
    rng, out = random.Random(9), []
    for i in range(n):
        text = prose(i % 7, 120)
        for _ in range(i // 7):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("äbc ") + text[at + rng.randint(0, 2) :]
        out.append((i, prose(1000 + i, 20) + text + "a" * rng.randint(0, 400)))
    return out


def test_op10_equals_brute_force(corpus):
    pairs = _families(60)
    want = _removed([(k, t.encode()) for k, t in pairs])
    got = {r.doc_id: r for r in repeats.remove_repeats(corpus(pairs)).collect()}
    for key, text in pairs:
        assert bytes(got[key].kept) == want[key]
        assert len(text.encode()) - sum(s.stop - s.start for s in got[key].spans) == len(want[key])


@needs_data
def test_op10_query(spark, texts):
    want = _removed([(k, t.encode()) for k, t in texts.items()])
    for r in queries.op10_repeats(spark, SF).collect():
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id]).hexdigest()
        assert r.n_removed == len(texts[r.doc_id].encode()) - len(want[r.doc_id])


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 300, "RUN_WINDOWS": 9, "INDEX_BYTES": 500}, {"COMMON": 2, "CHUNK": 700}])
def test_op10_steps_without_spark(monkeypatch, limits):
    """The same steps over small limits: cut runs, common anchors, many small indexes."""
    import pyarrow as pa

    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    pairs = [(k, t.encode()) for k, t in _families(40)]
    want, batches, parts = _removed(pairs), 3, 2
    frame = pa.table(
        {"key": [k for k, _ in pairs], "bytes": [t for _, t in pairs], "ord": [k for k, _ in pairs],
         "row": [k * 31 + 5 for k, _ in pairs], "batch": [k % batches for k, _ in pairs]}
    )
    packed = pa.Table.from_batches(list(repeats._anchor_rows(2)(frame.select(["bytes", "batch", "ord"]).to_batches())))
    buckets = packed.column("bucket").to_numpy()
    lists = pa.concat_tables([repeats._repeated(packed.filter(pa.array(buckets == b))) for b in set(buckets.tolist())])
    own = [frame.filter(pa.array(frame.column("batch").to_numpy() == b)) for b in range(batches)]
    to = lists.column("batch").to_numpy()
    found = pa.concat_tables([repeats._batch_runs(parts)(t, lists.filter(pa.array(to == b))) for b, t in enumerate(own)])
    part = found.column("part").to_numpy()
    spans = pa.concat_tables([repeats._decide(found.filter(pa.array(part == p))) for p in set(part.tolist())])
    where = spans.column("batch").to_numpy()
    for b, t in enumerate(own):
        for row in repeats._cut(t, spans.filter(pa.array(where == b))).to_pylist():
            assert row["kept"] == want[row["key"]]


@settings(max_examples=80, deadline=None)
@given(
    groups=st.lists(st.lists(st.binary(min_size=1, max_size=12), min_size=1, max_size=4), min_size=1, max_size=3),
    pattern=st.binary(min_size=1, max_size=20), pieces=st.lists(st.integers(0, 3), max_size=4),
)
def test_matching_statistics(groups, pattern, pieces):
    strings = [s for g in groups for s in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    pattern = pattern + b"".join(strings[p % len(strings)] for p in pieces)
    found = RunIndex(strings, group).statistics([pattern] * len(groups), np.arange(len(groups)))
    for g, row in zip(groups, found):
        for at in range(len(pattern)):
            length = 0
            while at + length < len(pattern) and any(pattern[at : at + length + 1] in s for s in g):
                length += 1
            assert row[at] == length


def test_op2_held_out_accuracy():
    """Unseen spellings share n-grams with seen ones; clean texts stay clean."""
    rng = random.Random(2)
    stems = ["grumbolt", "vexnak", "scorlip"]
    endings = ["", "s", "en", "ity", "ish", "ova", "ant"]

    def text(i, toxic):
        words = prose(i, rng.randint(20, 200)).split()
        for _ in range(max(1, len(words) // 40) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(stems) + rng.choice(endings[: 4 if i < 400 else 7]))
        return " ".join(words)

    labels = [int(i % 4 == 0) for i in range(600)]
    texts = [text(i, t) for i, t in enumerate(labels)]
    model = toxicity.train(texts[:400], labels[:400], [1.0] * 400)
    predicted = toxicity.Scorer(model).score(texts[400:]) >= 0.5
    truth = np.array(labels[400:], bool)
    assert predicted[truth].mean() > 0.9 and predicted[~truth].mean() < 0.05
    assert 0 <= toxicity.Scorer(model).score([None])[0] < 0.5
