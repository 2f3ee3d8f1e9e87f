"""Only strings that share a whole window are indexed, and small levels are indexed together."""

import random

import numpy as np
import pytest

from contactlake.llm import repeats

from .test_methods import prose


@pytest.fixture
def built(monkeypatch):
    """The strings of every index that is built."""
    seen = []

    class Counted(repeats.RunIndex):
        def __init__(self, strings, group):
            seen.append(strings)
            super().__init__(strings, group)

    monkeypatch.setattr(repeats, "RunIndex", Counted)
    return seen


def _brute(content, group, least):
    def windows(i):
        return [content[i][k : k + repeats.LEAST] for k in range(len(content[i]) - repeats.LEAST + 1)]

    n = range(len(content))
    before = [{w for j in n if group[j] == group[i] and least[j] < least[i] for w in windows(j)} for i in n]
    return [[w in before[i] for w in windows(i)] for i in n]


def _found(content, group, least):
    seen = repeats._seen_windows(content, group, least)
    none = [np.zeros(len(c) - repeats.LEAST + 1, bool) for c in content]
    return [seen.get(i, none[i]).tolist() for i in range(len(content))]


def test_shared_anchors_without_a_shared_window_need_no_index(built):
    common = prose(3, 40).encode()[: repeats.LEAST - 1]
    content = [bytes([200 + i]) + common + bytes([200 + i]) for i in range(20)]
    group = np.zeros(20, np.int64)
    assert repeats._seen_windows(content, group, np.arange(20)) == {}
    assert not built


def test_a_string_is_cut_to_what_it_shares(built):
    shared = prose(4, 40).encode()[:120]
    around = [bytes([200 + i]) for i in range(6)]
    content = [prose(10 + i, 30).encode() + x + shared + x + prose(40 + i, 30).encode() for i, x in enumerate(around)]
    group, least = np.zeros(6, np.int64), np.arange(6)
    assert _found(content, group, least) == _brute(content, group, least)
    assert not built


def test_levels_share_an_index(built):
    rng = random.Random(1)
    base = prose(5, 60).encode()
    content, group, least = [], [], []
    for i in range(40):
        at = rng.randrange(len(base) - 90)
        content.append(base[at : at + rng.randint(60, 90)])
        group.append(i % 2)
        least.append(rng.randrange(30))
    rank = np.argsort(np.argsort(np.array(least), kind="stable"))
    seen = repeats._seen_before(content, np.array(group), rank)
    want = _brute(content, group, rank.tolist())
    none = [np.zeros(len(c) - repeats.LEAST + 1, bool) for c in content]
    assert [seen.get(i, none[i]).tolist() for i in range(40)] == want
    assert len(built) == 1


@pytest.mark.parametrize("index_bytes", [1, 300, 1 << 20])
def test_any_grouping_of_levels_equals_brute_force(monkeypatch, index_bytes):
    monkeypatch.setattr(repeats, "INDEX_BYTES", index_bytes)
    rng = random.Random(2)
    for _ in range(5):
        base = bytes(rng.choice(b"ab") for _ in range(140))
        content, group, least = [], [], []
        for i in range(30):
            at = rng.randrange(len(base) - 80)
            text = bytearray(base[at : at + rng.randint(50, 80)])
            if i % 3 == 0:
                text[rng.randrange(len(text))] = ord("c")
            content.append(bytes(text))
            group.append(rng.randrange(3))
            least.append(rng.randrange(20))
        group, least = np.array(group), np.array(least)
        assert _found(content, group, least) == _brute(content, group, least)
