import pytest

from contactlake.llm.common import prepare

WORDS = "ona reti thel mund esta lore vio karn telu brisk oda quen sarvo mitel pano dres".split()


def prose(seed: int, n: int) -> str:
    """Words that differ from seed to seed."""
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state >> 16 & 15] + WORDS[state >> 20 & 15][: 1 + (state >> 24 & 3)])
    return " ".join(out)


SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, key string, "
    "batch int, text_hash int, component_id string"
)


def rows_of(pairs):
    return [(i, t, "en", f"s{(i or 0) % 2}", None if t is None else len(t), 0.5, "r", "k", 1, 2, "c") for i, t in pairs]


@pytest.fixture(scope="session")
def corpus(spark):
    prepare(spark)
    return lambda pairs: spark.createDataFrame(rows_of(pairs), SCHEMA)


def edge_pairs():
    """Nulls in both columns, empty and very long texts, repeated rows, one key with two texts."""
    long = prose(3, 40_000)
    return [
        (1, prose(1, 90)), (2, None), (3, ""), (4, " \n\t "), (5, long), (None, prose(6, 60)), (None, None),
        (7, prose(1, 90)), (8, prose(8, 70)), (8, prose(8, 70)), (8, prose(9, 70)), (10, "x"), (11, "é" * 80 + "😀"),
        (12, prose(1, 90) + " " + prose(12, 30)),
    ]


@pytest.fixture(scope="session")
def edges(corpus):
    return corpus(edge_pairs())


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus([])
