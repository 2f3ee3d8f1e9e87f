"""The limit on a line does not depend on its host's size."""

import pytest

from contactlake.llm import linefreq
from tests.llm.conftest import prose

BANNER = " ".join(f"Banner{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100))


@pytest.mark.parametrize("size,copies", [(40, 40), (40, 30), (3000, 40), (3000, 30), (3000, 31)])
def test_a_small_and_a_hot_host(spark, size, copies):
    """Rows that are mostly a banner go once it stands in more than the limit, on a host of 40 rows as on one of 3,000."""
    rows = [(i, f"{BANNER}\n{prose(i, 20)}" if i < copies else prose(i, 60), "host") for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = {r.doc_id: r.kept for r in linefreq.line_quality(docs).collect()}
    gone = copies > linefreq.MAX_LINE_DOCS
    assert [i for i in range(size) if not got[i]] == (list(range(copies)) if gone else [])
