"""Runs that are equal everywhere are settled by digest and least document."""

import numpy as np
import pyarrow as pa

from contactlake.llm import repeats

from .test_methods import _removed, prose


def test_digest_tells_runs_apart():
    texts = [prose(1, 60).encode(), b"x" + prose(1, 60).encode(), prose(2, 60).encode()]
    doc, place, size, _, digest = repeats.runs(texts)
    by_content = {}
    for d, s, n, x in zip(doc.tolist(), place.tolist(), size.tolist(), digest.tolist()):
        assert by_content.setdefault(texts[d][s : s + n + repeats.LEAST - 1], x) == x
    assert len(set(by_content.values())) == len(by_content)
    assert set(digest[doc == 0].tolist()) & set(digest[doc == 1].tolist())


def test_long_runs_count_as_different():
    _, _, size, _, digest = repeats.runs([b"a" * 2000])
    assert size.max() <= repeats.RUN_WINDOWS and not digest.any()


def test_facts_survive_packing():
    short = np.array([3, 3, 1 << 47, (1 << 48) - 1], np.uint64)
    known = (short, np.array([0, 9, 1, 1 << 31]), short, np.array([-5, 0, 7, (1 << 63) - 1]), np.array([1, 2, 255, 3]))
    for got, want in zip(repeats._unpack(repeats._pack(known)), known):
        assert got.tolist() == want.tolist()


def test_equal_runs_send_no_text(corpus):
    """One passage in many documents: what is sent are spans, and the result is that of brute force."""
    passage = prose(5, 80)
    pairs = [(i, passage) for i in range(30)] + [(100 + i, prose(200 + i, 40)) for i in range(5)]
    frame = pa.table(
        {"key": [k for k, _ in pairs], "bytes": [t.encode() for _, t in pairs], "ord": [k for k, _ in pairs],
         "row": [k for k, _ in pairs], "batch": [0] * len(pairs)}
    )
    packed = pa.Table.from_batches(list(repeats._anchor_rows(1)(frame.select(["bytes", "batch", "ord"]).to_batches())))
    found = repeats._batch_runs(1)(frame, repeats._repeated(packed))
    assert found.column("content").null_count == found.num_rows == 29
    want = _removed([(k, t.encode()) for k, t in pairs])
    for r in repeats.remove_repeats(corpus(pairs)).collect():
        assert bytes(r.kept) == want[r.doc_id]
