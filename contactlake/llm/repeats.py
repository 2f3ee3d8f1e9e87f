"""Exact substring deduplication with run-length indexes of repeated regions.

Every window of 50 bytes has an anchor: the least hash of the short strings
inside it. Equal windows have equal anchors, so windows meet by anchor, and a
run of neighbouring windows with one anchor travels as one string. The jobs:

1. Documents go into batches by hash. Their distinct anchors are dealt by anchor,
   each with its run's digest and the least document id. Those that stand in two
   documents or more go back: with the least id of all if all their runs are
   equal, which decides them without sending a byte of text.
2. Each batch keeps its runs with anchors whose runs differ. A run that another
   document of the batch with a smaller id has, too, is decided there and then;
   the others travel, so of one run at most one copy per batch does.
3. By anchor, equal runs are settled by the least document id. Different runs of
   one anchor that share a second anchor, too, are halved by document again and
   again: the smaller ids' runs
   become a run-compressed Burrows-Wheeler index with sampled run ends, and
   matching statistics of the larger ids' runs are streamed over it; a window
   is repeated where a match of 50 bytes begins.
4. Repeated windows return to their batch, which cuts the texts.

Documents and batches share one shuffle of the texts (steps 2 and 4).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from contactlake.llm.common import utf8
from contactlake.llm.rindex import RunIndex

LEAST = 50
ANCHOR = 20
#: second anchors are longer, so that strings which share a common phrase only seldom meet again
SECOND = 40
#: windows in one run at most, so that a run is short even in monotonous texts
RUN_WINDOWS = 256
#: bytes of text in a batch and in a part
BATCH_BYTES = 4 << 20
PART_BYTES = 8 << 20
#: an anchor in more documents than this is split by a second anchor
COMMON = 20_000
#: bytes of text that are hashed at once
CHUNK = 256 << 10
#: symbols that are indexed or streamed at once
INDEX_BYTES = 1 << 20

_ODD = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)
_LAST = (1 << 63) - 1
#: the bits of an anchor that travel; the upper ones choose the part
_LOW = np.uint64((1 << 40) - 1)
#: anchors are first looked for by their upper 48 bits, runs compared by 48 bits of digest:
#: a chance meeting of the former costs a comparison, one of the latter has odds of 1 to 2**48
_SHORT = np.uint64(16)
#: the digest that stands for runs that differ
_MIXED = np.uint64(0)


def _hashes(data: np.ndarray, odd: int, width: int) -> np.ndarray:
    """A hash of each string of ``width`` bytes, by doubling a polynomial's length."""
    step, out, size = data.astype(np.uint64) + np.uint64(1), None, 0
    step *= np.uint64(0x9E3779B97F4A7C15)
    step ^= step >> np.uint64(29)
    length, bits = 1, width
    while True:
        if bits & 1:
            if out is None:
                out, size = step, length
            else:
                n = len(data) - size - length + 1
                out = step[:n] * np.uint64(pow(odd, size, 1 << 64)) + out[length : length + n]
                size += length
        bits >>= 1
        if not bits:
            break
        step = step[:-length] * np.uint64(pow(odd, length, 1 << 64)) + step[length:]
        length *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(odd)
    return out ^ out >> np.uint64(32)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The anchor of every window of LEAST bytes, spread evenly over 64 bits."""
    return _least(hashes, LEAST - width + 1) * np.uint64(0x9E3779B97F4A7C15)


def second_anchors(data: np.ndarray) -> np.ndarray:
    return _windows(_hashes(data, _ODD[1], SECOND), SECOND)


@cache
def _powers(odd: int, size: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(size - 1, odd, np.uint64)])


def _digests(hashes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A digest of each run's bytes from the hashes of all short strings in it, by differences of one running sum.

    A run that is to be cut counts as one that differs.
    """
    odd, size = _ODD[1], 1 << max(1, len(hashes)).bit_length()
    total = np.r_[np.uint64(0), np.cumsum(hashes * _powers(odd, size)[: len(hashes)], dtype=np.uint64)]
    out = total[first + length + (LEAST - ANCHOR)] - total[first]
    out *= _powers(pow(odd, -1, 1 << 64), size)[first]
    out ^= length.astype(np.uint64) * np.uint64(_ODD[0])
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out >>= _SHORT
    return np.where(length > RUN_WINDOWS, _MIXED, np.maximum(out, np.uint64(1)))


def _split(doc: np.ndarray, place: np.ndarray, size: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of RUN_WINDOWS windows at most."""
    if not len(size) or size.max() <= RUN_WINDOWS:
        return doc, place, size, *others
    pieces = -(-size // RUN_WINDOWS)
    of = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    length = np.minimum(size[of] - number * RUN_WINDOWS, RUN_WINDOWS)
    return doc[of], place[of] + number * RUN_WINDOWS, length, *(x[of] for x in others)


def _cut_runs(doc: np.ndarray, place: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (doc, first window, windows, anchor) of windows that follow each other with one anchor."""
    if not len(doc):
        return doc, place, place, anchor
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)]
    first = np.flatnonzero(new)
    return _split(doc[first], place[first], np.diff(np.r_[first, len(doc)]), anchor[first])


def runs(texts: list[bytes], common: np.ndarray | None = None, only: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """All runs (doc, first window, windows, anchor, digest) of the texts, chunk by chunk.

    With ``only``, ascending short anchors, just their runs; runs of those in
    ``common`` are cut by a second anchor, which takes part in the result's.
    """
    held, size, out = [], 0, []

    def flush() -> None:
        data = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        docs, offsets, lengths = (np.array(c, np.int64) for c in zip(*((d, s, len(t)) for d, s, t in held)))
        begin, windows = np.cumsum(lengths) - lengths, lengths - LEAST + 1
        hashes = _hashes(data, _ODD[0], ANCHOR)
        anchor = _windows(hashes, ANCHOR)
        new = np.r_[True, anchor[1:] != anchor[:-1]]
        new[begin] = True
        new[(begin + windows)[:-1]] = True  # windows from here on reach into the next text
        first = np.flatnonzero(new)
        length = np.diff(np.r_[first, len(anchor)])
        piece = np.searchsorted(begin, first, "right") - 1
        inside = first - begin[piece]
        keep = inside < windows[piece]
        if only is not None:
            keep &= _among(anchor[first] >> _SHORT, only)
        first, length, piece, inside = first[keep], length[keep], piece[keep], inside[keep]
        doc, place, own, digest = docs[piece], inside + offsets[piece], anchor[first], _digests(hashes, first, length)
        if only is not None and common is not None and len(common) and (hot := _among(own >> _SHORT, common)).any():
            n = length[hot]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(first[hot], n) + step
            finer = anchor[at] ^ second_anchors(data)[at]
            cut = _cut_runs(np.repeat(doc[hot], n), np.repeat(place[hot], n) + step, finer)
            out.append((*cut, np.full(len(cut[0]), _MIXED)))
            doc, place, length, own, digest = (x[~hot] for x in (doc, place, length, own, digest))
        out.append(_split(doc, place, length, own, digest))

    for number, text in enumerate(texts):
        for start in range(0, max(0, len(text) - LEAST + 1), CHUNK):
            piece = text[start : start + CHUNK + LEAST - 1]
            if held and size + len(piece) > CHUNK:
                flush()
                held, size = [], 0
            held.append((number, start, piece))
            size += len(piece)
    if held:
        flush()
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether values are among ascending known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


#: what is known of an anchor in a batch: short anchor, batch, digest, least document, documents; and the bytes sent of each
_KNOWN = (("<u8", 6), ("<u4", 4), ("<u8", 6), ("<i8", 8), ("u1", 1))


def _pack(known: tuple[np.ndarray, ...]) -> bytes:
    """Facts of ascending anchors; small differences and empty bytes squeeze well."""
    steps = np.diff(known[0], prepend=np.uint64(0))
    planes = [
        np.ascontiguousarray(x.astype(t).view(np.uint8).reshape(len(x), -1)[:, :n].T)
        for x, (t, n) in zip((steps, *known[1:]), _KNOWN)
    ]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def _unpack(content: bytes) -> tuple[np.ndarray, ...]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(content), np.uint8)
    planes, at, out = planes.reshape(sum(n for _, n in _KNOWN), -1), 0, []
    for t, n in _KNOWN:
        whole = np.zeros((planes.shape[1], np.dtype(t).itemsize), np.uint8)
        whole[:, :n] = planes[at : at + n].T
        out.append(whole.view(t).ravel())
        at += n
    return np.cumsum(out[0], dtype=np.uint64), *out[1:]


def _bucket(short: np.ndarray, buckets: int) -> np.ndarray:
    return ((short >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _one_or_mixed(digest: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """The digest of each group that has just one."""
    least = np.minimum.reduceat(digest, edge)
    return np.where(least == np.maximum.reduceat(digest, edge), least, _MIXED)


def _distinct(
    doc: np.ndarray, batch: np.ndarray, short: np.ndarray, digest: np.ndarray, ords: np.ndarray
) -> tuple[np.ndarray, ...]:
    """(short anchor, batch, digest, least document, documents up to 255), ascending by anchor, of runs."""
    order = np.argsort(short, kind="stable")
    a, b, d = short[order], batch[order], doc[order]
    # few anchors come twice; only those are put in the order of batch and document
    again = np.r_[False, a[1:] == a[:-1]]
    again[:-1] |= again[1:].copy()
    some = np.flatnonzero(again)
    in_order = np.lexsort((d[some], b[some], a[some]))
    order[some] = order[some][in_order]
    b, d = batch[order], doc[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    edge = np.flatnonzero(new)
    docs = np.add.reduceat(np.r_[True, new[1:] | (d[1:] != d[:-1])].astype(np.int64), edge)
    least = np.minimum.reduceat(ords[order], edge)
    return a[new], b[new], _one_or_mixed(digest[order], edge), least, np.minimum(docs, 255).astype(np.uint8)


def _anchor_rows(buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, batch, ords = rows.column(0).to_pylist(), rows.column(1).to_numpy(), rows.column(2).to_numpy()
            doc, _, _, anchor, digest = runs(texts)
            if not len(doc):
                continue
            known = _distinct(doc, batch[doc], anchor >> _SHORT, digest, ords[doc])
            bucket = _bucket(known[0], buckets)
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            packed = [_pack(tuple(x[i:j] for x in known)) for i, j in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edges[:-1]]), pa.array(packed, pa.binary())], names=["bucket", "packed"]
            )

    return emit


_LISTS_DDL = "batch bigint, anchors binary, common binary, equal binary, least binary"


def _repeated(table: pa.Table) -> pa.Table:
    """Per batch the anchors of one bucket that stand in two documents or more.

    ``anchors`` have different runs, ``common`` are the frequent ones of them.
    Those in ``equal`` have one run everywhere, with the ``least`` document.
    """
    parts = [_unpack(x.as_py()) for x in table.column("packed")]
    anchor, batch, digest, least, docs = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(anchor, kind="stable")
    anchor, batch, digest, least, docs = (x[order] for x in (anchor, batch, digest, least, docs))
    edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[edge, len(anchor)])
    total = np.repeat(np.add.reduceat(docs.astype(np.int64), edge), size)
    equal = np.repeat(_one_or_mixed(digest, edge), size) != _MIXED
    first = np.repeat(np.minimum.reduceat(least, edge), size)
    # the only document of a batch that is the least one has nothing to learn
    keep = (total >= 2) & ~(equal & (docs == 1) & (least == first))
    order = np.flatnonzero(keep)[np.argsort(batch[keep], kind="stable")]
    anchor, batch, common, equal, first = (x[order] for x in (anchor, batch, total > COMMON, equal, first))
    edges = np.flatnonzero(np.r_[True, batch[1:] != batch[:-1], True]) if len(batch) else np.zeros(1, int)
    out: dict[str, list] = {c: [] for c in ("batch", "anchors", "common", "equal", "least")}
    for i, j in zip(edges[:-1], edges[1:]):
        a, c, e, f = anchor[i:j], common[i:j], equal[i:j], first[i:j]
        once, at = np.unique(a[e], return_index=True)
        out["batch"].append(int(batch[i]))
        for name, x in zip(("anchors", "common", "equal", "least"), (np.unique(a[~e]), np.unique(a[~e & c]), once, f[e][at])):
            out[name].append(x.tobytes())
    return pa.table({c: pa.array(x, pa.int64() if c == "batch" else pa.binary()) for c, x in out.items()})


_RUNS = pa.schema([
    ("part", pa.int64()), ("anchor", pa.int64()), ("ord", pa.int64()), ("batch", pa.int64()), ("row", pa.int64()),
    ("first", pa.int64()), ("windows", pa.int64()), ("content", pa.binary()),
])
_RUNS_DDL = "part bigint, anchor bigint, ord bigint, batch bigint, row bigint, first bigint, windows bigint, content binary"
_SPANS = pa.schema([("batch", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_SPANS_DDL = "batch bigint, row bigint, start bigint, stop bigint"


def _merge(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans joined where they touch within a row."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    base = np.cumsum(np.r_[0, row[1:] != row[:-1]]) * (int(stop.max()) + 1)  # rows apart on one line
    reach = np.maximum.accumulate(stop + base)
    new = np.r_[True, start[1:] + base[1:] > reach[:-1]]
    edge = np.flatnonzero(new)
    return row[edge], start[edge], reach[np.r_[edge[1:] - 1, len(row) - 1]] - base[edge]


def _numbers(docs: pa.Table) -> np.ndarray:
    """A number for each row of a batch, the same whenever the batch is put together; equal rows share one."""
    return np.unique(docs.column("row").to_numpy(), return_inverse=True)[1].ravel().astype(np.int64)


def _batch_runs(parts: int):
    def emit(docs: pa.Table, lists: pa.Table) -> pa.Table:
        if not lists.num_rows or not docs.num_rows:
            return _RUNS.empty_table()

        def listed(column: str, kind=np.uint64) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_py(), kind) for x in lists.column(column)])

        # an anchor is in the list of one bucket only
        differ, common, equal, least_ord = np.sort(listed("anchors")), np.sort(listed("common")), listed("equal"), listed("least", np.int64)
        order = np.argsort(equal)
        equal, least_ord = equal[order], least_ord[order]
        texts, ords = docs.column("bytes").to_pylist(), docs.column("ord").to_numpy()
        batch, names = int(docs.column("batch")[0].as_py()), _numbers(docs)
        doc, first, windows, anchor, digest = runs(texts, common, np.sort(np.r_[differ, equal]))
        own, short = ords[doc], anchor >> _SHORT
        # a run cut by a second anchor has no digest, and its anchor is none of those looked for
        alike = (digest != _MIXED) & _among(short, equal)
        settled = np.zeros(len(doc), bool)
        settled[alike] = own[alike] > least_ord[np.searchsorted(equal, short[alike])]
        other = np.flatnonzero(~alike)
        content = [texts[d][s : s + n + LEAST - 1] for d, s, n in zip(*(x[other].tolist() for x in (doc, first, windows)))]
        least: dict[tuple[int, bytes], int] = {}
        for a, c, o in zip(anchor[other].tolist(), content, own[other].tolist()):
            if least.get((a, c), _LAST) >= o:
                least[a, c] = o
        settled[other] = [least[a, c] < o for a, c, o in zip(anchor[other].tolist(), content, own[other].tolist())]
        open_ = other[~settled[other]]
        travel = [content[i] for i in np.flatnonzero(~settled[other])]
        row, start, stop = _merge(doc[settled], first[settled], first[settled] + windows[settled] + LEAST - 1)
        n = len(row)
        return pa.table(
            [
                pa.array(np.r_[_bucket(short[open_], parts), names[row] % parts]),
                pa.array(np.r_[(anchor[open_] & _LOW).view(np.int64), np.zeros(n, np.int64)]),
                pa.array(np.r_[own[open_], ords[row]]),
                pa.array(np.full(len(open_) + n, batch)),
                pa.array(np.r_[names[doc[open_]], names[row]]),
                pa.array(np.r_[first[open_], start]),
                pa.array(np.r_[windows[open_], stop - start]),  # settled spans carry their bytes' length
                pa.array(travel + [None] * n, pa.binary()),
            ],
            schema=_RUNS,
        )

    return emit


def _ranked(group: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (group, least document), and in it the rank in the group; one document is one rank."""
    order = np.lexsort((least, group))
    g, o = group[order], least[order]
    new = np.r_[True, g[1:] != g[:-1]]
    step = np.cumsum(np.r_[False, o[1:] != o[:-1]] | new)
    return order, step - np.repeat(step[new], np.diff(np.r_[np.flatnonzero(new), len(g)]))


def _shared(hashes: np.ndarray, group: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether another string of the window's group has a window of that hash."""
    hashes = hashes ^ group.astype(np.uint64) * np.uint64(_ODD[1])
    order = np.argsort(hashes)
    edge = np.flatnonzero(np.r_[True, hashes[order][1:] != hashes[order][:-1]])
    several = np.minimum.reduceat(own[order], edge) != np.maximum.reduceat(own[order], edge)
    out = np.empty(len(own), bool)
    out[order] = np.repeat(several, np.diff(np.r_[edge, len(own)]))
    return out


def _seen_windows(content: list[bytes], group: np.ndarray, least: np.ndarray) -> dict[int, np.ndarray]:
    """For each string the windows that a string of a smaller document in its group has, too.

    Equal windows have equal hashes, so those whose hash no other string of the
    group has are done. What is left is cut into runs of one second anchor, which
    equal windows share, too. Equal runs are settled by the least document, and only
    different runs with the same two anchors need an index.
    """
    lengths = np.array([len(c) for c in content])
    begin, windows = np.cumsum(lengths) - lengths, lengths - LEAST + 1
    own = np.repeat(np.arange(len(content)), windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    data = np.frombuffer(b"".join(content), np.uint8)
    shared = _shared(_hashes(data, _ODD[0], LEAST)[place + begin[own]], group[own], own)
    if not shared.any():
        return {}
    own, place = own[shared], place[shared]
    second = second_anchors(data)[place + begin[own]]
    own, place, size, second = _cut_runs(own, place, second)
    key = second ^ group[own].astype(np.uint64) * np.uint64(_ODD[0])
    order = np.lexsort((own, key))
    other = np.r_[False, (key[order][1:] == key[order][:-1]) & (own[order][1:] != own[order][:-1])]
    some = np.flatnonzero(_among(key, np.unique(key[order][other])))
    number: dict[tuple[int, bytes], int] = {}
    first: list[int] = []
    of = []
    for k, o, at, n in zip(key[some].tolist(), own[some].tolist(), place[some].tolist(), size[some].tolist()):
        i = number.setdefault((k, content[o][at : at + n + LEAST - 1]), len(number))
        of.append(i)
        if i == len(first):
            first.append(int(least[o]))
        elif least[o] < first[i]:
            first[i] = int(least[o])
    met: dict[int, np.ndarray] = {}
    if number:
        finer = np.unique(np.array([k for k, _ in number], np.uint64), return_inverse=True)[1].ravel()
        several = np.flatnonzero((np.bincount(finer) > 1)[finer])
        if len(several):
            order, rank = _ranked(finer[several], np.array(first)[several])
            order, strings = several[order], [c for _, c in number]
            met = {int(order[i]): hit for i, hit in _seen_before([strings[k] for k in order], finer[order], rank).items()}
    seen: dict[int, np.ndarray] = {}
    for i, o, at, n in zip(of, own[some].tolist(), place[some].tolist(), size[some].tolist()):
        hit = least[o] > first[i] or met.get(i)
        if hit is not None and hit is not False:
            seen.setdefault(o, np.zeros(windows[o], bool))[at : at + n] = hit
    return seen


def _seen_before(content: list[bytes], group: np.ndarray, rank: np.ndarray) -> dict[int, np.ndarray]:
    """For each string the places whose window a string of lower rank in its group has, too.

    Two ranks differ first in one bit, so they are told apart at exactly one
    level, where the one without the bit is indexed and the other streamed. A
    string whose windows have all been seen goes no further down: whatever has
    one of them in its node has met it above, too. Small levels share an index,
    as every pass costs a step for each symbol of the longest string.
    """
    seen: dict[int, np.ndarray] = {}
    open_ = np.ones(len(content), bool)
    lengths = np.array([len(c) for c in content])
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        part, node, later = (np.concatenate(c) for c in zip(*held))
        old, new = part[~later], part[later]
        index = RunIndex([content[x] for x in old], node[~later])
        found = index.statistics([content[x] for x in new], node[later]) >= LEAST
        for x, hit in zip(new.tolist(), found):
            hit = hit[: lengths[x] - LEAST + 1]
            seen[x] = seen[x] | hit if x in seen else hit
            open_[x] = not seen[x].all()
        held.clear()

    for bit in reversed(range(int(rank.max()).bit_length())):
        node = rank >> bit + 1
        later = rank >> bit & 1 == 1
        key = np.unique(np.stack([group, node], 1), axis=0, return_inverse=True)[1].ravel()
        nodes = int(key.max()) + 1
        both = (np.bincount(key[later & open_], minlength=nodes) > 0) & (np.bincount(key[~later & open_], minlength=nodes) > 0)
        some = np.flatnonzero(both[key] & open_)
        some = some[np.argsort(key[some], kind="stable")]
        size = np.cumsum(lengths[some])
        leads = np.flatnonzero(np.r_[True, key[some][1:] != key[some][:-1]]) if len(some) else []
        # whole nodes together, about INDEX_BYTES at once
        cut = [0]
        for lead in leads:
            if lead and size[lead - 1] - (size[cut[-1] - 1] if cut[-1] else 0) > INDEX_BYTES:
                cut.append(int(lead))
        for i, j in zip(cut, [*cut[1:], len(some)]):
            part = some[i:j]
            if not len(part):
                continue
            if held and sum(lengths[x].sum() for x, _, _ in held) + lengths[part].sum() > INDEX_BYTES:
                flush()
            number = np.unique(key[part], return_inverse=True)[1].ravel()
            held.append((part, number + (held[-1][1][-1] + 1 if held else 0), later[part]))
    if held:
        flush()
    return seen


_NOT = np.zeros(1, bool)


def _decide(table: pa.Table) -> pa.Table:
    """The repeated spans among the runs of one part."""
    content = table.column("content").to_pylist()
    anchor, ords, first, windows, row, batch = (
        table.column(c).to_numpy() for c in ("anchor", "ord", "first", "windows", "row", "batch")
    )
    row = row + (batch << 32)  # rows of all batches apart
    number: dict[tuple[int, bytes], int] = {}
    of = np.array([-1 if c is None else number.setdefault((a, c), len(number)) for a, c in zip(anchor.tolist(), content)], np.int64)
    runs_ = of >= 0
    least = np.full(len(number), _LAST)
    np.minimum.at(least, of[runs_], ords[runs_])
    group = np.unique([a for a, _ in number], return_inverse=True)[1].ravel() if number else np.zeros(0, int)
    strings = [c for _, c in number]
    several = np.flatnonzero((np.bincount(group) > 1)[group]) if len(group) else np.zeros(0, int)
    seen: dict[int, np.ndarray] = {}
    if len(several):
        found = _seen_windows([strings[k] for k in several], group[several], least[several])
        seen = {int(several[i]): hit for i, hit in found.items()}
    # spans that came settled carry their bytes' length; runs that a smaller document has go whole
    whole = np.flatnonzero(~runs_ | (runs_ & (ords > least[of]))) if len(number) else np.flatnonzero(~runs_)
    reach = np.where(runs_, windows + LEAST - 1, windows)
    spans = [(row[whole], first[whole], first[whole] + reach[whole])]
    if seen:
        held = np.zeros(len(number), bool)
        held[list(seen)] = True
        some = np.flatnonzero(runs_ & held[of] & (ords == least[of]))
        # the hits of all runs on one line, a place without one between them
        line = np.concatenate([x for i in of[some].tolist() for x in (_NOT, seen[i])] + [_NOT])
        begin = np.cumsum(windows[some] + 1) - windows[some]
        edge = np.flatnonzero(line[1:] != line[:-1]) + 1
        run = np.searchsorted(begin, edge[::2], "right") - 1
        shift = first[some][run] - begin[run]
        spans.append((row[some][run], edge[::2] + shift, edge[1::2] + shift + LEAST - 1))
    row, start, stop = _merge(*(np.concatenate(c) for c in zip(*spans)))
    return pa.table([pa.array(row >> 32), pa.array(row & (1 << 32) - 1), pa.array(start), pa.array(stop)], schema=_SPANS)


_CUT = pa.schema([
    ("key", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ("kept", pa.binary()),
])
_CUT_DDL = "key bigint, n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary"


def _cut(docs: pa.Table, spans: pa.Table) -> pa.Table:
    row, start, stop = _merge(*(spans.column(c).to_numpy() for c in ("row", "start", "stop"))) if spans.num_rows else ([],) * 3
    by_row: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(*(x.tolist() if len(x) else x for x in (row, start, stop))):
        by_row.setdefault(r, []).append((a, b))
    texts, names = docs.column("bytes").to_pylist(), _numbers(docs).tolist()
    own, kept = [], []
    for text, name in zip(texts, names):
        gone = by_row.get(name, [])
        edges = [0, *(x for span in gone for x in span), len(text)]
        own.append([{"start": a, "stop": b} for a, b in gone])
        kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if gone else text)
    return pa.table(
        [docs.column("key"), pa.array([len(t) for t in texts], pa.int64()), pa.array(own, _CUT.field("spans").type), pa.array(kept, pa.binary())],
        schema=_CUT,
    )


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``(key, n_bytes, spans, kept)``: its removed byte spans, and the bytes that are left.

    A byte goes if it is covered by ``LEAST`` bytes that also begin in a row
    with a smaller key, judged on the input. Null texts are empty; a null key
    counts as larger than all others; rows with equal keys do not remove from
    each other; an empty table gives an empty result.
    """
    given = docs.select(F.col(key).cast("bigint").alias("key"), utf8(text).alias("bytes")).withColumns(
        {"ord": F.coalesce("key", F.lit(_LAST)), "row": F.xxhash64("key", "bytes")}
    )
    total = docs.agg(F.coalesce(F.sum(F.octet_length(utf8(text))), F.lit(0))).head()[0]
    batches = -(-total // BATCH_BYTES) + 1
    parts = -(-total // PART_BYTES) + 1
    dealt = given.withColumn("batch", F.pmod("row", F.lit(batches)))
    packed = dealt.select("bytes", "batch", "ord").mapInArrow(_anchor_rows(parts), "bucket bigint, packed binary")
    lists = packed.groupBy("bucket").applyInArrow(_repeated, _LISTS_DDL)
    by_batch = dealt.groupBy("batch")
    found = by_batch.cogroup(lists.groupBy("batch")).applyInArrow(_batch_runs(parts), _RUNS_DDL)
    spans = found.groupBy("part").applyInArrow(_decide, _SPANS_DDL)
    cut = by_batch.cogroup(spans.groupBy("batch")).applyInArrow(_cut, _CUT_DDL)
    return cut.select(F.col("key").alias(key), "n_bytes", "spans", "kept")


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
