"""Substring deduplication: removes each byte covered by a string of ``least`` bytes that also starts earlier.

Whole texts are never sorted against each other. Each window of ``least`` bytes
picks the k-grams with the least hash in it as its anchors, so equal windows
pick equal anchors at equal offsets. An anchor's context holds all windows that
can pick it. Contexts go by anchor:

* equal contexts of an anchor (by 128-bit hash) form a class, first within a
  batch, then over the corpus; all but the earliest of a class are repeats as a
  whole;
* anchors with several classes need the bytes: their contexts are gathered, and
  an enhanced suffix array (order and common prefixes of the suffixes that start
  a window) is built over blocks of them. A stack scan walks the tree of
  common-prefix intervals; those of ``least`` bytes or more whose occurrences
  differ in the byte before them are the maximal repeats, with all occurrences,
  of which all but the earliest go;
* an anchor with more than ``MANY`` classes would make too large an array. Each
  context is cut into four parts, the windows of one part share a core of bytes,
  and the core takes the anchor's place. Parts of a core that still has too many
  are counted as windows by 128-bit hashes, combined on the map side.

Defined results: a null text has no bytes; a null key sorts first; rows that
repeat a key with equal texts are one document, with different texts they are
documents of their own, ordered by the hash of the text; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.batches import sliced
from lodestack.llm.names import fresh
from lodestack.runtime import drop_table, materialize

LEAST = 100
GRAM = 32
#: Bytes that are hashed, or put into one suffix array, at a time.
SLICE, BLOCK = 1 << 20, 1 << 19
#: The most contexts of an anchor, or parts of a core, that go into one suffix array (2.7 MB of contexts of 168 bytes).
MANY = 16_384
#: One in so many documents is looked at for anchors that are dealt out salted; this steers the dealing alone.
SAMPLED, SAMPLED_MANY, MAX_SALTED, SALTS = 64, 100, 20_000, 64
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: np.ndarray, grams: int = GRAM) -> np.ndarray:
    """A hash of the ``grams`` bytes, a power of two, from each position."""
    h, size = _BYTE[data], 1
    while size < grams:
        a = h[:-size] * _ODD + (h[size:] ^ (h[size:] >> np.uint64(29)))
        h = a ^ (a >> np.uint64(31))
        size *= 2
    return h * _ODD


def _sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        h = pick(h[:-size], h[size:])
        size *= 2
    return pick(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def anchors(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and hashes, of all k-grams that have the least hash in some window of ``least`` bytes."""
    width = least - GRAM + 1
    found, hashes = [], []
    for start in range(0, len(data) - least + 1, SLICE):
        h = _gram_hashes(data[start : start + SLICE + least - 1])
        low = _sliding(h, width, np.minimum)
        pad = np.zeros(width - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h)
        found.append(at + start)
        hashes.append(h[at])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(found), return_index=True)
    return at, np.concatenate(hashes)[first]


def union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as sorted, disjoint, non-touching ones."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.r_[True, lo[1:] > hi[:-1]]
    starts = np.flatnonzero(new)
    return lo[starts], hi[np.r_[starts[1:], len(lo)] - 1]


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, position), ...]) of each maximal repeat of ``least`` bytes or more, with all its occurrences."""
    owner, place, found = repeat_intervals(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64), least)
    return [(length, list(zip(owner[a:b].tolist(), place[a:b].tolist()))) for length, a, b in found]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number, the first the highest; bytes beyond the end are 0."""
    w = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        w = (w[:-size] << np.uint64(8 * size)) | w[size:]
    return w[: len(data) + 1]


#: Of a word, the first n bytes.
_FIRST = np.array([(0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(9)], np.uint64)


def _by_prefix(words: np.ndarray, starts: np.ndarray, hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts that share their first ``least`` bytes with another one, together, and the number of each group."""

    def grouped(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = np.r_[False, same] | np.r_[same, False]
        return order[shared], np.cumsum(np.r_[True, ~same])[shared]

    order = np.argsort(hashes, kind="stable")
    at, group = grouped(order, hashes[order][1:] == hashes[order][:-1])
    at = starts[at]
    offsets = [*range(0, least - 7, 8), least - 8] if least >= 8 else [0]
    mask = _FIRST[min(least, 8)]
    joined = group[1:] == group[:-1]
    if all((((words[at[1:] + i] ^ words[at[:-1] + i]) & mask)[joined] == 0).all() for i in offsets):
        return at, group
    # Two strings have one hash: the order by their bytes decides.
    keys = [words[at + i] & mask for i in offsets]
    order = np.lexsort(keys)
    picked, group = grouped(order, np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys]))
    return at[picked], group


def repeat_intervals(data: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Text and position of suffixes in order, and (length, first, end) of the maximal repeats among them.

    ``data``: the texts' bytes, one after another. The suffix array holds the
    suffixes that share their first ``least`` bytes with another one, unless all
    that do have one and the same byte before them. A repeat is maximal if its
    occurrences can't all be extended alike to the right (it is an interval with
    a longest common prefix) nor to the left (the bytes before them differ, or
    one has none).
    """
    ends = np.cumsum(sizes)
    none = np.empty(0, np.int64)
    if not len(data):
        return none, none, []
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(ends[owner] - np.arange(len(data)) >= least)
    if len(starts) < 2:
        return none, none, []
    grams = 1 << (least.bit_length() - 1)
    h = _gram_hashes(data, grams)
    words = _words(data)
    at, group = _by_prefix(words, starts, h[starts] * _ODD + (h[starts + least - grams] ^ (h[starts] >> np.uint64(31))), least)
    # Groups that extend alike to the left are part of the repeat that starts one byte before.
    first = (ends - sizes)[owner[at]]
    left = np.where(at == first, -1, data[at - 1].astype(np.int64))
    if not len(at):
        return none, none, []
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    low, high = np.minimum.reduceat(left, heads), np.maximum.reduceat(left, heads)
    stay = np.repeat((low != high) | (low == -1), np.diff(np.r_[heads, len(at)]))
    at, group, left = at[stay], group[stay], left[stay]
    if not len(at):
        return none, none, []
    # Suffixes of a group are ordered by their next words; a text's end counts as less than any byte.
    room = ends[owner[at]] - at
    common = np.zeros(len(at) - 1, np.int64)  # of each suffix and the next one
    open_, off = np.arange(len(at)), least
    rank = group.copy()
    while len(open_):
        have = np.clip(room[open_] - off, 0, 8)
        word = words[np.minimum(at[open_] + off, len(data))] & _FIRST[have]
        order = np.lexsort((have, word, rank[open_]))
        moved = open_[order]
        at[open_], left[open_], room[open_], rank[open_] = at[moved], left[moved], room[moved], rank[moved]
        word, have = word[order], have[order]
        joined = rank[open_][1:] == rank[open_][:-1]
        differ = word[1:] ^ word[:-1]
        equal = np.zeros(len(differ), np.int64)
        for n in range(1, 9):
            equal += (differ & _FIRST[n]) == 0
        upto = off + np.minimum(equal, np.minimum(have[1:], have[:-1]))
        near = open_[:-1][joined]  # its next one stands beside it, as groups are whole
        common[near] = upto[joined]
        same = joined & (differ == 0) & (have[1:] == have[:-1])
        rank[open_] = np.cumsum(np.r_[True, ~same])
        go_on = (np.r_[False, same] | np.r_[same, False]) & (have == 8)
        open_, off = open_[go_on], off + 8
    # How often the byte before changes along the order; a suffix without one differs from its neighbours.
    turns = np.cumsum(np.r_[0, (left[1:] != left[:-1]) | (left[1:] == -1)]).tolist()
    alone = (left == -1).tolist()
    values = [*common.tolist(), 0]
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i, now in enumerate(values):
        begin = i
        while stack and stack[-1][1] > now:
            begin, length = stack.pop()
            if alone[begin] or turns[i] > turns[begin]:
                out.append((length, begin, i + 1))
        if now and (not stack or stack[-1][1] < now):
            stack.append((begin, now))
    return owner[at], at - (ends - sizes)[owner[at]], out


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: (v if isinstance(v, pa.Array) else pa.array(v, pa.int64())) for k, v in columns.items()})


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


CONTEXTS = "anchor long, class long, more long, doc long, pos long, room long"


def _contexts(least: int):
    """Contexts of a batch's anchors, one of each class; a row without class is an interval found to repeat.

    ``class`` and ``more`` are the halves of a 128-bit hash. A context reaches
    ``room`` // 256 bytes to the left of ``pos`` and ``room`` % 256 to the right;
    an interval without class starts at ``pos`` and has ``room`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            ids, texts = _long(batch, "doc"), _binary(batch, "text")
            parts, digests = [], []
            for i in np.argsort(ids, kind="stable"):
                text = texts[i]
                at, h = anchors(np.frombuffer(text, np.uint8), least)
                if len(at):
                    lo = np.maximum(0, at - (least - GRAM))
                    hi = np.minimum(at + least, len(text))
                    digests += [xxhash.xxh3_128_digest(text[x:y], z) for x, y, z in zip(lo.tolist(), hi.tolist(), (at - lo).tolist())]
                    parts.append((h, np.full(len(at), ids[i]), at, lo, hi))
            if not parts:
                continue
            h, doc, at, lo, hi = (np.concatenate(x) for x in zip(*parts))
            cls, more = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).T
            order = np.lexsort((at, doc, more, cls, h))
            first = np.r_[True, (h[order][1:] != h[order][:-1]) | (cls[order][1:] != cls[order][:-1]) | (more[order][1:] != more[order][:-1])]
            leader = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
            again = np.zeros(len(h), bool)
            again[order] = ~first & ((doc[order] != doc[leader]) | (at[order] != at[leader]))
            keep = np.zeros(len(h), bool)
            keep[order[first]] = True
            yield _table(anchor=h[keep].view(np.int64), **{"class": pa.array(cls[keep])}, more=more[keep], doc=doc[keep], pos=at[keep], room=(at - lo)[keep] * 256 + (hi - at)[keep])
            cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            found = []
            for x, y in zip(cuts, np.r_[cuts[1:], len(doc)]):
                sel = again[x:y]
                if sel.any():
                    a, b = union(lo[x:y][sel], hi[x:y][sel])
                    found.append((np.full(len(a), doc[x]), a, b))
            if found:
                d, a, b = (np.concatenate(x) for x in zip(*found))
                salt = (d * 31 + a).astype(np.uint64) * _ODD
                yield _table(anchor=salt.view(np.int64), **{"class": pa.nulls(len(d), pa.int64())}, more=a, doc=d, pos=a, room=b - a)

    return run


def _classes():
    """Of contexts sorted by salt, anchor, class, document and position: repeats (open 0) and contexts to compare (open 1)."""

    def settle(rows):
        salt, anchor, cls, more, doc, pos, room, none = rows
        same_anchor = np.r_[False, (anchor[1:] == anchor[:-1]) & (salt[1:] == salt[:-1]) & ~none[1:] & ~none[:-1]]
        same = same_anchor & np.r_[False, (cls[1:] == cls[:-1]) & (more[1:] == more[:-1])]
        group = np.cumsum(~same_anchor) - 1
        lead = np.flatnonzero(~same)[np.cumsum(~same) - 1]
        repeat = none | (same & ((doc != doc[lead]) | (pos != pos[lead])))
        several = np.bincount(group, weights=~same)[group] > 1
        open_ = ~none & ~same & (several | (salt > 0))
        take = repeat | open_
        lo = np.where(none, pos, pos - (room >> 8))
        hi = np.where(none, pos + room, pos + (room & 255))
        return _table(open=open_[take].astype(np.int64), anchor=anchor[take], doc=doc[take], pos=pos[take], lo=lo[take], hi=hi[take])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            none = _column(batch, "class").is_null().to_numpy(zero_copy_only=False)
            rows = [*(_long(batch, c) for c in ("salt", "anchor", "class", "more", "doc", "pos", "room")), none]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            # The last anchor may go on. What is surely settled goes out, but for one row of its class and one of another.
            last = (rows[1] == rows[1][-1]) & (rows[0] == rows[0][-1])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield settle([r[:cut] for r in rows])
            held = [r[cut:] for r in rows]
            if len(held[0]) > 50_000:  # several classes or one: a long run of one anchor goes out in parts
                yield settle(held)
                first = np.r_[True, (held[2][1:] != held[2][:-1]) | (held[3][1:] != held[3][:-1])]
                stay = np.flatnonzero(first)[[0, -1]] if first.sum() > 1 else np.flatnonzero(first)
                held = [r[stay] for r in held]
        if held is not None and len(held[0]):
            yield settle(held)

    return run


STRINGS = "anchor long, doc long, lo long, at long, bytes binary"


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each document's open contexts."""
    for batch in sliced(batches, "text"):
        own = _column(batch, "own")
        counts = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = own.flatten()
        anchor, pos, lo, hi = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        row = np.repeat(np.arange(len(counts)), counts)
        texts = _binary(batch, "text")
        cut = [texts[i][x:y] for i, x, y in zip(row.tolist(), lo.tolist(), hi.tolist())]
        yield _table(anchor=anchor, doc=_long(batch, "doc")[row], lo=lo, at=pos - lo, bytes=pa.array(cut, pa.binary()))


def core_parts(text: bytes, at: int, anchor: int, least: int) -> list[tuple[int, int, int]]:
    """(key, start, end) of the parts of a context, four at most; each window stands whole in one of them.

    A window reaches 0 to ``least`` - GRAM bytes to the left of the anchor at
    ``at``. Those of a quarter of that range are one part and share all but a few
    of their bytes, which make the key.
    """
    span = least - GRAM
    edges = [span * i // 4 for i in range(5)]
    out = []
    for i in range(4):
        near, far = edges[i] + (i > 0), edges[i + 1]
        end = at + least - far
        if near <= at and end <= len(text):
            key = xxhash.xxh3_64_intdigest(text[at - near : end], (anchor + i) & 0xFFFFFFFFFFFFFFFF)
            out.append((key - 2**63, max(0, at - far), min(len(text), at - near + least)))
    return out


def _compared(least: int):
    """Intervals that repeat, from the suffix arrays of blocks of strings; those of one anchor stand in one block."""

    def block(docs: np.ndarray, los: np.ndarray, texts: pa.Array):
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)).astype(np.int64)
        begin = int(np.frombuffer(texts.buffers()[1], np.int32, 1, texts.offset * 4)[0])
        data = np.frombuffer(texts.buffers()[2], np.uint8, int(sizes.sum()), begin) if sizes.sum() else np.empty(0, np.uint8)
        owner, place, found = repeat_intervals(data, sizes, least)
        if not found:
            return None
        doc, spot = docs[owner], los[owner] + place
        order = np.lexsort((spot, doc))
        new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (spot[order][1:] != spot[order][:-1])]
        age = np.empty(len(order), np.int64)
        age[order] = np.cumsum(new)  # one spot has one age, in however many contexts it stands
        reach = np.zeros(len(order), np.int64)  # the longest repeat at each suffix that is not its earliest occurrence
        for length, a, b in found:
            own = age[a:b]
            part = reach[a:b]
            np.maximum(part, length, out=part, where=own != own.min())
        hit = np.flatnonzero(reach)
        if not len(hit):
            return None
        hit = hit[np.argsort(doc[hit], kind="stable")]
        d, x, y = doc[hit], spot[hit], spot[hit] + reach[hit]
        cuts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        spans = [(d[i], *union(x[i:j], y[i:j])) for i, j in zip(cuts, np.r_[cuts[1:], len(d)])]
        return _table(doc=np.concatenate([np.full(len(lo), own) for own, lo, _ in spans]), lo=np.concatenate([lo for _, lo, _ in spans]), hi=np.concatenate([hi for *_, hi in spans]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def blocks(last: bool):
            nonlocal held, size
            anchor, docs, los = (np.concatenate([h[i] for h in held]) for i in range(3))
            texts = pa.concat_arrays([h[3] for h in held])
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.r_[anchor[1:] != anchor[:-1], last]) + 1  # where an anchor that is whole ends
            at = 0
            while len(cuts) and at < cuts[-1]:
                i = int(np.searchsorted(ends[cuts - 1], (ends[at - 1] if at else 0) + BLOCK))
                if i == len(cuts) and not last:
                    break
                to = int(cuts[min(i, len(cuts) - 1)])
                if (out := block(docs[at:to], los[at:to], texts.slice(at, to - at))) is not None:
                    yield out
                at = to
            held = [(anchor[at:], docs[at:], los[at:], texts.slice(at))]
            size = int(ends[-1] - (ends[at - 1] if at else 0))

        for batch in batches:
            held.append((_long(batch, "anchor"), _long(batch, "doc"), _long(batch, "lo"), _column(batch, "bytes").cast(pa.binary())))
            size += pc.sum(pc.binary_length(held[-1][3])).as_py() or 0
            if size >= BLOCK:
                yield from blocks(False)
        if size:
            yield from blocks(True)

    return run


def _parts(least: int):
    """The parts of each context, with the key of their core in the anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, doc, lo, at, text in zip(*(_column(batch, c).to_pylist() for c in ("anchor", "doc", "lo", "at", "bytes"))):
                out += [(key, doc, lo + x, 0, text[x:y]) for key, x, y in core_parts(text, at, anchor, least)]
            cols = list(zip(*out)) if out else [[]] * 5
            yield _table(anchor=cols[0], doc=cols[1], lo=cols[2], at=cols[3], bytes=pa.array(cols[4], pa.binary()))

    return run


def _windows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, lo, text in zip(*(_column(batch, c).to_pylist() for c in ("doc", "lo", "bytes"))):
                out += [(xxhash.xxh3_128_digest(text[i : i + least]), doc, lo + i) for i in range(len(text) - least + 1)]
            cols = list(zip(*out)) if out else [[]] * 3
            yield _table(window=pa.array(cols[0], pa.binary()), doc=cols[1], lo=cols[2])

    return run


def _cleaned(column: str, spans: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column):
            kept, sizes, removed, counts = [], [], [], []
            own = _column(batch, spans)
            ends = np.cumsum(own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            los, his = (own.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for text, a, b in zip(_binary(batch, column), np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                n = len(text)
                if a == b:
                    kept.append(text)
                    sizes.append(n)
                    removed.append(0)
                    counts.append(0)
                    continue
                lo, hi = union(los[a:b], his[a:b])
                at, parts = 0, []
                for x, y in zip(lo.tolist(), hi.tolist()):
                    parts.append(text[at:x])
                    at = y
                kept.append(b"".join([*parts, text[at:]]))
                sizes.append(n)
                removed.append(int((hi - lo).sum()))
                counts.append(len(lo))
            new = {column: pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), "kept_bytes": pa.array(kept, pa.binary())}
            new |= {k: pa.array(v, pa.int64()) for k, v in (("n_bytes", sizes), ("n_removed", removed), ("n_spans", counts))}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(batch.schema.get_field_index(n)) for n in names], names)

    return run


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc, lo, hi): intervals, which may overlap, whose union is each document's repeated bytes. ``docs``: doc, text."""
    if not 2 * GRAM <= least < 256:
        raise ValueError(f"{2 * GRAM} to 255 bytes")
    spark = docs.sparkSession
    found = docs.mapInArrow(_contexts(least), CONTEXTS)
    few = docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0).mapInArrow(_contexts(least), CONTEXTS).where(F.col("class").isNotNull())
    hot = [r["anchor"] for r in few.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAMPLED_MANY).orderBy(F.desc("n")).limit(MAX_SALTED).collect()]
    if hot:
        hot_table = F.broadcast(spark.createDataFrame([(x, 1) for x in hot], "anchor long, _hot int"))
        salted = found.join(hot_table, "anchor", "left").withColumn("salt", F.when(F.col("_hot") == 1, F.pmod(F.xxhash64("class"), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("long")).drop("_hot")
    else:
        salted = found.withColumn("salt", F.lit(0).cast("long"))
    sorted_ = salted.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "class", "more", "doc", "pos")
    settled = materialize(sorted_.select("salt", "anchor", "class", "more", "doc", "pos", "room").mapInArrow(_classes(), "open long, anchor long, doc long, pos long, lo long, hi long"), "settled")

    opened = settled.where("open = 1")
    own = opened.groupBy("doc").agg(F.collect_list(F.struct("anchor", "pos", "lo", "hi")).alias("own"))
    strings = materialize(docs.dropna(subset=["text"]).join(own, "doc").mapInArrow(_cut_out, STRINGS), "contexts")
    spans = [materialize(settled.where("open = 0").select("doc", "lo", "hi"), "spans")]
    drop_table(spark, settled)
    for cut in (True, False):
        crowded = materialize(strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY).select("anchor"), "crowded")
        usual = strings.join(crowded, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
        spans.append(materialize(usual.mapInArrow(_compared(least), "doc long, lo long, hi long"), "spans"))
        if not crowded.take(1):
            break
        many = strings.join(crowded, "anchor", "left_semi")
        if cut:
            strings = materialize(many.mapInArrow(_parts(least), STRINGS), "parts")
        else:
            windows = materialize(many.mapInArrow(_windows(least), "window binary, doc long, lo long"), "windows")
            firsts = windows.groupBy("window").agg(F.min(F.struct("doc", "lo")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("window", "first")
            later = windows.join(firsts, "window").where((F.col("doc") != F.col("first.doc")) | (F.col("lo") != F.col("first.lo")))
            spans.append(materialize(later.select("doc", "lo", (F.col("lo") + least).alias("hi")), "spans"))
    return reduce(DataFrame.union, spans)


def _numbered(docs: DataFrame, doc: str, text: str, name: str) -> DataFrame:
    """Adds ``name``, a number for each row: its ``doc``, or, where texts share one, their rank by it and the text's hash."""
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    several = docs.groupBy(doc).agg(F.min(digest).alias("_a"), F.max(digest).alias("_b")).where("_a <> _b")
    if not several.take(1):
        return docs.withColumn(name, F.col(doc))
    # Numbers that rise with the partitions of a range-partitioned order.
    a, b, mine = (fresh(docs, n) for n in ("_key", "_digest", "_own_digest"))
    pairs = docs.select(F.col(doc).alias(a), digest.alias(b)).distinct().orderBy(a, b)
    ranks = materialize(pairs.withColumn(name, F.monotonically_increasing_id()), "ranks")
    return docs.withColumn(mine, digest).join(ranks, (F.col(doc) == F.col(a)) & (F.col(mine) == F.col(b))).select(*docs.columns, name)


def dedup_substrings(docs: DataFrame, least: int = LEAST, key: str = "doc_id", column: str = "text") -> DataFrame:
    """The documents with repeated bytes taken out, and ``kept_bytes``, ``n_bytes``, ``n_removed`` and ``n_spans``.

    Where a cut splits a character, ``kept_bytes`` has its bytes that stay, and
    the text leaves them out.
    """
    added = ["kept_bytes", "n_bytes", "n_removed", "n_spans"]
    docs = docs.drop(*added)
    as_long, number, mine, doc = (fresh(docs, n) for n in ("_as_long", "_number", "_spans", "_doc"))
    # A null key sorts first, as one document of its own.
    keyed = docs.withColumn(as_long, F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))))
    numbered = _numbered(keyed, as_long, column, number).drop(as_long)
    spans = repeated_spans(numbered.select(F.col(number).alias("doc"), F.col(column).alias("text")), least)
    lists = spans.groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("lo", "hi")).alias(mine))
    out = T.StructType([*docs.schema.fields, *(T.StructField(n, T.BinaryType() if n == "kept_bytes" else T.LongType()) for n in added)])
    return numbered.join(lists, F.col(number) == F.col(doc), "left").drop(doc, number).mapInArrow(_cleaned(column, mine, out.names), out)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, 100).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
