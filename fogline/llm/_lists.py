"""Pairs of the items of a list (all under one key) by 64-bit sketches, inside the task that reads the list.

A sketch holds one bit of each of 64 coordinates of a MinHash signature. Of two items at similarity s, (1 + s) / 2 of the bits
agree on average: at 0.75 fewer than 45 do in one of 10,000 cases, while items that share a key by chance stay near 36. So
chance costs a comparison of two numbers where the list lies, and no row; only pairs that pass are made.

Most keys occur once. Postings therefore travel in blocks, a row for a bucket of keys with as many bytes as the postings need, and
the task that reads a bucket sorts only those whose key occurs again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bits of two sketches that must agree.
ENOUGH = 45
#: An item close to no more than so many others of its list is paired with each of them, any other with the closest of so many.
CENTRES = 8
#: Lists up to this length are compared whole; of longer ones and of dense parts, the rest is compared once components are known.
WHOLE = 4096
#: Rows of a list that a task holds, groups of close items that are taken out of a list one by one, rows compared at once.
HELD, GROUPS, BLOCK = 1 << 16, 64, 256
#: Postings of a bucket from which keys with very many of them are read in parts; values times rows compared exactly at once.
BUCKET, CELLS = 1 << 21, 1 << 23
MET = "a long, b long, token long, doc long, sketch long"
POSTED = "bucket int, keys binary, docs binary, sketches binary, led binary"
_NONE = np.zeros(0, dtype=np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """One number per signature: low bits of its coordinates, then the next bits if there are fewer than 64."""
    bits = np.stack([(sig[:, i % sig.shape[1]] >> np.uint32(i // sig.shape[1])) & np.uint32(1) for i in range(64)], axis=1)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64).ravel()


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 64 - np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int8)


def close_pairs(sketch: np.ndarray, most: int = CENTRES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (x, y) of all close pairs of which one has at most ``most`` close items, and the mask of items with more."""
    dense, xs, ys = np.zeros(len(sketch), dtype=bool), [_NONE], [_NONE]
    for i in range(0, len(sketch), BLOCK):
        close = agreement(sketch[i : i + BLOCK, None], sketch[None, :]) >= ENOUGH
        row = np.arange(len(close))
        close[row, i + row] = False
        degree = close.sum(axis=1)
        dense[i : i + BLOCK] = degree > most
        x, y = np.nonzero(close & (degree <= most)[:, None])
        xs.append(x + i)
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys), dense


def centre_groups(sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of close items, taken out one after another: places of the centres, of the others, and each one's closest centre.
    What is left after ``GROUPS`` groups is not grouped."""
    left = np.arange(len(sketch))
    for _ in range(GROUPS):
        if len(left) < 2:
            return
        inside = agreement(sketch[left], sketch[left[0]]) >= ENOUGH
        group, left = left[inside], left[~inside]
        centres, rest = group[:CENTRES], group[CENTRES:]
        yield centres, rest, centres[agreement(sketch[rest, None], sketch[None, centres]).argmax(axis=1)] if len(rest) else _NONE


def centre_pairs(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y): every item with the closest centre of its group, centres with one another. Grows with the list."""
    xs, ys = [_NONE], [_NONE]
    for centres, rest, best in centre_groups(sketch):
        x, y = np.triu_indices(len(centres), 1)
        xs += [centres[x], rest]
        ys += [centres[y], best]
    return np.concatenate(xs), np.concatenate(ys)


def leads(keys: np.ndarray, node: np.ndarray, sketch: np.ndarray, longest: int) -> np.ndarray:
    """For every key (items x keys) the centre that stands for the item in lists longer than ``longest`` of these items, the item
    itself if it is one, -1 where there is none."""
    bands = keys.shape[1]
    flat, order = keys.ravel(), np.argsort(keys, axis=None, kind="stable")
    starts = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1])) if len(flat) else _NONE
    sizes = np.diff(np.append(starts, len(flat)))
    out = np.full(len(flat), -1, dtype=np.int64)
    some = np.zeros(len(flat), dtype=bool)
    for at in np.flatnonzero(sizes > longest):
        place = order[starts[at] : starts[at] + sizes[at]]
        owner = place // bands
        by_node = np.argsort(node[owner], kind="stable")
        place, owner = place[by_node], owner[by_node]
        for centres, rest, best in centre_groups(sketch[owner]):
            if len(rest):
                out[place[centres]], out[place[rest]] = node[owner[centres]], node[owner[best]]
                some[place[centres]] = some[place[rest]] = True
    return out, some


def _rows(a: np.ndarray = _NONE, b: np.ndarray = _NONE, token: np.ndarray = _NONE, doc: np.ndarray = _NONE, sketch: np.ndarray = _NONE) -> pa.RecordBatch:
    pairs, rows = pa.nulls(len(a), pa.int64()), pa.nulls(len(doc), pa.int64())
    columns = [*(pa.concat_arrays([pa.array(x), rows]) for x in (a, b)), *(pa.concat_arrays([pairs, pa.array(x)]) for x in (token, doc, sketch))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "token", "doc", "sketch"])


def _lists(token: np.ndarray, doc: np.ndarray, sketch: np.ndarray, led: np.ndarray, parted: np.ndarray, small: int, whole: int) -> pa.RecordBatch:
    """Pairs and dense rows of whole lists, sorted by token and doc; ``parted`` marks rows of lists of which more was or comes."""
    starts = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])))
    led, parted = (np.maximum.reduceat(x, starts) for x in (led, parted))
    token, doc, sketch = token[starts], doc[starts], sketch[starts]
    starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    sizes = np.diff(np.append(starts, len(token)))
    open_ended = np.maximum.reduceat(led | parted, starts).astype(bool)
    dense, xs, ys = np.repeat(open_ended, sizes), [_NONE], [_NONE]
    for size in range(2, small + 1):
        rows = starts[sizes == size][:, None] + np.arange(size)
        for i in range(size):
            for j in range(i):
                close = agreement(sketch[rows[:, i]], sketch[rows[:, j]]) >= ENOUGH
                xs.append(rows[close, i])
                ys.append(rows[close, j])
    for at in np.flatnonzero(sizes > small):
        a, n = starts[at], sizes[at]
        part = np.arange(a, a + n)
        if n <= whole and not open_ended[at]:
            x, y, many = close_pairs(sketch[part])
            dense[part] = many
            xs.append(part[x])
            ys.append(part[y])
            part = part[many]
        else:
            dense[part] = True
        x, y = centre_pairs(sketch[part])
        xs.append(part[x])
        ys.append(part[y])
    x, y = np.concatenate(xs), np.concatenate(ys)
    return _rows(np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y]), token[dense], doc[dense], sketch[dense])


def meet(small: int, whole: int = WHOLE):
    """From (token, doc, sketch, lead) in order of token and doc: pairs (a, b) to confirm, and rows (token, doc, sketch) of the
    items that have more close ones in their list than they are paired with. An item with a lead stands apart from its list,
    which may be spread over tasks; a list that does not fit is read in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, going = [_NONE] * 5, None
        for batch in batches:
            lead = batch.column(3)
            has = np.asarray(lead.is_valid())
            token, doc, sketch, lead = (np.asarray(c) for c in (*batch.columns[:3], lead.fill_null(0)))
            apart = has & (lead != doc)
            if apart.any():
                a, b = lead[apart], doc[apart]
                yield _rows(np.minimum(a, b), np.maximum(a, b), token[apart], b, sketch[apart])
            heads = [token, doc, sketch, has.astype(np.int64), (token == going).astype(np.int64) if going is not None else np.zeros(len(token), dtype=np.int64)]
            held = [np.concatenate([old, new[~apart]]) for old, new in zip(held, heads, strict=True)]
            token = held[0]
            if not len(token):
                continue
            cut = int(np.searchsorted(token, token[-1]))  # the last list may go on
            if len(token) - cut > HELD:
                held[4][cut:], going, cut = 1, int(token[-1]), len(token)
            if cut:
                yield _lists(*(x[:cut] for x in held), small, whole)
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield _lists(*held, small, whole)

    return run


def _binary(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of the rows, a value from each cut to the next."""
    offsets = (cuts * rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def post(sig: np.ndarray, doc: np.ndarray, sketch: np.ndarray, apart: np.ndarray, led: np.ndarray, per_band: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the keys (items x bands x bytes), but for those that stand apart from their list: a row for a bucket of a band."""
    bucket = np.zeros(sig.shape[:2], dtype=np.uint32)
    for r in range(sig.shape[2]):
        bucket = (bucket ^ sig[:, :, r]) * np.uint32(0x01000193)
    bucket = ((bucket ^ (bucket >> np.uint32(15))) % np.uint32(per_band)).astype(np.int64)
    for band in range(sig.shape[1]):
        at = np.flatnonzero(~apart[:, band])
        at = at[np.argsort(bucket[at, band], kind="stable")]
        names, starts = np.unique(bucket[at, band], return_index=True)
        cuts = np.append(starts, len(at))
        columns = [_binary(x, cuts) for x in (sig[at, band], doc[at], sketch[at], led[at, band].astype(np.uint8))]
        yield pa.RecordBatch.from_arrays([pa.array((band * per_band + names).astype(np.int32)), *columns], names=["bucket", "keys", "docs", "sketches", "led"])


def meet_blocks(small: int, whole: int, width: int, per_band: int, shift: int):
    """``meet`` for blocks in order of their bucket; a token is the key of ``width`` bytes under the number of its band."""

    def entries(bucket: int, keys: bytes, docs: bytes, sketches: bytes, led: bytes) -> list[np.ndarray]:
        token = np.zeros((len(led), 8), dtype=np.uint8)
        token[:, :width] = np.frombuffer(keys, dtype=np.uint8).reshape(-1, width)
        token = token.view("<i8").ravel().astype(np.int64) | (bucket // per_band << shift)
        return [token, np.frombuffer(docs, dtype=np.int64), np.frombuffer(sketches, dtype=np.int64), np.frombuffer(led, dtype=np.uint8).astype(np.int64)]

    def met(rows: list[np.ndarray], parted: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows[0]):
            order = np.lexsort((rows[1], rows[0]))
            yield _lists(*(x[order] for x in rows), parted[order], small, whole)

    def often(token: np.ndarray) -> np.ndarray:
        """How often each token occurs."""
        order = np.argsort(token)
        starts = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1]))
        sizes = np.diff(np.append(starts, len(token)))
        out = np.empty(len(token), dtype=np.int64)
        out[order] = np.repeat(sizes, sizes)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going, parts, held, most, hot = None, [], 0, BUCKET, _NONE

        def joined() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*parts, strict=True)]

        def ended() -> Iterator[pa.RecordBatch]:
            rows = joined()
            parted = np.isin(rows[0], hot)
            some = (often(rows[0]) > 1) | (rows[3] > 0) | parted
            yield from met([x[some] for x in rows], parted[some].astype(np.int64))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != going:
                    if parts:
                        yield from ended()
                    going, parts, held, most, hot = row[0], [], 0, BUCKET, _NONE
                parts.append(entries(*row))
                held += len(parts[-1][0])
                if held > most:
                    rows = joined()
                    many = (often(rows[0]) > HELD) | np.isin(rows[0], hot)
                    hot = np.union1d(hot, rows[0][many])
                    yield from met([x[many] for x in rows], np.ones(many.sum(), dtype=np.int64))
                    parts = [[x[~many] for x in rows]]
                    held = len(parts[0][0])
                    most = max(BUCKET, 2 * held)
        if parts:
            yield from ended()

    return run


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y, each an array of distinct values."""
    own = np.concatenate(list(x))
    values = np.unique(own)
    kind = np.float32 if len(values) < 1 << 24 else np.float64  # whole numbers up to the size of a set
    left = np.zeros((len(x), len(values)), dtype=kind)
    left[np.repeat(np.arange(len(x)), [len(v) for v in x]), np.searchsorted(values, own)] = 1
    out, step = np.zeros((len(x), len(y)), dtype=np.int64), max(1, CELLS // max(1, len(values)))
    for j in range(0, len(y), step):
        part = list(y[j : j + step])
        other, row = np.concatenate(part), np.repeat(np.arange(len(part)), [len(v) for v in part])
        at = np.minimum(np.searchsorted(values, other), len(values) - 1)
        hit = values[at] == other
        right = np.zeros((len(part), len(values)), dtype=kind)
        right[row[hit], at[hit]] = 1
        out[:, j : j + step] = left @ right.T
    return out


def reach(close: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: int) -> np.ndarray:
    """Which of the pairs marked in ``close`` (sets x by sets y) reach the similarity, in hundredths, by their whole sets."""
    out, n, m = np.zeros_like(close), np.array([len(v) for v in x]), np.array([len(v) for v in y])
    close = close & (100 * np.minimum(n[:, None], m[None, :]) >= similarity * np.maximum(n[:, None], m[None, :]))
    some, i = np.flatnonzero(close.any(axis=1)), 0
    while i < len(some):
        sizes = np.cumsum(n[some[i : i + 64]]) * np.arange(1, len(some[i : i + 64]) + 1)
        rows = some[i : i + max(1, int(np.searchsorted(sizes, CELLS)))]
        columns = np.flatnonzero(close[rows].any(axis=0))
        same = _shared(x[rows], y[columns])
        cells = np.ix_(rows, columns)
        out[cells] = close[cells] & (100 * same >= similarity * (n[rows][:, None] + m[columns][None, :] - same))
        i += len(rows)
    return out


def across(closest: int | None, sets: Callable[[pa.Array], list[np.ndarray]] | None = None, similarity: int = 0):
    """From (token, slice, rest, doc, sketch, component) in order of the first three: close pairs (a, b) of different components,
    of an item that comes with ``rest`` = 0 and one with 1. All of them, or of each item its ``closest`` ones in a batch.

    With ``sets``, a further column holds what they are made from, and only pairs are given whose whole sets reach the similarity:
    of an item with each component of a batch one, as links join components."""

    def whole(batch: pa.RecordBatch) -> list[np.ndarray]:
        if sets is None:
            return []
        made = np.empty(len(batch), dtype=object)
        made[:] = sets(batch.column(6))
        return [made]

    def compared(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(x[0]), BLOCK):
            part = [c[i : i + BLOCK] for c in x]
            bits = np.where(part[2][:, None] != y[2][None, :], agreement(part[1][:, None], y[1][None, :]), 0)
            if closest and closest < bits.shape[1]:
                best = np.argpartition(bits, -closest, axis=1)[:, -closest:]
                kept = np.zeros_like(bits)
                np.put_along_axis(kept, best, np.take_along_axis(bits, best, axis=1), axis=1)
                bits = kept
            close = bits >= ENOUGH
            at, to = np.nonzero(close if sets is None else reach(close, part[3], y[3], similarity))
            if sets is not None and len(at):
                order = np.lexsort((y[2][to], at))
                at, to = at[order], to[order]
                fresh = np.append(True, (at[1:] != at[:-1]) | (y[2][to][1:] != y[2][to][:-1]))
                at, to = at[fresh], to[fresh]
            yield part[0][at], y[0][to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, minors = None, []
        for batch in batches:
            if not len(batch):
                continue
            token, piece, rest, *row = (np.asarray(c) for c in batch.columns[:6])
            row += whole(batch)
            new = (token[1:] != token[:-1]) | (piece[1:] != piece[:-1]) | (rest[1:] != rest[:-1])
            starts = np.flatnonzero(np.append(True, new))
            for a, b in zip(starts, np.append(starts[1:], len(token)), strict=True):
                if key != (key := (token[a], piece[a])):
                    minors = []
                if not rest[a]:
                    minors.append([c[a:b] for c in row])
                elif minors:
                    minors = [[np.concatenate(c) for c in zip(*minors, strict=True)]]
                    for x, y in compared(minors[0], [c[a:b] for c in row]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run
