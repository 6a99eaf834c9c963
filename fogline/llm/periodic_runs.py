"""Maximal periodic runs of words, found through Lyndon arrays on an ordered alphabet.

Every run of a text whose length is at least twice its period holds, for one of the two orders of its words, a Lyndon word of
the length of that period which is the longest one at its place. So both Lyndon arrays name a candidate for every run: the
stretch from a word to its next smaller suffix. The scan that builds an array compares suffixes, and keeps how far they
agree: a comparison inside a stretch that has been matched before is read off its earlier copy and only goes on where that
match ended, and one with a further ancestor follows from the two comparisons beside it. Neither suffix arrays nor hashes of
text are used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run spans at least MIN_WORDS words and MIN_PERIODS periods.
MIN_WORDS, MIN_PERIODS = 24, 3

RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])
_ARROW_RUNS = pa.list_(pa.struct([pa.field(c, pa.int64()) for c in ("start", "length", "period")]))


def _agree(t: list[int], a: int, b: int) -> int:
    """How many words agree from a and from b > a on; the last item of ``t`` is an end mark that equals no word."""
    if t[a] != t[b]:
        return 0
    start, step = b, 1
    while t[a : a + step] == t[b : b + step]:  # doubling slices; the end mark stops them at the latest
        a, b, step = a + step, b + step, min(2 * step, 4096)
    while t[a] == t[b]:
        a, b = a + 1, b + 1
    return b - start


def next_smaller_suffixes(t: list[int]) -> tuple[list[int], list[int]]:
    """For every place the next one whose suffix is smaller, and how many words both suffixes share.

    ``t`` ends in a mark below all words. A place whose suffix is the smallest so far has the place of the mark, and 0. From
    left to right, the places that may still find a smaller suffix are a chain of ancestors: each is the previous smaller
    suffix of the one before. A place is compared along this chain until it meets a smaller suffix; all it passes have found theirs.
    """
    n = len(t) - 1
    smaller, shared = [n] * n, [0] * n  # to the right
    parent, common = [-1] * n, [0] * n  # to the left
    x, y, end = 0, 0, 0  # t[x : x + end - y] == t[y : end], with the rightmost end so far
    for i in range(1, n):
        here, j, before = t[i], i - 1, -1
        same = 0
        while j >= 0:
            if t[j] != here:
                same, known = 0, True
            elif before >= 0 and same != common[before]:
                same, known = min(same, common[before]), True  # of three suffixes, the two least agreements are equal
            else:
                known = False
                same = same if before >= 0 else 0
                if i < end and j >= y:  # the pair lies in a stretch that equals an earlier one
                    d = y - x
                    copy = shared[j - d] if smaller[j - d] == i - d else common[i - d] if parent[i - d] == j - d else 0
                    if copy < end - i:
                        same = max(same, copy)
                    else:
                        same = max(same, end - i)
            if not known:
                same += _agree(t, j + same, i + same)
                if i + same > end:
                    x, y, end = j, i, i + same
            if t[j + same] < t[i + same]:
                parent[i], common[i] = j, same
                break
            smaller[j], shared[j] = i, same
            before, j = j, parent[j]
    return smaller, shared


def _runs_in(words: list[int], least: int, periods: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of every run of one stretch of words."""
    n, found = len(words), set()
    for t in ([*words, -1], [*[-w for w in words], -n]):  # ranks, and ranks turned round, each with an end mark below them
        smaller, shared = next_smaller_suffixes(t)
        for i in range(n):
            j, right = smaller[i], shared[i]
            p = j - i
            if right < p or (i >= p and smaller[i - p] == i and shared[i - p] >= p):  # only the first root of a run counts
                continue
            left = 0
            while left < p and i - left > 0 and t[i - left - 1] == t[j - left - 1]:
                left += 1
            length = p + left + right
            if length >= least and length >= periods * p:
                found.add((i - left, length, p))
    return found


def _stretches(words: list, least: int, periods: int) -> Iterator[tuple[int, int]]:
    """Maximal stretches that may hold a run: each word of a run occurs in it once a period, so text is cut at words that are
    too rare in their stretch, until none is."""
    todo = [(0, len(words))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        part = words[a:b]
        counts = Counter(part)
        rare = [k for k, w in enumerate(part, a) if counts[w] < periods]
        if not rare:
            yield a, b
            continue
        cuts = [a - 1, *rare, b]
        todo.extend((s + 1, e) for s, e in zip(cuts[:-1], cuts[1:], strict=True) if e - s - 1 >= least)


def runs(words: list, least: int = MIN_WORDS, periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all maximal runs of at least ``least`` words and ``periods`` periods, by start, then
    period. Words may be any values with an order. ``periods`` is at least 3: then a run holds its first root and its copy."""
    if periods < 3:
        raise ValueError("runs of fewer than three periods are not reported")
    found: list[tuple[int, int, int]] = []
    for a, b in _stretches(words, least, periods):
        part = words[a:b]
        rank = {w: k for k, w in enumerate(sorted(set(part)))}
        found += [(a + s, length, p) for s, length, p in _runs_in([rank[w] for w in part], least, periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list, found: list[tuple[int, int, int]]) -> list:
    """Words that no run contains after its first period."""
    if not found:
        return words
    gone = bytearray(len(words))
    for start, length, period in found:
        gone[start + period : start + length] = b"\x01" * (length - period)
    return [w for w, g in zip(words, gone, strict=True) if not g]


def collapse_runs(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least: int = MIN_WORDS, periods: int = MIN_PERIODS, rewrite: Callable[[int | None, list], list] | None = None
) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period in words, by start, then period) and ``collapsed`` (the words that
    no run contains after its first period, joined by one space). Columns of these names are replaced; all others stay.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text and are compared byte for byte. ``rewrite`` may change the words of a row
    before, given its id. Null and empty texts, and those of white space, have no run and collapse to an empty string. Rows are
    independent: repeated rows and ids, null ids and empty tables need no care. A text is scanned in time that grows with its
    length, in one task, with some hundred bytes of memory a word; nothing is shuffled.
    """
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rest = docs.select(*[F.col(f"`{c}`") for c in names])
    carried = rest.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    schema = T.StructType([carried.schema["row"], T.StructField("runs", T.ArrayType(RUN, False), False), T.StructField("collapsed", T.StringType(), False)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans, texts = [], []
                for key, text in zip(part["id"].to_pylist(), part["text"], strict=True):
                    words = (text.as_py() or b"").split()  # bytes are split at exactly these six characters
                    words = words if rewrite is None else rewrite(key, words)
                    found = runs(words, least, periods)
                    spans.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(b" ".join(kept_words(words, found)).decode())
                yield pa.RecordBatch.from_arrays([part["row"], pa.array(spans, _ARROW_RUNS), pa.array(texts, pa.string())], ["row", "runs", "collapsed"])

    return carried.mapInArrow(scan, schema).select("row.*", "runs", "collapsed")
