"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to a share of its length in edits. Cut into one piece more than that budget, at
least one piece of it is untouched by any such occurrence. So the pieces of all items are looked up exactly in the document
text, and around every hit the whole item is compared by Myers' bit-parallel edit distance. A count of common 4-grams, which
k edits can lower by at most 4k, spares most comparisons.

Items of up to BLOCK_CHARS characters, which are counted first, go to the tasks, and documents are matched where they are read.
More items than that stay a table: a filter of fixed size says which stretches of a text can be a piece at all, the hashes of
these are joined with the hashes of the pieces, and the stretches around them with the items. Both ways give the same rows,
and neither bounds the number of items.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogline.llm import _text as X
from fogline.llm._scratch import Scratch

#: Edits allowed, in hundredths of the item's length.
EDIT_PERCENT = 8
#: Characters of items that may travel to the tasks; more items than that are joined.
BLOCK_CHARS = 4_000_000
GRAM = 4
#: Bits of the filter of piece hashes, 4 MB whatever the number of items: a full filter only lets more rows through to the join.
FILTER_BITS = 1 << 25
#: Characters of texts whose stretches are hashed together, and items that are looked for in a text together.
HASHED_CHARS, ITEM_SHARE = 1 << 20, 1 << 16
_BETWEEN = np.uint32(0x110000)  # no character

Items = tuple[tuple[int, str], ...]


def normal(text: str) -> str:
    """Lower case, and one space for every run of white space."""
    return " ".join(text.lower().split())


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """Budget + 1 pieces of nearly equal length, with their offsets. Short texts give fewer: no piece is empty."""
    parts = min(budget + 1, len(text))
    cuts = [len(text) * j // parts for j in range(parts + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_match(pattern: str, masks: dict[str, int], text: str, budget: int) -> tuple[int, int] | None:
    """Smallest distance of the pattern to any stretch of the text, and the first end of such a stretch; None over budget."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = budget + 1, -1
    if score < best:
        best, at = score, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        high = (down | ~(xh | up)) & full
        low = up & xh
        if high & top:
            score += 1
        elif low & top:
            score -= 1
        high = (high << 1) & full
        low = (low << 1) & full
        up = low | (~(xv | high) & full)
        down = high & xv
        if score < best:
            best, at = score, i
    return (best, at) if best <= budget else None


def char_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


class Item:
    """A text of an item, ready to be compared."""

    def __init__(self, item_id: int, text: str, percent: int):
        self.item_id, self.text, self.budget = item_id, text, len(text) * percent // 100
        self.masks, self.back = char_masks(text), char_masks(text[::-1])
        self.grams = Counter(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))

    def best_in(self, window: str, at: int) -> tuple[int, int, int] | None:
        """(distance, start, end) of the nearest stretch of a window that begins at ``at``; None over budget."""
        need = len(self.text) - GRAM + 1 - GRAM * self.budget
        if need > 0:
            here = Counter(window[i : i + GRAM] for i in range(len(window) - GRAM + 1))
            if sum(min(n, here.get(g, 0)) for g, n in self.grams.items()) < need:
                return None
        hit = best_match(self.text, self.masks, window, self.budget)
        if not hit:
            return None
        distance, end = hit
        reverse = best_match(self.text[::-1], self.back, window[:end][::-1], distance)
        return distance, at + end - (reverse[1] if reverse else len(self.text)), at + end


def windows(starts: Iterator[int], m: int, budget: int, size: int) -> list[tuple[int, int]]:
    """Stretches of a text of ``size`` that hold whatever begins about ``starts``; stretches that touch are one."""
    out: list[tuple[int, int]] = []
    for s in sorted(starts):
        a, b = max(0, s - budget), min(size, s + m + budget)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


class Matcher:
    """Items of one block, ready to be looked up."""

    def __init__(self, items: Items, percent: int):
        self.items, owners = [], defaultdict(list)  # an id may stand for several texts
        for item_id, raw in items:
            item = Item(item_id, normal(raw), percent)
            if item.text:
                for offset, piece in pieces(item.text, item.budget):
                    owners[piece].append((len(self.items), offset))
                self.items.append(item)
        self.find = ahocorasick.Automaton() if owners else None
        for piece, own in owners.items():
            self.find.add_word(piece, (len(piece), own))
        if owners:
            self.find.make_automaton()

    def matches(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of every item found, places in the normal text.

        Of several texts of an item the one with the smallest distance counts, then the first place.
        """
        if not raw or self.find is None:
            return []
        text = normal(raw)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, own) in self.find.iter(text):
            for key, offset in own:
                starts[key].add(end - length + 1 - offset)
        nearest: dict[int, tuple[int, int, int]] = {}
        for key, places in starts.items():
            item = self.items[key]
            for a, b in windows(places, len(item.text), item.budget, len(text)):
                hit = item.best_in(text[a:b], a)
                if hit:
                    nearest[item.item_id] = min(hit, nearest.get(item.item_id, hit))
        return [(item, *best) for item, best in sorted(nearest.items())]


@lru_cache(maxsize=2)
def matcher(items: Items, percent: int) -> Matcher:
    return Matcher(items, percent)


_FOUND = "array<struct<item_id: long, distance: int, start: long, end: long>>"


def _found_in(items: Items, percent: int, text: Column) -> Column:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(_FOUND)
    def run(column: pa.Array) -> pa.Array:
        m = matcher(items, percent)
        rows = ([{"item_id": k, "distance": d, "start": s, "end": e} for k, d, s, e in m.matches(x.as_py())] for x in column)
        return pa.array(list(rows), kind)

    return run(text)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _cut(percent: int):
    """From (key, id, text), the pieces of every text: (hash, chars, key, place, m)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = normal(raw)
                for offset, piece in pieces(text, len(text) * percent // 100) if text else []:
                    rows.append((int(X.window_hashes(_points(piece), len(piece)).view(np.int64)[0]), len(piece), key, offset, len(text)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["hash", "chars", "key", "place", "m"])

    return run


def _stretches(bits: np.ndarray, lengths: list[int]):
    """From (k1, k2, text), the stretches of a text that the filter lets through: (k1, k2, hash, places)."""
    mask = np.uint64(len(bits) * 64 - 1)

    def looked_up(keys: list[tuple[int, int]], texts: list[str]) -> pa.RecordBatch:
        data = np.concatenate([np.append(_points(t), _BETWEEN) for t in texts])
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        found = []
        for k in lengths:
            hashes = X.window_hashes(data, k)
            at = hashes & mask
            some = np.flatnonzero((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
            doc = np.searchsorted(begins, some, "right") - 1
            found.append((doc, hashes[some].view(np.int64), some - begins[doc]))
        doc, value, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, value, doc))
        doc, value, place = doc[order], value[order], place[order]
        fresh = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))) if len(doc) else np.zeros(0, dtype=np.int64)
        places = pa.ListArray.from_arrays(pa.array(np.append(fresh, len(doc)).astype(np.int32)), pa.array(place.astype(np.int32)))
        pairs = np.array(keys, dtype=np.int64).reshape(-1, 2)[doc[fresh]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(value[fresh]), places], names=["k1", "k2", "hash", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, size = [], [], 0
            for k1, k2, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = normal(raw.as_py())
                keys.append((k1.as_py(), k2.as_py()))
                texts.append(text)
                size += len(text) + 1
                if size >= HASHED_CHARS:
                    yield looked_up(keys, texts)
                    keys, texts, size = [], [], 0
            if texts:
                yield looked_up(keys, texts)

    return run


def _around(percent: int):
    """From (k1, k2, text, asked), the stretches to compare: (k1, k2, key, at, window)."""
    names = ["k1", "k2", "key", "at", "window"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, raw, asked in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, rows = normal(raw.as_py()), []
                for ask in asked.as_py():
                    m = ask["m"]
                    rows += [(k1.as_py(), k2.as_py(), ask["key"], a, text[a:b]) for a, b in windows(set(ask["starts"]), m, m * percent // 100, len(text))]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _compared(percent: int):
    """From (k1, k2, item_id, text, at, window), what is near enough: (k1, k2, item_id, distance, start, end)."""
    names = ["k1", "k2", "item_id", "distance", "start", "end"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = lru_cache(maxsize=1024)(lambda item_id, raw: Item(item_id, normal(raw), percent))
        for batch in batches:
            rows = []
            for k1, k2, item_id, raw, at, window in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hit = ready(item_id, raw).best_in(window, at)
                if hit:
                    rows.append((k1, k2, item_id, *hit))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _joined(texts: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(k1, k2, matches) of the texts (k1, k2, text) that hold an item of the table (id, text). Equal texts are matched once."""
    scratch = Scratch(texts.sparkSession, "pieces")
    items = scratch.write(items.select(F.monotonically_increasing_id().alias("key"), "id", "text"), "items")
    cut = scratch.write(items.mapInArrow(_cut(percent), "hash long, chars int, key long, place int, m int"), "cut")
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    held = cut.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    for row in held.toLocalIterator():  # at most FILTER_BITS / 64 rows
        bits[row["word"]] = row["bits"]
    lengths = sorted(r["chars"] for r in cut.select("chars").distinct().collect())  # pieces are about 100 / percent characters long
    if not lengths:
        return texts.select("k1", "k2", F.array().cast(_FOUND).alias("matches")).limit(0)

    hits = texts.mapInArrow(_stretches(bits.view(np.uint64), lengths), "k1 long, k2 long, hash long, places array<int>")
    hits = scratch.write(hits.dropDuplicates(["k1", "k2", "hash"]), "hits")
    shares = max(1, -(-items.count() // ITEM_SHARE))
    starts = hits.join(cut, "hash").select("k1", "k2", "key", "m", F.transform("places", lambda p: p - F.col("place")).alias("starts"))
    asked = starts.groupBy("k1", "k2", "key", "m").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))  # places of one text
    asked = asked.groupBy("k1", "k2", F.pmod(F.xxhash64("key"), F.lit(shares)).alias("share")).agg(F.collect_list(F.struct("key", "m", "starts")).alias("asked"))
    asked = scratch.write(asked, "asked")
    wanted = scratch.sized(asked.select(F.col("k1").alias("w1"), F.col("k2").alias("w2")).distinct())
    near = texts.join(wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left_semi").dropDuplicates(["k1", "k2"])
    around = near.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked").mapInArrow(_around(percent), "k1 long, k2 long, key long, at int, window string")
    pairs = around.join(items, "key").select("k1", "k2", "id", "text", "at", "window")
    found = pairs.mapInArrow(_compared(percent), "k1 long, k2 long, item_id long, distance int, start long, end long")
    best = found.groupBy("k1", "k2", "item_id").agg(F.min(F.struct("distance", "start", "end")).alias("best"))
    rows = best.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("item_id", "best.distance", "best.start", "best.end"))).alias("matches"))
    return scratch.write(rows, "found")


def with_matches(docs: DataFrame, items: DataFrame, text_col: str = "text", percent: int = EDIT_PERCENT, name: str = "matches", id_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a column of all items found: array of item_id, distance, start, end (places in the normal text), by item_id.

    Items with a null id, null or blank texts match nothing; a column of ``docs`` with the name is replaced.
    """
    X.batches_by_bytes(docs.sparkSession)
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("id is not null and trim(text) <> ''").distinct()
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    text = F.col(f"`{text_col}`").cast("string")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    if chars <= block_chars:
        held = tuple(sorted((r["id"], r["text"]) for r in rows.collect()))  # bounded by block_chars
        return docs.select(*kept, _found_in(held, percent, text).alias(name))
    keyed = docs.select(F.struct(*kept).alias("row"), text.alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"))
    found = _joined(keyed.where("text is not null").select(F.col("d1").alias("k1"), F.col("d2").alias("k2"), "text"), rows, percent)
    joined = keyed.join(found, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")) & F.col("text").isNotNull(), "left")
    return joined.select("row.*", F.coalesce("matches", F.array().cast(_FOUND)).alias(name))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = EDIT_PERCENT) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, start, end, contaminated (true).

    Null and empty texts hold nothing; texts of any length are matched whole. Rows that repeat an id are matched each. Of
    occurrences as near as each other the first is reported. Empty tables give an empty result. Items that share a text are all reported. Of
    several texts under one id each is matched, and the best match is reported. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = with_matches(rows, items, percent=percent).where(F.size("matches") > 0)
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.start", "m.end", F.lit(True).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", percent: int = EDIT_PERCENT) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return with_matches(row, items, percent=percent).where(F.size("matches") == 0).select("row.*")
