"""Fuzzy line deduplication by MinHash.

Lines are compared after trimming, with white space runs as one space and A-Z lower-cased. A line's set is its character
shingles (a shorter line is one shingle); equal lines are one node from the start. Signatures are cut into bands, a key per
band lists the lines that may be alike, candidates are confirmed by exact Jaccard similarity of the whole sets, and one line
of each connected component stays: the first by document and place.

With bands of five values and sixteen bands, a pair at 0.75 is met with probability 0.987, at 0.8 with 0.998. One edit of a
line changes as many shingles as a shingle has characters, so shingles are short: at five, a line of 40 characters
whose shingles all differ keeps 0.75 after any one edit.

Lines of one language are somewhat alike, so in a large table many lines share a band by chance, and such pairs grow with the
square of the table. Every posting therefore carries a sketch of 64 bits, and a list is compared where it lies: what meets by
chance never becomes a row. Links are found in two waves with components formed between them:

1. an item close to few others of its list with all of them, an item in a dense part with the closest of some centres: these pairs
   become rows and are confirmed;
2. in dense lists that are still several components, the items outside the largest one with all close items of other components,
   so that no pair is left out: their lines come to the list and are compared there, and only links become rows.

A list of very many items apart is posted again under longer keys before that: the band and some further coordinates, the more
the longer the list, and as many such keys as it takes for a pair at 0.75 to meet with probability 0.995.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogline.llm import _text as X
from fogline.llm._components import connected_components, relabelled
from fogline.llm._linking import merged
from fogline.llm._lists import MET, POSTED, WHOLE, across, leads, meet, meet_blocks, post, sketches
from fogline.llm._scratch import BROADCAST_KEYS, Scratch
from fogline.llm.near_dedup import signature_seeds, signatures

SHINGLE_CHARS, SIMILARITY, BANDS, BAND_ROWS = 5, 75, 16, 5
#: Lists of up to so many lines are compared pair by pair.
SMALL_LIST = 8
#: Rows of a dense list that a task compares with the items apart from it.
SLICE = 1 << 14
#: Most coordinates that a longer key adds to a band, and the share of pairs at the similarity that such keys may miss.
DEEPEST, MISSED = 10, 0.005
#: Lines whose keys a task holds at once, and lines that it remembers as seen.
HELD_LINES, SEEN_LINES = 1 << 16, 1 << 18
#: Lines whose keys of a band make a bucket, and most buckets of a band.
BUCKET_LINES, BUCKETS = 1 << 15, 1 << 10
#: Where the number of a band stands in a key; below it are up to six bytes of coordinates.
BAND_SHIFT = 48
_NEWLINE = 10
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = True


def tidy_lines(chunk: X.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tidied lines, start and end of every line that is not blank, its document and its number there."""
    data, offsets = X.lower_ascii(chunk.data), chunk.offsets
    blank, line_end = _BLANK[data], data == _NEWLINE
    opens = np.zeros(len(data), dtype=bool)  # nothing of the line stands before
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    opens[1:] |= line_end[:-1]
    after_blank = np.zeros(len(data), dtype=bool)
    after_blank[1:] = blank[:-1]
    keep = ~(blank & (opens | after_blank))
    kept = np.concatenate([[0], np.cumsum(keep)])
    text, offsets = np.where(blank, 32, data)[keep].astype(np.uint8), kept[offsets]
    ends = text == _NEWLINE
    starts, stops, per_doc = _lines(ends, offsets)
    full = stops > starts
    trail = np.zeros(len(starts), dtype=np.int64)
    trail[full] = text[stops[full] - 1] == 32
    stops = stops - trail
    doc = np.repeat(np.arange(len(chunk)), per_doc)
    number = np.arange(len(starts)) - np.repeat(np.concatenate([[0], np.cumsum(per_doc)])[:-1], per_doc)
    some = stops > starts
    return text, starts[some], stops[some], doc[some], number[some]


def _lines(ends: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and lines per document; a document without text is one empty line."""
    at = np.flatnonzero(ends)
    per_doc = np.diff(np.searchsorted(at, offsets)) + 1
    total = int(per_doc.sum())
    last = np.cumsum(per_doc) - 1
    stops = np.empty(total, dtype=np.int64)
    inner = np.ones(total, dtype=bool)
    inner[last] = False
    stops[inner] = at
    stops[last] = offsets[1:]
    starts = np.empty(total, dtype=np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    starts[1:] = stops[:-1] + 1
    starts[first] = offsets[:-1]
    return starts, stops, per_doc


def _points(text: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the bytes, and the spans in them."""
    lead = (text & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])
    points = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) != at[-1]:  # not valid UTF-8: bytes stand for characters
        return text.astype(np.uint32), starts, stops
    return points, at[starts], at[stops]


def line_shingles(text: np.ndarray, starts: np.ndarray, stops: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of every line, one after another, and their number per line."""
    points, a, b = _points(text, starts, stops)
    per = np.maximum(b - a - k + 1, 1)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    windows = X.window_hashes(points, k)
    out = np.zeros(int(per.sum()), dtype=np.uint64)
    if len(windows):
        at = np.arange(len(out)) - np.repeat(first - a, per)
        np.take(windows, np.minimum(at, len(windows) - 1), out=out)
    short = b - a < k
    if short.any():
        ends = np.cumsum((b - a)[short])
        starts = ends - (b - a)[short]
        packed = points[np.arange(ends[-1]) + np.repeat(a[short] - starts, ends - starts)]
        out[first[short]] = X.span_hashes(packed, starts, ends)
    return out, per


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple]:
    ids = np.asarray(batch.column(0).fill_null(0))
    for chunk in X.chunks(batch.column(1)):
        text, starts, stops, doc, number = tidy_lines(chunk)
        if len(starts):
            yield text, starts, stops, ids[chunk.first + doc], number, X.span_hashes(text, starts, stops).view(np.int64)


def _distinct_lines(starts: np.ndarray, stops: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, at = np.unique(node, return_index=True)
    return starts[at], stops[at], node[at]


def _packed(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number per band (lines x bands) from the bytes of its coordinates."""
    out = np.zeros((len(sig), bands), dtype=np.int64)
    for r in range(rows):
        out |= sig[:, r::rows].astype(np.int64) << (8 * r)
    return out


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """The low bytes of all coordinates (lines x width) of a signature column without nulls."""
    column = column.cast(pa.binary(width))
    return np.frombuffer(column.buffers()[1], dtype=np.uint8)[column.offset * width :][: len(column) * width].reshape(-1, width)


def _profile(k: int, bands: int, rows: int):
    """Every line that is not blank: node (hash of the tidied line), doc_id, line. The first time that a task meets a line,
    also its signature (a byte per coordinate), its sketch, and where many close lines met at about that time
    share a band, a centre of them: such lists are merged here, before the shuffle, however often a band's values occur."""
    seeds = signature_seeds(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            node, doc, number, first, sig, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            lead, some = leads(_packed(sig, bands, rows) | (np.arange(bands) << BAND_SHIFT), node[first], sketch, SMALL_LIST)
            lead, some = lead.reshape(-1, bands), some.reshape(-1, bands)
            led = some.any(axis=1)
            has = np.zeros(len(node), dtype=bool)
            has[np.flatnonzero(first)[led]] = True
            offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
            starts = pa.array(offsets, mask=np.append(~has, False))  # no list where there is no offset
            lists = pa.ListArray.from_arrays(starts, pa.array(lead[led].ravel(), mask=~some[led].ravel()))
            bits = np.zeros(len(node), dtype=np.int64)
            bits[first] = sketch
            known = pa.array(np.where(first, np.cumsum(first) - 1, 0), mask=~first)
            bytewise = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bands * rows), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary()).take(known)
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (node, doc, number)), pa.array(bits, mask=~first), bytewise, lists], names=["node", "doc_id", "line", "sketch", "sig", "leads"])

        for batch in batches:
            for text, starts, stops, doc, number, node in _chunks(batch):
                _, at = np.unique(node, return_index=True)
                at = np.array([i for i in at if int(node[i]) not in seen], dtype=np.int64)
                if len(seen) > SEEN_LINES:
                    seen.clear()
                seen.update(node[at].tolist())
                first = np.zeros(len(node), dtype=bool)
                first[at] = True
                values, per = line_shingles(text, starts[first], stops[first], k)
                sig = signatures(values, np.concatenate([[0], np.cumsum(per)[:-1]]), seeds) if first.any() else np.zeros((0, bands * rows), dtype=np.uint32)
                held.append((node, doc, number.astype(np.int32), first, sig.astype(np.uint8), sketches(sig)))
                if sum(len(h[0]) for h in held) >= HELD_LINES:
                    yield flush()
        if held:
            yield flush()

    return run


def _posted(bands: int, rows: int, per_band: int):
    """Blocks of the postings of (doc, sketch, sig, leads), but for the items that a centre stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            doc, sketch, sig, apart, led = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return post(sig.reshape(len(sig), bands, rows), doc, sketch, apart, led, per_band)

        for batch in batches:
            if not len(batch):
                continue
            doc, sketch = (np.asarray(batch.column(i)) for i in (0, 1))
            lead, led = _leads(batch.column(3), bands)
            held.append((doc, sketch, _bytes(batch.column(2), bands * rows), led & (lead != doc[:, None]), led))
            if sum(len(h[0]) for h in held) >= HELD_LINES:
                yield from flush()
        if held:
            yield from flush()

    return run


def _leads(column: pa.Array, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres (lines x bands), and where there is one."""
    out, led = np.zeros((len(column), bands), dtype=np.int64), np.zeros((len(column), bands), dtype=bool)
    some, values = np.asarray(column.is_valid()), column.flatten()
    out[some] = np.asarray(values.fill_null(0)).reshape(-1, bands)
    led[some] = np.asarray(values.is_valid()).reshape(-1, bands)
    return out, led


def _stand_ins(bands: int, rows: int):
    """Pairs and dense rows of the items of (doc, sketch, sig, leads) that a centre stands for, where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, sketch = (np.asarray(batch.column(i)) for i in (0, 1))
            lead, led = _leads(batch.column(3), bands)
            at, band = np.nonzero(led & (lead != doc[:, None]))
            token = _packed(_bytes(batch.column(2), bands * rows), bands, rows)[at, band] | (band << BAND_SHIFT)
            a, b = lead[at, band], doc[at]
            columns = [np.minimum(a, b), np.maximum(a, b), token, b, sketch[at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "token", "doc", "sketch"])

    return run


def _met(signed: DataFrame, bands: int, rows: int, whole: int) -> DataFrame:
    """Pairs and dense rows of the lists of (doc, sketch, sig, leads)."""
    per_band = min(BUCKETS, signed.count() // BUCKET_LINES + 1)
    blocks = signed.mapInArrow(_posted(bands, rows, per_band), POSTED).repartition("bucket").sortWithinPartitions("bucket")
    lists = blocks.mapInArrow(meet_blocks(SMALL_LIST, whole, rows, per_band, BAND_SHIFT), MET)
    return lists.unionByName(signed.where("leads is not null").mapInArrow(_stand_ins(bands, rows), MET))


def key_depth(often: np.ndarray, whole: int) -> np.ndarray:
    """Coordinates that are added to the key of a list of this length: one for every halving down to one that is compared whole."""
    return np.clip(np.ceil(np.log2(np.maximum(often, 1) / whole)) + 1, 2, DEEPEST).astype(np.int64)


def _longer_keys(bands: int, rows: int, similarity: int, whole: int):
    """From (token, doc, often, sig, sketch): the item again under several keys that hold the token and some more coordinates."""
    outside = (bands - 1) * rows
    shuffled = np.random.default_rng(17)
    plans = {}
    for depth in range(2, DEEPEST + 1):
        keys = int(np.ceil(np.log(1 / MISSED) / (similarity / 100) ** depth))
        plans[depth] = np.stack([np.sort(shuffled.permutation(outside)[:depth]) for _ in range(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, doc, sketch = (np.asarray(batch.column(i)) for i in (0, 1, 4))
            values = _bytes(batch.column(3), bands * rows)
            depths = key_depth(np.asarray(batch.column(2)), whole)
            for depth in np.unique(depths):
                at = np.flatnonzero(depths == depth)
                after = ((token[at] >> BAND_SHIFT) + 1) * rows  # coordinates outside the band follow it, around the end
                for part in np.array_split(at, max(1, len(at) // 4096)):
                    first = after[np.searchsorted(at, part)]
                    for n, chosen in enumerate(plans[int(depth)]):
                        key = X.mix(token[part].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
                        for c in chosen:
                            key = X.mix(key + values[part, (first + c) % (bands * rows)].astype(np.uint64) + np.uint64(1))
                        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (key.view(np.int64), doc[part], sketch[part])), pa.nulls(len(part), pa.int64())], names=["token", "doc", "sketch", "lead"])

    return run


def _line_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines (numbers) of every text, as (doc, text): node and tidied line."""
    for batch in batches:
        wanted = batch.column(2)
        for chunk in X.chunks(batch.column(1)):
            text, starts, stops, doc, number = tidy_lines(chunk)
            ask = wanted.slice(chunk.first, len(chunk))
            sizes = np.asarray(ask.value_lengths().fill_null(0)).astype(np.int64)
            asked = (np.repeat(np.arange(len(chunk)), sizes) << 32) | np.asarray(ask.flatten()).astype(np.int64)
            some = np.isin((doc << 32) | number, asked)
            starts, stops = starts[some], stops[some]
            lines = pa.array([text[a:b].tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(X.span_hashes(text, starts, stops).view(np.int64)), lines.cast(pa.string())], names=["doc", "text"])


def _sized(k: int):
    """Adds the number of distinct shingles to (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(s) for chunk in X.chunks(batch.column(1)) for s in X.distinct_by_doc(*line_shingles(chunk.data, chunk.offsets[:-1], chunk.offsets[1:], k))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32())], names=["doc", "text", "n"])

    return run


def _alike(k: int, similarity: int):
    """Whether two lines reach the similarity, from all their shingles; n is the size of both sets together.

    The shingles of both lines of a pair are sorted behind the number of the pair: of 2**40 values, so that two of the
    shingles of a pair of a thousand are taken for one by chance in one of a million such pairs.
    """

    @F.arrow_udf("boolean")
    def run(both: pa.Array, cut: pa.Array, n: pa.Array) -> pa.Array:
        lengths, sizes, out = np.asarray(cut).astype(np.int64), np.asarray(n).astype(np.int64), [np.zeros(0, dtype=bool)]
        for chunk in X.chunks(both):
            part = slice(chunk.first, chunk.first + len(chunk))
            middle = chunk.offsets[:-1] + lengths[part]
            starts, stops = np.column_stack([chunk.offsets[:-1], middle]).ravel(), np.column_stack([middle, chunk.offsets[1:]]).ravel()
            values, per = line_shingles(chunk.data, starts, stops, k)
            pair = np.repeat(np.arange(len(chunk), dtype=np.uint64), per.reshape(-1, 2).sum(axis=1))
            union = X.distinct((pair << np.uint64(40)) | (values >> np.uint64(24))) >> np.uint64(40)
            union = np.bincount(union.astype(np.int64), minlength=len(chunk))
            out.append(100 * (sizes[part] - union) >= similarity * union)
        return pa.array(np.concatenate(out), pa.bool_())

    return run


def _apart(dense: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows of the dense lists that are several components: (token, doc, sketch, component, often, top, minors), with the length of
    the list, its largest component, and how many of its items are not of that."""
    rows = scratch.write(relabelled(dense.withColumn("component", F.col("doc")), "component", found, scratch), f"{name}_rows")
    parts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    lists = parts.groupBy(F.col("token").alias("_token")).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("often"))
    lists = lists.select("_token", "often", F.col("top.component").alias("top"), (F.col("often") - F.col("top.n")).alias("minors")).where("minors > 0")
    lists = scratch.sized(scratch.write(lists, f"{name}_lists"), BROADCAST_KEYS // 4)
    return scratch.write(rows.join(lists, rows["token"] == lists["_token"]).drop("_token"), f"{name}_live")


def _across(live: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """Links (a, b) of the items outside the largest component of a list with items of other components; ``texts`` has their doc and
    text. A list is cut into slices of a bounded size, each with all items that are apart, so a long list is no single task."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        return [s for chunk in X.chunks(column) for s in X.distinct_by_doc(*line_shingles(chunk.data, chunk.offsets[:-1], chunk.offsets[1:], k))]

    slices = F.ceil(F.col("often") / SLICE).cast("int")
    columns = ["doc", "sketch", "component", "text"]
    live = live.join(texts, "doc")
    rest = live.select("token", F.pmod(F.xxhash64("doc"), slices).cast("int").alias("slice"), F.lit(1).alias("rest"), *columns)
    minors = live.where("component <> top").select("token", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(0).alias("rest"), *columns)
    rows = rest.unionByName(minors).repartition("token", "slice").sortWithinPartitions("token", "slice", "rest")
    return rows.mapInArrow(across(None, sets, similarity), "a long, b long").distinct()


def _linked(met: DataFrame, signed: DataFrame, scratch: Scratch, confirmed: Callable[[DataFrame], DataFrame], links_across: Callable[[DataFrame], DataFrame], longer_keys, whole: int) -> DataFrame:
    """Components (node, component) of the lines whose lists gave ``met``; ``confirmed`` gives those of the pairs (a, b) that are
    links, ``links_across`` the links of dense rows with other components, ``longer_keys`` posts (token, doc, often, sig, sketch) again."""

    def pairs_of(met: DataFrame) -> DataFrame:
        return met.where("a is not null").select("a", "b").distinct()

    def dense_of(met: DataFrame) -> DataFrame:
        return met.where("token is not null").select("token", "doc", "sketch").distinct()

    found = connected_components(scratch.write(confirmed(pairs_of(met)), "links"), scratch)
    live = _apart(dense_of(met), found, scratch, "first")
    if not live.limit(1).count():
        return found
    many = live.where(F.col("minors") > whole)
    if many.limit(1).count():
        rows = many.join(signed.select("doc", "sig").dropDuplicates(["doc"]), "doc").select("token", "doc", "often", "sig", "sketch")
        again = rows.mapInArrow(longer_keys, "token long, doc long, sketch long, lead long")
        longer = scratch.write(again.repartition("token").sortWithinPartitions("token", "doc").mapInArrow(meet(SMALL_LIST, whole), MET), "longer")
        sides = relabelled(relabelled(pairs_of(longer).select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), "x", found, scratch), "y", found, scratch)
        found = merged(found, confirmed(sides.where("x <> y").select("a", "b")), scratch, "second_cc")
        dense = live.where(F.col("minors") <= whole).select("token", "doc", "sketch").unionByName(dense_of(longer))
        live = _apart(dense, found, scratch, "second")
    return merged(found, links_across(live), scratch, "third_cc") if live.limit(1).count() else found


def repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_chars: int = SHINGLE_CHARS,
    similarity: int = SIMILARITY,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
    whole_list: int = WHOLE,
) -> DataFrame:
    """Lines to drop: (doc_id, line from 0, kept_doc_id, kept_line), one row per line that repeats an earlier one.

    Of each component the line with the smallest (doc_id, line) stays. Blank lines are never dropped; null and empty texts
    have none. Rows with a null id are left alone; rows that repeat an id count as one document. Other columns are ignored;
    an empty table gives an empty result. Very long lines count whole. Lists with more than ``whole_list`` items apart are posted
    again under longer keys; the result does not depend on it but for what such keys miss (``MISSED``).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    profile = base.mapInArrow(_profile(shingle_chars, bands, band_rows), "node long, doc_id long, line int, sketch long, sig binary, leads array<long>")
    profile = scratch.write(profile, "profile")
    occurrences = profile.select("node", "doc_id", "line")
    signed = profile.where("sig is not null").select(F.col("node").alias("doc"), "sketch", "sig", "leads")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(doc, text) of the nodes, each read from the first document that holds it."""
        nodes = scratch.sized(nodes.select(F.col("doc").alias("_node")))
        held = occurrences.join(nodes, occurrences["node"] == nodes["_node"], "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("first"))
        asked = held.groupBy(F.col("first.doc_id").alias("_doc")).agg(F.collect_list("first.line").alias("lines"))  # at most the lines of the document
        asked = scratch.sized(scratch.write(asked, "asked"), BROADCAST_KEYS // 4)
        return base.join(asked, base["doc_id"] == asked["_doc"]).select("doc_id", "text", "lines").mapInArrow(_line_texts, "doc long, text string").dropDuplicates(["doc"])

    def confirmed(pairs: DataFrame) -> DataFrame:
        close = scratch.write(pairs, "close")
        wanted = scratch.write(close.select(F.col("a").alias("doc")).union(close.select("b")).distinct(), "wanted")
        texts = scratch.write(texts_of(wanted).mapInArrow(_sized(shingle_chars), "doc long, text string, n int"), "texts")
        a, b = (texts.select(F.col("doc").alias(k), F.col("text").alias(f"text_{k}"), F.col("n").alias(f"n_{k}")) for k in ("a", "b"))
        both = close.join(a, "a").join(b, "b").where(100 * F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b"))
        alike = _alike(shingle_chars, similarity)(F.concat("text_a", "text_b"), F.octet_length("text_a"), F.col("n_a") + F.col("n_b"))
        return both.where(alike).select("a", "b")

    def links_across(live: DataFrame) -> DataFrame:
        texts = scratch.write(texts_of(live.select("doc").distinct()), "texts")
        return _across(live, texts, shingle_chars, similarity)

    met = scratch.write(_met(signed, bands, band_rows, whole_list), "met")
    found = _linked(met, signed, scratch, confirmed, links_across, _longer_keys(bands, band_rows, similarity, whole_list), whole_list)

    firsts = occurrences.groupBy("node").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("times"))
    labels = found.select(F.col("node").alias("linked"), "component")
    placed = firsts.join(labels, firsts["node"] == labels["linked"], "left").where("times > 1 or component is not null")
    placed = scratch.write(placed.select("node", F.coalesce("component", "node").alias("component"), "first"), "placed")
    keepers = scratch.write(placed.groupBy(F.col("component").alias("_component")).agg(F.min("first").alias("keep")), "keepers")
    keepers = scratch.sized(keepers, BROADCAST_KEYS // 4)
    keep = scratch.write(placed.join(keepers, placed["component"] == keepers["_component"]).select(F.col("node").alias("repeated"), "keep"), "keep")
    keep = scratch.sized(keep, BROADCAST_KEYS // 4)
    dropped = occurrences.join(keep, occurrences["node"] == keep["repeated"]).where((F.col("doc_id") != F.col("keep.doc_id")) | (F.col("line") != F.col("keep.line")))
    scratch.drop("met", "longer", "links", "close", "wanted", "texts", "asked", *(f"{w}_{t}" for w in ("first", "second") for t in ("rows", "lists", "live")))
    return dropped.select("doc_id", "line", F.col("keep.doc_id").alias("kept_doc_id"), F.col("keep.line").alias("kept_line")).distinct()


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped and dropped (sorted line numbers).

    A null text has no lines, an empty one has one, which is blank and never dropped. Rows with a null id are kept and have nothing
    dropped; rows that repeat an id have the same lines dropped, those of all of them. Texts and lines of any length count whole;
    other columns are ignored; an empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(ends + 1, F.lit(0)).cast("long").alias("n_lines"))
    dropped = repeated_lines(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list("line")).alias("dropped"))
    joined = rows.join(dropped, rows["doc_id"] == dropped["_doc"], "left")
    none = F.array().cast("array<int>")
    return joined.select("doc_id", "n_lines", F.size(F.coalesce("dropped", none)).cast("long").alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with repeated lines taken out of the text; all rows, columns and other lines stay as they are.

    Null and empty texts, rows with a null id and an empty table stay as they are; rows that repeat an id lose the same lines.
    Columns of any name are carried along. Dropped lines are marked by place, so a text costs its lines and not lines times drops.
    """
    dropped = repeated_lines(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list("line").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    joined = rows.join(dropped, F.col("id") == F.col("doc"), "left")
    old = F.col("row").getField(text_col)
    lines = F.split(old.cast("string"), "\n", -1)
    # from the sorted places: so many lines kept, then one dropped, and so on
    gone = F.array_sort("gone")
    gaps = F.transform(gone, lambda g, i: F.concat(F.array_repeat(F.lit(False), g - F.coalesce(F.get(gone, i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    marks = F.flatten(gaps)
    text = F.when(F.col("gone").isNull(), old).otherwise(F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("line"), marks.alias("gone")), lambda x: x["line"].isNotNull() & ~F.coalesce(x["gone"], F.lit(False))), lambda x: x["line"]), "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
