"""Ranked lexical search by windowed bucket scoring.

Documents become postings of the terms that the queries ask for, and are dealt by windows of consecutive doc_ids. A task takes
a window at a time: an array of one bucket per document, small enough for a core's cache, gets the weights of a query's terms
added posting list by posting list, while a bitset records which buckets are occupied. Occupied buckets are harvested into the
query's heap of best documents. A window's postings are read once for all queries; a task returns k documents per query.

Queries come in blocks of bounded size, whose terms and weights travel to all tasks; every block is scored against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fogline.llm import _text as X
from fogline.llm._scratch import Scratch

#: Documents of a window: 8192 scores of eight bytes fit in the first two caches of a core.
WINDOW = 1 << 13
#: Terms of queries that travel together.
BLOCK_TERMS = 1 << 20
#: A document's frequency is damped by 100 - LENGTH + LENGTH * its length / the mean length, in hundredths.
LENGTH = 25

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(chunk: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term after lower-casing A-Z, and the number of terms per document."""
    starts, ends, counts = X.runs(_TERM[chunk.data], chunk.offsets)
    return X.span_hashes(X.lower_ascii(chunk.data), starts, ends), counts


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to a row per distinct term of an item: item, term (its hash), times."""
    for batch in batches:
        for chunk in X.chunks(batch["text"]):
            hashes, counts = _terms(chunk)
            items = np.repeat(np.asarray(batch["item"])[chunk.first : chunk.first + len(chunk)], counts)
            order = np.lexsort((hashes, items))
            items, hashes = items[order], hashes[order]
            fresh = np.flatnonzero(np.concatenate([[True], (items[1:] != items[:-1]) | (hashes[1:] != hashes[:-1])])) if len(items) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(fresh, len(items)))
            yield pa.RecordBatch.from_arrays([pa.array(items[fresh]), pa.array(hashes[fresh].astype(np.int64)), pa.array(times)], ["item", "term", "times"])


_POSTED = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType(), False)), T.StructField("tfs", T.ArrayType(T.IntegerType(), False))])


def _post(vocabulary: Broadcast):
    """(doc, text) to doc, its number of terms, and number and frequency of those terms that the sorted vocabulary holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(vocabulary.value, dtype=np.int64)
        table = np.zeros(1 << 16, dtype=bool)  # of low bits: spares most searches
        table[known & 0xFFFF] = True
        for batch in batches:
            for chunk in X.chunks(batch["text"]):
                hashes, counts = _terms(chunk)
                hashes = hashes.astype(np.int64)
                likely = np.flatnonzero(table[hashes & 0xFFFF])
                number = np.searchsorted(known, hashes[likely])
                hit = known[np.minimum(number, len(known) - 1)] == hashes[likely] if len(known) else np.zeros(0, dtype=bool)
                owner = np.repeat(np.arange(len(chunk)), counts)[likely[hit]]
                pairs, tfs = np.unique(owner * len(known) + number[hit], return_counts=True)
                offsets = np.searchsorted(pairs, np.arange(len(chunk) + 1) * len(known)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (pairs % max(1, len(known)), tfs)]
                yield pa.RecordBatch.from_arrays([batch["doc"].slice(chunk.first, len(chunk)), pa.array(counts.astype(np.int64)), *lists], ["doc", "n", "terms", "tfs"])

    return run


@dataclass(frozen=True)
class Queries:
    """A block of queries, ready to be scored: weights by term number, terms of all items in one array."""

    items: list[int]
    offsets: np.ndarray
    terms: np.ndarray
    times: np.ndarray
    weights: np.ndarray
    documents: int
    total: int


class _Best:
    """The k highest scores of every query of a task; of equal scores the smaller doc_id. Null ids are the largest."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k, self.heaps = queries, k, [[] for _ in queries.items]

    def add(self, docs: np.ndarray, null: np.ndarray, ns: np.ndarray, owner: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        """Score one window: documents in order of id, and their postings."""
        q, size = self.queries, len(docs)
        order = np.argsort(terms, kind="stable")
        slots, tfs = owner[order], tfs[order].astype(np.int64)
        ends = np.cumsum(np.bincount(terms, minlength=len(q.weights)))
        damping = 100 - LENGTH + LENGTH * ns * q.documents // max(1, q.total)
        parts = 1_000_000_000 * tfs // (1000 * tfs + 12 * damping[slots])
        scores, bits = np.zeros(size, dtype=np.int64), {}
        for k, heap in enumerate(self.heaps):
            occupied = np.zeros((size + 7) // 8, dtype=np.uint8)
            for at in range(q.offsets[k], q.offsets[k + 1]):
                term = q.terms[at]
                a, b = ends[term - 1] if term else 0, ends[term]
                if a == b:
                    continue
                scores[slots[a:b]] += parts[a:b] * (q.weights[term] * q.times[at])  # a document comes once in a list
                if term not in bits:
                    held = np.zeros(size, dtype=bool)
                    held[slots[a:b]] = True
                    bits[term] = np.packbits(held)
                occupied |= bits[term]
            at = np.flatnonzero(np.unpackbits(occupied, count=size))
            got = scores[at]
            scores[at] = 0
            least = heap[0][0] if len(heap) == self.k else 0
            better = np.flatnonzero(got >= max(1, least))
            if len(better) > self.k:
                cut = np.partition(got[better], len(better) - self.k)[len(better) - self.k]
                better = np.concatenate([better[got[better] > cut], better[got[better] == cut][: self.k]])  # equal scores: the first ids
            for s in better:
                d = at[s]
                entry = (int(got[s]), not null[d], -int(docs[d]))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


_FOUND = "item_id long, doc long, score long"


def _score(queries: Broadcast, k: int, window: int):
    """Postings in order of doc to the k best documents of every item. Windows that hold few documents are scored together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, rows = _Best(queries.value, k), [], 0

        def flush(parts: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(parts).combine_chunks()
            docs, lists = whole["doc"].combine_chunks(), whole["terms"].combine_chunks()
            null = np.asarray(docs.is_null())
            owner = np.repeat(np.arange(len(docs), dtype=np.int32), np.asarray(lists.value_lengths()))
            best.add(np.asarray(docs.fill_null(0)), null, np.asarray(whole["n"].combine_chunks()), owner, np.asarray(lists.flatten()), np.asarray(whole["tfs"].combine_chunks().flatten()))

        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a window ends where its documents are as many as it has buckets
                part = batch.slice(at, window - rows)
                held.append(part)
                at, rows = at + part.num_rows, rows + part.num_rows
                if rows == window:
                    flush(held)
                    held, rows = [], 0
        if held:
            flush(held)
        found = [(item, None if not known else -d, s) for item, heap in zip(best.queries.items, best.heaps, strict=True) for s, known, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], ["item_id", "doc", "score"])

    return run


def _blocks(terms: DataFrame, bound: int) -> list[list[int]]:
    """Items in blocks of at most ``bound`` terms (or one item): only ids and counts of the queries come to the driver."""
    blocks, size = [], bound
    for r in terms.groupBy("item").agg(F.count(F.lit(1)).alias("n")).orderBy("item").toLocalIterator():
        if size + r["n"] > bound:
            blocks.append([])
            size = 0
        blocks[-1].append(r["item"])
        size += r["n"]
    return blocks


def _search_block(docs: DataFrame, rows: list[Row], k: int, window: int, scratch: Scratch, name: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = np.unique(np.array([r["term"] for r in rows], dtype=np.int64))
    posted = scratch.write(docs.mapInArrow(_post(spark.sparkContext.broadcast(vocabulary.tobytes())), _POSTED), f"posted_{name}")
    sums = posted.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    held = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for r in held.collect():  # a row per term of the block
        weights[r["term"]] = math.floor(1000 * math.log((2 * sums["documents"] + 2) / (2 * r["df"] + 1)))
    rows = sorted(rows, key=lambda r: r["item"])
    items, counts = np.unique(np.array([r["item"] for r in rows], dtype=np.int64), return_counts=True)
    numbers = np.searchsorted(vocabulary, np.array([r["term"] for r in rows], dtype=np.int64))
    block = Queries(items.tolist(), np.concatenate([[0], np.cumsum(counts)]), numbers, np.array([r["times"] for r in rows], dtype=np.int64), weights, sums["documents"], sums["total"])
    at = F.coalesce(F.expr(f"doc div {window}"), -F.col("n"))  # rows without an id are spread by length
    dealt = posted.where(F.size("terms") > 0).repartition(at).sortWithinPartitions(F.col("doc").asc_nulls_last())
    found = dealt.mapInArrow(_score(spark.sparkContext.broadcast(block), k, window), _FOUND)
    return scratch.write(found, f"found_{name}")


def search(
    docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", window: int = WINDOW, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """The ``k`` highest-scoring rows of ``docs`` with a score above 0 for every item: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and characters beyond ASCII, with A-Z in lower case. A term weighs
    floor(1000 ln((2N + 2) / (2 df + 1))), where N documents have a term and df hold this one. A document's score adds, for every
    term of the item with its repeats, the weight times 1000000000 tf div (1000 tf + 12 m), with m = 75 + 25 n N div L for its n
    terms of all L. All is integer arithmetic but the logarithm. Terms are told apart by 64 bits.

    Equal scores rank by ascending doc_id, null last. Null and empty texts hold no term: such documents are in no result, such
    items have none. Repeated rows are rows of their own, with equal scores. Texts of one item that comes more than once are one
    query; items without an id are left out. Very long documents are one row of a window, a document's terms are
    counted whole. Other columns are not read. Empty tables give an empty result.
    """
    scratch = Scratch(docs.sparkSession, "search")
    asked = queries.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{query_col}`").cast("string").alias("text")).where("item is not null")
    terms = asked.mapInArrow(_hashed, "item long, term long, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))
    terms = scratch.write(terms, "terms")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = None
    for number, items in enumerate(_blocks(terms, block_terms)):
        rows = terms.where(F.col("item").between(items[0], items[-1])).collect()  # at most block_terms rows
        part = _search_block(texts, rows, k, window, scratch, str(number))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _FOUND)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


SEARCH_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term),
x AS (SELECT q.item_id, p.doc_id, sum(q.times * w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.n_docs) // s.n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM x WHERE score > 0 QUALIFY rank <= 20
"""
