"""Near-duplicate documents by MinHash signatures joined through their coordinates.

1. Every document becomes its set of distinct word shingles and a signature of ``coordinates`` minima.
2. Documents with equal sets collapse into one class, so a group of exact copies costs one row from here on.
3. Each class is posted under its (coordinate, value) pairs. Pairs of equal signatures must collide ``matches`` times, so a
   class is posted only under its rarest shared pairs (prefix), and classes with too few shared pairs are skipped.
4. Each posting list is merged with its smallest member first: its pairs grow with the list and not with its square. Pairs
   that collide often enough in the whole signature are confirmed on the whole sets.
5. What step 4 left apart within a list is compared again, now by exact prefix filtering of the shingle sets: a pair is met
   only where the rarest parts of both sets allow the threshold to be reached. No list is capped and no pair is skipped.
6. Confirmed links go through distributed connected components.

A pair at the threshold of 0.75 collides in 48 of 64 coordinates on average; fewer than 34 come by chance in about one of
25,000 such pairs. Above the threshold the chance falls off quickly. Equality of shingles is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.llm import _text as X
from fogline.llm._linking import confirm, link, with_lows
from fogline.llm._scratch import BROADCAST_KEYS, Scratch

SHINGLE_WORDS, SIMILARITY, COORDINATES, MATCHES = 5, 75, 64, 34


def signature_seeds(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = X.mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64))
    high = (seeds >> np.uint64(32)).astype(np.uint32)
    return high[:coordinates] | np.uint32(1), high[coordinates:]


def signatures(values: np.ndarray, starts: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Minima of every non-empty segment of hashes under each permutation; one row per segment."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(seeds[0]), len(starts)), dtype=np.uint32)
    moved = np.empty_like(low)  # one buffer for all permutations, so that it stays in a core's cache
    for k, (a, b) in enumerate(zip(*seeds, strict=True)):
        np.bitwise_xor(low, b, out=moved)
        np.multiply(moved, a, out=moved)
        np.minimum.reduceat(moved, starts, out=out[k])
    return np.ascontiguousarray(out.T)


def _sets(words: int):
    """Distinct shingle hashes of each row of a batch."""

    def of(column: pa.Array) -> Iterator[list[np.ndarray]]:
        for chunk in X.chunks(column):
            yield X.distinct_by_doc(*X.shingles(*X.word_hashes(chunk), words))

    return of


def _profile(words: int, coordinates: int):
    import hashlib

    sets_of, seeds = _sets(words), signature_seeds(coordinates)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in sets_of(batch.column(1)):
                ids = batch.column(0).slice(at, len(sets))
                at += len(sets)
                full = [s for s in sets if len(s)]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * coordinates)]).astype(np.int32)
                flat = np.zeros(0, dtype=np.uint32)
                if full:
                    starts = np.concatenate([[0], np.cumsum([len(s) for s in full])[:-1]])
                    flat = signatures(np.concatenate(full), starts, seeds).ravel()
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(keys, pa.binary()), sig], schema=schema)

    return run


def _shingle_sets(words: int):
    sets_of = _sets(words)
    schema = pa.schema([("doc", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in sets_of(batch.column(1)):
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)
                at += len(sets)

    return run


def _agree(pairs: DataFrame, sig: DataFrame, matches: int) -> DataFrame:
    """Pairs (a, b) whose whole signatures collide in at least ``matches`` coordinates."""
    left = sig.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a"))
    right = sig.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b"))
    hits = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
    return pairs.join(left, "a").join(right, "b").where(hits >= matches).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    similarity: int = SIMILARITY,
    coordinates: int = COORDINATES,
    matches: int = MATCHES,
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is that smallest id).

    Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. Fewer words than a shingle make one shingle;
    a text without words, empty or null has no shingle and links with nothing: it is its own component and is kept. Texts of any
    length are compared whole. An id that stands for several texts is linked by each of them that no smaller id holds. A row
    with a null id is counted, gets the component of equal texts, takes part in no other link and is not kept. Ties and the
    order of rows do not matter. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    X.batches_by_bytes(spark)
    scratch = Scratch(spark, "near")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = scratch.write(base.mapInArrow(_profile(words, coordinates), "doc_id long, n_shingles long, set_key binary, sig array<int>"), "profile")

    groups = profile.where("n_shingles > 0").groupBy(F.col("set_key").alias("_key")).agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"))
    groups = groups.where("rows > 1 and doc is not null")
    groups = scratch.write(groups.select("_key", "doc"), "groups")  # a table of its own, so that the join can split a large group
    near = scratch.sized(groups, BROADCAST_KEYS // 4)
    placed = profile.join(near, profile["set_key"] == near["_key"], "left")
    placed = placed.select("doc_id", "n_shingles", "set_key", "sig", F.when(F.col("n_shingles") > 0, F.coalesce("doc", "doc_id")).alias("doc"), F.col("doc").isNull().alias("single"))
    members = placed.select("doc_id", "n_shingles", "doc")
    # an id that stands for several texts has as many heads, and is linked by each of them
    heads = placed.where("n_shingles > 0 and doc_id = doc")
    sig = heads.where("single").select("doc", "sig").unionByName(heads.where("not single").dropDuplicates(["doc", "set_key"]).select("doc", "sig"))

    token = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    tokens = sig.select("doc", F.posexplode("sig").alias("at", "value")).select("doc", token.alias("token"))
    shared = scratch.write(tokens.groupBy(F.col("token").alias("_token")).agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "shared")
    shared = scratch.sized(shared)
    posted = (
        tokens.join(shared, tokens["token"] == shared["_token"])
        .groupBy("doc")
        .agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("order"))  # one entry per coordinate of a text
        .where(F.size("order") >= matches)
        .select("doc", F.explode(F.slice("order", F.lit(1), F.size("order") - (matches - 1))).alias("key"))
        .select("doc", F.col("key.token").alias("token"))
    )
    posted = scratch.write(with_lows(scratch.write(posted.distinct(), "posted_tokens"), scratch), "posted")

    wanted = scratch.write(posted.select("doc").distinct(), "wanted")
    source = base.where("doc_id is not null")
    near = scratch.sized(wanted)
    texts = source.join(near, source["doc_id"] == near["doc"], "left_semi")
    sets = scratch.write(texts.mapInArrow(_shingle_sets(words), "doc long, shingles array<bigint>"), "sets")
    if sets.count() > wanted.count():  # rows that repeat an id
        sets = scratch.write(sets.distinct(), "distinct_sets")
    sig = scratch.write(sig.join(near, "doc", "left_semi"), "sig")

    found = link(posted, similarity, scratch, lambda pairs: confirm(_agree(pairs, sig, matches), sets, similarity), lambda live: live.join(sets, "doc"))
    scratch.drop("posted", "posted_tokens", "shared", "sets", "sig", "wanted")

    labels = scratch.sized(found.where("node <> component"), BROADCAST_KEYS // 2)
    out = members.join(labels, members["doc"] == labels["node"], "left")
    component = F.coalesce("component", "doc", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every component, all columns as they are. Rows with a null id all stay."""
    scratch = Scratch(docs.sparkSession, "kept")
    found = near_duplicates(docs, id_col, text_col, **options).where("doc_id is not null")
    verdicts = scratch.write(found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "verdicts")

    def sized(ids: DataFrame) -> tuple[DataFrame, int]:
        ids = ids.select(F.col("doc_id").alias("_id"))
        n = ids.count()
        return (F.broadcast(ids) if n <= BROADCAST_KEYS else ids), n

    gone, _ = sized(verdicts.where("not kept"))
    again, repeats = sized(verdicts.where("kept and rows > 1"))
    key = F.col(f"`{id_col}`").cast("long")
    left = docs.join(gone, key == gone["_id"], "left_anti")
    if not repeats:
        return left
    several = left.join(again, key == again["_id"], "left_semi").dropDuplicates([id_col])
    return left.join(again, key == again["_id"], "left_anti").unionByName(several)
