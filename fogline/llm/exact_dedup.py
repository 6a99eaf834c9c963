"""Exact deduplication by deterministic block naming.

Texts are cut into blocks of a fixed size. All blocks are sorted, and each distinct one takes its rank as name; then adjacent
pairs of names are sorted and ranked in the same way, level by level, until one name is left of a document. Two documents have
the same name at the same level only if they are equal: names are ranks of whole contents, so nothing can collide.

A document that holds a name which no other document holds is equal to none, and that name is its identity: it needs no
further level. What goes on to the next level is so only what may still be a copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fogline.llm._scratch import Scratch

BLOCK_BYTES = 1024
#: Characters that do not count.
SPACE = " \t\n\x0b\x0c\r"
#: Documents cut at once in a task.
_ROWS = 256

_BLOCKS = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("block", T.BinaryType()),
        T.StructField("id", T.LongType()),
        T.StructField("points", T.LongType()),
        T.StructField("digest", T.StringType()),
    ]
)


def _cut(size: int):
    """Rows (row, text, id, points, digest) to their blocks; what belongs to the row comes with its first block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows, ids, points, digests = (part[c].to_pylist() for c in ("row", "id", "points", "digest"))
                out: dict[str, list] = {c: [] for c in _BLOCKS.names}
                for k, text in enumerate(part["text"]):
                    data = text.as_py()
                    for pos in range(max(1, -(-len(data) // size))):  # an empty text is one empty block
                        first = pos == 0
                        values = (rows[k], pos, data[pos * size : (pos + 1) * size], ids[k] if first else None, points[k] if first else None, digests[k] if first else None)
                        for c, v in zip(out, values, strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], list(out))

    return run


_RANKED = pa.schema(
    [("row", pa.int64()), ("pos", pa.int64()), ("part", pa.int64()), ("rank", pa.int64()), ("own", pa.bool_()), ("first", pa.binary()), ("last", pa.binary())]
)
_RANKED_SQL = "row long, pos long, part long, rank long, own boolean, first binary, last binary"


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, row, pos) to (row, pos, part, rank, own): rank counts the distinct keys of the task from 0, and own says that
    all rows of the key are of one document here. One more row, without row and pos, has the number of keys as rank, and the
    first and last key. Of a key that goes on from batch to batch, rows wait only while they are all of one document."""
    part, first, rank, waiting, shared = TaskContext.get().partitionId(), None, 0, None, False
    last = None

    def out(rows: pa.RecordBatch, ranks: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(ranks), pa.binary())
        return pa.RecordBatch.from_arrays([rows["row"], rows["pos"], pa.array(np.full(len(ranks), part)), pa.array(ranks), pa.array(own), none, none], schema=_RANKED)

    for batch in batches:
        if not batch.num_rows:
            continue
        goes_on = last is not None and batch["key"][0].as_py() == last
        rank += last is not None and not goes_on
        if waiting is not None:
            if goes_on:  # the rows that wait may turn out to be shared
                batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            else:
                yield out(waiting, np.full(waiting.num_rows, rank - 1), np.ones(waiting.num_rows, dtype=bool))
            waiting = None
        keys, rows = batch["key"], np.asarray(batch["row"])
        first = keys[0].as_py() if first is None else first
        last = keys[len(keys) - 1].as_py()
        starts = np.concatenate([[0], 1 + np.flatnonzero(np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))))]).astype(np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        single = rows[starts] == rows[starts + sizes - 1]  # rows are in order within a key
        single[0] &= not (goes_on and shared)
        shared = not single[-1]
        ends = len(keys) if shared else int(starts[-1])
        if ends:
            yield out(batch.slice(0, ends), np.repeat(rank + np.arange(len(sizes)), sizes)[:ends], np.repeat(single, sizes)[:ends])
        waiting = None if shared else batch.slice(ends)
        rank += len(sizes) - 1
    if waiting is not None:
        yield out(waiting, np.full(waiting.num_rows, rank), np.ones(waiting.num_rows, dtype=bool))
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([None], [None], [part], [rank + 1], [None], [first], [last]), _RANKED, strict=True)], schema=_RANKED)


def dense_names(keyed: DataFrame, scratch: Scratch, table: str) -> DataFrame:
    """(row, pos, name, own) of ``keyed`` (row, pos, key: binary): name is the rank of the key among all distinct keys, from 0;
    own is true only if no other row has the key.

    Rows are dealt by ranges of key, row and pos, so that a key of very many rows is spread over tasks. Tasks rank what they
    hold; how many distinct keys lie before a task follows from a row per task, where a key that goes on from one task to the
    next counts once.
    """
    dealt = keyed.select("key", "row", "pos").repartitionByRange("key", "row", "pos").sortWithinPartitions("key", "row", "pos")
    ranked = scratch.write(dealt.mapInArrow(_rank, _RANKED_SQL), table)
    in_order = Window.orderBy("part")  # a row per task of one shuffle
    tasks = ranked.where("row is null").select("part", "rank", F.coalesce(F.lag("last").over(in_order) == F.col("first"), F.lit(False)).alias("goes_on"))
    tasks = tasks.select(
        F.col("part").alias("_part"), F.col("rank").alias("keys"), "goes_on", F.lead("goes_on", 1, False).over(in_order).alias("leads_on"),
        (F.sum(F.col("rank") - F.col("goes_on").cast("long")).over(in_order) - F.col("rank")).alias("before"),
    )
    placed = ranked.where("row is not null").join(F.broadcast(tasks), F.col("part") == F.col("_part"))
    edge = (F.col("goes_on") & (F.col("rank") == 0)) | (F.col("leads_on") & (F.col("rank") == F.col("keys") - 1))
    return placed.select("row", "pos", (F.col("rank") + F.col("before")).alias("name"), (F.col("own") & ~edge).alias("own"))


def _next_level(names: DataFrame, scratch: Scratch, level: int) -> tuple[DataFrame, DataFrame]:
    """From (row, pos, name, own): (row, name) of documents that are done with one name, and (row, names) of the others.

    Documents with a name of their own are in neither: they are equal to none.
    """
    rows = names.groupBy("row").agg(F.bool_or("own").alias("own"), F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("names"))
    rows = scratch.write(rows.where("not own").select("row", F.col("names.name").alias("names")), f"rows_{level}")
    return rows.where("size(names) = 1").select("row", F.col("names")[0].alias("name")), rows.where("size(names) > 1")


def _pairs(rows: DataFrame) -> DataFrame:
    """Adjacent pairs of names as keys of 16 bytes; a last name without a partner is paired with a mark."""
    halves = F.expr("transform(sequence(0, (size(names) - 1) div 2), i -> struct(names[2 * i] as left, coalesce(get(names, 2 * i + 1), -1L) as right))")
    each = rows.select("row", F.posexplode(halves).alias("pos", "pair"))
    key = F.unhex(F.concat(F.lpad(F.hex("pair.left"), 16, "0"), F.lpad(F.hex("pair.right"), 16, "0")))
    return each.select("row", F.col("pos").cast("long").alias("pos"), key.alias("key"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without the characters ``SPACE``; null counts as empty, and all such texts are equal.
    Of equal texts the row with the most code points in its original text stays, then the one with the smallest id (null last);
    of repeated rows with one id exactly one stays. Very long texts are only more blocks; memory of a task is bounded by its
    longest text. Other columns, whatever their names, are neither read nor returned. An empty table gives an empty result.

    Texts are cut once and written in blocks, then shuffled once, by ranges of blocks. Later levels handle numbers of documents
    whose every block occurs in another document.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    own = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    bare = F.translate(own, SPACE, "")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
        bare.cast("binary").alias("text"), F.char_length(own).cast("long").alias("points"), F.sha2(bare.cast("binary"), 256).alias("digest"),
    )
    cut = rows.mapInArrow(_cut(block_bytes), _BLOCKS)
    cut.write.mode("overwrite").option("compression", "zstd").parquet(scratch.path("blocks"))  # read from here on: rows keep their numbers
    blocks = docs.sparkSession.read.schema(_BLOCKS).parquet(scratch.path("blocks"))

    keyed, done, level = blocks.select("row", "pos", F.col("block").alias("key")), None, 0
    while True:
        ended, going = _next_level(dense_names(keyed, scratch, f"ranked_{level}"), scratch, level)
        ended = ended.select("row", F.lit(level).alias("level"), "name")
        done = ended if done is None else done.unionByName(ended)
        if not going.limit(1).count():
            break
        keyed, level = _pairs(going), level + 1

    heads = blocks.where("pos = 0").select("row", "id", "points", "digest")
    named = scratch.write(done.join(heads.select(F.col("row").alias("_row"), "id", "points"), F.col("row") == F.col("_row")).drop("_row"), "named")
    best = F.min_by(F.struct("id", "row"), F.struct(-F.col("points"), F.col("id").isNull(), "id", "row"))
    groups = named.groupBy("level", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    groups = scratch.write(groups.select(F.col("level").alias("_level"), F.col("name").alias("_name"), "best", "n"), "groups")
    placed = named.join(scratch.sized(groups), (named["level"] == F.col("_level")) & (named["name"] == F.col("_name")))
    placed = placed.select(F.col("row").alias("_row"), "best", "n")
    joined = heads.join(placed, heads["row"] == placed["_row"], "left")
    alone = F.col("best").isNull()
    return joined.select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"), F.col("digest").alias("text_sha256"),
    )


EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, length(text) AS points, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS bare FROM d),
g AS (SELECT *, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS place,
             first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(bare) AS text_sha256 FROM g
"""
