"""Mix sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. Expected copies are summed in a fixed order within
the source, one offset per source is added, and a document is emitted once for every integer that its stretch of the sum
crosses. Documents of like size stand together in that order, so the words taken follow the target as closely as the copies.

All documents of a source expect the same number of copies, so the prefix sum is that rate times a rank. Ranks come from
three bounded levels - size classes of a source, slices of a class, documents of a slice - so no source, however large, is
ordered in one task, and no sum of fractions depends on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogline.llm._scratch import BROADCAST_KEYS, Scratch

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, "mix-1"
#: Documents of a slice, on average at most; a class has as many slices as it needs, a power of two.
SLICE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Number of decimal digits and the first two of them: sizes of a class differ by a tenth at most from ten on."""
    digits = size.cast("string")
    return (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).cast("int")


def slices_of(rows: Column) -> Column:
    """The smallest power of two of slices of ``SLICE_ROWS`` that hold so many rows."""
    full = F.floor((rows - 1) / SLICE_ROWS).cast("long")
    return F.when(full < 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(full))).cast("long"))


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Target of every source from (source, source_size): weights by rank, stopping at ``cap`` times the source's size.

    What sources above their cap give back goes to the others by weight. In the end a source has either its cap or the same
    level times its weight; the level follows from the sources in order of cap / weight.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    levels = capped.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    common = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("common", common).select("source", "source_size", F.when(F.col("common").isNull(), F.col("most")).otherwise(F.least("most", F.col("common") * F.col("weight"))).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, copies, taken (copies x size); with ``carry``, the columns
    named there as one struct ``row``.

    Rows with a null source form a source of their own. A null or empty text has size 0; a source without words has target 0
    and takes nothing. Rows that repeat an id are documents of their own. The draw depends on ids, sizes and the seed alone,
    so reruns agree. A column in ``carry`` may bear any name but those above. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    finest = 1 << (max(0, docs.count() - 1) // SLICE_ROWS).bit_length()
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )
    placed = sized.withColumn("class", size_class(F.col("size"))).withColumn("draw", F.pmod(_hash32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(finest)))

    blocks = placed.groupBy("source", "class", "draw").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words"))
    blocks = scratch.write(blocks, "blocks")
    classes = blocks.groupBy("source", "class").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words")).withColumn("slices", slices_of(F.col("rows")))
    classes = scratch.write(classes, "classes")
    parted = scratch.sized(classes.select(F.col("source").alias("_source"), F.col("class").alias("_class"), "slices"), BROADCAST_KEYS // 4)

    def sliced(rows: DataFrame) -> DataFrame:
        """Rows with the slice of their class; all slices are powers of two, so a draw tells its slice."""
        same = rows["source"].eqNullSafe(parted["_source"]) & (rows["class"] == parted["_class"])
        return rows.join(parted, same).withColumn("slice", F.pmod("draw", "slices")).drop("_source", "_class", "slices", "draw")

    blocks = sliced(blocks).groupBy("source", "class", "slice").agg(F.sum("rows").alias("rows"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    class_base = classes.select("source", "class", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("class_base"))
    earlier = Window.partitionBy("source", "class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("source", "class", "slice", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("slice_base"))
    offset = _hash32(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("")))) / F.lit(4294967296.0)
    for part, keys in ((class_base, ("source", "class")), (targets.withColumn("offset", offset), ("source",))):
        named = part.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in part.columns])
        on = None
        for k in keys:
            same = base[k].eqNullSafe(named[f"_{k}"])
            on = same if on is None else on & same
        base = base.join(named, on).drop(*[f"_{k}" for k in keys])
    base = scratch.write(base.withColumn("base", F.col("class_base") + F.col("slice_base")).drop("class_base", "slice_base"), "base")
    base = scratch.sized(base, BROADCAST_KEYS // 4)
    placed = sliced(placed)
    base = base.select(F.col("source").alias("_source"), F.col("class").alias("_class"), F.col("slice").alias("_slice"), "source_size", "target", "offset", "base")

    here = placed["source"].eqNullSafe(base["_source"]) & (placed["class"] == base["_class"]) & (placed["slice"] == base["_slice"])
    within = Window.partitionBy("source", "class", "slice").orderBy("size", "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ranked = placed.join(base, here).withColumn("rank", F.row_number().over(within) + F.col("base")).withColumn("rate", rate)
    copies = F.floor(F.col("rate") * F.col("rank") + F.col("offset")) - F.floor(F.col("rate") * (F.col("rank") - 1) + F.col("offset"))
    return ranked.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        *(["row"] if carry else []),
    )


def emit_mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: every row of ``docs`` as often as it was drawn, all columns as they were."""
    drawn = mix_sources(docs, carry=tuple(docs.columns), **options).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: The same draw in DuckDB.
MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
classed AS (
  SELECT doc_id, source, size, length(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT AS class,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS draw
  FROM sized),
counted AS (SELECT *, (count(*) OVER (PARTITION BY source, class) - 1) // {SLICE_ROWS} AS full_slices FROM classed),
placed AS (SELECT doc_id, source, size, class, draw % (CASE WHEN full_slices < 1 THEN 1 ELSE 1 << length(bin(full_slices)) END) AS slice FROM counted),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM placed GROUP BY source),
capped AS (
  SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM capped),
common AS (SELECT arg_min(lvl, struct_pack(a := most / weight, b := rnk)) AS lvl FROM levels WHERE lvl * weight <= most),
targets AS (
  SELECT l.source, l.source_size, CASE WHEN c.lvl IS NULL THEN most ELSE least(most, c.lvl * weight) END AS target,
         (('0x' || substr(md5('{SEED}|' || coalesce(l.source, '')), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS u
  FROM levels l LEFT JOIN common c ON true),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slice, size, doc_id NULLS FIRST) AS rnk FROM placed)
SELECT r.doc_id, r.size, t.source_size, t.target,
       ((floor(rate * rnk + u) - floor(rate * (rnk - 1) + u)) * r.size)::BIGINT AS taken
FROM ranked r JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets) t
  ON r.source IS NOT DISTINCT FROM t.source
"""
