"""From shared keys to exact links and their components, without all pairs of a group.

Used by the near-duplicate operators. ``posted`` (token, doc, low, large) lists items under the keys that they share: ``low``
is an item of the same list that the row is compared with first, ``large`` says whether the list has more than ``SMALL_LIST``
items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogline.llm._components import connected_components, relabelled
from fogline.llm._scratch import Scratch

#: Lists of up to so many items are compared whole, at most 28 pairs each; longer ones are merged and then prefix-filtered.
SMALL_LIST = 8


def confirm(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity, in hundredths."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("same"), (F.size("set_a") + F.size("set_b")).cast("long").alias("sizes"))
    return both.where(100 * F.col("same") >= similarity * (F.col("sizes") - F.col("same"))).select("a", "b")


def with_lows(posted: DataFrame, scratch: Scratch) -> DataFrame:
    """``posted`` (token, doc; a written table) with low, the smallest item of the list, and large."""
    lists = posted.groupBy("token").agg(F.min("doc").alias("low"), (F.count(F.lit(1)) > SMALL_LIST).alias("large"))
    lists = scratch.write(lists.select(F.col("token").alias("_token"), "low", "large"), "lists")
    near = scratch.sized(lists)
    return posted.join(near, posted["token"] == near["_token"]).select("token", "doc", "low", "large")


def first_pairs(posted: DataFrame) -> DataFrame:
    """Pairs (a, b) of the first comparison: all of a small list, and each item of a large one with its low item."""
    small = posted.where("not large").groupBy("token").agg(F.collect_set("doc").alias("docs"))  # at most SMALL_LIST items
    inner = small.select("docs", F.explode("docs").alias("a")).select("a", F.explode("docs").alias("b")).where("a < b")
    star = posted.where("large and low <> doc").select(F.least("low", "doc").alias("a"), F.greatest("low", "doc").alias("b"))
    return inner.unionByName(star).distinct()


def left_apart(live: DataFrame, similarity: int, scratch: Scratch) -> DataFrame:
    """Pairs of items of different components whose sets can still reach the similarity; ``live`` has doc, component and
    shingles (the whole distinct set).

    Shingles are ordered from rare to frequent. If two sets share enough, the rarest ones they share lie near the front of
    both: at places i and j of sets of n and m, at most min(n - i, m - j) can be shared, and at least
    s / (100 + s) * (n + m) must be. Both bounds are part of the join, so a pair that cannot reach the threshold is not made.
    """
    rows = live.select("doc", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = scratch.write(rows.groupBy(F.col("shingle").alias("_shingle")).agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    often = scratch.sized(often)
    ranked = (
        rows.join(often, rows["shingle"] == often["_shingle"])
        .groupBy("doc", "component", "n")
        .agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("order"))  # bounded by the item's own length
        .withColumn("alone", F.col("n") - F.size("order"))
        .withColumn("front", F.col("n") - F.ceil(F.lit(similarity) * F.col("n") / 100).cast("int") + 1 - F.col("alone"))
        .where("front > 0")
        .select("doc", "component", "n", "alone", F.posexplode(F.slice("order", F.lit(1), F.col("front"))).alias("at", "key"))
        .select("doc", "component", "n", F.col("key.shingle").alias("shingle"), (F.col("at") + F.col("alone")).alias("at"))
    )
    ranked = scratch.write(ranked, "ranked")
    x, y = ranked.alias("x"), ranked.alias("y")
    need = F.lit(similarity) * (F.col("x.n") + F.col("y.n"))
    reach = F.lit(100 + similarity) * F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    return (
        x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") < F.col("y.component")) & (reach >= need))
        .select(F.least("x.doc", "y.doc").alias("a"), F.greatest("x.doc", "y.doc").alias("b"))
        .distinct()
    )


def merged(found: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``found`` after further links (a, b), which join components and not items."""
    links = scratch.write(relabelled(relabelled(links, "a", found, scratch), "b", found, scratch).where("a <> b").distinct(), f"{name}_links")
    joined = connected_components(links, scratch, name)
    fresh = joined.join(scratch.sized(found.select(F.col("node").alias("_node"))), F.col("node") == F.col("_node"), "left_anti")
    return scratch.write(relabelled(found, "component", joined, scratch).unionByName(fresh), f"{name}_found")


def _apart(posted: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(token, doc, component, often, top, minors) of the large lists that hold several components: the length of the list, its
    largest component, and how many of its items are not of that."""
    large = posted.where("large")
    rows = large.select("token", "doc").unionByName(large.select("token", F.col("low").alias("doc"))).distinct()
    rows = scratch.write(relabelled(rows.withColumn("component", F.col("doc")), "component", found, scratch), f"{name}_lists")
    parts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    lists = parts.groupBy(F.col("token").alias("_token")).agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("often"))
    lists = lists.select("_token", "often", F.col("top.component").alias("top"), (F.col("often") - F.col("top.n")).alias("minors")).where("minors > 0")
    lists = scratch.sized(scratch.write(lists, f"{name}_apart"))
    return scratch.write(rows.join(lists, rows["token"] == lists["_token"]).drop("_token"), f"{name}_live")


def link(
    posted: DataFrame,
    similarity: int,
    scratch: Scratch,
    confirmed: Callable[[DataFrame], DataFrame],
    with_sets: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Components (node, component) of the items whose sets reach the similarity and that share a token.

    ``confirmed`` gives those of the pairs (a, b) that are links; ``with_sets`` adds the column shingles to (doc, component).

    Small lists are settled by the first comparison. A large list is merged through its low items, so its pairs grow with the
    list and not with its square; where it still holds several components, its items are compared again by exact prefix
    filtering. Later links join components and not items: components are never computed again from all links.
    """
    found = connected_components(scratch.write(confirmed(first_pairs(posted)), "links"), scratch)
    live = _apart(posted, found, scratch, "first")
    if live.limit(1).count():
        items = scratch.write(live.select("doc", "component").distinct(), "live")
        pairs = scratch.write(left_apart(with_sets(items), similarity, scratch), "late_pairs")
        found = merged(found, confirmed(pairs), scratch, "late_cc")
    scratch.drop("live", "links", "first_lists", "first_live", "first_apart", "late_pairs", "lists", "ranked", "often")
    return found
