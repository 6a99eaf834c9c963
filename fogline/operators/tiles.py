"""Connected areas of large grids, tile by tile.

Every tile labels its own active cells, in a task that holds one tile. Only labels of cells on tile borders are joined with those
next to them; what a frame's labels come to is decided on these links. So no group holds a frame: an object over many tiles
is gathered when its cells are listed, and then only it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fogline.functions.numeric import at_least
from fogline.operators.labelling import AREA_CELLS, CLOUDBURST_MM
from fogline.operators.objects import MIN_AREA, components

TILE = 64


def labelled_cells(cells: DataFrame, threshold: float, nx: int, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """(keys, row, col, value, label) of cells at or above the threshold; label is the smallest row * nx + col of the cell's area."""
    active = cells.where(at_least(F.col("value"), threshold)).select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in active.schema.fields if f.name in keys)
    tiled = active.withColumn("_ty", F.floor(F.col("row") / tile)).withColumn("_tx", F.floor(F.col("col") / tile))

    def label(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["row"].to_numpy(), part["col"].to_numpy()
        ordered = np.lexsort((c, r))
        first = components(r, c)  # places in row-major order
        part = part[[*keys, "row", "col", "value"]].copy()
        part["label"] = (r * nx + c)[ordered][first]
        return part

    local = tiled.groupBy(*keys, "_ty", "_tx").applyInPandas(label, f"{ddl + ', ' if ddl else ''}row long, col long, value double, label long")
    edge = local.where((F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1)).select(*keys, "row", "col", "label")
    later = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("r"), (F.col("col") + dc).alias("c")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    reach = edge.select(*keys, F.col("label").alias("a"), later.alias("at")).select(*keys, "a", F.col("at.r").alias("row"), F.col("at.c").alias("col"))
    links = reach.join(edge, [*keys, "row", "col"]).where("a <> label").select(*keys, "a", F.col("label").alias("b")).distinct()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while root.setdefault(k, k) != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in zip(part["a"], part["b"], strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        out = pd.DataFrame({"a": list(root), "root": [find(k) for k in list(root)]})
        for k in keys:
            out[k] = part[k].iloc[0]
        return out[[*keys, "a", "root"]]

    roots = links.groupBy(*keys).applyInPandas(merge, f"{ddl + ', ' if ddl else ''}a long, root long")  # a frame's border links
    return local.withColumnRenamed("label", "a").join(roots, [*keys, "a"], "left").select(*keys, "row", "col", "value", F.coalesce("root", "a").alias("label"))


def detect_in_tiles(cells: DataFrame, threshold: float, nx: int, keys: Sequence[str], min_area: int = MIN_AREA, tile: int = TILE) -> DataFrame:
    """The objects of ``objects.detect_objects``, found tile by tile: for grids whose active cells do not fit in a task. Keys are not null."""
    rows = labelled_cells(cells, threshold, nx, keys, tile)
    found = rows.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).cast("int").alias("area_cells"), F.max("value").alias("max_value"), F.avg("col").alias("centroid_x"), F.avg("row").alias("centroid_y"),
        F.min("row").cast("int").alias("row_min"), F.max("row").cast("int").alias("row_max"), F.min("col").cast("int").alias("col_min"), F.max("col").cast("int").alias("col_max"),
        F.array_sort(F.collect_list((F.col("row") * nx + F.col("col")).cast("int"))).alias("cells"),
    ).where(F.col("area_cells") >= min_area)
    order = Window.partitionBy(*keys).orderBy("label")
    return found.withColumn("object", (F.row_number().over(order) - 1).cast("int")).select(*keys, "object", "area_cells", "max_value", "centroid_x", "centroid_y", "row_min", "row_max", "col_min", "col_max", "cells")


def cloudburst_areas(rates: DataFrame, nx: int, keys: Sequence[str], limit: float = CLOUDBURST_MM, least: int = AREA_CELLS, tile: int = TILE) -> DataFrame:
    """Areas of at least five contiguous cells with at least 100 mm in the hour: a proxy label, not a gauge."""
    return detect_in_tiles(rates, limit, nx, keys, least, tile)
