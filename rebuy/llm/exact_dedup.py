"""Exact deduplication by content sort (DataFrame operations only).

Rows are ordered by (first characters of the normalised text, SHA-256 of it, id). Sampled
splitters of this key cut the order into slices of about equal numbers of rows; a slice is
sorted externally, equal texts are then neighbours, and each row's whole normalised text is
compared with its neighbour's. The digest stands for the tail of the byte order, so splitters
stay short however long the texts are, and the id lets a splitter cut through a group of
copies: no group, however large, has to fit one task. Runs that touch a slice's ends (two at
most for each slice) are joined across slices at the end.

Defined cases: a null text counts as empty, so all null and empty texts form one group. Of
repeated rows with the same id and text one is kept. A null id sorts below all others; if a
group has no other, ``keep_id`` is null. An empty table gives an empty result. Only the two
named columns are read, whatever else the table holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from rebuy.llm.common import ascii_lower, count_not_above, partitions_of
from rebuy.session import materialize

HEAD = 32  # characters of the text in the sort key
SLICES_PER_PARTITION = 4
SAMPLE_PER_SLICE = 32


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    return rows.select("doc_id", "norm", F.substring("norm", 1, HEAD).alias("head"), F.sha2("norm", 256).alias("digest"))


def _splitters(df: DataFrame, id_col: str, text_col: str, slices: int) -> DataFrame:
    """One row with the ascending cut points, from a sample of rows, which only decides how even the slices are.

    Rows are drawn before they are keyed, so other texts are not read for it.
    """
    total = df.count()
    wanted = slices * SAMPLE_PER_SLICE
    drawn = df.sample(fraction=min(1.0, wanted / total), seed=11) if total > wanted else df
    keys = _keyed(drawn, id_col, text_col).select("head", "digest", "doc_id")
    keys = keys.orderBy("head", "digest", F.col("doc_id").asc_nulls_first()).collect()
    cuts = sorted({round(i * len(keys) / slices) for i in range(1, slices)} - {0, len(keys)})
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"bounds array<struct<head:string,digest:string,doc_id:{id_type}>>"
    return df.sparkSession.createDataFrame([([tuple(keys[i]) for i in cuts],)], schema)


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slices: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; the row with the
    largest id of each group is kept.
    """
    slices = slices or SLICES_PER_PARTITION * partitions_of(df.sparkSession)
    # One row, which travels beside the plan however many cut points it has.
    bounds = F.broadcast(_splitters(df, id_col, text_col, slices))
    keyed = _keyed(df, id_col, text_col).join(bounds)
    place = count_not_above(F.col("bounds"), F.struct("head", "digest", "doc_id"), max(2, math.isqrt(slices)))
    order = Window.partitionBy("slice").orderBy("head", "digest", "norm", F.col("doc_id").asc_nulls_first())
    compared = keyed.withColumn("slice", place.cast("int")).drop("bounds").select(
        "slice",
        "doc_id",
        "digest",
        F.row_number().over(order).alias("pos"),
        F.when(F.lag("norm").over(order) == F.col("norm"), 0).otherwise(1).alias("starts"),
    )
    light = Window.partitionBy("slice").orderBy("pos")
    numbered = compared.select(
        "slice", "doc_id", "digest", "pos", F.sum("starts").over(light.rowsBetween(Window.unboundedPreceding, 0)).alias("run")
    )
    run, slice_ = Window.partitionBy("slice", "run"), Window.partitionBy("slice")
    runs = numbered.select(
        "slice",
        "doc_id",
        "digest",
        F.count(F.lit(1)).over(run).alias("n"),
        F.max("doc_id").over(run).alias("top"),
        (F.max("pos").over(run) == F.col("pos")).alias("last"),
        ((F.col("run") == 1) | (F.col("run") == F.max("run").over(slice_))).alias("at_edge"),
    )
    stored = materialize(runs, "content-sort")
    # At most two runs per slice touch an edge, so this side is bounded by the number of slices.
    across = (
        stored.filter("at_edge and last")
        .groupBy("digest")
        .agg(F.sum("n").alias("all_n"), F.max("top").alias("all_top"), F.max("slice").alias("last_slice"), F.lit(True).alias("at_edge"))
    )
    joined = stored.join(F.broadcast(across), ["digest", "at_edge"], "left")
    return joined.select(
        "doc_id",
        F.when(F.col("all_n").isNull(), F.col("top")).otherwise(F.col("all_top")).alias("keep_id"),
        F.coalesce("all_n", "n").cast("long").alias("group_size"),
        (F.col("last") & (F.col("slice") == F.coalesce("last_slice", "slice"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows with all their columns."""
    kept = duplicate_groups(df, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest"))
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.withColumns({"__sha": F.sha2(norm, 256), "__own": F.col(id_col)})
    matched = rows.join(kept, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__digest")), "left_semi")
    # Rows repeated with the same id and text all match; the join has already put them together.
    one = Window.partitionBy("__own", "__sha").orderBy(F.lit(0))
    return matched.withColumn("__n", F.row_number().over(one)).filter("__n = 1").select(*df.columns)
