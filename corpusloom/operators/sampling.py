"""Seeded, deterministic sampling and splitting with exact counts.

Rows are ranked by a hash of seed, group and id, so a result depends on the data alone. Ranks inside a group
come from counting: rows are dealt into buckets by the leading bits of their hash, buckets are counted, and
only rows of one bucket are ranked together. A source that holds a third of all rows is thus never sorted in
one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 1337
BUCKETS = 1024


def order_key(seed, *parts: Column) -> Column:
    """Hex digest that orders rows; text so that SQL engines agree on it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)) if not isinstance(seed, Column) else seed, *(p.cast("string") for p in parts)))


def ranked(rows: DataFrame, group: list[str], seed, id_cols: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows with rn, the place (from 1) in its group by order_key, and n, the group's size."""
    keyed = rows.withColumn("__ranked_key", order_key(seed, *(F.col(c) for c in group + id_cols)))
    keyed = keyed.withColumn("__ranked_bucket", F.pmod(F.conv(F.substring("__ranked_key", 1, 8), 16, 10).cast("long") / (2**32 // buckets), F.lit(2**40)).cast("int"))
    counts = keyed.groupBy(*group, "__ranked_bucket").agg(F.count(F.lit(1)).alias("__ranked_count"))
    upto = Window.partitionBy(*group).orderBy("__ranked_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = counts.select(
        *(F.col(c).alias(f"_{c}_of") for c in group),
        F.col("__ranked_bucket").alias("__ranked_of_bucket"),
        F.coalesce(F.sum("__ranked_count").over(upto), F.lit(0)).alias("__ranked_before"),
        F.sum("__ranked_count").over(whole).alias("n"),
    )
    on = F.col("__ranked_bucket") == F.col("__ranked_of_bucket")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}_of"))
    within = Window.partitionBy(*group, "__ranked_bucket").orderBy("__ranked_key", *id_cols)
    out = keyed.withColumn("__ranked_row", F.row_number().over(within)).join(offsets, on)
    out = out.withColumn("rn", F.col("__ranked_before") + F.col("__ranked_row"))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), "rn", "n")


def split(rows: DataFrame, group: list[str], id_cols: list[str], share: tuple[int, int] = (9, 10), seed: int = SEED) -> DataFrame:
    """rows with split: train for exactly floor(n * share) rows of each group, val for the rest."""
    r = ranked(rows, group, seed, id_cols)
    return r.withColumn("split", F.when(F.col("rn") <= F.floor(F.col("n") * share[0] / share[1]), "train").otherwise("val")).drop("rn", "n")


def down_sample(rows: DataFrame, ratio: Column, group: list[str], id_cols: list[str], seed: int = SEED) -> DataFrame:
    """Rows of each group cut to max(1, floor(n * ratio)); a ratio of 1 or more keeps all, 0 or less none."""
    r = ranked(rows.withColumn("_ratio", ratio), group, seed, id_cols)
    enough = F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.col("_ratio")))
    keep = F.when(F.col("_ratio") >= 1, True).when(F.col("_ratio") > 0, enough).otherwise(False)
    return r.where(keep).drop("rn", "n", "_ratio")


def ratio_for(source: Column, specs: list[tuple[str, float]], default: float = 1.0) -> Column:
    """Ratio of a source by prefix; the last spec that matches wins."""
    out = F.lit(default)
    for prefix, ratio in specs:
        out = F.when(source.startswith(prefix), ratio).otherwise(out)
    return out


def char_split(text: Column, share: tuple[int, int] = (9, 10)) -> Column:
    """Struct of train and val, the first share of a text's characters and the rest."""
    cut = F.floor(F.length(text) * share[0] / share[1]).cast("int")
    return F.struct(F.substring(text, F.lit(1), cut).alias("train"), F.substring(text, cut + 1, F.length(text)).alias("val"))


def sample_prompts(blocks: DataFrame, key: list[str], user: str, model: str, seed: int = SEED) -> DataFrame:
    """One prompt a block: the lines up to a user line that isn't the first, drawn by hash, and an open model turn."""
    lines = blocks.select(*key, "block", F.posexplode(F.split("block", "\n")).alias("pos", "line"))
    asked = lines.where((F.col("pos") > 0) & F.col("line").startswith(user))
    drawn = asked.groupBy(*key, "block").agg(
        F.min_by("pos", F.struct(order_key(seed, *(F.col(c) for c in key), F.col("pos")), "pos")).alias("pos")
    )
    head = F.array_join(F.slice(F.split("block", "\n"), F.lit(1), F.col("pos") + 1), "\n")
    return drawn.select(*key, F.concat(head, F.lit(f"\n{model}")).alias("prompt"))


def mix_schedule(batches: DataFrame, batch_col: str, probability: float, seed: int = SEED) -> DataFrame:
    """batches with source second for a hash-drawn share of the batches, first for the rest."""
    draw = F.conv(F.substring(order_key(seed, F.col(batch_col)), 1, 8), 16, 10).cast("long") % 10000
    return batches.withColumn("source", F.when(draw < int(probability * 10000), "second").otherwise("first"))


def length_batches(rows: DataFrame, ids_col: str, order: list[str], batch: int, keep_last: int = 96, pad: int = 0) -> DataFrame:
    """Rows of similar length in batches: the last keep_last ids, padded on the left to the batch's longest.

    Rows are range-partitioned by length and batched inside each partition, so no task sees them all.
    """
    cut = F.when(F.size(ids_col) > keep_last, F.slice(ids_col, -keep_last, keep_last)).otherwise(F.col(ids_col))
    rows = rows.withColumn(ids_col, cut).withColumn("_n", F.size(ids_col)).repartitionByRange("_n", *order)
    rows = rows.withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy("_part").orderBy("_n", *order)
    rows = rows.withColumn("batch", F.concat_ws("-", "_part", F.floor((F.row_number().over(w) - 1) / batch)))
    longest = F.max("_n").over(Window.partitionBy("_part", "batch"))
    padded = F.concat(F.array_repeat(F.lit(pad), longest - F.col("_n")), F.col(ids_col))
    return rows.withColumn(ids_col, padded).drop("_n", "_part")
