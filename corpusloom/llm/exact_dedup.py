"""Exact deduplication by 128-bit content hash with a byte comparison inside each hash group."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of=content_hash
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows whose texts are byte-identical form a group; the row with the smallest (keep="min") or largest
    (keep="max") id stays.

    The grouping key is (hash, text): the hash alone decides nothing, because Spark's aggregation compares
    the text's bytes whenever two keys hash alike, so two texts that collide stay apart. Copies collapse
    map-side, one row per distinct text and task is shuffled, so a group that holds a third of the table
    reaches the reducer as one row per task. Rows are then sent to their group by (hash, sha256), two
    independent digests, without their text and without comparing bytes again; that join may be split by AQE where one group is very large.

    Null texts count as empty, null ids lose against any other id and keep_id is null only where all ids of
    the group are null. Of rows that repeat the same winning id each is marked kept: they are the same row.
    An empty table gives an empty result. Extra columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    marks = rows.select("_id", hash_of(F.col("_text")).alias("_h"), F.sha2("_text", 256).alias("_sha"))
    groups = equal_texts(rows, keep, hash_of)
    return marks.join(groups, (F.col("_h") == F.col("_gh")) & (F.col("_sha") == F.col("text_sha256"))).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def text_of(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit(""))


def equal_texts(rows: DataFrame, keep: str, hash_of) -> DataFrame:
    """(_gh, text_sha256, keep_id, group_size) of each distinct text of (_id, _text) rows."""
    best = F.max("_id") if keep == "max" else F.min("_id")
    groups = rows.groupBy(hash_of(F.col("_text")).alias("_h"), "_text").agg(
        best.alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return groups.select(F.col("_h").alias("_gh"), F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """docs with one row of each distinct text, that of the smallest or largest id; all columns stay.

    Of rows that repeat both id and text any one stays. Rows find their group by its digests and the id that
    stays, so a large group is spread over its ids and only one row of it passes the join.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text"))
    groups = equal_texts(rows, keep, content_hash).drop("group_size")
    text = text_of(text_col)
    marked = docs.select(  # the row as one value, so that its columns' names can't clash
        F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("_id"), content_hash(text).alias("_h"), F.sha2(text, 256).alias("_sha")
    )
    same = (F.col("_h") == F.col("_gh")) & (F.col("_sha") == F.col("text_sha256"))
    kept = marked.join(groups, same & F.col("_id").eqNullSafe(F.col("keep_id")))
    return kept.dropDuplicates(["_h", "_sha", "_id"]).select("row.*")
