"""The ordered filter cascade over dialogue pairs, with the reason each dropped pair goes."""

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONTINUE, HAN_OR_PUNCTUATION, STOPWORDS, char_len, class_ratio, is_degenerate, strip_noise
from ..sources.staging import staged
from .metrics import distinct_share


@dataclass(frozen=True)
class Limits:
    """Thresholds of the cascade; the language class may be any character class."""

    min_user: int = 3
    min_assistant: int = 6
    max_user: int = 200
    max_assistant: int = 400
    max_combined: int = 440
    least_ratio: float = 0.5
    character_class: str = HAN_OR_PUNCTUATION
    echo_from: int = 6


def drop_reason(user: Column, asst: Column, limits: Limits) -> Column:
    """First test that a cleaned pair fails, null if it passes all. The order of the tests carries the meaning."""
    n_user, n_asst = char_len(user), char_len(asst)
    ratio = class_ratio(F.concat_ws(" ", user, asst), limits.character_class)
    return (
        F.when((F.length(user) < limits.min_user) | (F.length(asst) < limits.min_assistant), "too_short")
        .when(user.isin(*STOPWORDS) | ((F.length(user) <= 3) & user.contains(CONTINUE)), "stopword_user")
        .when(
            (n_user > limits.max_user) | (n_asst > limits.max_assistant) | (n_user + n_asst > limits.max_combined),
            "too_long",
        )
        .when(ratio < limits.least_ratio, "low_ratio")
        .when(is_degenerate(user) | is_degenerate(asst), "degenerate")
        .when((user == asst) | ((F.length(user) >= limits.echo_from) & F.contains(asst, user)), "echo")
    )


def filter_pairs(pairs: DataFrame, order: list[str], limits: Limits | None = None) -> DataFrame:
    """Cleaned pairs with the reason they are dropped for; null means kept.

    Pairs with an empty side are left out uncounted. Of pairs that pass all tests and are equal after cleaning, the
    first in order is kept and the others are dropped as dup; of those that share that place any one is kept.

    Pairs are cleaned and judged once, into a table that also numbers them. Only digests and places of those that pass
    are aggregated, and the numbers of the first ones come back, so copies of a pair are never gathered.
    """
    limits = limits or Limits()
    present = pairs.where("user <> '' and asst <> ''")
    cleaned = present.withColumns({"user": strip_noise(F.col("user")), "asst": strip_noise(F.col("asst"))})
    judged = cleaned.withColumn("drop_reason", drop_reason(F.col("user"), F.col("asst"), limits))
    columns = judged.columns
    numbered = judged.withColumns({"_row": F.monotonically_increasing_id(), "_pair": F.sha2(F.concat_ws("\0", F.length("user"), "user", "asst"), 256)})
    numbered = staged(numbered, "judged")
    passed = numbered.where(F.col("drop_reason").isNull())
    first = passed.groupBy("_pair").agg(F.min(F.struct(*order, "_row")).alias("_first")).select(F.col("_first._row").alias("_kept"))
    marked = passed.select("_row", *columns).join(first, F.col("_row") == F.col("_kept"), "left")
    marked = marked.withColumn("drop_reason", F.when(F.col("_kept").isNull(), "dup"))
    return numbered.where(F.col("drop_reason").isNotNull()).select(*columns).unionByName(marked.select(*columns))


def drop_counts(judged: DataFrame) -> DataFrame:
    """(reason, n) of filter_pairs(), kept pairs under "kept"."""
    return judged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def first_of_equals(rows: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """rows with one row of each key, the first in order, by one pre-aggregated minimum a key and a join.

    Rows find their key's minimum by the digest of the key and by their place, so no group is gathered or
    sorted, however many rows a key has. Null is a value of a key like any other. Of rows that share both key
    and place any one stays. A column named `row` and others of any name pass through.
    """
    named = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(key)))
    digest = F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)
    marked = rows.select(F.struct("*").alias("row"), digest.alias("_key"), F.struct(*order).alias("_place"))
    first = marked.groupBy(F.col("_key").alias("_of")).agg(F.min("_place").alias("_first"))
    kept = marked.join(first, (F.col("_key") == F.col("_of")) & F.col("_place").eqNullSafe(F.col("_first")))
    return kept.dropDuplicates(["_key"]).select("row.*")


def filter_sample(ids: Column, text: Column, han: str = r"[\x{4e00}-\x{9fff}]") -> Column:
    """Whether a generated sample is worth keeping: long, varied in token 3-grams, and mostly Chinese.

    At least 40 ids, distinct 3-grams at least 0.35 of their number, a text of which 0.3 are Han characters.
    """
    n = F.size(ids)

    @F.pandas_udf("double")
    def variety(values: pd.Series) -> pd.Series:
        return pd.Series([0.0 if v is None else distinct_share(np.asarray(v, dtype=np.int64) & 0xFFFFFFFF, 3) for v in values], dtype="float64")

    varied = variety(ids) >= 0.35
    share = F.regexp_count(text, F.lit(han)) >= 0.3 * F.length(text)
    return F.when((n >= 40) & (text != ""), varied & share).otherwise(F.lit(False))


def acceptance(judged: DataFrame, group: list[str], keep: str = "keep") -> DataFrame:
    """Per group: samples, those kept, and the share of them; no samples in all give no row."""
    kept = F.count_if(F.col(keep))
    return judged.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), kept.alias("n_kept"), (kept / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("rate")
    )


def appended(roots: list[DataFrame], order: list[str], most: int) -> DataFrame:
    """Rows of several roots one after the other, each in order until so many are there in all; 0 means all rows.

    The limit is checked after a row was added, so every later root still adds its first row. A root's first rows
    are found by a top-k of that size, and only those are counted.
    """
    tops = [r.orderBy(*order).limit(most) if most else r for r in roots]
    numbered = [t.withColumn("__root", F.lit(i)) for i, t in enumerate(tops)]
    rows = functools.reduce(DataFrame.unionByName, numbered)
    if not most:
        return rows.drop("__root")
    counts = rows.groupBy("__root").agg(F.count(F.lit(1)).cast("int").alias("__n"))  # one row a root
    listed = counts.agg(F.array_sort(F.collect_list(F.struct("__root", "__n"))).alias("__counts"))
    add = lambda total, c: total + F.least(c["__n"], F.greatest(most - total, F.lit(1)))
    before = F.aggregate(F.filter("__counts", lambda c: c["__root"] < F.col("__root")), F.lit(0), add)
    place = F.row_number().over(Window.partitionBy("__root").orderBy(*order))
    kept = rows.withColumn("__place", place).crossJoin(F.broadcast(listed)).where(F.col("__place") <= F.greatest(most - before, F.lit(1)))
    return kept.drop("__root", "__place", "__counts")
