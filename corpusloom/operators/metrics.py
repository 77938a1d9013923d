"""Text-quality metrics: n-gram repetition and variety, and means over groups."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import no_spaces, turn_structure, whitespace_ratio


def gram_counts(codes: np.ndarray, n: int) -> np.ndarray:
    """How often each distinct n-gram of a sequence of numbers below 2**32 occurs."""
    size = len(codes) - n + 1
    if size < 1:
        return np.zeros(0, dtype=np.int64)
    key = codes[:size].astype(np.uint64)
    for k in range(1, n):
        if k > 1:  # the gram so far as a number below the sequence's length, so that the next one fits beside it
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = key << np.uint64(32) | codes[k : k + size].astype(np.uint64)
    return np.unique(key, return_counts=True)[1]


def repeated_share(codes: np.ndarray, n: int) -> float:
    counts = gram_counts(codes, n)
    return float(counts[counts > 1].sum() / counts.sum()) if len(codes) >= 2 * n else 0.0


def distinct_share(codes: np.ndarray, n: int) -> float:
    counts = gram_counts(codes, n)
    return float(len(counts) / counts.sum()) if len(counts) else 0.0


def of_characters(text: Column, measure: Callable[[np.ndarray, int], float], n: int) -> Column:
    """A measure of the n-grams of a text's characters, white space left out; null counts as empty.

    Grams are counted row by row on arrays, so nothing is shuffled and rows that share an id stay apart. Sorting
    numbers there is many times faster than lambdas over arrays of one-character strings.
    """

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([measure(np.frombuffer(t.encode("utf-32-le"), dtype="<u4"), n) for t in texts], dtype="float64")

    return udf(no_spaces(F.coalesce(text, F.lit(""))))


def repetition(text: Column, n: int) -> Column:
    """Share of n-gram occurrences whose gram occurs more than once, 0 below 2n characters."""
    return of_characters(text, repeated_share, n)


def distinct(text: Column, n: int) -> Column:
    """Distinct n-grams among all, 0 below n characters."""
    return of_characters(text, distinct_share, n)


def ngram_repetition(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, repetition) of each row, also of those that share an id."""
    return docs.select(id_col, repetition(F.col(text_col), n).alias("repetition"))


def distinct_n(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, distinct) of each row, also of those that share an id."""
    return docs.select(id_col, distinct(F.col(text_col), n).alias("distinct"))


def evaluation_record(samples: DataFrame, group: list[str], n_tokens: Column, text_col: str = "text", user: str = "用户", model: str = "模型") -> DataFrame:
    """Per group of samples the means of their length, repetition, white space, variety and turns, least repeated first.

    Means are rounded as reports show them: lengths and turns to one digit, shares to four. Null texts count as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = {"avg_len_tokens": (n_tokens, 1)}
    parts |= {f"rep{n}": (repetition(text, n), 4) for n in (2, 3, 4)}
    parts |= {"ws_ratio": (whitespace_ratio(text), 4)} | {f"distinct{n}": (distinct(text, n), 4) for n in (1, 2)}
    parts["turn_structure"] = (turn_structure(text, user, model)["turns"], 1)
    each = samples.select(*group, *(value.alias(name) for name, (value, _) in parts.items()))
    means = each.groupBy(*group).agg(*(F.round(F.avg(name), digits).alias(name) for name, (_, digits) in parts.items()))
    return means.orderBy("rep3", *group)


def eos_summary(samples: DataFrame, group: list[str]) -> DataFrame:
    """Per group: samples, hits (eos_pos is set), hit rate, mean place of the hits, samples of two turns or more."""
    hits = F.count_if(F.col("eos_pos").isNotNull())
    return samples.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        hits.alias("eos_hits"),
        (hits / F.count(F.lit(1))).alias("eos_rate"),
        (F.coalesce(F.sum("eos_pos"), F.lit(0)) / F.greatest(hits, F.lit(1))).alias("mean_eos_pos"),
        F.count_if(F.col("turns") >= 2).alias("multi_turn"),
    )


def corpus_totals(docs: DataFrame, group: list[str], n_tokens: str | None = None) -> DataFrame:
    """Per group: documents, characters, mean characters, and tokens where a count is given."""
    chars = F.sum(F.length("text"))
    more = [F.sum(n_tokens).alias("n_tokens")] if n_tokens else []
    return docs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_docs"), chars.alias("n_chars"), (chars / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_chars"), *more
    )


def sums_where(rows: DataFrame, value: str, predicates: dict[str, Column]) -> DataFrame:
    """One row: the sum of a value over the rows of each predicate, 0 where there are none; for parameters by kind."""
    return rows.agg(*(F.coalesce(F.sum(F.when(p, F.col(value))), F.lit(0)).alias(name) for name, p in predicates.items()))
