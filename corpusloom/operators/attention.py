"""Batch analytics over tables of logits and vectors: routing load, pooling, windowed attention, sampling."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, repetition_penalty, softmax
from . import arrays


def expert_load(rows: DataFrame, logits: str, k: int) -> DataFrame:
    """(expert, load, mean_prob): share of the k slots an expert gets, and its mean softmax probability."""
    ordered = lambda p: F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    best = ordered(softmax(F.col(logits)))
    each = rows.select(F.posexplode(best).alias("place", "p"))
    each = each.select(F.struct(F.col("p.i").alias("expert"), (-F.col("p.v")).alias("prob"), (F.col("place") < k).alias("hit")).alias("e"))
    by = each.groupBy("e.expert").agg(F.count_if("e.hit").alias("hits"), F.avg("e.prob").alias("mean_prob"), F.count(F.lit(1)).alias("n"))
    return by.select("expert", (F.col("hits") / (F.col("n") * k)).alias("load"), "mean_prob")


def switch_loss(load: DataFrame, experts: int, weight: float = 1.0) -> DataFrame:
    """One row: weight * experts * sum of load times mean probability."""
    return load.agg((weight * experts * F.sum(F.col("load") * F.col("mean_prob"))).alias("loss"))


def dispatch(routes: DataFrame, key: str) -> DataFrame:
    """(key, expert, weight) of (key, slot, expert, weight): where a row names an expert twice the last slot counts."""
    return routes.groupBy(key, "expert").agg(F.max_by("weight", "slot").alias("weight"))


def block_mean_pool(rows: DataFrame, group: list[str], pos: str, value: str, block: int) -> DataFrame:
    """(group, block, dim, mean): means of each dimension over blocks of positions; a last partial block goes."""
    each = rows.select(*group, F.floor(F.col(pos) / block).alias("block"), pos, F.posexplode(value).alias("dim", "v"))
    pooled = each.groupBy(*group, "block", "dim").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("_n"))
    return pooled.where(F.col("_n") == block).drop("_n")


def prior_block_mean(pooled: DataFrame, group: list[str]) -> DataFrame:
    """pooled with prior, the mean of all earlier blocks of the same dimension (0 if there is none)."""
    before = Window.partitionBy(*group, "dim").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return pooled.withColumn("prior", F.coalesce(F.avg("mean").over(before), F.lit(0.0)))


def attention_pairs(rows: DataFrame, group: list[str], pos: str, vec: str, window: int) -> DataFrame:
    """(group, q, k, score): dot products of each position with itself and those up to `window` ahead.

    The band is an equi-join: positions are cut into buckets as wide as the window, and each key is sent to
    its own bucket and the one before, so a task gets neighbours only.
    """
    bucket = F.floor(F.col(pos) / (window + 1))
    q = rows.select(*group, F.col(pos).alias("q"), F.col(vec).alias("_x"), bucket.alias("_b"))
    k = rows.select(*group, F.col(pos).alias("k"), F.col(vec).alias("_y"), F.explode(F.array(bucket, bucket - 1)).alias("_b"))
    band = q.join(k, [*group, "_b"]).where((F.col("k") >= F.col("q")) & (F.col("k") <= F.col("q") + window))
    return band.select(*group, "q", "k", dot(F.col("_x"), F.col("_y")).alias("score"))


def causal_pairs(rows: DataFrame, group: list[str], pos: str, vec: str, size: int = 256) -> DataFrame:
    """(group, q, k, score) of every position, from 0, with those not after it.

    The pairs are the result; for weighted values see attended, which makes none. The join is on buckets of `size` keys,
    to which each later position is sent, so what meets in a task is bounded on one side, and a long sequence is many keys
    of which the larger can be split.
    """
    bucket = F.floor(F.col(pos) / size)
    q = rows.select(*group, F.col(pos).alias("q"), F.col(vec).alias("_x"), F.explode(F.sequence(F.lit(0).cast("long"), bucket)).alias("_b"))
    k = rows.select(*group, F.col(pos).alias("k"), F.col(vec).alias("_y"), bucket.alias("_b"))
    pairs = q.join(k, [*group, "_b"]).where(F.col("k") <= F.col("q"))
    return pairs.select(*group, "q", "k", dot(F.col("_x"), F.col("_y")).alias("score"))


def attend(pairs: DataFrame, group: list[str], scale: float, sink: float | None = None) -> DataFrame:
    """pairs with weight: the softmax of the scaled scores of a query; a sink adds a logit that takes no value."""
    w = Window.partitionBy(*group, "q")
    scored = pairs.withColumn("_s", F.col("score") * scale)
    top = F.max("_s").over(w) if sink is None else F.greatest(F.max("_s").over(w), F.lit(sink))
    scored = scored.withColumn("_top", top).withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
    below = F.sum("_e").over(w) + (0 if sink is None else F.exp(F.lit(sink) - F.col("_top")))
    return scored.withColumn("weight", F.col("_e") / below).drop("_s", "_top", "_e")


def keep_top(pairs: DataFrame, group: list[str], k: int, ties: bool) -> DataFrame:
    """The k best keys of each query; with ties every key at the threshold stays."""
    w = Window.partitionBy(*group, "q").orderBy(F.desc("score"))
    place = F.rank().over(w) if ties else F.row_number().over(w.orderBy(F.desc("score"), "k"))
    return pairs.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def block_pairs(rows: DataFrame, group: list[str], pos: str, vec: str, block: int) -> DataFrame:
    """(group, q, k, score): dot products of each position with the means of the whole blocks before its own.

    A sequence has one k for each `block` positions, so there are that many times fewer pairs than between positions.
    """
    pooled = block_mean_pool(rows, group, pos, vec, block)
    pooled = pooled.groupBy(*group, F.col("block").alias("k")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("_y")
    )
    q = rows.select(*group, F.col(pos).alias("q"), F.col(vec).alias("_x"))
    pairs = q.join(pooled, group).where(F.col("k") < F.floor(F.col("q") / block))
    return pairs.select(*group, "q", "k", dot(F.col("_x"), F.col("_y")).alias("score"))


def block_attention(rows: DataFrame, group: list[str], pos: str, vec: str, block: int, k: int, scale: float, digits: int | None = None) -> DataFrame:
    """(group, q, k, score, weight) of the k best earlier blocks of each position, ties kept, with softmax weights.

    Positions of the first block have no earlier one and no rows. digits rounds the scores before they are ranked.
    """
    pairs = block_pairs(rows, group, pos, vec, block)
    if digits is not None:
        pairs = pairs.withColumn("score", F.round("score", digits))
    return attend(keep_top(pairs, group, k, ties=True), group, scale)


def sample_tokens(logits: DataFrame, key: list[str], draw: Column, temperature: float, k: int) -> DataFrame:
    """(key, tok, prob): the token drawn from (key, tok, logit) rows by inverse distribution.

    Logits are divided by the temperature, those below the k-th largest go (ties stay), the rest become
    probabilities; the first token in order whose cumulative probability exceeds draw is taken.
    """
    w = Window.partitionBy(*key)
    kept = logits.withColumn("_l", F.col("logit") / temperature)
    kept = kept.withColumn("_r", F.rank().over(w.orderBy(F.desc("_l")))).where(F.col("_r") <= k)
    kept = kept.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(w)))
    kept = kept.withColumn("prob", F.col("_e") / F.sum("_e").over(w))
    kept = kept.withColumn("_cum", F.sum("prob").over(w.orderBy("tok"))).withColumn("_u", draw)
    taken = kept.withColumn("_hit", (F.col("_cum") > F.col("_u")))
    return taken.groupBy(*key).agg(
        F.coalesce(F.min_by("tok", F.when(F.col("_hit"), F.col("tok"))), F.max("tok")).alias("tok")
    )


def cross_entropy(rows: DataFrame, logp: Column, target: Column, ignored: int = -100) -> DataFrame:
    """One row: mean negative log-probability over the targets that count."""
    return rows.agg(F.avg(F.when(target != ignored, -logp)).alias("loss"))


def ahead_targets(rows: DataFrame, ids_col: str, steps: int) -> DataFrame:
    """rows with ahead_1..ahead_steps: arrays of the tokens that follow each token of an array, null past the end."""
    return rows.withColumns({f"ahead_{n}": arrays.ahead(F.col(ids_col), n) for n in range(1, steps + 1)})


def ahead_totals_of(texts: pa.Array, steps: int) -> pa.Array:
    ids = arrays.code_points_of(texts)
    found = [arrays.totals_of(arrays.ahead_of(ids, n)) for n in range(1, steps + 1)]
    return pa.StructArray.from_arrays(found, names=[f"t{n}" for n in range(1, steps + 1)])


def ahead_totals(text: Column, steps: int) -> Column:
    """struct t1..tsteps: arrays.totals() of the ahead_targets() of a text's code points, in one UDF that sends no arrays."""
    kind = ", ".join(f"t{n}: {arrays.TOTALS}" for n in range(1, steps + 1))
    return arrays.by_pieces(f"struct<{kind}>", lambda texts: ahead_totals_of(texts, steps), text)


def penalise(logits: DataFrame, history: DataFrame, key: list[str], penalty: float, once: bool = False, context: int | None = None) -> DataFrame:
    """logits (key, tok, logit) with the logit penalised for each time that its token is in history (key, pos, tok).

    Occurrences are counted over the whole history, over its last context places, or once a token. Only counts are
    joined; tokens that never occurred keep their logit, and a null logit stays null.
    """
    seen = history
    if context is not None:
        ends = history.groupBy(*key).agg(F.max("pos").alias("__end"))
        seen = history.join(ends, key).where(F.col("pos") > F.col("__end") - context)
    counts = seen.groupBy(*key, "tok").agg(F.count(F.lit(1)).alias("__n"))
    joined = logits.join(counts, [*key, "tok"], "left").withColumn("logit", repetition_penalty(F.col("logit"), F.coalesce("__n", F.lit(0)), penalty, once))
    return joined.select(*(F.col(f"`{c}`") for c in logits.columns))
