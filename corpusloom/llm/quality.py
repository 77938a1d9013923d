"""Quality classification by naive-Bayes-scaled n-gram indicators and a linear hinge-loss model (NBSVM)."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import lowest, materialise

#: Hashed n-gram features.
FEATURES = 1 << 17
#: Labelled rows of each class that the linear model is fitted on; the log-count ratios cover all of them.
FIT_ROWS = 2000
#: Bytes of features (4 each) of a class that the driver gets of them; rows beyond that are not fitted on.
FIT_BYTES = 1 << 27
CHUNK = 1 << 20
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)
INVERSE_STEP = np.uint64(pow(int(STEP), -1, 1 << 64))
POWERS = np.concatenate([[np.uint64(1)], np.full(2 * CHUNK, STEP, dtype=np.uint64)]).cumprod(dtype=np.uint64)
INVERSES = np.concatenate([[np.uint64(1)], np.full(2 * CHUNK, INVERSE_STEP, dtype=np.uint64)]).cumprod(dtype=np.uint64)


def bucket(codes: np.ndarray, kind: int) -> np.ndarray:
    return ((codes * np.uint64(2) + np.uint64(2 * kind + 1)) * MIX >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int32)


@np.errstate(over="ignore")
def word_codes(raw: bytes) -> np.ndarray:
    """A number for each run of bytes above the space, from sums over CHUNK bytes at a time that are carried over."""
    parts, held, scale = [], np.uint64(0), np.uint64(1)
    open_word = False  # whether the last byte so far was part of a word
    for begin in range(0, len(raw), CHUNK):
        b = np.frombuffer(raw[begin : begin + CHUNK], dtype=np.uint8).astype(np.uint64)
        inside = b > 32
        starts = inside & ~np.concatenate([[open_word], inside[:-1]])
        ends = ~inside & np.concatenate([[open_word], inside[:-1]])
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        sums = np.concatenate([[np.uint64(0)], (b * POWERS[: len(b)]).cumsum(dtype=np.uint64)])
        if open_word and len(last) and (not len(first) or last[0] < first[0]):
            parts.append(np.array([held + sums[last[0]] * scale], dtype=np.uint64))
            last = last[1:]
            open_word = False
        whole = first[: len(last)]
        parts.append((sums[last] - sums[whole]) * INVERSES[whole])
        if open_word:  # the word goes on through all of these bytes
            held += sums[-1] * scale
            scale *= POWERS[len(b)]
        elif len(first) > len(last):
            held = (sums[-1] - sums[first[-1]]) * INVERSES[first[-1]]
            scale, open_word = POWERS[len(b) - first[-1]], True
    if open_word:
        parts.append(np.array([held], dtype=np.uint64))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text: byte trigrams, words, and pairs of adjacent words.

    A pair of equal words counts as one and the same feature whatever the word, and so do three and four.
    """
    raw, found = (text or "").encode("utf-8"), []
    for begin in range(0, len(raw) - 2, CHUNK):
        b = np.frombuffer(raw[begin : begin + CHUNK + 2], dtype=np.uint8).astype(np.uint64)
        found.append(np.unique(bucket(b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:], 0)))
    words = word_codes(raw)
    if len(words):
        pairs = np.where(words[1:] == words[:-1], np.uint64(0), words[1:] * STEP + words[:-1] * MIX)
        found += [bucket(words, 1), bucket(pairs, 2)]
        same = words[1:] == words[:-1]
        for n in (3, 4):  # of longer n-grams only those of one word: all are one feature
            same = same[1:] & (words[n - 1 :] == words[: 1 - n])
            found.append(bucket(np.zeros(min(1, same.sum()), dtype=np.uint64), n))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int32)


@dataclass
class Model:
    """score = sigmoid(slope * margin + shift), margin = bias + the mean-scaled sum of weights of the features."""

    weights: np.ndarray
    scale: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        scale = self.scale[found]
        norm = float(np.sqrt((scale * scale).sum())) or 1.0
        return float(self.weights[found] @ scale) / norm + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -500, 500))))


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 20):
    """Weights and bias of min |w|^2/2 + c * sum of hinge losses over unit rows of scaled indicators.

    One dual variable at a time is set to its best value in [0, c] while w is kept up to date.
    """
    w, bias = np.zeros(len(scale)), 0.0
    x = [scale[r] / (np.sqrt((scale[r] ** 2).sum()) or 1.0) for r in rows]
    q = np.array([v @ v for v in x]) + 1.0
    alpha, order = np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                bias += step
                alpha[i] = new
    return w, bias


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits labels (-1, 1) to margins, by Newton steps on smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([(d * margins).sum(), d.sum()])
        m = np.array([[(h * margins**2).sum(), (h * margins).sum()], [(h * margins).sum(), h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def class_counts(labelled: DataFrame) -> np.ndarray:
    """Documents of class 0 and 1 that hold each feature, and in a last column the classes' sizes.

    Each task sums its own rows; what it sends is bounded by the number of features, and so is the result.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((2, FEATURES + 1), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                counts[label, features(text)] += 1
                counts[label, FEATURES] += 1
        some = np.flatnonzero(counts.any(0))
        yield pd.DataFrame({"feature": some, "n0": counts[0, some], "n1": counts[1, some]})

    sums = labelled.select("text", "label").mapInPandas(partial, "feature long, n0 long, n1 long")
    rows = sums.groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.zeros((2, FEATURES + 1))
    counts[:, rows["feature"]] = rows[["n0", "n1"]].to_numpy().T
    return counts


def fit(texts: DataFrame, known: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from texts (doc, text) and their labels (id, label), label 0 or 1.

    Labels grow with the documents, so they are joined by a shuffle at every size, and once only.

    The class log-count ratios are counted over all rows. The hinge-loss model is fitted on at most fit_rows rows of
    each class, those whose ids hash lowest, and of these on as many as have FIT_BYTES of features; an id counts once,
    with the text that hashes lowest, so what the driver gets is bounded however often ids repeat. A quarter of the
    rows sets the sigmoid. Where a class has no rows the score is constant, the smoothed share of label 1.
    """
    counts = class_counts(texts.join(known.hint("shuffle_hash"), F.col("doc") == F.col("id")).select("text", "label"))
    sizes = counts[:, FEATURES]
    smooth = counts[:, :FEATURES] + 1
    scale = np.log(smooth[1] / (sizes[1] + 2)) - np.log(smooth[0] / (sizes[0] + 2))
    scale[~counts[:, :FEATURES].any(0)] = 0
    if not sizes.all():
        share = (sizes[1] + 1) / (sizes.sum() + 2)
        return Model(np.zeros(FEATURES), scale, 0.0, 0.0, float(np.log(share / (1 - share))))
    rows = fit_sample(texts, known, fit_rows)
    y = rows["label"].to_numpy() * 2 - 1
    x = [np.frombuffer(r, dtype=np.int32) for r in rows["found"]]
    later = np.arange(len(y)) % 4 == 0
    pick = lambda mask: [x[i] for i in np.flatnonzero(mask)]
    w, bias = dual_coordinate_descent(pick(~later), scale, y[~later])
    model = Model(w, scale, bias, 1.0, 0.0)
    if (y[later] > 0).any() and (y[later] <= 0).any():
        model.slope, model.shift = platt(np.array([model.margin(r) for r in pick(later)]), y[later])
        # the sample has other shares of the classes than the labels
        model.shift += float(np.log(sizes[1] / sizes[0]) - np.log((y > 0).sum() / (y <= 0).sum()))
    return model


def fit_sample(texts: DataFrame, known: DataFrame, fit_rows: int) -> pd.DataFrame:
    """(id, label, found) of the rows to fit on, in order of ids."""
    hashed = known.select("id", "label", F.xxhash64("id").alias("hash"))
    of_class = lambda k: hashed.where(F.col("label") == k)
    few = [of_class(k).join(F.broadcast(lowest(of_class(k), "hash", fit_rows)), "hash") for k in (0, 1)]
    chosen = F.broadcast(few[0].union(few[1]).select("hash", "id", "label"))

    @F.pandas_udf("binary")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).tobytes(), na_action=None)

    rows = texts.join(chosen, F.col("doc") == F.col("id")).select("hash", "id", "label", found("text").alias("found"))
    rows = rows.groupBy("hash", "id", "label").agg(F.min_by("found", F.xxhash64("found")).alias("found"))
    rows = materialise(rows, "sample")
    by_size = rows.select("hash", "label", F.octet_length("found").alias("size")).toPandas().sort_values("hash")
    by_size["upto"] = by_size.groupby("label")["size"].cumsum()
    last = by_size[by_size["upto"] <= FIT_BYTES].groupby("label")["hash"].max()
    within = F.lit(False)
    for label, hash_ in last.items():
        within |= (F.col("label") == int(label)) & (F.col("hash") <= int(hash_))
    return rows.where(within).select("id", "label", "found").toPandas().sort_values(["id", "label"], ignore_index=True)


def score(text: Column, model_of) -> Column:
    """Score of each whole text under a broadcast Model; null counts as empty."""

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        model = model_of.value
        return pd.Series([model.score(features(t)) for t in texts], dtype="float64")

    return udf(text)


def held_out(id_col: Column) -> Column:
    """The fold that labels are never learned from: crc32 of the id as text, mod 4, is 2; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= 0.7).

    Labels of held-out rows, null labels and labels of ids without a document are not learned from; a label
    that is given twice counts once. Null and empty texts get the score of a text without features. Scores
    depend on the text alone, so repeated rows score alike. Columns of docs pass through; columns named
    held_out, score or predicted are replaced. An empty table gives an empty result.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.where(~held_out(F.col("doc")))
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, known))
    scored = docs.withColumn("held_out", held_out(F.col(f"`{id_col}`")))
    scored = scored.withColumn("score", score(F.col(f"`{text_col}`"), model))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
