"""Vocabularies, encodings, token windows and loss masks."""

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TURN_MARKERS
from . import arrays
from .sampling import order_key

IGNORED = -100


def char_vocab(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(ch, id): the distinct characters in code point order, numbered from 0.

    The numbering sorts distinct characters only, a set bounded by Unicode.
    """
    chars = docs.select(F.explode(F.array_distinct(F.split(text_col, ""))).alias("ch")).where("ch <> ''").distinct()
    return chars.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).cast("long").alias("id"))


def char_encoder(docs: DataFrame, vocab: DataFrame) -> Callable[[pa.Array], pa.Array]:
    """What makes lists of character numbers of an Arrow array of texts.

    The vocabulary, which Unicode bounds, is sent to tasks as two sorted arrays of its own size.
    """
    known = vocab.select(F.ascii("ch").cast("int").alias("code"), "id").where("code is not null and id is not null").toPandas().sort_values("code")
    shared = docs.sparkSession.sparkContext.broadcast((known["code"].to_numpy(dtype=np.int32), known["id"].to_numpy(dtype=np.int64)))

    def encode(texts: pa.Array) -> pa.Array:
        codes, ids = shared.value
        texts = pc.fill_null(texts, "")
        wanted = arrays.code_points_of(texts).values.to_numpy()
        if not len(codes):
            return arrays.lists_of(pa.array(ids), pa.array(np.zeros(len(texts), dtype=np.int64)))
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        found = codes[at] == wanted
        edges = np.concatenate([[0], pc.utf8_length(texts).to_numpy().cumsum()])
        sizes = np.diff(np.concatenate([[0], found.cumsum()])[edges])
        return arrays.lists_of(pa.array(ids[at[found]]), pa.array(sizes))

    return encode


def char_encode(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the numbers of a text's characters; those outside the vocabulary are left out, a null text has none."""
    return docs.select(id_col, arrays.by_pieces("array<bigint>", char_encoder(docs, vocab), F.col(text_col)).alias("ids"))


def char_totals(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, total): how many numbers char_encode() gives the texts of an id, and their sum, without sending the numbers."""
    encode = char_encoder(docs, vocab)
    sums = arrays.by_pieces(arrays.TOTALS, lambda texts: arrays.totals_of(encode(texts)), F.col(text_col))
    return docs.select(id_col, sums.alias("_t")).groupBy(id_col).agg(F.sum("_t.n").alias("n"), F.sum("_t.total").alias("total"))


def char_decode(encoded: DataFrame, vocab: DataFrame, id_col: str = "doc_id") -> DataFrame:
    table = vocab.agg(F.map_from_entries(F.collect_list(F.struct("id", "ch"))).alias("_vocab"))
    text = F.array_join(F.transform("ids", lambda i: F.col("_vocab")[i]), "")
    return encoded.crossJoin(F.broadcast(table)).select(id_col, text.alias("text"))


@functools.lru_cache(maxsize=4)
def load_tokenizer(spec: str):
    """A tokenizer from its JSON text, or from a file that every executor can read."""
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec) if spec.lstrip().startswith("{") else Tokenizer.from_file(spec)


def bpe_encode(text: Column, spec: str, append: int | None = None, chunk: int | None = None) -> Column:
    """array<int> of token ids, nothing special added but an end id if given.

    Texts are encoded whole, or if asked for in chunks of so many characters, whose edges no token spans.
    """
    more = [] if append is None else [append]

    @F.pandas_udf("array<int>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = load_tokenizer(spec)
        for texts in batches:
            out = []
            for t in texts:
                step = chunk or max(len(t or ""), 1)
                parts = [t[i : i + step] for i in range(0, len(t or ""), step)]
                coded = tokenizer.encode_batch(parts, add_special_tokens=False)
                out.append([i for c in coded for i in c.ids] + more)
            yield pd.Series(out, dtype=object)

    return udf(text)


def bpe_decode(ids: Column, spec: str) -> Column:
    @F.pandas_udf("string")
    def udf(values: pd.Series) -> pd.Series:
        tokenizer = load_tokenizer(spec)
        return values.map(lambda v: tokenizer.decode(list(v), skip_special_tokens=False))

    return udf(ids)


def streaming_decode(ids: Column, spec: str, most: int = 32) -> Column:
    """array<string>: the pieces in which ids can be shown one after the other.

    Ids are held back while their text ends in an incomplete character, but at most so many of them.
    """

    @F.pandas_udf("array<string>")
    def udf(values: pd.Series) -> pd.Series:
        tokenizer = load_tokenizer(spec)

        def pieces(ids: list[int]) -> list[str]:
            out, held = [], []
            for i in ids:
                held.append(int(i))
                text = tokenizer.decode(held, skip_special_tokens=False)
                if "�" not in text or len(held) >= most:
                    out.append(text)
                    held = []
            return out + [tokenizer.decode(held, skip_special_tokens=False)] * bool(held)

        return values.map(pieces)

    return udf(ids)


def windows(streams: DataFrame, key: list[str], ids_col: str, length: int, stride: int) -> DataFrame:
    """(key, window, x, y): windows of a token array and the same shifted by one; the last full one ends it."""
    last = F.size(ids_col) - length - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride)))
    each = streams.select(*key, F.col(ids_col).alias("_ids"), F.posexplode(starts).alias("window", "_start"))
    cut = lambda shift: F.slice("_ids", F.col("_start") + 1 + shift, F.lit(length))
    return each.select(*key, F.col("window").cast("long").alias("window"), cut(0).alias("x"), cut(1).alias("y"))


def random_windows(streams: DataFrame, key: list[str], ids_col: str, length: int, n: int, seed: int = 1337) -> DataFrame:
    """n windows of each stream at starts drawn by hash below len - length; streams too short give none."""
    room = F.size(ids_col) - length
    hashed = lambda k: F.conv(F.substring(order_key(seed, *map(F.col, key), k), 1, 8), 16, 10).cast("long")
    draw = lambda k: F.pmod(hashed(k), room).cast("int")
    starts = F.when(room > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw))
    each = streams.select(*key, F.col(ids_col).alias("_ids"), F.posexplode(starts).alias("window", "_start"))
    cut = lambda shift: F.slice("_ids", F.col("_start") + 1 + shift, F.lit(length))
    return each.select(*key, "window", cut(0).alias("x"), cut(1).alias("y"))


def loss_mask_of(lists: pa.Array, opens: tuple[int, int], closes: tuple[tuple[int, int], ...], blank: tuple[int, int]) -> pa.Array:
    """loss_mask() of an Arrow array of lists."""
    values, begin, end = arrays.opened(lists)
    tok = values.to_numpy(zero_copy_only=False)  # with null tokens nan, which begin no pair
    at = np.arange(len(tok))
    mark = np.zeros(len(tok), dtype=np.int8)  # 1: opens a reply, 2: opens another turn, 3: blank
    inner = at[:-1] + 1 < end[:-1]  # of those with a token after them in their list
    for pair, sign in [(blank, 3), *((p, 2) for p in closes), (opens, 1)]:
        mark[:-1][inner & (tok[:-1] == pair[0]) & (tok[1:] == pair[1])] = sign
    before = np.concatenate([[0], mark])[:-1]  # of the pair that a token ends, whose marks never end a list
    last = np.maximum.accumulate(np.where(before > 0, at - 1, -1))
    inside = (last >= begin) & (mark[last] == 1) if len(tok) else mark > 0
    masked = np.where(mark > 0, mark < 3, np.where(before > 0, before < 3, inside))
    return arrays.closed(pa.array(masked), lists)


def loss_mask(ids: Column, opens: tuple[int, int], closes: tuple[tuple[int, int], ...], blank: tuple[int, int]) -> Column:
    """array<boolean>: whether a token of an array lies in a reply; null for null.

    The pair that opens a reply is masked in, so are the pairs that close one by opening another turn; a
    blank pair closes it and is masked out. Otherwise a token is as the last pair before it left it. Marks are
    set within the row, so nothing is shuffled and rows may share an id.
    """
    return arrays.by_pieces("array<boolean>", lambda lists: loss_mask_of(lists, opens, closes, blank), ids)


def masked_targets(y: Column, mask: Column) -> Column:
    """Targets with IGNORED where the mask is false."""
    return arrays.where_true(y, mask, IGNORED)


def masked_totals_of(texts: pa.Array, opens: tuple[int, int], closes: tuple[tuple[int, int], ...], blank: tuple[int, int]) -> pa.Array:
    ids = arrays.code_points_of(texts)
    return arrays.totals_of(arrays.where_true_of(ids, loss_mask_of(ids, opens, closes, blank), IGNORED), IGNORED)


def masked_totals(text: Column, opens: tuple[int, int], closes: tuple[tuple[int, int], ...], blank: tuple[int, int]) -> Column:
    """arrays.totals() of the masked_targets() of a text's code points under their loss_mask(), in one UDF that sends no arrays."""
    return arrays.by_pieces(arrays.TOTALS, lambda texts: masked_totals_of(texts, opens, closes, blank), text)


def cut_at_turn(ids: Column, spec: str, markers: tuple[str, ...] = TURN_MARKERS) -> Column:
    """Ids before a turn marker, cut at the last token that ends before it; the first marker in list order decides."""

    @F.pandas_udf("array<int>")
    def udf(values: pd.Series) -> pd.Series:
        tokenizer = load_tokenizer(spec)
        text = lambda some: tokenizer.decode(some, skip_special_tokens=False)

        def cut(value) -> list[int]:
            ids = [int(i) for i in value]
            whole = text(ids)
            at = next((p for p in map(whole.find, markers) if p >= 0), -1)
            if at < 0:
                return ids
            low, high = 0, len(ids)  # the most ids whose text is no longer than the part before the marker
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if len(text(ids[:mid])) <= at else (low, mid - 1)
            return ids[:low]

        return values.map(cut)

    return udf(ids)


def lookup(tokens: DataFrame, vectors: DataFrame, tok: str = "tok", sent_rows: int = 10_000, salts: int = 32) -> DataFrame:
    """tokens with the vector of each from (tok, vector) rows; unknown tokens get null.

    Some tokens are a large share of all. A table of at most sent_rows vectors, which is counted first, goes whole to
    every task; a larger one is repeated `salts` times, and each token's rows are spread over its copies.
    """
    named = vectors.withColumnRenamed(tok, "_tok")
    if len(vectors.select(tok).limit(sent_rows + 1).collect()) <= sent_rows:
        return tokens.join(F.broadcast(named), F.col(tok) == F.col("_tok"), "left").drop("_tok")
    copies = named.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hashed = [F.col(f"`{c}`") for c, kind in tokens.dtypes if "map<" not in kind]  # of the row, so a task that runs again deals alike
    spread = tokens.withColumn("_salt", F.pmod(F.xxhash64(*hashed), salts).cast("int"))
    return spread.join(copies, (F.col(tok) == F.col("_tok")) & (F.col("_salt") == F.col("_copy")), "left").drop("_tok", "_copy", "_salt")
