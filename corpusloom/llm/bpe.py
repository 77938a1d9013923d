"""Byte-level BPE with word ends: encoding by a segment tree over adjacent pair ranks, and decoding.

The vocabulary is a `tokenizers` JSON file whose path is a parameter; the file must be readable at that path
on every executor (it is part of an installed package here). Nothing is trained.
"""

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

#: Words of one width below which each is merged by itself: rounds over arrays pay for many words only.
FEW = 32
#: Distinct words whose ids a worker remembers; longer words are not remembered.
CACHED_WORDS, CACHED_LENGTH = 300_000, 40

# Fixed values of the vocabulary's word pattern, for texts within Latin letters (code points below U+02B0).
LATIN_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ʯ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
LATIN_SPACES = "\\t-\\r \x85\xa0"
LATIN_WORD = re.compile(
    f"[{LATIN_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{LATIN_NUMBERS}]|[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+"
)
BEYOND_LATIN = re.compile("[^\\x00-ʯ]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(spare.get(b, b)) for b in range(256)]


class MergeForest:
    """One minimum segment tree per word over the ranks of its adjacent pairs, all words of a class together.

    A leaf holds rank and position of the pair that starts there, so a tree's root is the leftmost
    lowest-rank merge of its word. Each round merges every word's root pair and updates the three leaves it
    touches and their ancestors, a logarithmic number, until no word has a pair left to merge.
    """

    NONE = np.int64(1 << 62)

    def __init__(self, ids: np.ndarray, merges: "Merges"):
        """ids: one row per word, padded with -1 to a power of two."""
        self.ids, self.merges = ids, merges
        words, width = ids.shape
        self.shift = width.bit_length()
        self.after = np.tile(np.arange(1, width + 1), (words, 1))
        self.before = np.tile(np.arange(-1, width - 1), (words, 1))
        leaves = np.full((words, width), self.NONE)
        leaves[:, :-1] = self.keys(ids[:, :-1], ids[:, 1:], np.arange(width - 1))
        self.levels = [leaves]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:, ::2], below[:, 1::2]))

    def keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = self.merges.rank(left, right)
        return np.where(rank < 0, self.NONE, rank << self.shift | at)

    def update(self, row: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        self.levels[0][row, at] = key
        for below, level in zip(self.levels, self.levels[1:], strict=False):
            at = at >> 1
            level[row, at] = np.minimum(below[row, 2 * at], below[row, 2 * at + 1])

    def run(self) -> np.ndarray:
        """The ids of each word, with -1 where a symbol was merged away."""
        ids, after, before, none = self.ids, self.after, self.before, self.NONE
        width = ids.shape[1]
        row = np.flatnonzero(self.levels[-1][:, 0] != none)
        while len(row):
            root = self.levels[-1][row, 0]
            i = root & ((1 << self.shift) - 1)
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = new = self.merges.result[root >> self.shift]
            ids[row, j] = -1
            after[row, i] = k
            more = k < width
            before[row[more], k[more]] = i[more]
            self.update(row, j, none)
            beyond = np.where(more, ids[row, np.minimum(k, width - 1)], -1)
            self.update(row, i, self.keys(new, beyond, i))
            h = before[row, i]
            some = h >= 0
            self.update(row[some], h[some], self.keys(ids[row[some], h[some]], new[some], h[some]))
            row = row[self.levels[-1][row, 0] != none]
        return ids


def merge_one(ids: list[int], merges: "Merges") -> list[int]:
    """The ids of one word merged, by a segment tree in a plain list; for words too few or too long for MergeForest.

    The tree's root is at 1, its leaves hold rank and position of the pairs that start there, as in MergeForest. An
    update goes up only as far as it changes a minimum, so a merge takes a logarithmic number of steps at most.
    """
    n = len(ids)
    width = 1 << max(1, (n - 1).bit_length())
    shift, none, ranks, result = width.bit_length(), 1 << 62, merges.ranks, merges.results
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[width + i] = rank << shift | i
    for p in range(width - 1, 0, -1):
        tree[p] = min(tree[2 * p], tree[2 * p + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def update(i: int, rank: int | None) -> None:
        p = width + i
        tree[p] = none if rank is None else rank << shift | i
        while p > 1:
            p >>= 1
            a, b = tree[2 * p], tree[2 * p + 1]
            least = a if a < b else b
            if tree[p] == least:
                return
            tree[p] = least

    while tree[1] != none:
        i = tree[1] & ((1 << shift) - 1)
        j = after[i]
        k = after[i] = after[j]
        ids[i], ids[j] = result[tree[1] >> shift], -1
        update(j, None)
        if k < n:
            before[k] = i
        update(i, ranks.get(ids[i] << 32 | ids[k]) if k < n else None)
        if before[i] >= 0:
            update(before[i], ranks.get(ids[before[i]] << 32 | ids[i]))
    return [x for x in ids if x >= 0]


class Merges:
    """Rank and result of each mergeable pair of ids."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        """pairs: (left, right, result) by rank."""
        left, right, result = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable")
        self.sorted, self.result = key[self.order], result
        self.ranks = dict(zip(reversed(key.tolist()), range(len(key) - 1, -1, -1), strict=True))  # the first of equals
        self.results = result.tolist()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """-1 where the pair can't merge; ids of -1 stand for no symbol."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.sorted, key), len(self.sorted) - 1)
        return np.where((self.sorted[at] == key) & (left >= 0) & (right >= 0), self.order[at], -1)


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        flags = ("single_word", "lstrip", "rstrip", "normalized")
        if spec.get("decoder") or any(t.get(f) for t in spec["added_tokens"] for f in flags):
            raise ValueError(f"{path}: decoders and added tokens with any of {', '.join(flags)} are not supported")
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.merges = Merges([(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]])
        inner, last = ([self.ids[s + end] for s in byte_symbols()] for end in ("", self.suffix))
        self.inner, self.last = np.array(inner, dtype=np.int64), np.array(last, dtype=np.int64)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")
        self.library = Tokenizer.from_file(path)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p)
        self.library_words = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in the form that merging starts from."""
        lower = text.lower()
        if lower.isascii() or not BEYOND_LATIN.search(lower) and not BEYOND_LATIN.search(text):
            return LATIN_WORD.findall(lower)
        normal = self.library.normalizer.normalize_str(text)  # full Unicode rules: the library's own
        return [w for w, _ in self.library_words.pre_tokenize_str(normal)]

    def merge(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of each word. Words are merged together by the power of two that holds their bytes."""
        coded = [w.encode("utf-8") for w in words]
        sizes = np.array([len(c) for c in coded])
        width = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(int)
        out: dict[str, bytes] = {}
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            if len(of) < FEW:
                for i in of.tolist():
                    raw = coded[i]
                    ids = [*self.inner[np.frombuffer(raw[:-1], dtype=np.uint8)].tolist(), int(self.last[raw[-1]])]
                    out[words[i]] = np.array(merge_one(ids, self.merges), dtype="<u4").tobytes()
                continue
            for part in np.array_split(of, -(-len(of) * int(w) // (1 << 20))):
                n = sizes[part]
                inside = np.arange(w) < n[:, None]
                ids = np.full(inside.shape, -1, dtype=np.int64)
                ids[inside] = self.inner[np.frombuffer(b"".join([coded[i] for i in part]), dtype=np.uint8)]
                ids[np.arange(len(part)), n - 1] = self.last[[coded[i][-1] for i in part]]
                ids = MergeForest(ids, self.merges).run()
                packed, ends = ids[ids >= 0].astype("<u4").tobytes(), np.cumsum((ids >= 0).sum(1)) * 4
                begin = 0
                for i, end in zip(part.tolist(), ends.tolist(), strict=True):
                    out[words[i]], begin = packed[begin:end], end
        return out

    def parts(self, text: str | None) -> list[tuple[bool, str]]:
        """The text cut at the vocabulary's special tokens: (is special, part)."""
        if not text:
            return []
        if not any(token in text for token in self.special):
            return [(False, text)]
        return [(p in self.special, p) for p in self.split_special.split(text) if p]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        split = [[p if special else self.words(p) for special, p in self.parts(t)] for t in texts]
        seen: set[str] = set()
        seen.update(*(p for parts in split for p in parts if isinstance(p, list)))
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new = list(seen.difference(self.cache))
        merged = self.merge(new) if new else {}
        self.cache |= {w: p for w, p in merged.items() if len(w) <= CACHED_LENGTH}
        ids = self.cache if all(len(w) <= CACHED_LENGTH for w in new) else self.cache | merged
        special = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        return [
            b"".join([b"".join(map(ids.__getitem__, p)) if isinstance(p, list) else special[p] for p in parts])
            for parts in split
        ]

    def decode(self, packed: bytes) -> str:
        """Tokens joined by a space, as for a vocabulary file that names no decoder; unknown ids are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in memoryview(packed).cast("I").tolist() if i in tokens])


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def in_runs(texts: pd.Series, size: int = 1 << 20) -> Iterator[list]:
    """The texts in runs of about so many characters."""
    run: list = []
    total = 0
    for t in texts:
        run.append(t)
        total += len(t or "")
        if total >= size:
            yield run
            run, total = [], 0
    if run:
        yield run


def encode(text: Column, path: str) -> Column:
    """Ids of each text as a binary column of little-endian unsigned 32-bit integers; null gives no ids."""

    @F.pandas_udf("binary")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = word_bpe(path)
        for texts in batches:
            yield pd.Series([i for run in in_runs(texts) for i in bpe.encode(run)], dtype=object)

    return udf(text)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with a struct column `bpe`: ids (binary, little-endian uint32), n_tokens and decoded (string).

    Every text is encoded whole. Null and empty texts give no ids and an empty string. Rows are independent,
    so there is no shuffle, and repeated rows give repeated results; other columns pass through unread, but
    one named `bpe` is replaced. A word of n bytes takes O(n log n).
    """

    @F.pandas_udf("ids binary, decoded string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(path)
        for texts in batches:
            ids = [i for run in in_runs(texts) for i in bpe.encode(run)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": [bpe.decode(i) for i in ids]})

    both = docs.withColumn("bpe", udf(F.col(f"`{text_col}`")))
    return both.withColumn("bpe", F.col("bpe").withField("n_tokens", (F.octet_length("bpe.ids") / 4).cast("long")))


def ids_array(packed: Column) -> Column:
    """array<bigint> of a binary column of little-endian unsigned 32-bit integers."""
    size = F.octet_length(packed)
    places = F.when(size > 0, F.sequence(F.lit(1), size, F.lit(4))).otherwise(F.array().cast("array<int>"))
    byte = lambda at, k: F.conv(F.hex(F.substring(packed, at + k, 1)), 16, 10).cast("long")
    return F.transform(places, lambda at: sum((byte(at, k) * 256**k for k in range(1, 4)), byte(at, 0)))
