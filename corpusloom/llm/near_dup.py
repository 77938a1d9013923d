"""Joins on the Jaccard similarity of word n-grams: an LSH forest over MinHash signatures, then exact verification."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .tables import materialise

WORDS, SIMILARITY = 5, 0.8
#: Prefix trees and hash values on the longest path of each.
TREES, DEPTH = 20, 6
#: Share of the pairs at the similarity threshold that the forest must find.
RECALL = 0.9999
#: Members of a bucket, and bytes of their n-grams, that one task compares with as many others.
BLOCK, BLOCK_BYTES = 256, 1 << 23
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS_STEP = np.uint64(0x100000001B3)


def depth_for(similarity: float, recall: float, trees: int = TREES, longest: int = DEPTH) -> int:
    """The longest prefix by which a pair at the threshold is found often enough, whatever else is in the trees.

    Two signatures share a prefix of length k in one tree with probability similarity**k.
    """
    depth = longest
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def stops(similarity: float, recall: float, trees: int = TREES, longest: int = DEPTH) -> tuple[int, dict[int, int]]:
    """(shortest, most): how far prefixes are shortened at most, and the evidence at which a longer one is kept.

    The evidence for a set at a length d is the sum over its trees of max(min(L, d - 1) - 1, 0), L being the longest
    prefix that it shares with any set. A set keeps the prefix d if its evidence is at most most[d]. If a partner at the
    threshold shared no prefix of length d with it, the prefixes that they do share, shorter than d and no longer than
    L, would all the same make the evidence larger, but for a probability that is summed here exactly. What `shortest`
    leaves of 1 - recall is dealt out evenly over the longer prefixes and both sets of a pair. First values count for
    nothing, since among very many sets unrelated ones share them by chance.
    """
    shortest = depth_for(similarity, recall, trees, longest)
    left = 1 - recall - (1 - similarity**shortest) ** trees
    most = {}
    for d in range(shortest + 1, longest + 1):
        one = np.zeros(max(d - 1, 1))
        for k in range(d):
            one[max(k - 1, 0)] += (1 - similarity) * similarity**k
        all_trees = np.ones(1)
        for _ in range(trees):
            all_trees = np.convolve(all_trees, one)
        most[d] = int(np.searchsorted(all_trees.cumsum(), max(left, 0) / 2 / (longest - shortest), side="right")) - 1
    return shortest, most


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word: runs of ASCII letters and digits and of other characters beyond ASCII, in lower case."""
    b = np.frombuffer(text.lower().encode("utf-8"), dtype=np.uint8)
    word = (b >= 128) | (b >= 97) & (b <= 122) | (b >= 48) & (b <= 57)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    number = np.zeros(len(b), dtype=np.int64)
    number[begin] = 1
    place = (np.arange(len(b)) - begin[number.cumsum() - 1]).astype(np.uint64)
    values = np.where(word, mix((b.astype(np.uint64) + np.uint64(1)) * MIX + place * POWERS_STEP), np.uint64(0))
    return mix(np.add.reduceat(values, begin) + size.astype(np.uint64))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of so many words; a shorter text with words has one run."""
    w = word_hashes(text or "")
    n = min(words, len(w))
    if not n:
        return w
    total = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        total = mix(total * MIX + w[k : len(w) - n + 1 + k])
    return np.unique(total)


class Forest:
    """Signatures as paths in prefix trees, and numbers for the prefixes of a length."""

    def __init__(self, depth: int = DEPTH, trees: int = TREES):
        self.depth, self.trees = depth, trees
        seeds = np.random.default_rng(5)
        self.a = seeds.integers(1, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = seeds.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def paths(self, found: np.ndarray) -> np.ndarray:
        """(trees, depth) hash values of a set, the least of each function; big-endian, so that bytes sort like values."""
        high, low = (found >> np.uint64(32)).astype(np.uint32), found.astype(np.uint32)
        least = np.full(len(self.a), np.iinfo(np.uint32).max, dtype=np.uint32)
        for i in range(0, len(found), 4096):
            h, low_part = high[i : i + 4096, None], low[i : i + 4096, None]
            values = (h ^ self.b) * self.a + low_part
            values = (values ^ values >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            values ^= values >> np.uint32(12)
            np.minimum(least, values.min(0), out=least)
        return least.reshape(self.trees, self.depth).astype(">u4")

    def unpacked(self, packed: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(packed), dtype=">u4").reshape(-1, self.trees, self.depth)

    def labels(self, paths: np.ndarray, length: int) -> np.ndarray:
        """(sets, trees) numbers of the prefixes of this length of (sets, trees, depth) paths, other ones in each tree."""
        start = np.arange(1, self.trees + 1, dtype=np.uint64) * np.uint64(64) + np.uint64(length)
        out = np.broadcast_to(start, paths.shape[:2])
        for k in range(length):
            out = mix(out * MIX + paths[:, :, k].astype(np.uint64))
        return out


def sketches(docs: DataFrame, forest: Forest, words: int) -> DataFrame:
    """(id, set_key, paths, bytes) of each row; set_key, a 128-bit hash of the set of n-grams, is null where it is empty."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, paths, sizes = [], [], []
            for text in batch["text"]:
                found = shingles(text, words)
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                paths.append(forest.paths(found).tobytes() if len(found) else None)
                sizes.append(found.nbytes)
            yield pd.DataFrame({"id": batch["id"], "set_key": keys, "paths": paths, "bytes": sizes})

    return docs.mapInPandas(sketch, f"id {docs.schema['id'].dataType.simpleString()}, set_key binary, paths binary, bytes long")


def shared_prefixes(sets: DataFrame, forest: Forest) -> DataFrame:
    """(set_key, shared): for each tree and set the longest prefix that it shares with any other, where two values or more.

    Each tree's paths are sorted, as in a trie: a path shares most with one of its neighbours. Sorting is by ranges of
    (tree, path, set), so paths with a common beginning may lie in any number of tasks; those at the edge of a task, whose
    neighbour is in another, count as shared in full, which only makes the forest look for more.
    """

    @F.pandas_udf("array<binary>")
    def by_tree(packed: pd.Series) -> pd.Series:
        size = 4 * forest.depth
        return packed.map(lambda p: [p[i : i + size] for i in range(0, len(p), size)])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, left = None, forest.depth  # the last row, and what it shares with the one before
        for batch in batches:
            if not len(batch):
                continue
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            paths = np.frombuffer(b"".join(frame["path"]), dtype=">u4").reshape(-1, forest.depth)
            tree = frame["tree"].to_numpy()
            same = (paths[1:] == paths[:-1]) & (tree[1:] == tree[:-1])[:, None]
            with_next = np.cumprod(same, axis=1).sum(1)
            shared = np.maximum(np.concatenate([[left], with_next[:-1]]), with_next) if len(with_next) else with_next
            some = np.flatnonzero(shared > 1)
            yield pd.DataFrame({"set_key": frame["set_key"].to_numpy()[some], "shared": shared[some]})
            held, left = frame.iloc[-1:], int(with_next[-1]) if len(with_next) else left
        if held is not None:
            yield pd.DataFrame({"set_key": held["set_key"], "shared": forest.depth})

    members = sets.select("set_key", F.posexplode(by_tree("paths")).alias("tree", "path"))
    ranged = members.repartitionByRange("tree", "path", "set_key").sortWithinPartitions("tree", "path", "set_key")
    return ranged.select("set_key", "tree", "path").mapInPandas(compare, "set_key binary, shared int")


def prefix_of_each(sets: DataFrame, forest: Forest, similarity: float, recall: float) -> DataFrame:
    """sets with depth: the length of the prefix by which it looks for others, shortened until stops() says so."""
    shortest, most = stops(similarity, recall, forest.trees, forest.depth)
    longer = range(forest.depth, shortest, -1)
    evidence = lambda d: F.sum(F.greatest(F.least(F.col("shared"), F.lit(d - 1)) - 1, F.lit(0)))
    sums = [evidence(d).alias(f"at_{d}") for d in longer] or [F.count(F.lit(1)).alias("n")]
    known = shared_prefixes(sets, forest).groupBy(F.col("set_key").alias("_of")).agg(*sums)
    depth = F.lit(shortest)
    for d in reversed(longer):
        depth = F.when(F.coalesce(F.col(f"at_{d}"), F.lit(0)) <= most[d], d).otherwise(depth)
    joined = sets.join(known, F.col("set_key") == F.col("_of"), "left")
    return joined.select(*sets.columns, depth.cast("int").alias("depth"))


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of key-sorted rows regrouped so that no key is cut, with the bounds of the keys' runs."""
    held: list[pd.DataFrame] = []

    def cut(frame: pd.DataFrame) -> np.ndarray:
        values = frame[key].to_numpy()
        return np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1, [len(frame)]])

    for batch in batches:
        if not len(batch):
            continue
        if held and (held[-1][key].iloc[-1] == batch[key].iloc[-1]).all():
            held.append(batch)
            continue
        frame = pd.concat([*held, batch], ignore_index=True)
        bounds = cut(frame)
        if len(bounds) > 2:
            yield frame.iloc[: bounds[-2]], bounds[:-1]
        held = [frame.iloc[bounds[-2] :]]
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, cut(frame)


def first_shared(labels: np.ndarray, key: int, side: np.ndarray, cell: int) -> np.ndarray:
    """Which pairs of a bucket's cell are this bucket's to compare: those that share no earlier tree's path.

    side is the block of each row; a cell holds one block, or two of which only pairs across count.
    """
    tree = int(np.flatnonzero(labels[0] == np.uint64(key & 0xFFFFFFFFFFFFFFFF))[0])
    own = np.ones((len(labels), len(labels)), dtype=bool)
    for t in range(tree):
        own &= labels[:, None, t] != labels[None, :, t]
    a, b = divmod(cell, 1 << 20)
    if a != b:
        own &= (side[:, None] == a) & (side[None, :] == b)
    return np.triu(own, 1) if a == b else own


def jaccard_links(sets: list[np.ndarray], own: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs marked in own have so large a Jaccard similarity, exactly."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], sizes.cumsum()[:-1]])
    distinct, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    present, linked = np.zeros(len(distinct), dtype=bool), np.zeros_like(own)
    for x in np.flatnonzero(own.any(1)):
        mine = numbers[starts[x] : starts[x] + sizes[x]]
        others = np.flatnonzero(own[x])
        present[mine] = True
        if len(others) * 4 < len(sets):
            common = np.array([present[numbers[starts[y] : starts[y] + sizes[y]]].sum() for y in others])
        else:
            common = np.add.reduceat(present[numbers].astype(np.int64), starts)[others]
        present[mine] = False
        linked[x, others] = common >= similarity * (sizes[x] + sizes[others] - common)
    return linked


def forest_edges(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a small graph given by an upper or block matrix."""
    parent = list(range(len(linked)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges = []
    for x, y in zip(*np.nonzero(linked), strict=True):
        a, b = root(int(x)), root(int(y))
        if a != b:
            parent[b] = a
            edges.append((int(x), int(y)))
    return edges


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    trees: int = TREES,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, class_id, copy_of, n_links.

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is at least `similarity`.
    copy_of is the least id with the same set, class_id the least id that links lead to, n_links the number
    of other rows linked to this one.

    Rows with equal sets are first taken together, so copies never form pairs. Each distinct set has a path
    in every tree of the forest. A set first looks for others by whole paths; its prefixes are shortened step by
    step, until what it shares with its neighbours in the sorted trees is too little for a partner to be missed, or
    until a pair at the threshold meets in some tree with probability `recall` (stops()). Sets that share a prefix
    are a bucket, and two of them are compared where they share the longer of their prefixes. A pair belongs to the
    first tree in which it meets, so it is verified once. A bucket of more than `block` sets, or of more than
    BLOCK_BYTES of n-grams, is dealt out in cells of two blocks each, so no task holds a whole bucket. A cell gives
    each member's number of links and a spanning forest of its links, never the pairs.

    Null and empty texts, and texts without words, have no n-grams: they link to nothing and form classes of
    their own. Rows with a null id are not compared and have null class_id and copy_of. Repeated ids count as
    rows of their own. Other columns are ignored; an empty table gives an empty result.
    """
    forest = Forest(DEPTH, trees)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketched = materialise(sketches(rows, forest, words), "sketches")
    has = F.col("set_key").isNotNull() & F.col("id").isNotNull()
    sets = materialise(
        sketched.where(has).groupBy("set_key").agg(
            F.min("id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"), F.any_value("paths").alias("paths"),
            F.any_value("bytes").alias("bytes"),
        ),
        "sets",
    )
    seeking = materialise(prefix_of_each(sets, forest, similarity, recall).select("set_key", "paths", "bytes", "depth"), "seeking")
    compared = materialise(candidates(seeking, forest, block), "compared")
    loaded = load_shingles(compared, sets, rows, words)
    found = materialise(verified(loaded, forest, similarity), "links")
    links = found.where("v is null").groupBy(F.col("u").alias("_u")).agg(F.sum("links").alias("_links"))
    roots = connected_components(found.where("v is not null").select("u", "v"))
    summed = (
        sets.select("set_key", "copy_of", "n_copies")
        .join(links, F.col("set_key") == F.col("_u"), "left")
        .join(roots, F.col("set_key") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "set_key"))
    )
    least = summed.groupBy(F.col("root").alias("_root")).agg(F.min("copy_of").alias("class_id"))
    summed = summed.join(least, F.col("root") == F.col("_root")).select(
        F.col("set_key").alias("_key"),
        "class_id",
        "copy_of",
        (F.coalesce("_links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
    )
    out = sketched.where(has).join(summed, F.col("set_key") == F.col("_key"))
    same = F.col("id")
    alone = sketched.where(~has).select(
        same.alias(id_col), same.alias("class_id"), same.alias("copy_of"), F.lit(0).cast("long").alias("n_links")
    )
    return out.select(F.col("id").alias(id_col), "class_id", "copy_of", "n_links").unionByName(alone)


def bucket_rows(sets: DataFrame, forest: Forest) -> DataFrame:
    """(set_key, depth, bytes, length, path): the prefixes of each set, from its own length to the whole path."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            paths, depth = forest.unpacked(batch["paths"].tolist()), batch["depth"].to_numpy()
            for length in range(int(depth.min()), forest.depth + 1):
                some = np.flatnonzero(depth <= length)
                frame = batch[["set_key", "depth", "bytes"]].iloc[np.repeat(some, forest.trees)]
                yield frame.assign(length=length, path=forest.labels(paths[some], length).ravel().view(np.int64))

    return sets.select("set_key", "depth", "bytes", "paths").mapInPandas(rows, "set_key binary, depth int, bytes long, length int, path long")


def candidates(sets: DataFrame, forest: Forest, block: int) -> DataFrame:
    """(set_key, depth, length, path, side, cell): which sets are to be compared in which cell of which bucket.

    Two sets are compared by prefixes of the longer of their lengths, so a bucket in which nobody has its length goes.
    """

    @F.pandas_udf("binary")
    def labels(packed: pd.Series, length: pd.Series) -> pd.Series:
        paths, out = forest.unpacked(packed.tolist()), np.empty(len(packed), dtype=object)
        for k in length.unique().tolist():
            some = np.flatnonzero(length.to_numpy() == k)
            for i, row in zip(some.tolist(), forest.labels(paths[some], k), strict=True):
                out[i] = row.tobytes()
        return pd.Series(out)

    members = bucket_rows(sets, forest)
    sizes = members.groupBy(F.col("path").alias("_path"), F.col("length").alias("_length")).agg(
        F.count(F.lit(1)).alias("_size"), F.sum("bytes").alias("_bytes"), F.max("depth").alias("_deepest")
    )
    sizes = sizes.where("_size > 1 and _deepest = _length")
    sizes = materialise(sizes, "buckets")  # so that both sides of the join are shuffled and a hot bucket can be split
    blocks = F.ceil(F.greatest(F.col("_size") / block, F.col("_bytes") / BLOCK_BYTES)).cast("int")
    same = (F.col("path") == F.col("_path")) & (F.col("length") == F.col("_length"))
    shared = members.join(sizes, same).select(
        "set_key", "depth", "length", "path", F.pmod(F.xxhash64("set_key"), blocks).cast("int").alias("side"), blocks.alias("blocks")
    )
    cell = lambda other: F.least("side", other).cast("long") * (1 << 20) + F.greatest("side", other)
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), cell)
    cells = shared.select("set_key", "depth", "length", "path", "side", F.explode(every).alias("cell"))
    labelled = cells.join(sets.select("set_key", "paths"), "set_key").withColumn("labels", labels("paths", "length"))

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, ["path", "cell"]):
            matrix = np.frombuffer(b"".join(frame["labels"]), dtype=np.uint64).reshape(-1, forest.trees)
            path, at, side, depth, length = (frame[c].to_numpy() for c in ("path", "cell", "side", "depth", "length"))
            keep = np.zeros(len(frame), dtype=bool)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a > 1:
                    own = first_shared(matrix[a:b], int(path[a]), side[a:b], int(at[a])) & by_longer(depth[a:b], int(length[a]))
                    keep[a:b] = own.any(0) | own.any(1)
            yield frame.loc[keep, ["set_key", "depth", "length", "path", "side", "cell"]]

    dealt = labelled.repartition("path", "cell").sortWithinPartitions("path", "cell")
    dealt = dealt.select("set_key", "depth", "length", "path", "side", "cell", "labels")
    return dealt.mapInPandas(wanted, "set_key binary, depth int, length int, path long, side int, cell long")


def by_longer(depth: np.ndarray, length: int) -> np.ndarray:
    """Which pairs are to be compared by prefixes of this length: those of which it is the longer one's."""
    return np.maximum(depth[:, None], depth[None, :]) == length


def load_shingles(compared: DataFrame, sets: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """compared with each set's n-grams, made again from the text of a row that has the set.

    The n-grams are made after the join: a UDF in its condition would be evaluated for every text.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, words).tobytes() for t in batch["text"]]
            keys = [hashlib.blake2b(f, digest_size=16).digest() for f in found]
            same = [k == wanted for k, wanted in zip(keys, batch["_key"], strict=True)]
            yield batch[["_key", "n_copies"]].assign(shingles=found)[same]

    needed = sets.join(compared.select("set_key").distinct(), "set_key", "left_semi")
    needed = needed.select("copy_of", "n_copies", F.col("set_key").alias("_key"))
    texts = rows.join(needed, F.col("id") == F.col("copy_of")).select("_key", "n_copies", "text")
    texts = texts.mapInPandas(made, "_key binary, n_copies long, shingles binary")
    return compared.join(texts, F.col("set_key") == F.col("_key"))


def verified(loaded: DataFrame, forest: Forest, similarity: float) -> DataFrame:
    """(u, null, number of links) for each member of a cell that has any, and (u, v, 0) for a spanning forest."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(batches, ["path", "cell"]):
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                cell = frame.iloc[a:b].drop_duplicates("set_key")  # the same row may be there twice
                keys, copies = cell["set_key"].to_numpy(), cell["n_copies"].to_numpy()
                sets = [np.frombuffer(s, dtype=np.uint64) for s in cell["shingles"]]
                length = int(cell["length"].iloc[0])
                matrix = forest.labels(np.array([forest.paths(s) for s in sets]), length)
                own = first_shared(matrix, int(cell["path"].iloc[0]), cell["side"].to_numpy(), int(cell["cell"].iloc[0]))
                own &= by_longer(cell["depth"].to_numpy(), length)
                linked = jaccard_links(sets, own, similarity)
                links = linked @ copies + copies @ linked
                out += [(keys[i], None, int(links[i])) for i in np.flatnonzero(links)]
                out += [(keys[x], keys[y], 0) for x, y in forest_edges(linked)]
            yield pd.DataFrame(out, columns=["u", "v", "links"])

    dealt = loaded.select("set_key", "n_copies", "depth", "length", "path", "side", "cell", "shingles")
    dealt = dealt.repartition("path", "cell").sortWithinPartitions("path", "cell", "set_key")
    return dealt.mapInPandas(verify, "u binary, v binary, links long")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class of linked texts, that of the least id; all columns stay.

    Rows that share an id go only if each of them is linked to a lesser id. Rows without an id stay.
    """
    classes = ngram_join(docs, id_col, text_col, **options)
    drop = classes.groupBy(F.col(id_col).alias("_drop_id")).agg(F.every(F.col(id_col) != F.col("class_id")).alias("_drop"))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("_id"))  # names can't clash
    return rows.join(drop.where("_drop"), F.col("_id") == F.col("_drop_id"), "left_anti").select("row.*")
