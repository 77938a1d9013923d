"""Removal of repeated runs of words: suffixes are split by variable-length prefixes, and a suffix tree is built of each group."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import whole_groups
from .suffix_dedup import POWERS, hashes, merged, prefix_sums, runs
from .tables import materialise

#: Words of a window, and of the gram that ends the prefix by which a suffix is first dealt out.
LENGTH, GRAM = 35, 8
#: Words (and bytes) that are looked at together, and bytes of segments that one task holds as trees.
CHUNK, FOREST = 1 << 20, 1 << 19
#: Bytes of a group of suffixes beyond which it is split by more of the words that their prefixes end with.
CROWDED = 1 << 18
#: Anchors that are handed on together.
FRAME_ROWS = 50_000
#: A segment that is met by more than one in so many of all anchors is hot; there are fewer than so many of them.
HOT = 1000


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word; words are what white space (bytes 32 and 9 to 13) leaves."""
    b = np.frombuffer(raw, dtype=np.uint8)
    blank = (b == 32) | (b - np.uint8(9) < 5)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    begin, end = edges[::2], edges[1::2]
    out, i = np.empty(len(begin), dtype=np.uint64), 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK, side="right")))
        low, high = int(begin[i]), int(end[j - 1])
        if high - low > CHUNK:
            out[i] = int.from_bytes(hashlib.blake2b(raw[low:high], digest_size=8).digest(), "little")
        else:
            out[i:j] = hashes(prefix_sums(b[low:high]), begin[i:j] - low, end[i:j] - low)
        i = j
    return out


class Windows:
    """The windows that start at offset.. of a text, no more than CHUNK, with hashes of any run of their words."""

    def __init__(self, words: np.ndarray, offset: int, length: int):
        w = words[offset : offset + CHUNK]
        self.offset, self.n = offset, len(w) - length + 1
        self.sums = np.concatenate([[np.uint64(0)], (w * POWERS[: len(w)]).cumsum(dtype=np.uint64)])
        places = np.arange(self.n)
        _, first, back = np.unique(hashes(self.sums, places, places + length), return_index=True, return_inverse=True)
        #: Where the same words start first.
        self.first = first[back]
        later = np.flatnonzero(self.first != places)
        if len(later):  # all the words' hashes are equal too
            differ = np.zeros(len(later), dtype=bool)
            for k in range(length):
                differ |= w[later + k] != w[self.first[later] + k]
            self.first[later[differ]] = later[differ]
        #: Which windows are met again within these.
        self.again = self.first != places
        self.again[self.first[self.again]] = True

    @staticmethod
    def of(words: np.ndarray, length: int) -> Iterator["Windows"]:
        for offset in range(0, len(words) - length + 1, CHUNK - length + 1):
            yield Windows(words, offset, length)


def anchors(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, segment, lo, hi, at): the windows that start at lo..hi have their anchor at word `at`.

    The anchor of a window is its gram of least hash, the leftmost of equals, so equal windows have equal anchors at
    equal places. key is the hash of the gram, segment that of all words of lo..hi. Of windows that a chunk holds more
    than once only the first is here: a text that repeats itself, however long, gives each of its windows once.
    """
    parts = []
    for some in Windows.of(words, length):
        places = np.arange(some.n + length - gram)
        grams = hashes(some.sums, places, places + gram)
        low = np.uint64((1 << 24) - 1)
        least, reach, width = grams & ~low | places.astype(np.uint64), 1, length - gram + 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: reach - width], least[width - reach :])
        at = (least & low).astype(np.int64)
        kept = np.flatnonzero(some.first == np.arange(some.n))
        if not len(kept):
            continue
        cut = np.flatnonzero((np.diff(kept) != 1) | (np.diff(at[kept]) != 0))
        lo, hi = kept[np.concatenate([[0], cut + 1])], kept[np.append(cut, len(kept) - 1)]
        parts.append((grams[at[lo]], hashes(some.sums, lo, hi + length), lo + some.offset, hi + some.offset, at[lo] + some.offset))
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def frame(refs: list[bytes], parts: list[tuple]) -> pd.DataFrame:
        key, segment, lo, hi, at = (np.concatenate(p) for p in zip(*parts, strict=True))
        ref = np.repeat(np.array(refs, dtype=object), [len(p[0]) for p in parts])
        return pd.DataFrame({"key": key.view(np.int64), "segment": segment.view(np.int64), "ref": ref, "lo": lo, "hi": hi, "at": at})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs, parts, n = [], [], 0  # many texts a frame: a frame has a cost of its own
        for batch in batches:
            for ref, text in zip(batch["ref"], batch["text"], strict=True):
                refs.append(ref)
                parts.append(anchors(word_hashes(text.encode("utf-8")), length, gram))
                n += len(parts[-1][0])
                if n >= FRAME_ROWS:
                    yield frame(refs, parts)
                    refs, parts, n = [], [], 0
        if n:
            yield frame(refs, parts)

    long_enough = texts.where(F.octet_length("text") >= 2 * length - 1).select("ref", "text")
    return long_enough.mapInPandas(rows, "key long, segment long, ref binary, lo long, hi long, at long")


def leaf_parents(segments: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment (starts, depths): which of its suffixes of at least `length` words hang below a deep node, and how deep.

    The segments' suffixes in order, with the lengths that neighbours share, are their suffix tree: an inner node is
    a run of neighbours, its depth the least of the lengths between them, and a leaf's parent is as deep as the longer
    of the two beside it. Suffixes below a node of `length` words or more begin with the same words as others, and the
    depth of their parent is how far a maximal repeat goes. Ranks by the first 1, 2, 4.. words give order and lengths.
    """
    known: dict[bytes, int] = {}
    codes, begins, at = [], [], 0
    for s in segments:
        words = s.split()
        begins.append(at)
        codes += [known.setdefault(w, len(known)) for w in words]
        codes.append(-1)
        at += len(words) + 1
    text = np.array(codes, dtype=np.int64)
    ends = np.flatnonzero(text < 0)
    text[ends] = len(known) + np.arange(len(ends))  # each end is a letter of its own, so nothing is shared beyond it
    sizes = ends - np.array(begins)
    owner = np.repeat(np.arange(len(segments)), np.maximum(sizes - length + 1, 0))
    if not len(owner):
        return [(np.zeros(0, dtype=np.int64),) * 2 for _ in segments]
    first = np.concatenate([np.arange(b, b + max(0, n - length + 1)) for b, n in zip(begins, sizes.tolist(), strict=True)])
    ranks, reach, most = [text], 1, int(sizes.max())
    while 2 * reach <= most:
        last = ranks[-1]
        pair = last * (len(text) + len(known) + 1)
        pair[:-reach] += last[reach:] + 1
        ranks.append(np.unique(pair, return_inverse=True)[1])
        reach *= 2
    last = ranks[-1]
    beyond = np.concatenate([last + 1, np.zeros(reach, dtype=np.int64)])[first + reach]
    order = first[np.lexsort((beyond, last[first]))]
    a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(len(order) - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = ranks[level][a] == ranks[level][b]
        for x in (a, b, shared):
            x[same] += 1 << level
    depth = np.maximum(np.append(shared, 0), np.concatenate([[0], shared]))
    deep = np.flatnonzero(depth >= length)
    whose = np.searchsorted(np.array(begins), order[deep], side="right") - 1
    by = np.lexsort((order[deep], whose))
    found, whose, depth = order[deep][by], whose[by], depth[deep][by]
    cuts = np.searchsorted(whose, np.arange(len(segments) + 1))
    return [(found[x:y] - b, depth[x:y]) for x, y, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), begins, strict=True)]


def grow_trees(groups: DataFrame, length: int) -> DataFrame:
    """(key, name, start, end): words of segments in repeated strings, from (group, key, name, twin, offset, words) rows.

    All rows of a group are in one task, which builds trees of some groups together; a twin has a copy that is not here.
    """

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            held.clear()
            out = []
            segments = rows["words"].tolist()
            found = leaf_parents(segments, length)
            places = zip(rows["key"].tolist(), rows["name"].tolist(), rows["twin"].tolist(), rows["offset"].tolist(), segments, found, strict=True)
            for key, name, twin, offset, words, (starts, depths) in places:
                spans = [(0, words.count(b" ") + 1)] if twin else merged(list(zip(starts.tolist(), (starts + depths).tolist(), strict=True)))
                out += [(key, name, a + offset, b + offset) for a, b in spans]
            return pd.DataFrame(out, columns=["key", "name", "start", "end"])

        total = 0
        for frame, bounds in whole_groups(batches, ["group"]):
            sizes = np.concatenate([[0], frame["words"].map(len).to_numpy().cumsum()])
            begin = 0
            for b in bounds[1:].tolist():
                if total + sizes[b] - sizes[begin] >= FOREST:
                    held.append(frame.iloc[begin:b])
                    yield done()
                    begin, total = b, 0
            if begin < len(frame):
                held.append(frame.iloc[begin:])
                total += int(sizes[-1] - sizes[begin])
        if held:
            yield done()

    dealt = groups.select("group", "key", "name", "twin", "offset", "words").repartition("group").sortWithinPartitions("group")
    return dealt.mapInPandas(grow, "key long, name long, start long, end long")


def suffix_rows(crowded: DataFrame, length: int, gram: int) -> DataFrame:
    """Crowded pieces in halves: hashes of the words that the prefixes of all suffixes of a half end with, and of the half.

    Suffixes that begin `low` to `high` words before their anchor have prefixes that run to the end of the window of the
    one that begins first, and all hold the words from where the last one begins: the narrower the range, the more words.
    Equal windows have equal anchors at equal places, so they are in halves with the same such words.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, name, twin, offset, at, low, high, raw in zip(*(batch[c] for c in batch.columns), strict=True):
                words, values = raw.split(), word_hashes(raw)
                sums = np.concatenate([[np.uint64(0)], (values * POWERS[: len(values)]).cumsum(dtype=np.uint64)])
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    begin, end = max(at - b, 0), min(at - a + length, len(words))
                    if end - begin >= length:
                        group, whole = hashes(sums, np.array([at - a, begin]), np.array([at - b + length, end])).view(np.int64).tolist()
                        out.append((group, whole, key, name, twin, offset + begin, offset + end, at - begin, a, b, b" ".join(words[begin:end])))
            yield pd.DataFrame(out, columns=columns)

    schema = "group long, whole long, key long, name long, twin boolean, offset long, end long, at long, low int, high int, words binary"
    columns = [c.split()[0] for c in schema.split(", ")]
    return crowded.select("key", "name", "twin", "offset", "at", "low", "high", "words").mapInPandas(cut, schema)


def split_crowded(crowded: DataFrame, length: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(groups, equal) of crowded segments: rows for grow_trees() of what prefixes that share more leave together, and spans.

    Pieces are halved by where their suffixes begin. Of equal halves all are repeated, and one goes on for them; a group
    in which nothing is left to be found goes, one of at most `most` bytes gets its tree, a larger one is halved again.
    What halves of one suffix share is the whole window, so those of a group are equal.
    """
    n_words = F.size(F.split(F.col("words").cast("string"), " ")).cast("long")
    equal = crowded.where("twin").select("key", "name", F.lit(0).cast("long").alias("start"), n_words.alias("end"))
    within = [F.lit(0).cast("long").alias("offset"), "at", F.lit(0).alias("low"), F.lit(length - gram).alias("high")]
    rest, few = crowded.select("key", "name", "twin", *within, "words"), []
    for _ in range(max(1, (length - gram).bit_length())):
        rest = materialise(suffix_rows(rest, length, gram), "suffixes")
        one = F.min(F.struct("key", "name", "offset", "at", "low", "high", "words")).alias("one")
        pieces = rest.groupBy("group", "whole").agg(F.count(F.lit(1)).alias("n"), F.max("twin").alias("twin"), one)
        # as tables of their own they are shuffled for the joins, which can then be split where a piece or a group is hot
        pieces = materialise(pieces.withColumn("twin", F.col("twin") | (F.col("n") > 1)), "pieces")
        again = pieces.where("n > 1").select(F.col("group").alias("_group"), F.col("whole").alias("_whole"))
        met = rest.join(again, (F.col("group") == F.col("_group")) & (F.col("whole") == F.col("_whole")))
        equal = equal.union(met.select("key", "name", F.col("offset").alias("start"), "end"))
        sizes = pieces.groupBy(F.col("group").alias("_group")).agg(
            F.count(F.lit(1)).alias("n_pieces"), F.count_if(~F.col("twin")).alias("n_open"), F.sum(F.octet_length("one.words")).alias("size")
        )
        sizes = materialise(sizes.where("n_pieces > 1 and n_open > 0").select("_group", "size"), "prefixes")
        shared = pieces.join(sizes, F.col("group") == F.col("_group")).select("group", "one.*", "twin", "size")
        shared = materialise(shared, "shared")
        few.append(shared.where(F.col("size") <= most).select("group", "key", "name", "twin", "offset", "words"))
        rest = shared.where(F.col("size") > most)
        if rest.isEmpty():
            break
    groups = few[0]
    for more in few[1:]:
        groups = groups.union(more)
    return groups, equal


def remove_repeats(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED
) -> DataFrame:
    """docs with a struct column `repeats`: n_words, spans (ranges of words removed, maximal, in order) and kept (text).

    A word is removed if a window of `length` consecutive words that covers it starts at any other place too, in the
    same text or another. Windows are judged on the input and never cross texts; words are compared as they are. kept
    is the other words, joined by one space.

    1. A window that its own text repeats is known within the text, and goes on once.
    2. Of each window's suffix the prefix runs up to the end of its anchor, so prefixes differ in length. Suffixes
       whose prefixes end with the same anchor overlap: a group shares one segment of words for each run of them.
       Anchors are counted, and one that is met once has no repeated window.
    3. Of each distinct segment of the others two copies are taken (one, if it is met once or in equal texts only),
       and a suffix tree is built of each group: suffixes below a node of `length` words or more are repeated.
       A group of more than `crowded` bytes is first split: its segments are halved by where their suffixes begin, so
       that the prefixes of a half end with more words than the anchor, step by step, and equal halves go on as one.
    4. What is found of a segment holds for all places that have it (two 64-bit hashes of its words). Texts are joined
       to their spans once, by content hash, so that a text that a third of the table repeats has one set of spans.

    Words are compared as such within trees, by 64-bit hashes in 1, by two of them where equal halves go on as one.
    Null counts as empty; texts of fewer than `length` words keep everything, with blanks made one space. Repeated rows
    are repeated texts: of one of at least `length` words nothing stays. Other columns pass through, one named `repeats`
    is replaced. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole_rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(text)).alias("ref"))  # names can't clash
    plain = docs.select(text.alias("text")).select(F.unhex(F.md5("text")).alias("ref"), "text")
    rows = anchor_rows(plain, length, gram)
    keys = rows.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    # as a table of its own the counts are shuffled for the join, whose hot keys can then be split
    many = materialise(keys.where("n > 1").select("_key"), "keys")
    met = materialise(rows.join(many, F.col("key") == F.col("_key")).select("key", "segment", "ref", "lo", "hi", "at"), "anchors")
    place = F.struct("ref", "lo", "hi", "at")
    distinct = met.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("of"), F.max(place).alias("other"))
    distinct = materialise(distinct, "segments")
    same = F.col("of") == F.col("other")  # of equal texts
    places = F.when(same, F.array("of")).otherwise(F.array("of", "other"))
    wanted = distinct.select("key", "segment", ((F.col("n") > 1) & same).alias("twin"), F.posexplode(places).alias("copy", "p"))
    wanted = wanted.select(
        F.col("p.ref").alias("ref"),
        F.struct("key", "segment", "copy", "twin", "p.lo", "p.hi", (F.col("p.at") - F.col("p.lo")).alias("at")).alias("s"),
    )
    wanted = wanted.groupBy(F.col("ref").alias("_of")).agg(F.collect_list("s").alias("wanted"))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value, some in zip(batch["text"], batch["wanted"], strict=True):
                words = value.encode("utf-8").split()  # at white space of ASCII only
                out += [(s["key"], s["segment"], s["copy"], s["twin"], s["at"], b" ".join(words[s["lo"] : s["hi"] + length])) for s in some]
            yield pd.DataFrame(out, columns=["key", "name", "copy", "twin", "at", "words"])

    once = plain.groupBy("ref", "text").agg(F.count(F.lit(1)).alias("n"))  # copies of a text go map-side
    held = once.join(wanted.hint("shuffle_hash"), F.col("ref") == F.col("_of")).select("text", "wanted")
    segments = materialise(held.mapInPandas(cut_out, "key long, name long, copy int, twin boolean, at long, words binary"), "cut")
    sizes = segments.groupBy(F.col("key").alias("_key")).agg(F.sum(F.octet_length("words")).alias("_size")).where(F.col("_size") > crowded)
    sizes = materialise(sizes, "crowded")
    of_key = F.col("key") == F.col("_key")
    groups = segments.join(sizes, of_key, "left_anti").select(F.col("key").alias("group"), "key", "name", "twin", F.lit(0).cast("long").alias("offset"), "words")
    equal = None
    if not sizes.isEmpty():
        dense = materialise(segments.join(sizes, of_key, "left_semi"), "dense")
        more, equal = split_crowded(dense, length, gram, crowded)
        groups = groups.union(more)
    found = grow_trees(groups, length)
    parts = found if equal is None else found.union(equal)
    parts = parts.groupBy(F.col("key").alias("_key"), F.col("name").alias("_name")).agg(F.collect_set(F.struct("start", "end")).alias("parts"))
    hot = distinct.where(F.col("n") * HOT > met.count()).select(F.col("key").alias("_hot"), F.col("segment").alias("_hot_segment"))
    parts, hot = materialise(parts, "repeated"), materialise(hot, "hot")
    of_hot = (F.col("key") == F.col("_hot")) & (F.col("segment") == F.col("_hot_segment"))
    on = (F.col("key") == F.col("_key")) & (F.col("segment") == F.col("_name"))
    common = parts.join(F.broadcast(hot), (F.col("_key") == F.col("_hot")) & (F.col("_name") == F.col("_hot_segment"))).drop("_hot", "_hot_segment")
    covered = met.join(F.broadcast(common), on).unionByName(met.join(F.broadcast(hot), of_hot, "left_anti").join(parts, on))
    spans = covered.select("ref", "lo", F.explode("parts").alias("p"))
    spans = spans.select("ref", F.struct((F.col("lo") + F.col("p.start")).alias("start"), (F.col("lo") + F.col("p.end")).alias("end")).alias("s"))
    spans = materialise(spans.groupBy(F.col("ref").alias("_of")).agg(F.collect_set("s").alias("_spans")), "spans")

    @F.pandas_udf("n_words bigint, spans array<struct<start: bigint, end: bigint>>, kept string")
    def remove(values: pd.Series, found: pd.Series) -> pd.DataFrame:
        counts, spans, kept = [], [], []
        for value, some in zip(values, found, strict=True):
            raw = (value or "").encode("utf-8")
            words = raw.split()
            cut = [(s["start"], s["end"]) for s in some] if some is not None else []
            if len(words) >= length:
                for own in Windows.of(word_hashes(raw), length):
                    cut += [(a + own.offset, b + own.offset + length) for a, b in runs(np.flatnonzero(own.again))]
            cut = merged(cut)
            spans.append([{"start": a, "end": b} for a, b in cut])
            edges = [0, *(x for s in cut for x in s), len(words)]
            counts.append(len(words))
            kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]).decode("utf-8"))
        return pd.DataFrame({"n_words": counts, "spans": pd.Series(spans, dtype=object), "kept": pd.Series(kept, dtype=object)})

    joined = whole_rows.join(spans.hint("shuffle_hash"), F.col("ref") == F.col("_of"), "left")
    done = joined.select("row", remove(F.col("row")[text_col], F.col("_spans")).alias("repeats"))
    return done.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "repeats"), "repeats")
