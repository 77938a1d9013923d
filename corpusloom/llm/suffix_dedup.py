"""Removal of repeated byte strings: anchors bring equal strings together, a Burrows-Wheeler transform compares them."""

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import MIX, mix, whole_groups
from .tables import materialise

LENGTH, GRAM = 200, 32
#: Bytes of a text that are looked at together, and of segments that one transform holds.
CHUNK, TRANSFORM = 1 << 22, 1 << 19
#: Bytes of distinct segments beyond which the strings of one anchor are dealt out by more of what they share.
CROWDED = 1 << 18
#: Anchors are dense where more than one in so many bytes is another.
DENSE = 16
#: Anchors that are handed on together.
FRAME_ROWS = 50_000
#: A segment with more than one in so many of all anchors is hot; there are fewer than so many of them.
HOT = 1000
STEP = np.uint64(0x100000001B3)
SIZE = CHUNK + 1024
POWERS = np.concatenate([[np.uint64(1)], np.full(SIZE, STEP, dtype=np.uint64)]).cumprod(dtype=np.uint64)
INVERSES = np.concatenate([[np.uint64(1)], np.full(SIZE, pow(int(STEP), -1, 1 << 64), dtype=np.uint64)]).cumprod(dtype=np.uint64)
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MIX)


def prefix_sums(b: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.uint64(0)], (BYTES[b] * POWERS[: len(b)]).cumsum(dtype=np.uint64)])


def hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings begin..end of the text with these sums."""
    return mix((sums[end] - sums[begin]) * INVERSES[begin] + (end - begin).astype(np.uint64) * MIX)


def anchors(raw: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, segment, lo, hi): each string of `length` bytes that starts at lo..hi has the same anchor.

    The anchor is the gram with the least hash in the string, the leftmost of equals: equal strings have
    equal anchors at equal places. key is the gram's hash, segment that of all bytes of those strings.

    Where anchors change at nearly every byte (rulers, padding, blank runs) the bytes repeat themselves. Of strings that
    a chunk holds more than once only the first then has its anchor's key; all of them are in segments of their own
    that are given twice. So there are no more rows than other bytes have.
    """
    parts = []
    for offset in range(0, len(raw) - length + 1, CHUNK - length + 1):
        b = np.frombuffer(raw[offset : offset + CHUNK], dtype=np.uint8)
        if len(b) < length:
            break
        sums = prefix_sums(b)
        places = np.arange(len(b) - gram + 1)
        grams = hashes(sums, places, places + gram)
        low = np.uint64((1 << 24) - 1)
        least, reach, window = grams & ~low | places.astype(np.uint64), 1, length - gram + 1
        while 2 * reach <= window:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < window:
            least = np.minimum(least[: reach - window], least[window - reach :])
        at = (least & low).astype(np.int64)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        if len(lo) * DENSE > len(at):
            first, again = within_itself(b, sums, length)
            lo, hi = pieces(first, at)
            run_lo, run_hi = pieces(again, np.arange(len(at)) // (length - gram + 1))
            of_run = hashes(sums, run_lo, run_hi + length)
            # of another key than any anchor's, and there twice: such a segment is known to be repeated whole
            parts += [(mix(of_run + MIX), of_run, run_lo + offset, run_hi + offset)] * 2
        else:
            hi = np.append(lo[1:], len(at)) - 1
        parts.append((grams[at[lo]], hashes(sums, lo, hi + length), lo + offset, hi + offset))
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def within_itself(b: np.ndarray, sums: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, again): starts of the first of equal strings of `length` bytes, and of all that are there more than once."""
    places = np.arange(len(b) - length + 1)
    _, at, back = np.unique(hashes(sums, places, places + length), return_index=True, return_inverse=True)
    first = at[back]
    later = np.flatnonzero(first != places)
    differ = np.zeros(len(later), dtype=bool)
    for k in range(length):  # the bytes, not only their hashes
        differ |= b[later + k] != b[first[later] + k]
    first[later[differ]] = later[differ]
    again = np.zeros(len(places), dtype=bool)
    again[first != places] = True
    again[first[again]] = True
    return np.flatnonzero(first == places), np.flatnonzero(again)


def pieces(some: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive numbers that have the same value of `by`."""
    if not len(some):
        return some, some
    cut = np.flatnonzero((np.diff(some) != 1) | (np.diff(by[some]) != 0))
    return some[np.concatenate([[0], cut + 1])], some[np.append(cut, len(some) - 1)]


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, the starts of its strings of `length` bytes that occur more than once among them all.

    The segments' Burrows-Wheeler transform is searched breadth-first by backward extension: the intervals of
    all strings of l + 1 bytes that end where a common prefix of length l is first seen come from those of
    l bytes, so the lengths of common prefixes between neighbours in suffix order appear by increasing value.
    The strings that the suffixes were first sorted by are where it begins. It stops at `length`; where no
    value has appeared by then the neighbours share that many bytes.
    """
    text = np.frombuffer(b"\xff".join(segments) + b"\xff", dtype=np.uint8)  # no UTF-8 text holds this byte
    n = len(text)
    order, sorted_by, known = suffix_order(text, length)
    before = text[order - 1]
    first = np.argsort(before, kind="stable")
    back = np.empty(n, dtype=np.int64)
    back[first] = np.arange(n)
    letter = before[first]
    edges = np.flatnonzero(known)
    lb, rb = edges[:-1], edges[1:]
    for _ in range(sorted_by, length):
        size = rb - lb
        owner = np.repeat(np.arange(len(lb)), size)
        image = back[np.arange(size.sum()) + np.repeat(lb - np.concatenate([[0], size.cumsum()[:-1]]), size)]
        if len(image) * 16 > n:
            owner_at = np.full(n, -1, dtype=np.int64)
            owner_at[image] = owner
            image = np.flatnonzero(owner_at >= 0)
            owner = owner_at[image]
        else:
            by = np.argsort(image)
            image, owner = image[by], owner[by]
        cut = (np.diff(image) != 1) | (np.diff(owner) != 0) | (letter[image[1:]] != letter[image[:-1]])
        ends = np.append(np.flatnonzero(cut), len(image) - 1)
        rb = image[ends] + 1
        lb = image[np.concatenate([[0], ends[:-1] + 1])]
        fresh = ~known[rb]
        lb, rb = lb[fresh], rb[fresh]
        known[rb] = True
        if not len(lb):
            break
    same = np.flatnonzero(~known)
    found = np.zeros(n, dtype=bool)
    found[order[same]] = found[order[same - 1]] = True
    out, at = [], 0
    for s in segments:
        out.append(np.flatnonzero(found[at : at + max(0, len(s) - length + 1)]))
        at += len(s) + 1
    return out


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Suffixes by their first `length` bytes or more, by tripling the length compared.

    Also a length that they were sorted by on the way, no more than `length`, and where in the order the
    strings of that length begin (and the order's end).
    """
    n, done, early = len(text), 8, None
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k]
    bits = int(n + 1).bit_length()
    times = 3 if 3 * bits <= 64 else 2
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.concatenate([[0], (ordered[1:] != ordered[:-1]).cumsum()]).astype(np.uint64) + np.uint64(1)
        if done <= length:
            early = done, rank
        if done >= length:
            break
        key = rank
        for k in range(1, times):
            key = key << np.uint64(bits)
            key[: max(0, n - k * done)] |= rank[k * done :]
        done *= times
    sorted_by, rank = early if early else (0, np.zeros(n, dtype=np.uint64))
    along = rank[order]
    return order, sorted_by, np.concatenate([[True], along[1:] != along[:-1], [True]])


def runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<start: bigint, end: bigint>>"


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def frame(refs: list[bytes], parts: list[tuple]) -> pd.DataFrame:
        key, segment, lo, hi = (np.concatenate(p) for p in zip(*parts, strict=True))
        ref = np.repeat(np.array(refs, dtype=object), [len(p[0]) for p in parts])
        return pd.DataFrame({"key": key.view(np.int64), "segment": segment.view(np.int64), "ref": ref, "lo": lo, "hi": hi})

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs, parts, n = [], [], 0  # many texts a frame: a frame has a cost of its own
        for batch in batches:
            for ref, text in zip(batch["ref"], batch["text"], strict=True):
                refs.append(ref)
                parts.append(anchors(text.encode("utf-8"), length, gram))
                n += len(parts[-1][0])
                if n >= FRAME_ROWS:
                    yield frame(refs, parts)
                    refs, parts, n = [], [], 0
        if n:
            yield frame(refs, parts)

    long_enough = texts.where(F.octet_length("text") >= length).select("ref", "text")
    return long_enough.mapInPandas(rows, "key long, segment long, ref binary, lo long, hi long")


def compare_segments(segments: DataFrame, length: int) -> DataFrame:
    """(key, name, start, end): bytes of segments covered by repeated strings, from (key, name, twin, bytes) rows.

    Bytes that a key has in two rows, or in one of which a twin is known, are repeated whole; which strings of
    different bytes are equal is found by the transform. All of a key are together, no more than CROWDED bytes.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            rows = pd.concat(held, ignore_index=True)
            held.clear()
            places: dict[tuple[int, bytes], list[int]] = {}
            for i, at in enumerate(zip(rows["key"].tolist(), rows["bytes"], strict=True)):
                places.setdefault(at, []).append(i)
            kinds = Counter(key for key, _ in places)
            several = [at for at in places if kinds[at[0]] > 1]
            starts = dict(zip(several, repeated_starts([b for _, b in several], length), strict=True)) if several else {}
            out, names, twin = [], rows["name"].tolist(), rows["twin"].tolist()
            for at, some in places.items():
                if len(some) > 1 or twin[some[0]]:
                    found = [(0, len(at[1]))]
                else:
                    found = [(a, b + length) for a, b in runs(starts[at])] if at in starts else []
                out += [(at[0], name, a, b) for name in {names[i] for i in some} for a, b in found]
            return pd.DataFrame(out, columns=["key", "name", "start", "end"])

        total = 0
        for frame, bounds in whole_groups(batches, ["key"]):
            sizes = frame["bytes"].map(len).to_numpy().cumsum()
            begin = 0
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if total + sizes[b - 1] - (sizes[begin - 1] if begin else 0) >= TRANSFORM:
                    held.append(frame.iloc[begin:b])
                    yield done()
                    begin, total = b, 0
            if begin < len(frame):
                held.append(frame.iloc[begin:])
                total += int(sizes[-1] - (sizes[begin - 1] if begin else 0))
        if held:
            yield done()

    dealt = segments.select("key", "name", "twin", "bytes").repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(compare, "key long, name long, start long, end long")


def anchor_of(raw: bytes, length: int, gram: int) -> int:
    """Where the anchor of a segment lies: the least gram within the bytes that all of its strings have."""
    sums = prefix_sums(np.frombuffer(raw, dtype=np.uint8))
    places = np.arange(len(raw) - length, length - gram + 1)
    return int(places[np.argmin(hashes(sums, places, places + gram) & ~np.uint64((1 << 24) - 1))])


def split_segments(crowded: DataFrame, length: int, gram: int, level: int) -> DataFrame:
    """(key, name, twin, at, bytes, of_key, of_name, offset): segments dealt out by how far left of the anchor strings begin.

    Equal strings begin equally far from their anchor. Distances are taken together in cells of 2**(8 - level)
    or so; the strings of a cell share more bytes than the anchor, whose hash is their new key.
    """
    width = -(-(length - gram + 1) >> level) or 1

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, name, twin, at, raw in zip(*(batch[c] for c in ("key", "name", "twin", "at", "bytes")), strict=True):
                anchor = anchor_of(raw, length, gram) if at < 0 else int(at)
                least, most = anchor - (len(raw) - length), anchor
                for cell in range(least // width, most // width + 1):
                    low, high = max(least, cell * width), min(most, cell * width + width - 1)
                    begin = anchor - high
                    shared = raw[anchor - cell * width : anchor - cell * width - width + 1 + length]
                    piece = raw[begin : anchor - low + length]
                    digest = lambda of: int.from_bytes(hashlib.blake2b(of, digest_size=8).digest(), "little", signed=True)
                    of = b"%d %d %d " % (key, level, cell)
                    out.append((digest(of + shared), digest(b"piece " + piece), twin, high, piece, key, name, begin))
            yield pd.DataFrame(out, columns=["key", "name", "twin", "at", "bytes", "of_key", "of_name", "offset"])

    schema = "key long, name long, twin boolean, at long, bytes binary, of_key long, of_name long, offset long"
    return crowded.select("key", "name", "twin", "at", "bytes").mapInPandas(split, schema)


def repeated_parts(segments: DataFrame, length: int, gram: int, most: int, level: int = 0) -> DataFrame:
    """compare_segments() of (key, name, twin, at, bytes, crowded) rows; those of crowded keys are split first.

    At the last level a cell holds one distance, so the strings of a key are all equal and no key is crowded.
    """
    found = compare_segments(segments.where("not crowded"), length)
    crowded = segments.where("crowded")
    if crowded.isEmpty():
        return found
    parts = materialise(split_segments(crowded, length, gram, level + 1), "parts")
    # equal parts are taken together; two of them are compared byte by byte
    named = parts.groupBy("key", "name").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("twin").alias("twin"), F.min("at").alias("at"),
        F.min("bytes").alias("bytes"), F.max("bytes").alias("other"),
    )
    named = materialise(
        named.select("key", "name", "n", "at", "bytes", (F.col("twin") | ((F.col("n") > 1) & (F.col("bytes") == F.col("other")))).alias("twin")),
        "named",
    )
    sizes = named.groupBy(F.col("key").alias("_key")).agg(
        F.sum("n").alias("_n"), F.bool_or("twin").alias("_twin"), F.sum(F.octet_length("bytes")).alias("_size"), F.count(F.lit(1)).alias("_kinds")
    )
    sizes = materialise(sizes.where("_n > 1 or _twin"), "sizes")
    some = named.join(sizes, F.col("key") == F.col("_key")).select(
        "key", "name", "twin", "at", "bytes", ((F.col("_size") > most) & (F.col("_kinds") > 1)).alias("crowded")
    )
    within = repeated_parts(materialise(some, "some"), length, gram, most, level + 1)
    within = within.select(F.col("key").alias("_k"), F.col("name").alias("_m"), "start", "end")
    owners = parts.select("key", "name", "of_key", "of_name", "offset")
    back = owners.join(within, (F.col("key") == F.col("_k")) & (F.col("name") == F.col("_m"))).select(
        F.col("of_key").alias("key"), F.col("of_name").alias("name"), (F.col("offset") + F.col("start")).alias("start"),
        (F.col("offset") + F.col("end")).alias("end"),
    )
    return found.union(back)


def remove_repeats(
    docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowded: int = CROWDED
) -> DataFrame:
    """docs with a struct column `repeats`: spans (byte ranges removed, maximal and in order) and kept (bytes).

    Every byte covered by a string of `length` bytes that starts at any other place too, in the same text or
    another, is removed; strings are judged on the input and never cross texts. kept may cut a character, so
    it is binary.

    1. Each text is cut into segments, the runs of strings that have the same anchor (about one in a hundred
       bytes starts one). Anchors are counted; one that is met once has no repeated string.
    2. Of each distinct segment of the others one copy is compared with those of the same anchor, and two if it
       is met more often: their bytes must be equal for it to be repeated. Different segments are compared by
       the transform. An anchor with very many is split by what more its strings share.
    3. What is found of a segment holds for all places that have it; segments are named by two 64-bit hashes.
    4. Texts are joined to their spans once, by content hash: equal texts share their spans, so a text that a
       third of the table repeats has one set of spans.

    Null counts as empty. Texts shorter than `length` keep everything. Repeated rows are repeated texts: all
    of a text of at least `length` bytes goes. Other columns pass through; one named `repeats` is replaced.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole_rows = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(text)).alias("ref"))  # names can't clash
    plain = docs.select(text.alias("text")).select(F.unhex(F.md5("text")).alias("ref"), "text")
    rows = anchor_rows(plain, length, gram)
    keys = rows.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    # as a table of its own the counts are shuffled for the join, whose hot keys can then be split
    many = materialise(keys.where("n > 1").select("_key"), "keys")
    met = materialise(rows.join(many, F.col("key") == F.col("_key")).select("key", "segment", "ref", "lo", "hi"), "anchors")
    place = F.struct("ref", "lo", "hi")
    distinct = met.groupBy("key", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("of"), F.max(place).alias("other"))
    distinct = materialise(distinct, "segments")
    size = F.col("of.hi") - F.col("of.lo") + length
    many = distinct.groupBy(F.col("key").alias("_key")).agg(F.sum(size).alias("_size")).where(F.col("_size") > crowded)
    flagged = distinct.join(many, F.col("key") == F.col("_key"), "left").withColumn("crowded", F.col("_size").isNotNull())
    same = F.col("of") == F.col("other")  # of equal texts
    places = F.when((F.col("n") > 1) & ~same, F.array("of", "other")).otherwise(F.array("of"))
    wanted = flagged.select(
        "key", "segment", "crowded", ((F.col("n") > 1) & same).alias("twin"), F.explode(places).alias("p")
    ).select(F.col("p.ref").alias("ref"), F.struct("key", "segment", "p.lo", "p.hi", "twin", "crowded").alias("s"))
    wanted = wanted.groupBy(F.col("ref").alias("_of")).agg(F.collect_list("s").alias("wanted"))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for value, some in zip(batch["text"], batch["wanted"], strict=True):
                raw = value.encode("utf-8")
                out += [(s["key"], s["segment"], s["twin"], -1, raw[s["lo"] : s["hi"] + length], s["crowded"]) for s in some]
            yield pd.DataFrame(out, columns=["key", "name", "twin", "at", "bytes", "crowded"])

    once = plain.groupBy("ref", "text").agg(F.count(F.lit(1)).alias("n"))  # copies of a text go map-side
    held = once.join(wanted.hint("shuffle_hash"), F.col("ref") == F.col("_of")).select("text", "wanted")
    segments = held.mapInPandas(cut_out, "key long, name long, twin boolean, at long, bytes binary, crowded boolean")
    parts = repeated_parts(materialise(segments, "cut"), length, gram, crowded)
    parts = parts.groupBy(F.col("key").alias("_key"), F.col("name").alias("_name")).agg(F.collect_set(F.struct("start", "end")).alias("parts"))
    hot = distinct.where(F.col("n") * HOT > met.count()).select(F.col("key").alias("_hot"), F.col("segment").alias("_hot_segment"))
    parts, hot = materialise(parts, "repeated"), materialise(hot, "hot")
    of_hot = (F.col("key") == F.col("_hot")) & (F.col("segment") == F.col("_hot_segment"))
    on = (F.col("key") == F.col("_key")) & (F.col("segment") == F.col("_name"))
    common = parts.join(F.broadcast(hot), (F.col("_key") == F.col("_hot")) & (F.col("_name") == F.col("_hot_segment"))).drop("_hot", "_hot_segment")
    covered = met.join(F.broadcast(common), on).unionByName(met.join(F.broadcast(hot), of_hot, "left_anti").join(parts, on))
    spans = covered.select("ref", "lo", F.explode("parts").alias("p"))
    spans = spans.select("ref", (F.col("lo") + F.col("p.start")).alias("start"), (F.col("lo") + F.col("p.end")).alias("end"))
    spans = materialise(spans.distinct().groupBy(F.col("ref").alias("_of")).agg(F.collect_list(F.struct("start", "end")).alias("_spans")), "spans")

    @F.pandas_udf(f"spans {SPANS}, kept binary")
    def remove(values: pd.Series, found: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for value, some in zip(values, found, strict=True):
            raw = (value or "").encode("utf-8")
            cut = merged([(s["start"], s["end"]) for s in some]) if some is not None else []
            spans.append([{"start": a, "end": b} for a, b in cut])
            edges = [0, *(x for s in cut for x in s), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return pd.DataFrame({"spans": pd.Series(spans, dtype=object), "kept": pd.Series(kept, dtype=object)})

    joined = whole_rows.join(spans.hint("shuffle_hash"), F.col("ref") == F.col("_of"), "left")
    done = joined.select("row", remove(F.col("row")[text_col], F.col("_spans")).alias("repeats"))
    return done.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "repeats"), "repeats")
