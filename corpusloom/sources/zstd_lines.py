"""Lines of zstd-compressed logs: the frames of a file are dealt over tasks, which stitch lines across their edges."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import list_files, locate

#: Compressed bytes of frames that one task reads together, and bytes of text that it hands on together.
GROUP_BYTES, HANDED_BYTES = 1 << 26, 1 << 22
READ_BYTES = 1 << 20
# Fixed values of the format (RFC 8878).
MAGIC, SKIPPABLE = 0xFD2FB528, 0x184D2A50
LINES_BITS = 40


class Source:
    """A file read at places in order; small reads come from a block that is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.begin, self.held = file, size, 0, b""

    def bytes_at(self, at: int, n: int) -> bytes:
        if not self.begin <= at or at + n > self.begin + len(self.held):
            self.begin, self.held = at, self.file.read_at(min(max(n, 1 << 12), max(self.size - at, 0)), at)
        return self.held[at - self.begin : at - self.begin + n]


def frame_end(source: Source, at: int) -> int:
    """Where the frame that begins at a place ends, from its header and those of its blocks; -1 if there is no whole frame.

    A frame is left by adding up sizes: nothing is decompressed, and bytes inside of a block are never taken for a frame.
    """
    number = lambda p, n: int.from_bytes(source.bytes_at(p, n), "little")
    magic = number(at, 4)
    if magic & 0xFFFFFFF0 == SKIPPABLE:
        end = at + 8 + number(at + 4, 4)
        return end if at + 8 <= source.size and end <= source.size else -1
    if magic != MAGIC or at + 6 > source.size:
        return -1
    flags = number(at + 4, 1)
    single = flags >> 5 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    while True:
        if at + 3 > source.size:
            return -1
        header = number(at, 3)
        at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)  # a block of one repeated byte holds that byte
        if header & 1:
            at += 4 * (flags >> 2 & 1)
            return at if at <= source.size else -1


def frame_groups(spark: SparkSession, path: str, pattern: str, group_bytes: int) -> DataFrame:
    """(path, nth, begin, end): runs of whole frames of at least group_bytes, the last of a file to its end."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, length in zip(batch["path"], batch["length"], strict=True):
                store, inside = locate(name)
                edges = [0]
                with store.open_input_file(inside) as f:
                    source, at = Source(f, int(length)), 0
                    while 0 <= at < length:
                        at = frame_end(source, at)
                        if 0 < at < length and at - edges[-1] >= group_bytes:
                            edges.append(at)
                yield pd.DataFrame({"path": name, "nth": range(len(edges)), "begin": edges, "end": [*edges[1:], int(length)]})

    files = list_files(spark, path, pattern).select("path", "length").where("length > 0")
    return files.mapInPandas(walk, "path string, nth int, begin long, end long")


def decompressed(file, begin: int, stop: int, strict: bool) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether the place where they were found is still before stop) from a frame's begin to the file's end.

    Where a frame can't be read the rest is left, unless strict.
    """
    import zstandard

    at, decoder, size = begin, zstandard.ZstdDecompressor().decompressobj(), file.size()
    try:
        while at < size:
            block = file.read_at(min(READ_BYTES, (stop if at < stop else size) - at, size - at), at)
            before = at < stop
            at += len(block)
            while block:
                out = decoder.decompress(block)
                if out:
                    yield out, before
                block = decoder.unused_data if decoder.eof else b""
                if decoder.eof:
                    decoder = zstandard.ZstdDecompressor().decompressobj()
    except zstandard.ZstdError:
        if strict:
            raise


def read_zstd_lines(spark: SparkSession, path: str, pattern: str = "*.zst", group_bytes: int = GROUP_BYTES, strict: bool = True) -> DataFrame:
    """(path, line_no, value): lines of zstd-compressed files that are not blank.

    Frames of a file are found by their headers and taken together in groups, each of which any task can read from its
    begin. A line belongs to the group in which it begins: a group leaves out what comes before its first line end, if
    it is not a file's first, and reads on past its own end to finish its last line. line_no orders the lines of a file;
    it counts them from 0 where a file is one group, else within groups. Bytes that are no UTF-8 become replacement
    characters. A frame that can't be read fails the read, or, if not strict, ends its group, whose earlier lines stay.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, nth, begin, end in zip(batch["path"], batch["nth"], batch["begin"], batch["end"], strict=True):
                store, inside = locate(name)
                with store.open_input_file(inside) as file:
                    yield from of_group(name, int(nth), decompressed(file, int(begin), int(end), strict))

    def of_group(name: str, nth: int, pieces: Iterator[tuple[bytes, bool]]) -> Iterator[pd.DataFrame]:
        numbers, values, size, n = [], [], 0, 0
        tail, begun, done = [], nth == 0, False

        def take(raw: bytes) -> None:
            nonlocal n, size
            text = raw.rstrip(b"\r").decode("utf-8", "replace")
            if text.strip():
                numbers.append(nth << LINES_BITS | n)
                values.append(text)
                size += len(text)
            n += 1

        for piece, before in pieces:
            first, *rest = piece.split(b"\n")
            tail.append(first) if begun else None
            if rest:
                if begun:
                    take(b"".join(tail))
                if not before:  # the line that began within the group is finished
                    done = True
                    break
                begun = True
                for whole in rest[:-1]:
                    take(whole)
                tail = [rest[-1]]
            elif not begun and not before:
                done = True  # no line begins within the group
                break
            if size > HANDED_BYTES:
                yield pd.DataFrame({"path": name, "line_no": numbers, "value": values})
                numbers, values, size = [], [], 0
        if begun and not done and b"".join(tail):
            take(b"".join(tail))
        if values:
            yield pd.DataFrame({"path": name, "line_no": numbers, "value": values})

    groups = frame_groups(spark, path, pattern, group_bytes).repartition("path", "nth")
    return groups.mapInPandas(lines, "path string, line_no long, value string")
