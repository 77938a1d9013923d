"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans to them."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import lowest

#: Kinds that base patterns find, and those of the field, which also finds keys and tokens of services.
KINDS = ("email", "ip", "card", "phone")
FIELD_KINDS = (*KINDS, "secret")
#: Documents whose islands the field is fitted on, islands taken from each of them, and characters of each island.
FIT_DOCS, FIT_ISLANDS, FIT_CHARS = 400, 4, 500
#: Longest entity, in tokens, that the dynamic programme considers.
LONGEST = 16
#: Blanks that an island reaches across on either side of a digit or at sign: a segment of LONGEST tokens has no more
#: than half as many, and the tokens beside it, which its features see, add two.
REACH = LONGEST // 2 + 2
#: Shortest run of letters and digits together that is one token, not one for each change between them.
MIXED_RUN = 16
#: Tokens whose segments are scored together, and characters of islands that are decoded together.
TOKENS, CHARS = 4096, 1 << 16
HASHED, FEATURES = 1 << 14, 9

LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
ASIDE = re.compile(rf"(?:\S*+[^\S\n]++){{0,{REACH}}}+\S*+")
#: Where the value of a key, token or password is plainly named; the field learns from these what such values look like.
NAMED_SECRET = re.compile(
    r"(?i)\b(?:token|secret|password|passwd|api[_ -]?key|access[_ -]?key)s?[\"']?\s{0,4}[:=]\s{0,4}[\"']?([A-Za-z0-9]{16,200})(?![A-Za-z0-9])"
)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Every match needs an at sign, so each is tried once: the characters before it, then a dotted domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL_PART.match(text, begin - 1):
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """(kind number, start, end) of the base patterns, leftmost and non-overlapping within each kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += ((0, a, b) for a, b in email_spans(text))
    for m in ADDRESS.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]  # int() takes no more than 4300 digits
        if all(len(p) < 4 and int(p) <= 255 for p in parts):
            spans.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += ((3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15)
    return spans


def islands(text: str) -> Iterator[tuple[int, int]]:
    """The stretches of a text in which every segment that may be an entity lies whole, with the tokens beside it.

    Such a segment holds a digit or an at sign, has no more than LONGEST tokens and stays within a line. A stretch goes
    on for REACH blanks, however long the words are, and so never ends within a word. Each part of the text is looked
    at a bounded number of times.
    """
    begin, end, last = 0, -1, -1  # last: the last digit or at sign so far; end: how far the stretch is known to go
    for m in ANCHOR.finditer(text):
        p = m.start()
        if p >= end >= 0:
            end = ASIDE.match(text, last).end()
            if p >= end:
                yield begin, end
        if p >= end:
            low = text.rfind("\n", max(end, 0), p) + 1 or max(end, 0)
            begin = p
            for _ in range(REACH + 1):
                begin = text.rfind(" ", low, begin)
                if begin < 0:
                    begin = low
                    break
                while begin > low and text[begin - 1].isspace():
                    begin -= 1
            end = ASIDE.match(text, p).end()
        last = p
    if end >= 0:
        yield begin, ASIDE.match(text, last).end()


# Kinds of tokens. Other characters are tokens of their own, their kind is SIGN plus the code point.
LETTERS, DIGITS, MIXED, BLANK, LINE, SIGN = range(6)
MIX = np.uint64(0x9E3779B97F4A7C15)
PLUS, OPENING, CLOSING, DOT, AT = (SIGN + ord(c) for c in "+().@")


def char_kind(c: str) -> int:
    if c.isascii() and c.isdigit():
        return DIGITS
    if c.isalnum() and not c.isdecimal():
        return LETTERS
    return LINE if c == "\n" else BLANK if c.isspace() else SIGN


ASCII = np.array([char_kind(chr(i)) for i in range(128)], dtype=np.uint8)


class Tokens:
    """Tokens of a text: runs of letters, of digits, of blanks, long runs of letters and digits mixed, and single signs."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = ASCII[np.minimum(codes, 127)]
        beyond = np.flatnonzero(codes > 127)
        if len(beyond):
            found, at = np.unique(codes[beyond], return_inverse=True)
            kinds[beyond] = np.array([char_kind(chr(c)) for c in found.tolist()], dtype=np.uint8)[at]
        plain = kinds <= DIGITS
        edges = np.flatnonzero(np.diff(np.concatenate([[False], plain, [False]]).view(np.int8)))
        first, last = edges[::2], edges[1::2]
        numbers = np.concatenate([[0], (kinds == DIGITS).cumsum()])
        n_digits = numbers[last] - numbers[first]
        long = (last - first >= MIXED_RUN) & (n_digits > 0) & (n_digits < last - first)
        for a, b in zip(first[long].tolist(), last[long].tolist(), strict=True):
            kinds[a:b] = MIXED
        begins = (kinds == SIGN) | (kinds == LINE)
        begins[1:] |= kinds[1:] != kinds[:-1]
        begins[:1] = True
        self.codes = codes
        self.start = np.flatnonzero(begins)
        self.end = np.append(self.start[1:], len(codes))[: len(self.start)]
        kind = kinds[self.start].astype(np.int64)
        self.kind = np.where(kind == SIGN, SIGN + codes[self.start], kind)

    def __len__(self) -> int:
        return len(self.start)


def bucket(feature: int, values: np.ndarray) -> np.ndarray:
    return (((values.astype(np.uint64) * np.uint64(16) + np.uint64(feature)) * MIX) >> np.uint64(64 - HASHED.bit_length() + 1)).astype(np.int64)


def joined(*parts: np.ndarray) -> np.ndarray:
    """One number for each row of several."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for p in parts:
        out = out * np.uint64(0x100000001B3) + p.astype(np.uint64) + np.uint64(1)
    return out


def segments(tokens: Tokens, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, ids) of the candidate segments whose last token is one of low..high-1, with whole-span features.

    ids are the hashed numbers of FEATURES features of each segment: its shape, counts of digits, signs,
    dots and at signs, checks (parts of an address, Luhn), length, and surroundings. Candidates begin and
    end with letters, digits or a bracket, hold a digit or an at sign, and stay within a line.
    """
    base = max(0, low - LONGEST - 1)
    stop = min(len(tokens), high + 2)
    kind = tokens.kind[base:stop]
    begin, end = tokens.start[base:stop], tokens.end[base:stop]
    n = len(kind)
    size = end - begin
    padded = np.concatenate([kind, np.full(3, LINE)])
    before = np.concatenate([[LINE], kind[:-1]])
    total = lambda x: np.concatenate([[0], x.cumsum()])

    digit = kind == DIGITS
    chars = tokens.codes[begin[0] : end[-1]].astype(np.int64) - 48 if n else np.zeros(0, dtype=np.int64)
    counted = np.repeat(digit, size)
    values = np.where(counted, chars, 0)
    places = np.where(counted, counted.cumsum() - 1, 0)
    doubled = values * 2 - 9 * (values > 4)
    at = np.concatenate([begin, end[-1:]]) - (begin[0] if n else 0)
    sums = [total(np.where(counted, np.where(places % 2 == parity, doubled, values), 0))[at] for parity in (0, 1)]
    upto, digits = total(counted), total(np.where(digit, size, 0))
    dots, ats, letters = total(kind == DOT), total(kind == AT), total((kind == LETTERS) | (kind == MIXED))
    mixed, lines = total(kind == MIXED), total(kind == LINE)
    anchors = total(digit | (kind == AT) | (kind == MIXED))
    three = np.zeros(n, dtype=np.int64)
    short = digit & (size <= 3)
    for k in range(3):  # the value of a run of at most three digits
        inside = short & (size > k)
        three[inside] = three[inside] * 10 + tokens.codes[begin[inside] + k].astype(np.int64) - 48
    part = short & (three <= 255)
    address = np.zeros(n, dtype=bool)
    if n >= 7:
        address[: n - 6] = True
        for k in range(7):
            address[: n - 6] &= (kind == DOT)[k : n - 6 + k] if k % 2 else part[k : n - 6 + k]
    bit = np.where(kind >= SIGN, np.minimum(np.maximum(kind - SIGN - 32, 0), 95) % 62, 63)
    mask = np.where(kind >= SIGN, np.uint64(1) << bit.astype(np.uint64), np.where(kind == BLANK, np.uint64(1) << np.uint64(63), np.uint64(0)))
    can_begin = (kind <= MIXED) | (kind == PLUS) | (kind == OPENING)
    can_end = (kind <= MIXED) | (kind == CLOSING)

    out = []
    shape, signs = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for length in range(1, min(LONGEST, n) + 1):
        m = n - length + 1
        last = np.arange(length - 1, n)
        shape = shape[:m] * np.uint64(1000003) + kind[last].astype(np.uint64) + np.uint64(1)
        signs = signs[:m] | mask[last]
        held = anchors[length:] - anchors[:m] > 0
        good = can_begin[:m] & can_end[last] & held & (lines[length:] == lines[:m])
        good &= (last + base >= low) & (last + base < high)
        i = np.flatnonzero(good)
        if not len(i):
            continue
        j, e = i + length, i + length - 1
        n_digits, has_letters = digits[j] - digits[i], letters[j] > letters[i]
        is_address = address[i] & (length == 7)
        last_digit = upto[at[j]] - 1  # doubled are the digits an odd number of places before it
        check = np.where(last_digit % 2 == 0, sums[1][j] - sums[1][i], sums[0][j] - sums[0][i])
        card = (n_digits >= 16) & (n_digits <= 19) & (check % 10 == 0)
        n_dots, n_ats = np.minimum(dots[j] - dots[i], 6), np.minimum(ats[j] - ats[i], 2)
        n_mixed = np.minimum(mixed[j] - mixed[i], 3)
        width = np.minimum(end[e] - begin[i], 64)
        after = padded[j]
        beyond = np.where(after == LINE, LINE, padded[j + 1])
        out.append((i + base, np.full(len(i), length), np.stack([
            bucket(0, shape[i]),
            bucket(1, joined(np.minimum(n_digits, 24), has_letters)),
            bucket(2, signs[i] * np.uint64(2) + has_letters.astype(np.uint64)),
            bucket(3, joined(n_dots, n_ats, is_address)),
            bucket(4, joined(before[i], kind[i], kind[e], after)),
            bucket(5, joined(kind[e], after, beyond)),
            bucket(6, joined(card, is_address, kind[i] == PLUS, has_letters)),
            bucket(7, joined(np.full(len(i), length))),
            bucket(8, joined(n_mixed, width // 4, np.full(len(i), length == 1))),
        ], axis=1)))
    if not out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, FEATURES), dtype=np.int64)
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


@dataclass
class SemiCrf:
    """Weights of segments by feature and kind, of outside tokens by kind of token, and of adjacent labels.

    Label 0 is outside (one token a segment), the others are FIELD_KINDS. A labelling's score is the sum over
    its segments, so the best one is found, and all are summed, by dynamic programming over segment ends.
    """

    segment: np.ndarray
    outside: np.ndarray
    adjacent: np.ndarray

    @staticmethod
    def zeros() -> "SemiCrf":
        labels = len(FIELD_KINDS) + 1
        return SemiCrf(np.zeros((HASHED, labels - 1)), np.zeros(SIGN + 2), np.zeros((labels, labels)))

    @staticmethod
    def classes(tokens: Tokens) -> np.ndarray:
        return np.where(tokens.kind == AT, SIGN + 1, np.minimum(tokens.kind, SIGN))

    def ending(self, tokens: Tokens, outside: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores by (last token - low, LONGEST - length, kind), minus infinity where no candidate is, and where any is.

        A candidate is left out if any labelling gains by calling its tokens outside instead, whatever the labels
        beside it.
        """
        first, length, ids = segments(tokens, low, high)
        found, last = self.segment[ids].sum(1), first + length - 1
        upto = np.concatenate([[0.0], outside[max(0, low - LONGEST) : high].cumsum()])
        alone = upto[last + 1 - max(0, low - LONGEST)] - upto[first - max(0, low - LONGEST)] + (length - 1) * self.adjacent[0, 0]
        gain = (self.adjacent[:, 1:] - self.adjacent[:, :1]).max(0) + (self.adjacent[1:] - self.adjacent[0]).max(1)
        found[found + gain < alone[:, None] - 1e-6] = -np.inf
        kept = np.isfinite(found).any(1)
        scores, ends = np.full((high - low, LONGEST, len(FIELD_KINDS)), -np.inf), np.zeros(high - low, dtype=bool)
        scores[last[kept] - low, LONGEST - length[kept]] = found[kept]
        ends[last[kept] - low] = True
        return scores, ends

    def decode(self, tokens: Tokens) -> list[tuple[int, int, int]]:
        """The best segmentation's entities as (kind number, first token, token after the last)."""
        n, labels = len(tokens), len(FIELD_KINDS) + 1
        each = self.outside[self.classes(tokens)]
        outside = each.tolist()
        # best score of a segmentation of the tokens before a place, before a segment with a label; LONGEST rows of padding
        reach = np.full((LONGEST + n + 1, labels), -np.inf)
        came = np.zeros((n + 1, labels), dtype=np.int8)  # label of the segment before the place, for each next label
        taken = np.zeros((n + 1, labels - 1), dtype=np.int8)  # LONGEST less the length of the best segment of each kind that ends there
        reach[LONGEST] = self.adjacent[0]
        best = np.full(labels, -np.inf)
        best[0] = 0
        kinds, turned = best[1:], np.ascontiguousarray(self.adjacent.T)
        for low in range(0, n, TOKENS):
            high = min(n, low + TOKENS)
            scores, ends = self.ending(tokens, each, low, high)
            for p, some in zip(range(low + 1, high + 1), ends.tolist(), strict=True):
                row = LONGEST + p
                stay = reach[row - 1, 0] + outside[p - 1]
                if not some:
                    reach[row] = stay + self.adjacent[0]
                    best[0], best[1:] = stay, -np.inf
                    continue
                found = scores[p - 1 - low] + reach[p:row, 1:]
                at = found.argmax(0)
                taken[p] = at
                best[0] = stay
                np.maximum.reduce(found, 0, out=kinds)
                step = turned + best
                came[p] = step.argmax(1)
                np.maximum.reduce(step, 1, out=reach[row])
        out, p, y = [], n, int(best.argmax())
        while p:
            i = p - LONGEST + int(taken[p, y - 1]) if y else p - 1
            if y:
                out.append((y - 1, i, p))
            p, y = i, int(came[i, y])
        return out[::-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    most[most == -np.inf] = 0
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


@np.errstate(divide="ignore")
def gradient(model: SemiCrf, examples: list["Example"]) -> SemiCrf:
    """Gradient of the log-likelihood of the gold segmentations, by forward and backward sums over all examples at once."""
    size, n, labels = len(examples), max(x.n for x in examples), len(FIELD_KINDS) + 1
    lengths = np.array([x.n for x in examples])
    row = np.repeat(np.arange(size), [len(x.first) for x in examples])
    first, length, ids, observed = (np.concatenate([getattr(x, f) for x in examples]) for f in ("first", "length", "ids", "observed"))
    segment, last = model.segment[ids].sum(1), first + length
    outside = np.zeros((size, n))
    for x, values in zip(examples, outside, strict=True):
        values[: x.n] = model.outside[x.classes]
    by_last = np.full((n + 1, size, LONGEST, labels - 1), -np.inf)
    by_first = np.full((n + LONGEST + 1, size, LONGEST, labels - 1), -np.inf)
    by_last[last, row, LONGEST - length], by_first[first, row, length - 1] = segment, segment
    fore = np.full((n + 1, size, labels), -np.inf)
    into = np.full((LONGEST + n + 1, size, labels), -np.inf)  # LONGEST rows of padding
    fore[0, :, 0] = 0
    for p in range(n + 1):
        if p:
            fore[p, :, 0] = into[LONGEST + p - 1, :, 0] + outside[:, p - 1]
            fore[p, :, 1:] = log_sum(into[p : p + LONGEST, :, 1:].swapaxes(0, 1) + by_last[p], 1)
        into[LONGEST + p] = log_sum(fore[p][:, :, None] + model.adjacent, 1)
    back = np.full((n + LONGEST + 1, size, labels), -np.inf)  # sums over what may follow a segment with this label
    out_of = np.full((n + 1, size, labels), -np.inf)  # the same, from a segment with this label that starts here
    for p in range(n, -1, -1):
        if p < n:
            out_of[p, :, 0] = outside[:, p] + back[p + 1, :, 0]
            out_of[p, :, 1:] = log_sum(by_first[p] + back[p + 1 : p + LONGEST + 1, :, 1:].swapaxes(0, 1), 1)
            back[p] = log_sum(model.adjacent + out_of[p][:, None, :], 2)
        back[p, lengths == p] = 0
        out_of[p, lengths <= p] = -np.inf
        back[p, lengths < p] = -np.inf
    norm = log_sum(fore[lengths, np.arange(size)], 1)
    expected = np.exp(fore[:n, :, :, None] + model.adjacent + out_of[:n, :, None, :] - norm[:, None, None]).sum((0, 1))
    share = np.exp(into[LONGEST + first, row, 1:] + segment + back[last, row, 1:] - norm[row, None])
    change = SemiCrf.zeros()
    for f in range(FEATURES):
        for k in range(labels - 1):
            change.segment[:, k] += np.bincount(ids[:, f], observed[:, k] - share[:, k], HASHED)
    for r, x in enumerate(examples):
        alone = np.exp(into[LONGEST : LONGEST + x.n, r, 0] + outside[r, : x.n] + back[1 : x.n + 1, r, 0] - norm[r])
        change.outside += np.bincount(x.classes, ~x.covered - alone, SIGN + 2)
    change.adjacent = sum(x.steps for x in examples) - expected
    return change


class Example:
    """A labelled stretch of text: its candidate segments and which of them are entities."""

    def __init__(self, text: str, spans: list[Span]):
        tokens = Tokens(f"{text}\n")
        self.n, self.classes = len(tokens), SemiCrf.classes(tokens)
        self.first, self.length, self.ids = segments(tokens, 0, self.n)
        last = self.first + self.length
        starts = {a: i for i, a in enumerate(tokens.start.tolist())}
        ends = {b: i + 1 for i, b in enumerate(tokens.end.tolist())}
        number = {k: s for s, k in enumerate(zip(self.first.tolist(), last.tolist(), strict=True))}
        self.observed = np.zeros((len(self.first), len(FIELD_KINDS)))
        self.covered, gold, done = np.zeros(self.n, dtype=bool), {}, 0
        for kind, a, b in sorted(spans, key=lambda s: s[1]):  # of overlapping ones the first
            i, j = starts.get(a), ends.get(b)
            if (i, j) in number and i >= done:
                self.observed[number[i, j], kind] = 1
                self.covered[i:j] = True
                gold[i], done = (j, kind + 1), j
        labels = len(FIELD_KINDS) + 1
        self.steps, p, y = np.zeros((labels, labels)), 0, 0
        while p < self.n:
            p, following = gold.get(p, (p + 1, 0))
            self.steps[y, following] += 1
            y = following


def known_spans(text: str) -> list[Span]:
    """Base matches, and the values of secrets that are plainly named."""
    return base_spans(text) + [(4, m.start(1), m.end(1)) for m in NAMED_SECRET.finditer(text)]


def variants(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """A labelled stretch, and the same with its first entity that has one in another common spelling."""
    yield text, spans
    for kind, a, b in spans:
        old = text[a:b]
        new = {
            2: ".".join(old[i : i + 4] for i in range(0, len(old), 4)),
            3: old[old.find("(") :] if "(" in old else old[1:],
            4: old.swapcase()[: max(MIXED_RUN, len(old) * 3 // 5)],
        }
        if kind in new and new[kind] != old:
            yield text[:a] + new[kind] + text[b:], [(kind, a, a + len(new[kind]))]
            return


def fit(docs: DataFrame) -> SemiCrf:
    """A field fitted to (id, text) rows: base matches and named secrets are the labels, all else is outside.

    At most FIT_DOCS different rows that hold a digit or an at sign are used, those whose hashes are lowest, and of
    each the first FIT_CHARS characters of FIT_ISLANDS islands, so what the driver gets is bounded however often ids or
    rows repeat; entities are also shown in spellings that the base patterns miss. Without such rows the field adds nothing.
    """
    keyed = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("id", "text").alias("hash"), "text")
    few = F.broadcast(lowest(keyed, "hash", FIT_DOCS))

    @F.pandas_udf("array<string>")
    def stretches(texts: pd.Series) -> pd.Series:
        take = lambda t: [t[a : min(b, a + FIT_CHARS)] for (a, b), _ in zip(islands(t), range(FIT_ISLANDS), strict=False)]
        return texts.map(take)

    rows = keyed.join(few, "hash").select("hash", stretches("text").alias("stretches"))
    found = rows.groupBy("hash").agg(F.min("stretches").alias("stretches")).toPandas()  # a repeated row counts once
    texts = [t for some in found.sort_values("hash")["stretches"] for t in some]
    return fit_examples(list(dict.fromkeys(texts)))


def fit_examples(stretches: list[str], epochs: int = 10, batch: int = 32, rate: float = 0.3) -> SemiCrf:
    """Gradient steps over batches of stretches of like length, each weight with a rate of its own that falls (Adagrad)."""
    model, squares = SemiCrf.zeros(), SemiCrf.zeros()
    model.outside[:] = 1.0
    examples = [Example(t, s) for text in stretches for t, s in variants(text, known_spans(text))]
    examples = sorted((x for x in examples if len(x.first)), key=lambda x: x.n)
    batches = [examples[i : i + batch] for i in range(0, len(examples), batch)]
    order = np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(batches)):
            change = gradient(model, batches[i])
            for part in ("segment", "outside", "adjacent"):
                g, total, weights = (getattr(x, part) for x in (change, squares, model))
                total += g * g
                weights += rate * g / np.sqrt(total + 1e-8)
    return model


def clear_of(spans: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> list[Span]:
    """Those of spans, by start, that touch none of the taken ranges."""
    order = sorted(taken)
    begins = np.array([a for a, _ in order], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in order], dtype=np.int64)) if order else begins
    out = []
    for kind, a, b in spans:
        before = int(np.searchsorted(begins, b))  # ranges that begin before the span ends
        if not before or reach[before - 1] <= a:
            out.append((kind, a, b))
    return out


def find(text: str | None, model: SemiCrf | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, by kind and start; added spans never touch base ones."""
    return find_all([text], model)[0]


def find_all(texts: list[str | None], model: SemiCrf | None) -> list[tuple[list[Span], list[Span]]]:
    """find() of each text. Islands of several texts are decoded as lines of one, which entities never cross."""
    base = [sorted(base_spans(t)) if t and ANCHOR.search(t) else [] for t in texts]
    added: list[list[Span]] = [[] for _ in texts]

    def decode(held: list[tuple[int, int, int]]) -> None:
        text = "".join(f"{texts[n][a:b]}\n" for n, a, b in held)
        begins = np.concatenate([[0], np.cumsum([b - a + 1 for _, a, b in held])])
        tokens = Tokens(text)
        for kind, i, j in model.decode(tokens):
            first, last = int(tokens.start[i]), int(tokens.end[j - 1])
            at = int(np.searchsorted(begins, first, side="right")) - 1
            n, a, _ = held[at]
            added[n].append((kind, first - int(begins[at]) + a, last - int(begins[at]) + a))

    if model is not None:
        held, size = [], 0
        for n, t in enumerate(texts):
            for a, b in islands(t) if t else ():
                held.append((n, a, b))
                size += b - a
                if size >= CHARS:
                    decode(held)
                    held, size = [], 0
        if held:
            decode(held)
    return [(b, sorted(b + clear_of(more, [(x, y) for _, x, y in b]))) for b, more in zip(base, added, strict=True)]


def named(spans: list[Span]) -> list[tuple[str, int, int]]:
    return [(FIELD_KINDS[k], a, b) for k, a, b in spans]


SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a struct column `pii`: base and spans, arrays of (kind, start, end) in code points.

    spans holds the base spans and what the field adds, which may be of the further kind "secret". Every text is read whole; null and empty texts have
    no spans. Rows are independent, so repeated rows give repeated results, and other columns pass through
    (one named `pii` is replaced). An empty table gives an empty result.
    """
    model = fit(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(f"base {SPANS}, spans {SPANS}")
    def udf(texts: pd.Series) -> pd.DataFrame:
        found = find_all(texts.tolist(), shared.value)
        as_rows = lambda n: [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in named(f[n])] for f in found]
        return pd.DataFrame({"base": pd.Series(as_rows(0), dtype=object), "spans": pd.Series(as_rows(1), dtype=object)})

    return docs.withColumn("pii", udf(F.col(f"`{text_col}`")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of their texts replaced by its kind in angle brackets; overlaps become one mark."""
    model = fit(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None, spans: list[Span]) -> str | None:
        out, done = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"<{FIELD_KINDS[kind]}>"]
            done = max(done, b)
        return "".join([*out, text[done:]]) if out else text

    @F.pandas_udf("string")
    def udf(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        return pd.Series([clean(t, found[1]) for t, found in zip(values, find_all(values, shared.value), strict=True)], dtype=object)

    return docs.withColumn(text_col, udf(F.col(f"`{text_col}`")))
