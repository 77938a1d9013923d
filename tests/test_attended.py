import numpy as np
import pytest

from corpusloom.operators import attended, attention

HEADS, DIM = 2, 3
SCHEMA = "seq string, pos long, q array<double>, k array<double>, v array<double>, i array<double>, y string, qblock int"


def sequences():
    rng = np.random.default_rng(51)
    rows = []
    for seq, n in (("a", 23), ("b", 1), (None, 9), ("c", 40)):
        for pos in range(n):
            rows.append((seq, pos, *(rng.normal(size=HEADS * DIM).tolist() for _ in range(3)), rng.normal(size=HEADS).tolist()))
    rows.append(("a", 5, *rows[2][2:]))  # a position that is there twice
    rows.append(("c", 41, *rows[3][2:]))  # after a gap
    return rows


def frame(spark, rows):
    odd = [("a", None, *rows[0][2:]), ("a", 3, None, None, *rows[0][4:])] if rows else []
    return spark.createDataFrame([(*r, "x", 1) for r in rows + odd], SCHEMA)


def by_head(x):
    return np.array(x).reshape(HEADS, DIM)


def softmax_sum(pairs, sink):
    """Of (score, value): the values weighted by the softmax."""
    if not pairs:
        return np.zeros(DIM)
    below = sum(np.exp(s) for s, _ in pairs) + (0 if sink is None else np.exp(sink))
    return sum(np.exp(s) * v for s, v in pairs) / below


def plainly(rows, seen, scale, sink):
    out = []
    for seq, pos, q, *_ in rows:
        y = []
        for h in range(HEADS):
            keys = [r for r in rows if r[0] == seq and seen(pos, r[1])]
            y.append(softmax_sum([(scale * by_head(q)[h] @ by_head(r[3])[h], by_head(r[4])[h]) for r in keys], sink))
        out.append((seq, pos, np.concatenate(y)))
    return out


def same(got, want):
    order = lambda r: (str(r[0]), r[1], tuple(np.round(r[2], 6)))
    got, want = sorted(((r[0], r[1], np.array(r[2])) for r in got), key=order), sorted(want, key=order)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert np.allclose(a[2], b[2], atol=1e-9), (a, b)


@pytest.mark.parametrize("size", [1, 4, 256])
def test_outputs_are_those_of_a_plain_version(spark, size):
    rows = sequences()
    some = frame(spark, rows)
    forms = [
        (dict(), lambda q, k: k <= q, None),
        (dict(sink=0.7), lambda q, k: k <= q, 0.7),
        (dict(behind=0, ahead=5), lambda q, k: q <= k <= q + 5, None),
        (dict(behind=6, ahead=2, sink=-1.0), lambda q, k: q - 6 <= k <= q + 2, -1.0),
    ]
    for how, seen, sink in forms:
        got = attended.attention(some, ["seq"], "pos", "q", "k", "v", heads=HEADS, scale=0.5, size=size, **how)
        assert got.columns == ["seq", "pos", "y"]
        same(got.collect(), plainly(rows, seen, 0.5, sink))


WEIGHTS = (0.3, -0.2, 0.9)


def blocks_of(rows, block):
    """Mean key and value by head of each whole block of a sequence."""
    out = {}
    for seq in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == seq]
        for b in {r[1] // block for r in mine}:
            held = [r for r in mine if r[1] // block == b]
            if len(held) == block:
                out[seq, b] = tuple(np.mean([by_head(r[c]) for r in held], 0) for c in (3, 4))
    return out


def chosen(rows, block, top, scale, indexed):
    """(row number, head) -> [(block, score)]."""
    means, out = blocks_of(rows, block), {}
    for n, (seq, pos, q, _, _, i) in enumerate(rows):
        before = {b: m for (s, b), m in means.items() if s == seq and b < pos // block}
        real = {b: [round(scale * by_head(q)[h] @ m[0][h], 4) for h in range(HEADS)] for b, m in before.items()}
        index = {b: round(sum(i[h] * (m[0][h] @ np.array(WEIGHTS) + 0.1) for h in range(HEADS)), 4) for b, m in before.items()}
        for h in range(HEADS):
            rank = {b: index[b] if indexed else real[b][h] for b in before}
            least = sorted(rank.values(), reverse=True)[: top][-1:] or [0]
            out[n, h] = [(b, real[b][h]) for b in before if rank[b] >= least[0]]
    return out, means


@pytest.mark.parametrize("size", [1, 4, 256])
@pytest.mark.parametrize("indexed", [False, True])
def test_sparse_attention_is_that_of_a_plain_version(spark, size, indexed):
    rows = [r for r in sequences() if not (r[0] == "a" and r[1] == 5)]
    index = attended.Index("i", WEIGHTS, 0.1) if indexed else None
    how = dict(top=2, block=4, heads=HEADS, scale=0.5, digits=4, index=index, size=size)
    picked, means = chosen(rows, 4, 2, 0.5, indexed)
    got = attended.chosen_blocks(frame(spark, rows), ["seq"], "pos", "q", "k", sink=0.2, **how).collect()
    want = {(rows[n][0], rows[n][1], h, b): np.exp(s) / (np.exp(0.2) + sum(np.exp(x) for _, x in some)) for (n, h), some in picked.items() for b, s in some}
    assert {(r.seq, r.q, r["head"], r.k) for r in got} == set(want)
    assert all(abs(r.weight - want[r.seq, r.q, r["head"], r.k]) < 1e-9 for r in got)
    near = plainly(rows, lambda q, k: q <= k <= q + 3, 0.5, 0.2)
    far = [np.concatenate([softmax_sum([(s, means[r[0], b][1][h]) for b, s in picked[n, h]], 0.2) for h in range(HEADS)]) for n, r in enumerate(rows)]
    assert all(not far[n].any() for n, r in enumerate(rows) if r[1] < 4)  # the first block has the window only
    got = attended.sparse_attention(frame(spark, rows), ["seq"], "pos", "q", "k", "v", window=3, sink=0.2, **how)
    same(got.collect(), [(s, p, y + f) for (s, p, y), f in zip(near, far, strict=True)])


@pytest.mark.parametrize("size", [2, 256])
def test_divergence_is_that_of_a_plain_version(spark, size):
    rows = [r for r in sequences() if not (r[0] == "a" and r[1] == 5)]
    means, apart = blocks_of(rows, 4), {}
    for seq, pos, q, _, _, i in rows:
        before = [m for (s, b), m in means.items() if s == seq and b < pos // 4]
        if before:
            a = np.array([sum(i[h] * (m[0][h] @ np.array(WEIGHTS) + 0.1) for h in range(HEADS)) for m in before])
            b = np.array([np.mean([0.5 * by_head(q)[h] @ m[0][h] for h in range(HEADS)]) for m in before])
            p, t = (np.exp(x) / np.exp(x).sum() for x in (a, b))
            apart.setdefault(seq, []).append((p * np.log(p / t)).sum())
    got = attended.index_divergence(frame(spark, rows), ["seq"], "pos", "q", "k", attended.Index("i", WEIGHTS, 0.1), block=4, heads=HEADS, scale=0.5, size=size)
    found = {r.seq: (r.n, r.divergence) for r in got.collect() if r.n}
    assert found.keys() == apart.keys()
    assert all(found[s][0] == len(x) and abs(found[s][1] - np.mean(x)) < 1e-9 for s, x in apart.items())


def test_states_merge_in_any_order():
    rng = np.random.default_rng(52)
    scores, values = rng.normal(size=(5, HEADS, 9)) * 300, rng.normal(size=(9, HEADS, DIM))
    scores[0], scores[1, :, :6] = -np.inf, -np.inf
    whole = attended.State.of(scores, values)
    parts = [attended.State.of(scores[:, :, c], values[c]) for c in (slice(0, 2), slice(2, 6), slice(6, 9))]
    for a, b, c in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        for sink in (None, 2.0):
            left = parts[a].merge(parts[b]).merge(parts[c])
            right = parts[a].merge(parts[b].merge(parts[c]))
            assert np.allclose(left.output(sink), whole.output(sink)) and np.allclose(right.output(sink), whole.output(sink))
    assert not whole.output()[0].any() and not whole.output(1.0)[0].any()


def test_a_cell_holds_two_blocks_only(spark):
    """Whatever a sequence's length, no row of the plan holds more than `size` positions of queries or keys."""
    rows = [("s", p, [float(p % 7), 1.0], [1.0, 0.5], [1.0, 2.0]) for p in range(500)]
    some = spark.createDataFrame(rows, "seq string, pos long, q array<double>, k array<double>, v array<double>")
    blocks = attended.packed(some, ["seq"], "pos", {"q": "q"}, 16, "q")
    assert max(len(r.qpos) for r in blocks.collect()) == 16 and blocks.count() == 32
    assert attended.attention(some, ["seq"], "pos", "q", "k", "v", size=16).count() == 500


def test_causal_pairs_at_every_bucket_size(spark):
    rows = [("a", p, [float(p), 1.0]) for p in range(30)] + [("b", p, [1.0, float(p)]) for p in (0, 7, 8, 500)]
    some = spark.createDataFrame(rows, "seq string, pos long, x array<double>")
    want = {(s, p, t): sum(u * w for u, w in zip(x, y, strict=True)) for s, p, x in rows for r, t, y in rows if r == s and t <= p}
    for size in (1, 8, 256):
        got = attention.causal_pairs(some, ["seq"], "pos", "x", size).collect()
        assert {(r.seq, r.q, r.k): r.score for r in got} == want and len(got) == len(want)


def test_empty(spark):
    none = frame(spark, [])
    index = attended.Index("i", WEIGHTS)
    assert attended.attention(none, ["seq"], "pos", "q", "k", "v", heads=HEADS).count() == 0
    assert attended.sparse_attention(none, ["seq"], "pos", "q", "k", "v", top=2, block=4, window=3, heads=HEADS, index=index).count() == 0
    assert attended.chosen_blocks(none, ["seq"], "pos", "q", "k", top=2, block=4, heads=HEADS).count() == 0
    assert attended.index_divergence(none, ["seq"], "pos", "q", "k", index, block=4, heads=HEADS).count() == 0
