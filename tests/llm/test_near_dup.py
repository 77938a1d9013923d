import random
import re
from collections import Counter

import numpy as np

from corpusloom.llm import near_dup
from corpusloom.llm.components import connected_components

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def grams(text):
    w = WORD.findall((text or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(docs, similarity=0.8):
    sets = [(i, grams(t)) for i, t in docs]
    links, parent = Counter(), list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y in range(x):
            j, b = sets[y]
            if i is not None and j is not None and a and b and len(a & b) >= similarity * len(a | b):
                links[x] += 1
                links[y] += 1
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted(((i, least.get(root(x)), links[x]) for x, (i, _) in enumerate(sets)), key=repr)


def corpus():
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(random.choices(words, k=random.randint(1, 80)))) for i in range(150)]
    for i in range(150, 330):  # near copies, a large group among them
        of = docs[0 if i < 250 else random.randrange(150)][1].split()
        for _ in range(random.randint(0, 4)):
            of[random.randrange(len(of))] = random.choice(words)
        docs.append((i, " ".join(of)))
    docs += [(400, None), (401, ""), (402, "!!! ..."), (None, docs[0][1]), (403, docs[0][1].upper()), (404, "a b"), (405, "A  b!"), (404, "a b")]
    return docs


def test_join_is_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, set_key int, path string")
    for block in (1024, 16):  # 16: the large group is dealt out in cells
        got = near_dup.ngram_join(frame, block=block).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute(docs)


def test_drop_keeps_one_of_each(spark):
    docs = [d for d in corpus() if d[0] is not None]
    frame = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, _drop_id string")
    kept = near_dup.drop_near(frame)
    assert kept.columns == ["doc_id", "text", "_drop_id"]
    assert {r.doc_id for r in kept.collect()} == {i for i, c, _ in brute(docs) if i == c}


def test_empty(spark):
    assert near_dup.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_depth_reaches_recall():
    for recall in (0.9, 0.99, 0.9999):
        depth = near_dup.depth_for(0.8, recall)
        assert 1 - (1 - 0.8**depth) ** near_dup.TREES >= recall
        assert 1 - (1 - 0.8 ** (depth + 1)) ** near_dup.TREES < recall or depth == near_dup.DEPTH


def simulated(rng, n, similarity, trees, longest):
    """Lengths of the prefixes that each of n pairs shares in each tree."""
    return np.minimum(rng.geometric(1 - similarity, (n, trees)) - 1, longest)


def test_shortened_prefixes_keep_the_recall():
    """A set whose only relative is a partner at the threshold stops too early no more often than is allowed."""
    rng, n = np.random.default_rng(7), 400_000
    for recall in (0.99, 0.999):
        shortest, most = near_dup.stops(0.8, recall)
        shared = simulated(rng, n, 0.8, near_dup.TREES, near_dup.DEPTH)
        depth, open_ = np.full(n, shortest), np.ones(n, dtype=bool)
        for d in range(near_dup.DEPTH, shortest, -1):
            evidence = np.maximum(np.minimum(shared, d - 1) - 1, 0).sum(1)
            depth[open_ & (evidence <= most[d])] = d
            open_ &= evidence > most[d]
        found = (shared >= depth[:, None]).any(1).mean()
        assert found >= recall - 3 * ((1 - recall) / n) ** 0.5, (recall, found)
    assert all(near_dup.stops(0.8, near_dup.RECALL)[1][d] > 0 for d in (5, 6))


def test_shared_prefixes_are_those_with_any_other_set(spark):
    rng = random.Random(8)
    forest = near_dup.Forest(near_dup.DEPTH, 4)
    sets = [near_dup.shingles(" ".join(rng.choices("abcdefgh", k=30))) for _ in range(120)]
    paths = np.array([forest.paths(s) for s in sets])
    rows = [(i.to_bytes(16, "big"), bytearray(p.tobytes()), 8) for i, p in enumerate(paths)]
    frame = spark.createDataFrame(rows, "set_key binary, paths binary, bytes long")
    got = Counter((int.from_bytes(r.set_key, "big"), r.shared) for r in near_dup.shared_prefixes(frame, forest).collect())
    longest = lambda i, t: max(np.cumprod(paths[i, t] == paths[j, t]).sum() for j in range(len(sets)) if j != i)
    want = Counter((i, int(n)) for i in range(len(sets)) for t in range(4) if (n := longest(i, t)) > 1)
    more = got - want  # at the edges of tasks
    assert sum((want - got).values()) <= sum(more.values()) <= 16 and all(n == near_dup.DEPTH for _, n in more)


def test_sets_without_relatives_keep_whole_paths(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(300)]
    texts += [t.replace(t.split()[7], "other", 1) for t in texts[:20]]
    forest = near_dup.Forest()
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = near_dup.prefix_of_each(near_dup.sketches(docs, forest, 5), forest, 0.8, near_dup.RECALL).collect()
    related = {i for i in [*range(20), *range(300, 320)]}
    assert len(sets) == 320 and all((r.depth == 4) or r.id not in related for r in sets)
    assert sum(r.depth == near_dup.DEPTH for r in sets) > 250


def test_all_links_of_a_table_are_found(spark):
    """Every pair of different sets of sf0.1 that has one n-gram in common and fitting sizes is compared here."""
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").toPandas()
    found, ids = {}, {}
    for i, t in zip(texts["doc_id"], texts["text"], strict=True):
        s = near_dup.shingles(t)
        if len(s):
            found.setdefault(s.tobytes(), s)
            ids.setdefault(s.tobytes(), []).append(i)
    keys = sorted(found, key=lambda k: len(k))
    sets, copies = [found[k] for k in keys], np.array([len(ids[k]) for k in keys])
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    edges = np.flatnonzero(np.diff(flat[order], prepend=flat[order][0] ^ np.uint64(1), append=flat[order][-1] ^ np.uint64(1)))
    begin, number = edges[:-1], np.empty(len(flat), dtype=np.int64)
    number[order] = np.repeat(np.arange(len(begin)), np.diff(edges))
    ends, at = edges[1:], np.concatenate([[0], sizes.cumsum()])
    links = np.zeros(len(sets), dtype=np.int64)
    for x in range(len(sets)):
        lists = [owner[begin[g] : ends[g]] for g in number[at[x] : at[x + 1]] if ends[g] - begin[g] > 1]
        if lists:
            others, common = np.unique(np.concatenate(lists), return_counts=True)
            linked = (common >= 0.8 * (sizes[x] + sizes[others] - common)) & (others != x)
            links[x] = copies[others[linked]].sum()
    want = {i: int(links[n] + copies[n] - 1) for n, k in enumerate(keys) for i in ids[k]}
    got = {r.doc_id: r.n_links for r in near_dup.ngram_join(spark.createDataFrame(texts)).collect()}
    assert {i: n for i, n in got.items() if n or i in want} == want
    assert sum(want.values()) == 3956  # each link counts for both


def test_components(spark):
    random.seed(6)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
