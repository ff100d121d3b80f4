"""The similarity join against all pairs, with copies, chains, tiny sets and families cut into blocks."""

import re

import numpy as np
import pytest

from halyard.llm import jaccard_join, shingles, signature_tree
from halyard.llm.components import components
from halyard.sources import scratch
from tests.llm.frames import no_documents, odd_documents

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def set_of(text, width):
    words = re.findall(SPACE, (text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(texts, width, num, den):
    """Smallest id reachable, comparing all pairs."""
    sets = {i: set_of(t, width) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def planted(seed=0):
    """Texts, near copies of many degrees, chains of edits, shared passages, and sets of a few words."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    passage = rng.choice(vocabulary, 60).tolist()
    texts, i = {}, 0
    for size in (1, 2, 3, 4, 5, 6, 9, 10, 11, 12, 13, 20, 30, 60, 150, 400):
        for _ in range(3):
            words = rng.choice(vocabulary, size).tolist()
            chain = list(words)
            for edits in (0, 0, 1, 1, 2, 3, 6, 12):
                chain = list(chain)
                for _ in range(min(edits, len(chain) // 4)):
                    chain[rng.integers(len(chain))] = "new" + str(rng.integers(9999))
                texts[i] = " ".join(chain).upper() if i % 5 == 0 else "  ".join(chain)
                i += 1
            texts[i] = " ".join(words[: size // 2] + passage + words[size // 2 :])
            texts[i + 1] = " ".join(words + ["tail"] * (size % 3))
            i += 2
    return texts


@pytest.mark.parametrize("width,num,den,block", [(3, 90, 100, 1 << 20), (5, 80, 100, 1 << 20), (3, 90, 100, 300), (1, 80, 100, 500)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, width, num, den, block):
    plain = jaccard_join.links
    monkeypatch.setattr(jaccard_join, "links", lambda *given: plain(*given, block_members=block))
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs, "doc_id", "text", width, num, den).collect()}
    assert got == brute(texts, width, num, den)


@pytest.mark.parametrize("width,num,den,block", [(3, 90, 100, 1 << 20), (5, 80, 100, 300)])
def test_links_are_counted_whole(spark, monkeypatch, width, num, den, block):
    """Groups of three and more different similar texts, exact copies, a repeated row, an id of two texts."""
    plain = jaccard_join.links
    monkeypatch.setattr(jaccard_join, "links", lambda *given: plain(*given, block_members=block))
    rows = [*planted().items(), (0, planted()[0]), (0, planted()[340 % len(planted())])]
    docs = spark.createDataFrame([*rows, (None, rows[-1][1])], "doc_id long, text string").repartition(5)
    sets = [set_of(t, width) for _, t in rows]
    near = lambda a, b: den * len(a & b) >= num * len(a | b)
    want = [(i, sum(k != m and bool(s) and bool(o) and near(s, o) for m, o in enumerate(sets))) for k, ((i, _), s) in enumerate(zip(rows, sets))]
    want.append((None, sum(near(sets[-1], o) for o in sets)))
    got = [(r.id, r.n_links) for r in jaccard_join.linked(docs, "doc_id", "text", width, num, den, True).collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert max(n for _, n in want) > 3


@pytest.mark.parametrize("sides", [1, 2])
def test_pairs_are_all_pairs(sides):
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 1 << 62, 60, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.append(base[k % 6][k % 7 :], rng.integers(0, 1 << 62, k % 4, dtype=np.uint64))) for k in range(150)]
    side = np.arange(len(sets)) % sides
    want = {
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if (sides == 1 or side[i] != side[j]) and signature_tree.similar(sets[i], sets[j], 85, 100)
    }
    found = [(max(p), min(p)) for x, y in signature_tree.pairs(sets, side, 85, 100) for p in zip(x.tolist(), y.tolist())]
    assert set(found) == want and len(found) == len(want)


def test_odd_rows(spark):
    rows = jaccard_join.linked(odd_documents(spark), "doc_id", "text", 3, 90, 100).collect()
    assert len(rows) == 11
    got = {r.id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (7, 1) and got[2] == (7, 1) and [r.id for r in rows].count(2) == 2
    assert got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5)
    assert got[7] == (1, 7) and got[9] == (1, 9) and got[6][0] == 6
    assert got[None][1] is None and got[None][0] == 6
    assert jaccard_join.linked(no_documents(spark), "doc_id", "text", 3, 90, 100).count() == 0


def test_hashed_sets_have_the_right_size():
    texts = ["", "one", "a b", "A b  c\nd", "a b c a b c a b c", "x" * 5000 + " y z", " lead and trail "]
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for width in (1, 3, 5):
        found = shingles.sets(np.frombuffer(data, np.uint8), offsets, width)
        assert [len(s) for s in found] == [len(set_of(t, width)) for t in texts]
    one, other = (shingles.sets(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3)[0] for t in (b"A B C D", b"a b\tc  d"))
    assert (one == other).all()


def test_linked_sets_share_a_cell():
    """The pigeonhole: whatever members differ, some filled cell is the same in both."""
    rng = np.random.default_rng(4)
    for num, den in ((90, 100), (80, 100)):
        plan = jaccard_join.bands(num, den)
        for size in (4, 5, 9, 10, 17, 19, 40, 95, 180, 700):
            for _ in range(60):
                a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                drop, add = rng.integers(0, size // 4 + 1), rng.integers(0, size // 4 + 1)
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
                a = np.unique(a)
                shared = np.intersect1d(a, b)
                if signature_tree.similar(a, b, num, den) and len(np.setxor1d(a, b)):
                    for frequent in (shared[:0], shared[: len(shared) // 2], shared, np.union1d(a, b)):
                        assert set(jaccard_join.cells(a, plan, frequent)) & set(jaccard_join.cells(b, plan, frequent))


@pytest.mark.parametrize("sides", [1, 2])
def test_forest_connects_what_all_pairs_connect(sides):
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, rng.integers(10, 80), dtype=np.uint64)
        for drop in range(6):
            sets.append(np.unique(base[drop:] if drop % 2 else np.append(base, rng.integers(0, 1 << 62, drop, dtype=np.uint64))))
    side = np.arange(len(sets)) % sides
    found = signature_tree.forest(sets, side, 85, 100)
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if (sides == 1 or side[i] != side[j]) and signature_tree.similar(sets[i], sets[j], 85, 100)
    ]

    def groups(pairs):
        label = list(range(len(sets)))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return [label.index(x) for x in label]

    assert groups(found) == groups(links)
    assert len(found) == len(set(range(len(sets)))) - len(set(groups(links)))
    assert all(signature_tree.similar(sets[i], sets[j], 85, 100) for i, j in found)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_texts_go_to_their_blocks_in_passes(spark):
    """A family of many blocks: a share of the pairs at a time finds the links of all at once, and leaves no table of texts."""
    texts = [" ".join(f"w{i}" for i in range(n, n + 40 + n % 7)) for n in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sized = jaccard_join.sketches(docs, "doc_id", "text", 1).selectExpr("id as node", "7L as family", "n", "key1", "key2")
    for want in ("pairs", "forest"):
        found = [
            jaccard_join.links(docs, "doc_id", "text", 1, 80, 100, sized, want, block_members=300, pass_members=most)
            for most in (1 << 24, 200)
        ]
        # a set is compared in several blocks: an edge may come more than once
        whole, shares = [{tuple(sorted(r)) for r in f.collect()} for f in found]
        assert len(whole) > 60 if want == "pairs" else whole
        assert whole == shares
    assert len(found[1].inputFiles()) > 1  # written a pass at a time
    assert not [path for _, path in scratch._written if "shingle-texts" in path]


def test_texts_that_share_a_sentence_are_no_family(spark):
    """Each text shares a run of words with the next: one chain of shared cells, but only the copies among them can link."""
    rng = np.random.default_rng(5)
    runs = [rng.choice([f"r{i}" for i in range(5000)], 9).tolist() for _ in range(81)]
    texts = {}
    for i in range(80):
        body = [f"b{i}x{k}" for k in range(40 + i % 5)]
        texts[i] = " ".join([*runs[i], *body, *runs[i + 1]])
    for i in (7, 8, 40):
        texts[100 + i] = texts[i].replace(f"b{i}x20", "other")
        texts[200 + i] = texts[i].replace(f"b{i}x30", "another")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    family = jaccard_join.families(docs, "text", 5, 80, 100, np.zeros(0, np.uint64))
    assert family.count() <= 20
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs, "doc_id", "text", 5, 80, 100).collect()}
    assert got == brute(texts, 5, 80, 100)


def test_linked_sets_share_the_least_of_cells_that_each_names():
    rng = np.random.default_rng(9)
    for num in (80, 90):
        plan = jaccard_join.bands(num, 100)
        for size in (20, 41, 90, 300, 777):
            members = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
            for drop in range(0, size // 9, 2):
                other = np.unique(np.concatenate([members[drop:], rng.integers(0, 2**63, drop // 3, dtype=np.int64).astype(np.uint64)]))
                if not signature_tree.similar(members, other, num, 100):
                    continue
                a, b = jaccard_join.cell_parts(members, plan), jaccard_join.cell_parts(other, plan)
                common = {x[1] for x in a} & {x[1] for x in b}
                assert common or not plan.differ(size) or not plan.differ(len(other))
                for band in common:
                    (mine, _, least), (theirs, _, least_of_other) = next(x for x in a if x[1] == band), next(x for x in b if x[1] == band)
                    if least > 1 and least_of_other > 1:
                        assert len(set(mine.tolist()) & set(theirs.tolist())) >= max(least, least_of_other)
