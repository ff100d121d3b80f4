"""Ranked lexical search against plain counting."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from halyard.llm import lexical
from tests.llm.frames import no_documents, odd_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k):
    """{item: [(score, id)]} by the formula alone; an id may be null."""
    counted = [(i, Counter(TERM.findall((t or "").translate(SMALL)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    total = sum(sum(c.values()) for _, c in counted)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(SMALL)))
    out = {}
    for item, terms in asked.items():
        found = []
        for doc, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * len(counted)) // total
            score = 0
            for t in terms & c.keys():
                holding = sum(t in other for _, other in counted)
                w = math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * holding + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out[item] = [(-s, d) for s, _, _, d in sorted(found)[:k]]
    return {i: r for i, r in out.items() if r}


def ranked(spark, docs, items, k):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    out = {}
    for r in lexical.ranked(d, "doc_id", "text", q, "item_id", "text", k).collect():
        out.setdefault(r.item, []).append((r.rank, r.score, r.id))
    for rows in out.values():
        assert sorted(r[0] for r in rows) == list(range(1, len(rows) + 1))
    return {i: [(s, d) for _, s, d in sorted(rows)] for i, rows in out.items()}


def corpus(seed, documents, vocabulary, most):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.6)) % vocabulary}" for _ in range(5000)]
    return [(i, " ".join(draw.choices(words, k=draw.randint(0, most)))) for i in range(documents)]


@pytest.mark.parametrize("vocabulary", [12, 400])
def test_same_as_plain_counting(spark, vocabulary, monkeypatch):
    docs = corpus(1, 300, vocabulary, 60) + [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3"), (900, None), (901, "")]
    items = corpus(2, 25, vocabulary, 90) + [(3, "w5 w6"), (None, "w1 W2"), (88, None), (89, "?!")]
    assert ranked(spark, docs, items, 10) == plain(docs, items, 10)


def test_terms_are_split_and_folded_by_byte(spark):
    docs = [(1, "Été-Über ÉTÉ été"), (2, "don't STOP_now x2"), (3, "a\x00b\x7fc\n—dash—")]
    items = [(1, "été über"), (2, "STOP Now t"), (3, "b — —dash—")]
    assert ranked(spark, docs, items, 3) == plain(docs, items, 3)
    assert lexical.terms_of("A-b_C".encode()) == [b"a", b"b", b"c"]


def test_small_blocks_and_many_passes_change_nothing(spark, monkeypatch):
    docs, items = corpus(3, 120, 60, 40), corpus(4, 12, 60, 30)
    monkeypatch.setattr(lexical, "PASS_TERMS", 20)
    assert ranked(spark, docs, items, 4) == plain(docs, items, 4)


def test_masks_are_left_out_only_below_the_last_score():
    draw = np.random.default_rng(5)
    best, all_scores = lexical.Best(1, 5), []
    weights = draw.integers(0, 9000, 70)
    for block in range(6):
        docs = 64
        cells = draw.random((70, docs)) < 0.2
        term, doc = np.nonzero(cells)
        counts, lengths = draw.integers(1, 9, len(term)), draw.integers(10, 300, docs)
        made = lexical.Block(np.arange(docs) + 100 * block, lengths, term, doc, counts, weights)
        made.rank(0, list(range(70)), best)
        scores = np.zeros(docs, np.int64)
        np.add.at(scores, doc, weights[term] * ((10**9 * counts) // (1000 * counts + 8 * lengths[doc])))
        all_scores += list(zip((-scores).tolist(), (np.arange(docs) + 100 * block).tolist()))
    assert list(zip((-best.scores[0]).tolist(), best.ids[0].tolist())) == sorted(all_scores)[:5]


def test_masks_of_more_than_one_word_are_told_apart():
    bits = np.zeros((130, 4), np.uint8)
    bits[129, 1] = bits[0, 2] = bits[129, 3] = 1
    number, first = lexical._masks(bits)
    assert number[1] == number[3] and len({*number.tolist()}) == len(first) == 3


def test_odd_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "quick lazy x lorem")], "item_id long, text string")
    odd = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = lexical.ranked(odd, "doc_id", "text", items, "item_id", "text", 20).collect()
    assert [(r.score, r.id) for r in sorted(found, key=lambda r: r.rank)] == plain(rows, [(1, "quick lazy x lorem")], 20)[1]
    assert lexical.ranked(no_documents(spark), "doc_id", "text", items, "item_id", "text", 5).count() == 0
    assert lexical.ranked(odd, "doc_id", "text", items.limit(0), "item_id", "text", 5).count() == 0
