"""Packing and byte-level BPE against the libraries themselves."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from halyard.llm import merge_replay, packing
from tests.llm.frames import no_documents, odd_documents

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("capacity,shard_windows", [(4096, 64), (64, 4), (1, 1)])
def test_pieces_hold_every_id_once(spark, capacity, shard_windows):
    docs = odd_documents(spark)
    if capacity == 1:
        docs = docs.where("doc_id <= 5")
    rows = packing.pack(docs, "doc_id", "text", WORDS, 2, capacity=capacity, shard_windows=shard_windows).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    want = sorted(tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + (2,) for r in docs.collect())
    by_place = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    used = {}
    for r in by_place:  # offsets are gapless, no window is too full
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + len(r.ids) // 4
    assert max(used.values()) <= capacity
    got, waiting = [], {}
    for r in sorted(rows, key=lambda r: (str(r.id), r.doc_tokens, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        waiting.setdefault((r.id, r.doc_tokens), []).append((r.start, ids))
    for (_, n), pieces in waiting.items():
        copies = sum(len(ids) for _, ids in pieces) // n
        assert sum(len(ids) for _, ids in pieces) == copies * n
        at = {}
        for start, ids in pieces:
            at.setdefault(start, ids)
        whole, start = [], 0
        while start < n:
            whole += at[start]
            start = len(whole)
        got += [tuple(whole)] * copies
    assert sorted(got) == want


def test_names_of_added_tokens(spark):
    texts = ["<|endoftext|> a", "x<|startoftext|>", "<|endoftext|", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for literal in (False, True):
        tokenizer = Tokenizer.from_file(WORDS)
        tokenizer.encode_special_tokens = literal
        got = {r.id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.pack(docs, "doc_id", "text", WORDS, 2, literal=literal).collect()}
        assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
        assert (49407 in got[0]) != literal


def test_ids_of_all_plain_characters():
    import random

    tokenizer = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as f:
        own = packing.WordIds(f.read())
    draw = random.Random(1)
    characters = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xC0, 0x250)]]
    texts = ["".join(draw.choices(characters, k=draw.randint(0, 60))) for _ in range(3000)] + ["it's don't we'll I'd THEY'RE 'S 's", "ſ K İstanbul"]
    assert [np.frombuffer(i, "<u4").tolist() for i in own.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_store_that_is_too_small_changes_nothing(monkeypatch):
    with open(WORDS, encoding="utf-8") as f:
        file = f.read()
    texts = [f"word{i % 7} other{i} same thing" for i in range(300)]
    whole = packing.WordIds(file).encode(texts)
    monkeypatch.setattr(packing, "STORED_WORDS", 40)
    small = packing.WordIds(file)
    assert [small.encode(texts[i : i + 10]) for i in range(0, 300, 10)] == [whole[i : i + 10] for i in range(0, 300, 10)]


def test_padding_does_not_grow_with_the_splits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartitionByRange(1000, "doc_id")
    pieces = packing.pack(docs, "doc_id", "text", WORDS, 2).select("sequence_id", (F.octet_length("ids") / 4).alias("n"))
    tokens, windows = pieces.agg(F.sum("n"), F.count_distinct("sequence_id")).first()
    assert 1 - tokens / (4096 * windows) < 0.02


def test_packing_an_empty_table(spark):
    assert packing.pack(no_documents(spark), "doc_id", "text", WORDS, 2).count() == 0


def test_differencing_balances():
    sizes = [8, 7, 6, 5, 4]
    assert sorted(total for total, _ in packing.differencing(sizes, 2)) == [14, 16]  # the known result of the method
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 400).tolist()
    found = packing.differencing(sizes, 20)
    assert sorted(i for _, members in found for i in members) == list(range(400))
    assert all(total == sum(sizes[i] for i in members) for total, members in found)
    assert max(t for t, _ in found) - min(t for t, _ in found) < 20


def test_windows_rise_and_pieces_are_cut_to_fit():
    pieces, windows = packing.near_equal([3000, 3000, 3000], 4096, 0.01)
    sums = [sum(pieces[p][2] for p in members) for members in windows]
    assert max(sums) <= 4096 and sum(sums) == 9000 and len(sums) == 3
    pieces, windows = packing.near_equal([2731] * 300, 4096, 0.01)
    assert len(windows) * 4096 * 0.99 <= 2731 * 300 + 4096


def test_encoding_is_that_of_the_library(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd_documents(spark)
    encoded = merge_replay.encode(docs, "text", RANKS, public_tokenizers.PATTERN)
    assert set(docs.columns) == set(encoded.columns)  # the clashing column is replaced
    rows = merge_replay.decode(encoded, "ids", RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "").encode()
    assert merge_replay.encode(no_documents(spark), "text", RANKS, public_tokenizers.PATTERN).count() == 0


def test_replay_equals_word_by_word():
    encoder = merge_replay.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice(list(b"abenrstht io"), rng.integers(0, 30))) for _ in range(2000)] + [b"a" * 999, b"ab" * 500, b""]
    want = [np.array(encoder._alone(w) if w else [], "<u4").tobytes() for w in words]
    assert encoder.replay(words) == want


def test_words_are_replayed_in_bounded_runs(monkeypatch):
    """However many new words a slice has, few are laid out at once; the ids are those of the words alone."""
    rng = np.random.default_rng(3)
    encoder = merge_replay.Encoder(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    words = ["".join(rng.choice(list("etaoinshrdluéß😀"), rng.integers(2, 20))) for _ in range(10_000)]
    laid_out, replay = [], encoder.replay
    monkeypatch.setattr(encoder, "replay", lambda run: laid_out.append(len(run)) or replay(run))
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    got = encoder.encode(texts)
    assert sum(laid_out) > 5_000 and max(laid_out) <= 4_000
    want = [b"".join(np.array(encoder._alone(w.encode()), "<u4").tobytes() for w in encoder.words.findall(t)) for t in texts]
    assert got == want
    assert [encoder.decode(ids).decode() for ids in got] == texts
