import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from skyledger.llm import token_counts, token_files

from .common import HARD, WORD, clashing, documents

BPE = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    array = np.array(values, np.uint64)
    words, marks = token_files.encode(array)
    assert token_files.decode(words).tolist() == values
    for k, at in enumerate(marks.tolist()):  # a mark is where its value's run begins
        tail = token_files.decode(words[at:])
        assert len(tail) >= len(values) - k * token_files.MARK and tail[len(tail) - (len(values) - k * token_files.MARK) :].tolist() == values[k * token_files.MARK :]


def test_simple8b_packs():
    assert len(token_files.encode(np.zeros(1200, np.uint64))[0]) == 10
    assert len(token_files.encode(np.arange(3000, dtype=np.uint64) % 50_000)[0]) < 800


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def test_files_hold_the_library_ids(spark):
    draw = random.Random(3)
    pieces = ["the", " ", "  ", "\n", "\n\n", "don't", "É", "中文", "1234", "!?", "\t", " ", " ", "\x1c", "\x85", "<|endoftext|>", "<|endo", "a" * 300, "'s", " '", "　"]
    texts = HARD + ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 60))) for _ in range(150)]
    docs = clashing(documents(spark, texts, ids=list(range(len(texts), 0, -1))))
    folder = token_files.write_tokens(docs, BPE, 2)
    rows = {r["doc_id"]: r for r in token_files.read_index(spark, folder).collect()}
    full = {r["doc_id"]: r["token_ids"] for r in token_files.read_tokens(spark, folder).collect()}
    start = 0
    for doc_id, text in sorted(zip(range(len(texts), 0, -1), texts, strict=True)):
        ids = [*library(text), 2]
        r = rows[doc_id]
        assert full[doc_id] == ids
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_repeated_null_and_empty(spark):
    docs = documents(spark, ["b", "a", "a", None], ids=[1, 1, 1, None])
    rows = sorted(((r["doc_id"] or 0, r["start"], r["n_tokens"]) for r in token_files.read_index(spark, token_files.write_tokens(docs, BPE, 2)).collect()))
    assert rows == [(0, 0, 1), (1, 1, 2), (1, 3, 2), (1, 5, 2)]
    empty = docs.where("false")
    assert token_files.read_index(spark, token_files.write_tokens(empty, BPE, 2)).count() == 0


def greedy(word, pieces, longest):
    at = n = 0
    while at < len(word):
        for end in range(min(len(word), at + longest), at, -1):
            if word[at:end] in pieces:
                at, n = end, n + 1
                break
        else:
            n, at = n + len(word[at].encode()), at + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=25), st.text("abcé", max_size=40))
def test_automaton_equals_greedy(pieces, word):
    assert token_counts.Automaton(pieces).count(word) == greedy(word, pieces, 6)


def test_counts_equal_greedy(spark):
    pieces = token_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    known, longest = set(pieces), max(map(len, pieces))
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(clashing(documents(spark, HARD)), pieces).collect()}
    for i, text in enumerate(HARD):
        words = WORD.findall(text or "")
        assert (rows[i]["n_words"], rows[i]["n_tokens"]) == (len(words), sum(greedy(token_counts.MARKER + w, known, longest) for w in words))
    assert token_counts.count_tokens(documents(spark, ["a"]).where("false"), pieces).count() == 0
