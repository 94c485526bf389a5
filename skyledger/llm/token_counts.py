"""Word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie. Each node's failure link leads to the node that is left
after greedily popping whole pieces off its string, and carries how many pieces that pops, so a
word is read once from left to right, each character moving forward or along links, and its
greedy longest-match length comes out without building a piece.

A piece that starts a word begins with ``MARKER``; the marker goes before each word. A character
at which no piece starts counts as its UTF-8 bytes (byte fallback). Words are the runs between
ASCII white space.

Defined cases: null and wordless texts have no tokens; words of any length are read whole;
repeated rows are counted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.words import rows

MARKER = "▁"
#: Words whose counts a worker remembers, up to this length.
REMEMBERED, LONGEST = 500_000, 64
WHITE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


class Automaton:
    """Trie with failure links; ``ends[v]`` is the number of greedy pieces of node v's whole string."""

    def __init__(self, pieces: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        whole, letter, parent = [False], [""], [0]
        for piece in pieces:
            v = 0
            for c in piece:
                u = self.children[v].get(c)
                if u is None:
                    u = self.children[v][c] = len(self.children)
                    self.children.append({}), whole.append(False), letter.append(c), parent.append(v)
                v = u
            if v:
                whole[v] = True
        n = len(self.children)
        self.link, self.pops = [-1] * n, [0] * n
        level = list(self.children[0].values())
        while level:  # breadth first: links lead to shorter strings
            below = []
            for v in level:
                if whole[v]:
                    self.link[v], self.pops[v] = 0, 1
                else:
                    up, c = parent[v], letter[v]
                    state, count = self.link[up], self.pops[up]
                    if up == 0:  # a first letter that is no piece itself: popped as bytes
                        state, count = 0, len(c.encode("utf-8", "surrogatepass"))
                    else:
                        state, more = self._step(state, c)
                        count += more
                    self.link[v], self.pops[v] = state, count
                below.extend(self.children[v].values())
            level = below
        self.ends = [0] * n
        for v in range(1, n):
            u, total = v, 0
            while u:
                total += self.pops[u]
                u = self.link[u]
            self.ends[v] = total

    def _step(self, state: int, c: str) -> tuple[int, int]:
        """The state after reading ``c`` in ``state``, and the pieces popped on the way."""
        popped = 0
        while True:
            child = self.children[state].get(c)
            if child is not None:
                return child, popped
            if not state:
                return 0, popped + len(c.encode("utf-8", "surrogatepass"))
            popped += self.pops[state]
            state = self.link[state]

    def count(self, word: str) -> int:
        children, link, pops = self.children, self.link, self.pops
        state, total = 0, 0
        for c in word:
            while True:
                child = children[state].get(c)
                if child is not None:
                    state = child
                    break
                if not state:
                    total += len(c.encode("utf-8", "surrogatepass"))
                    break
                total += pops[state]
                state = link[state]
        return total + self.ends[state]


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


_MADE: dict[int, tuple[Automaton, dict[str, int]]] = {}


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary.value
        key = hash(pieces)
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = (Automaton(pieces.split("\n")), {})
        automaton, known = _MADE[key]
        for batch in batches:
            ids, n_words, n_tokens = [], [], []
            for doc_id, text in rows(batch):
                words = [w for w in (text or "").translate(WHITE).split(" ") if w]
                if len(known) > REMEMBERED:
                    known.clear()
                total = 0
                for word in words:
                    n = known.get(word)
                    if n is None:
                        n = automaton.count(MARKER + word)
                        if len(word) <= LONGEST:
                            known[word] = n
                    total += n
                ids.append(doc_id), n_words.append(len(words)), n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, n_words, n_tokens)], names=["doc_id", "n_words", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens. The vocabulary (a fixed file) is broadcast."""
    vocabulary = docs.sparkSession.sparkContext.broadcast("\n".join(p for p in pieces if "\n" not in p))
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(_count(vocabulary), "doc_id bigint, n_words bigint, n_tokens bigint")
