"""Token-id files of Simple-8b words.

A 64-bit word holds a selector in its top 4 bits and, in the other 60, a varying number of ids
of equal width (``LAYOUT``). Selector 1 says that the next word is one whole 64-bit value (the
escape, for values of more than 60 bits). A block has the ids of whole documents up to some
``BLOCK_IDS`` (a longer document makes a block of its own), its documents' ids and counts, the
id before its first one, and the word at which each 4096th id's run starts, so that a reader may
decode a part. Words of one selector are unpacked together.

The container is Parquet, one row per block, written by Spark's committer into a shared folder:
a lost executor's tasks are repeated and never seen twice. Rows are range-partitioned by doc_id;
``shard`` is the partition, ascending, ``start`` counts within it.

Defined cases: a null text is the empty text, which has the end id only; repeated doc_ids are
written one after the other, in order of their text hash; null doc_ids come first; an empty
table writes no block and reads as an empty table; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.words import rows
from skyledger.session import scratch_path

#: Fixed values of the format: selector -> (ids in a word, bits of each). 0: a run of 120 zeros; 1: escape.
LAYOUT = {0: (120, 0), 2: (60, 1), 3: (30, 2), 4: (20, 3), 5: (15, 4), 6: (12, 5), 7: (10, 6), 8: (8, 7),
          9: (7, 8), 10: (6, 10), 11: (5, 12), 12: (4, 15), 13: (3, 20), 14: (2, 30), 15: (1, 60)}
ESCAPE = 1
BLOCK_IDS = 65_536
MARK = 4096

FILE_SQL = "shard int, block bigint, start bigint, doc_ids array<bigint>, counts array<bigint>, marks array<int>, payload binary"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, marks): greedy Simple-8b of unsigned values, and the word that holds each ``MARK``-th value."""
    n = len(values)
    values = values.astype(np.uint64)
    widths = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # bits; one more just below a power of two above 2**53
    take, chosen = np.ones(n, np.uint8), np.full(n, ESCAPE, np.uint8)
    widest = {1: widths}  # of each run of so many values
    for count, bits, selector in sorted((c, b, k) for k, (c, b) in LAYOUT.items()):  # the last that fits holds most
        if count > n:
            break
        if count not in widest:
            half = max(c for c in widest if c < count)
            rest = max(c for c in widest if c >= count - half)  # two runs that cover it, overlapping
            widest[count] = np.maximum(widest[half][: n - count + 1], widest[rest][count - rest : count - rest + n - count + 1])
        fits = widest[count] <= bits
        if not fits.any():
            continue
        take[: n - count + 1][fits], chosen[: n - count + 1][fits] = count, selector
    steps, at, spots = take.tolist(), 0, []
    while at < n:
        spots.append(at)
        at += steps[at]
    spots = np.array(spots, np.int64)
    picked = chosen[spots]
    place = np.arange(len(spots)) + np.concatenate([[0], np.cumsum(picked == ESCAPE)])[: len(spots)]
    words = np.zeros(len(spots) + int((picked == ESCAPE).sum()), np.uint64)
    words[place] = picked.astype(np.uint64) << np.uint64(60)
    words[place[picked == ESCAPE] + 1] = values[spots[picked == ESCAPE]]
    for selector, (count, bits) in LAYOUT.items():
        mine = np.nonzero(picked == selector)[0]
        if bits and len(mine):
            first, packed = spots[mine], np.zeros(len(mine), np.uint64)
            for j in range(count):
                packed |= values[first + j] << np.uint64(j * bits)
            words[place[mine]] |= packed
    marks = place[np.searchsorted(spots, np.arange(0, n, MARK), side="right") - 1] if n else np.empty(0, np.int64)
    return words, marks


def decode(words: np.ndarray) -> np.ndarray:
    """The values of a block's words."""
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words), bool)
    # a word after an escape is a value; such words may look like escapes, so they are told apart in order
    maybe = np.nonzero(selectors == ESCAPE)[0]
    last = -2
    for at in maybe.tolist():
        if at != last + 1 or not raw[at]:
            raw[at + 1 : at + 2] = True
            last = at
    counts = np.zeros(16, np.int64)
    for selector, (count, _) in LAYOUT.items():
        counts[selector] = count
    held = np.where(raw, 1, counts[selectors])
    starts = np.concatenate([[0], np.cumsum(held)])
    out = np.zeros(int(starts[-1]), np.uint64)
    out[starts[:-1][raw]] = words[raw]
    for selector, (count, bits) in LAYOUT.items():
        mine = np.nonzero((selectors == selector) & ~raw)[0]
        if bits and len(mine):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[starts[mine][:, None] + np.arange(count)] = (words[mine][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out


# ---- tokens

#: A run of white space and the run of other characters after it. The pre-tokenizer never joins a
#: character with white space that follows it, so such units are encoded alike alone or in a text.
UNIT = re.compile(r"\s*\S+|\s+")
#: Where Python and the tokenizer may disagree on what white space is.
ODD = re.compile("[\x1c-\x1f]")
#: White space other than single spaces and line feeds inside, and control characters of the keys (RE2).
UNEVEN = (r"[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
          r"|[ \n][ \n]|\A[ \n]|[ \n]\z")
#: A plain letter and ASCII punctuation after it, between which the pre-tokenizer always cuts (RE2).
TURN = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
#: Units whose ids a worker remembers; as many again wait to be used once more.
REMEMBERED = 600_000


class Memory:
    """A mapping of bounded size: what was not used for a generation is forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def missing(self, keys: set[str]) -> list[str]:
        """The unknown ones of ``keys``; the others are in ``new`` afterwards."""
        fresh = keys.difference(self.new)
        kept = {k: self.old[k] for k in fresh if k in self.old}
        self.new |= kept
        return list(fresh.difference(kept))

    def age(self) -> None:
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new


class Encoder:
    """Ids of texts as the tokenizers library gives them; the units it has encoded are remembered.

    Units are named by a key: a unit after one space by its other characters, a line feed by
    itself, and any other unit with a NUL before it. Unknown units are encoded together, with the
    vocabulary's special token, which nothing is joined with, between them.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.library.no_truncation()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.between, self.between_id = next(iter(self.special.items()), (None, -1))
        self.units = Memory(REMEMBERED)
        self.uneven = UNEVEN + "".join(f"|{re.escape(s)}" for s in self.special)

    def _ids(self, texts: list[str]) -> list[bytes]:
        made = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in made]

    def _look_up(self, keys: list[str]) -> list[bytes]:
        fresh = self.units.missing(set(keys))
        for at in range(0, len(fresh), 2048):
            self._learn(fresh[at : at + 2048])
        return list(map(self.units.new.__getitem__, keys))

    def _learn(self, keys: list[str]) -> None:
        units = [k[1:] if k[:1] == "\0" else k if k == "\n" else f" {k}" for k in keys]
        if self.between is None:
            self.units.new.update(zip(keys, self._ids(units), strict=True))
            return
        joined = self.between.join(units)
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.append(np.nonzero(ids == self.between_id)[0], len(ids)).tolist()
        data, at = ids.tobytes(), 0
        for key, end in zip(keys, ends, strict=True):
            self.units.new[key] = data[4 * at : 4 * end]
            at = end + 1

    def _uneven(self, text: str) -> bytes:
        """Ids of a text with white space other than single spaces and line feeds, or with odd characters."""
        if ODD.search(text) or "\0" in text or any(s in text for s in self.special):
            return self._ids([text])[0]
        return b"".join(self._look_up([f"\0{u}" for u in UNIT.findall(text)]))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """32-bit ids of each text.

        Even texts are cut at spaces, around line feeds and between letters and punctuation, and
        each distinct unit of all of them is looked up once.
        """
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.uneven)
        plain = texts.filter(pc.invert(odd))
        cut_up = pc.replace_substring_regex(plain, TURN, "\\1 \0\\2")
        keyed = pc.replace_substring(pc.binary_join_element_wise("\0", cut_up, ""), "\n", " \n \0")
        lists = pc.split_pattern(keyed, " ")
        units = lists.flatten().dictionary_encode()
        at, data = units.indices.to_numpy(), self._look_up(units.dictionary.to_pylist())
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(data), np.uint32)[place]
        cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        even = iter(np.split(ids, cuts[1:-1]) if len(plain) else [])
        out = [np.frombuffer(self._uneven(texts[i].as_py()), np.uint32) if hard else next(even) for i, hard in enumerate(odd.to_pylist())]
        self.units.age()
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """The worker's encoder for a vocabulary file's text, made once."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def pieces(batch: pa.RecordBatch, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with some ``size`` bytes of text, one row at least."""
    lengths = np.cumsum(pc.fill_null(pc.binary_length(batch["_text"]), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        done = int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + size, side="right"))
        end = max(done, at + 1)
        yield batch.slice(at, end - at)
        at = end


def _write(vocabulary, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = _encoder(vocabulary.value), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        held, ids, counts, block, start = [], [], [], 0, 0

        def flush():
            nonlocal held, ids, counts, block, start
            values = np.concatenate(held)
            words, marks = encode(values)
            made = pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()), "start": pa.array([start], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())),
                "marks": pa.array([marks.astype(np.int32)], pa.list_(pa.int32())), "payload": pa.array([words.astype("<u8").tobytes()], pa.binary())})
            held, ids, counts, block, start = [], [], [], block + 1, start + len(values)
            return made

        size = 0
        for batch in batches:
            for part in pieces(batch):
                for doc_id, data in zip(part["_id"].to_pylist(), encoder.encode(part["_text"]), strict=True):
                    ids.append(doc_id), counts.append(len(data) + 1), held.extend((data, end))
                    size += counts[-1]
                    if size >= BLOCK_IDS:
                        yield flush()
                        size = 0
        if ids:
            yield flush()
    return run


def write_tokens(docs: DataFrame, vocabulary_path: str, end_id: int, folder: str | None = None) -> str:
    """Encode every text and write the files; the folder they are in.

    The vocabulary (a file of fixed size, 1.5 MB for 50,000 ids) is read on the driver and broadcast.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())
    folder = folder or scratch_path(spark, "tokens")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    tie = F.xxhash64("_text")
    ordered = texts.repartitionByRange(parts, F.col("_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("_id").asc_nulls_first(), tie)
    ordered.select("_id", "_text").mapInArrow(_write(vocabulary, end_id), FILE_SQL).write.option("compression", "none").parquet(folder)
    return folder


_READ = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("rel", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start, ids, counts, payload in rows(batch, 4):
            values = decode(np.frombuffer(payload, "<u8")).astype("<u4")
            ends = np.cumsum(counts)
            data = memoryview(values.tobytes())
            begins = ends - counts
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(start + begins, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], schema=_READ)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, counts, payload in rows(batch, 4):
            values, ends = decode(np.frombuffer(payload, "<u8")).astype(np.int64), np.cumsum(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([values[e - c : e] for c, e in zip(counts, ends, strict=True)], pa.list_(pa.int64()))],
                names=["doc_id", "token_ids"])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and token_ids (with the end id) of every document of the files."""
    files = spark.read.schema(FILE_SQL).parquet(folder)
    return files.select("doc_ids", "counts", "payload").mapInArrow(_decoded, "doc_id bigint, token_ids array<bigint>")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, from the decoded ids.

    A shard's first start is the sum of the shards before it: one row per shard (as many as the
    writer had partitions) meets in the window.
    """
    files = spark.read.schema(FILE_SQL).parquet(folder)
    size = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum(size).alias("n")).select(
        F.col("shard").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    index = files.select("shard", "start", "doc_ids", "counts", "payload").mapInArrow(
        _read, "shard int, doc_id bigint, rel bigint, n_tokens bigint, ids_crc32 bigint")
    return index.join(shards, F.col("shard") == F.col("_s")).select(
        "doc_id", (F.col("rel") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")
