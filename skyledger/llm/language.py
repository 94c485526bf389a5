"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. A trigram is the product
(binding) of its letters' vectors, each permuted by its place; a text is the sum (bundle) of its
trigrams' vectors, a language the sum of its training texts' unit vectors. A text goes to the
language whose vector has the largest cosine with its own; ties go to the smaller name.

Training reads at most some ``per_language`` texts of each language, chosen by a hash of their
id (the bound that makes the fit's cost independent of the input); prediction reads every whole
text. The vectors of a block of texts are one product of its trigram counts with the vectors of
the trigrams that occur in it, in column blocks, so memory is bounded for any script.

Defined cases: null and letterless texts are ``und`` with score 0; without training rows all are
``und``; rows without lang or text teach nothing; repeated rows are predicted alike; labels are
any strings; an empty table gives an empty result; ``source`` and ``doc_id`` are never inputs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.words import rows, scramble

DIMENSIONS = 1024
UNKNOWN = "und"
#: Trigrams whose vectors are held at a time.
COLUMNS = 4096
#: Characters of a block of texts.
BLOCK = 400_000


@lru_cache(65536)
def letter_vector(code: int) -> np.ndarray:
    """The fixed random vector of a code point."""
    with np.errstate(over="ignore"):
        bits = scramble(np.arange(DIMENSIONS, dtype=np.uint64) + np.uint64((code + 1) << 20))
    return np.where(scramble(bits) >> np.uint64(63), 1, -1).astype(np.int8)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of trigrams of code points, shape (n, 3)."""
    letters, at = np.unique(codes, return_inverse=True)
    at = at.reshape(codes.shape)
    base = np.stack([letter_vector(int(c)) for c in letters])
    turned = [np.roll(base, 2, 1), np.roll(base, 1, 1), base]
    return turned[0][at[:, 0]] * turned[1][at[:, 1]] * turned[2][at[:, 2]]


_LETTERS = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x3000)])


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Code points of general category L."""
    out = _LETTERS[np.minimum(codes, 0x2FFF)]
    high = codes >= 0x3000
    if high.any():
        seen, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([unicodedata.category(chr(c))[0] == "L" for c in seen])[at]
    return out


def text_vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, letters): the bundle of each text's trigrams and its number of letters.

    Texts are lower-cased; runs of other characters count as one space, also at both ends.
    """
    joined = "\0" + "\0".join(t.lower() for t in texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.cumsum(codes == 0) - 1
    # a text's own NULs would shift the owners, so they are taken out before joining by the caller
    letter = _is_letter(codes)
    keep = letter.copy()
    keep[1:] |= ~letter[1:] & letter[:-1]  # the first of a run of others, which closes a word
    keep[0] = True
    codes, owner, letter = np.where(letter, codes, 32)[keep], owner[keep], letter[keep]
    total = np.bincount(owner[letter], minlength=len(texts))[: len(texts)]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    if len(codes) >= 3:
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        # a trigram belongs to the text of its letters; one that reaches over a separator has its middle as space
        whose = np.where(letter[1:-1], owner[1:-1], -1)
        use = whose >= 0
        letters, dense = _ranked(codes, int(codes.max()) + 1)
        n = len(letters)
        code = (dense[:-2] * n + dense[1:-1]) * n + dense[2:]
        code, whose = code[use], whose[use]
        kinds, at = _ranked(code, n**3)
        for lo in range(0, len(kinds), COLUMNS):
            part = kinds[lo : lo + COLUMNS]
            inside = (at >= lo) & (at < lo + COLUMNS) if len(kinds) > COLUMNS else slice(None)
            counts = np.bincount(whose[inside] * len(part) + at[inside] - lo, minlength=len(texts) * len(part))
            three = np.stack([letters[part // (n * n)], letters[part // n % n], letters[part % n]], 1)
            out += counts.reshape(len(texts), len(part)).astype(np.float32) @ trigram_vectors(three).astype(np.float32)
    return out, total


def _ranked(code: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with inverse, by counting where the values are few."""
    if limit > 4_000_000:
        return np.unique(code, return_inverse=True)
    kinds = np.nonzero(np.bincount(code, minlength=limit))[0]
    place = np.zeros(limit, np.int64)
    place[kinds] = np.arange(len(kinds))
    return kinds, place[code]


def _blocks(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows(batch):
        held.append(row)
        size += len(row[0] or "") + 1
        if size >= BLOCK or len(held) >= 256:
            yield held
            held, size = [], 0
    if held:
        yield held


def _clean(text: str | None) -> str:
    return (text or "").replace("\0", " ")


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of the texts of each language, one row per task and language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for block in _blocks(batch):
            vectors, letters = text_vectors([_clean(r[0]) for r in block])
            norms = np.linalg.norm(vectors, axis=1)
            for i, (_, lang) in enumerate(block):
                if letters[i] and norms[i] > 0:
                    sums[lang] = sums.get(lang, 0) + vectors[i].astype(np.float64) / norms[i]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([list(v) for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])


def learn(rows_: DataFrame, per_language: int = 3000, parts: int = 24) -> dict[str, np.ndarray]:
    """Unit vector of each language of ``rows_(doc_id, text, lang)``.

    About ``per_language`` texts of each language are read, all of those that have fewer.
    """
    known = rows_.where("lang is not null and text is not null")
    counts = known.groupBy("lang").count().select(F.col("lang").alias("_l"), (F.lit(float(per_language)) / F.col("count")).alias("_f"))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row per language, as many as the profiles that the driver holds: broadcast, so that no text moves to be chosen
    chosen = known.select("text", "lang", draw.alias("_u")).join(F.broadcast(counts), F.col("lang") == F.col("_l")).where("_u < _f").select("text", "lang")
    bundles = chosen.repartition(parts).mapInArrow(_bundle, "lang string, v array<double>")
    summed = bundles.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for lang, i, x in summed.collect():  # languages times dimensions, whatever the input
        out.setdefault(lang, np.zeros(DIMENSIONS))[i] = round(x, 6)
    return {lang: v / (np.linalg.norm(v) or 1.0) for lang, v in out.items()}


def _predict(profiles: dict[str, np.ndarray]):
    names = sorted(profiles)
    matrix = np.stack([profiles[n] for n in names]).astype(np.float32) if names else np.zeros((0, DIMENSIONS), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for block in _blocks(batch.select(["_text"])):
                vectors, letters = text_vectors([_clean(r[0]) for r in block])
                norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                cosine = vectors @ matrix.T / norms
                for i in range(len(block)):
                    if letters[i] and names:
                        best = int(cosine[i].argmax())
                        langs.append(names[best])
                        scores.append(round(min(1.0, max(0.0, float(cosine[i, best]))), 6))
                    else:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
            made = [batch["_row"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, names=["_row", "_pred", "_score"])
    return run


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """``_row`` (the columns ``keep`` as a struct), ``_pred`` and ``_score`` of each row of ``docs``."""
    given = docs.select(F.struct(*keep).alias("_row"), F.col("text").alias("_text"))
    made = given.select("_row", F.lit("").alias("_pred"), F.lit(0.0).alias("_score"))
    return given.mapInArrow(_predict(profiles), made.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_languages(docs: DataFrame, per_language: int = 3000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns from the rows outside the held-out fold."""
    profiles = learn(docs.where(~held_out()).select("doc_id", "text", "lang"), per_language)
    found = identify(docs, profiles, ["doc_id"])
    return found.select(F.col("_row.doc_id").alias("doc_id"), F.col("_pred").alias("lang_pred"), F.col("_score").alias("score")).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float | None = None, per_language: int = 3000) -> DataFrame:
    """Every column of the rows whose language was found; with ``least``, only those of a larger score.

    Without ``least`` the score decides nothing: a text in letters that no training row holds has
    a cosine around 0, and keeps its row whatever the sign.
    """
    profiles = learn(docs.where(~held_out()).select("doc_id", "text", "lang"), per_language)
    found = identify(docs, profiles, docs.columns).where(F.col("_pred") != UNKNOWN)
    return (found if least is None else found.where(F.col("_score") > least)).select("_row.*")
