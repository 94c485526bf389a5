"""Benchmark decontamination: word windows of test items found in training texts. DataFrame functions only.

Texts are lower-cased (A-Z) and cut into runs of digits, a-z and non-ASCII characters. A window
is ``size`` consecutive item words, or the whole of a shorter item. Looking up every window of
every text is not needed: a text that holds a window of L words holds, at some position that is
a multiple of s = L - m + 1, m words in a row that also stand in a row in an item. So only every
s-th position is hashed and looked up in the broadcast set of the items' m-grams; around the
hits the windows themselves are compared as text, which makes the result exact.

Defined cases: null and wordless texts have no words and no hits; items without words give no
window; repeated items and rows change nothing; rows are told apart by (doc_id, text hash), so
rows that share an id are judged each by its own text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.ranges import free
from skyledger.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Item n-grams up to this number are broadcast (some 30 MB); beyond it the join is left to Spark.
BROADCAST_GRAMS = 500_000


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def bind(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once and not once for each place it is used in."""
    return F.element_at(F.transform(F.array(value), use), 1)


def probe_shape(length: int) -> tuple[int, int]:
    """Words of a probe, and the step between probed positions, for windows of ``length`` words."""
    m = 5 if length >= 9 else (length + 1) // 2
    return m, length - m + 1


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct (item_id, length, window text, words) of the items."""
    cut_up = items.select("item_id", words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    length = F.least(F.size("_w"), F.lit(size))
    spots = cut_up.select("item_id", "_w", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("_w") - length + 1)).alias("_at"))
    part = F.slice("_w", F.col("_at"), F.col("length"))
    return spots.select("item_id", "length", F.array_join(part, " ").alias("gram"), part.alias("_part")).dropDuplicates(["item_id", "length", "gram"])


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_GRAMS else df


def hits(docs: DataFrame, items: DataFrame, size: int = 13) -> tuple[DataFrame, DataFrame]:
    """(counts, found): n_words for each row, and one row for each text with a hit.

    ``counts`` has (_id, _hash, n_words); ``found`` has (_id, _hash, starts, items) with the
    windows as (start, length), 1-based, and the distinct item ids as sorted strings.
    """
    windows = cut(item_windows(items, size))
    per_length = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    total = sum(per_length.values())
    shapes = {length: probe_shape(length) for length in sorted(per_length)}

    def probe(a: Column, length: int) -> Column:
        m, step = shapes[length]
        spots = F.sequence(F.lit(1), F.size(a) - m + 1, F.lit(step))
        return F.when(F.size(a) >= length, F.transform(spots, lambda i: F.xxhash64(F.slice(a, i, m)))).alias(f"p{length}")

    text_hash = F.coalesce(F.xxhash64("text"), F.lit(0))
    looked = bind(words(F.col("text")), lambda a: F.struct(F.size(a).cast("bigint").alias("n_words"), *[probe(a, n) for n in shapes]))
    base = cut(docs.select(F.col("doc_id").alias("_id"), text_hash.alias("_hash"), looked.alias("_l")).select("_id", "_hash", "_l.*"))
    counts = base.select("_id", "_hash", "n_words")
    spots = None
    for length, (m, step) in shapes.items():
        grams = windows.where(F.col("length") == length).select(
            F.explode(F.transform(F.sequence(F.lit(1), F.lit(length - m + 1)), lambda i: F.xxhash64(F.slice("_part", i, m)))).alias("_g")
        ).distinct()
        probed = base.select("_id", "_hash", F.posexplode(f"p{length}").alias("_k", "_g"))
        near = probed.join(_sized(grams, per_length[length] * step), "_g").select(
            "_id", "_hash", F.struct(F.lit(length).alias("length"), (F.col("_k") * step + 1).cast("int").alias("at")).alias("_spot")
        )
        spots = near if spots is None else spots.unionAll(near)
    if spots is None:
        none = base.where("false").select("_id", "_hash", F.lit(None).cast("array<struct<start:int,length:int>>").alias("starts"),
                                          F.lit(None).cast("array<string>").alias("items"))
        return counts, none
    marked = spots.groupBy("_id", "_hash").agg(F.collect_set("_spot").alias("_spots"))
    texts = docs.select(F.col("doc_id").alias("_d"), text_hash.alias("_h"), "text")
    held = texts.join(marked, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))

    def around(a: Column) -> Column:
        """The windows that a hit probe may belong to."""
        def one(spot: Column) -> Column:
            n, at = spot["length"], spot["at"]
            step = F.create_map(*[F.lit(x) for k, (_, s) in shapes.items() for x in (k, s)])[n]
            starts = F.sequence(F.greatest(F.lit(1), at - step + 1), F.least(at, F.size(a) - n + 1))
            return F.transform(starts, lambda i: F.struct(i.alias("start"), n.alias("length")))
        spans = F.array_distinct(F.flatten(F.transform("_spots", one)))
        return F.transform(spans, lambda x: F.struct(
            x["start"].alias("start"), x["length"].alias("length"), F.array_join(F.slice(a, x["start"], x["length"]), " ").alias("gram")))

    tried = held.select("_id", "_hash", F.explode(bind(words(F.col("text")), around)).alias("_c")).select("_id", "_hash", "_c.*")
    matched = tried.join(_sized(windows.select("item_id", "length", "gram"), total), ["length", "gram"])
    found = matched.groupBy("_id", "_hash").agg(
        F.collect_set(F.struct("start", "length")).alias("starts"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    return counts, found


def _covered() -> Column:
    """Distinct word positions that the windows of ``starts`` cover."""
    return F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))


def judge(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """For each row: doc_id, _hash, n_words, n_hit, items and contaminated (n_hit is 1/``share`` of the words or more)."""
    counts, found = hits(docs, items, size)
    n_hit = found.select(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.size(_covered()).cast("bigint").alias("_n"), "items")
    joined = counts.join(n_hit, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    hit = F.coalesce("_n", F.lit(0)).cast("bigint")
    return joined.select(
        F.col("_id").alias("doc_id"), "_hash", "n_words", hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((hit > 0) & (hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without the contaminated rows."""
    i, h = free(docs.columns, "_i"), free(docs.columns, "_h")
    bad = judge(docs, items, size, share).where("contaminated").select(F.col("doc_id").alias(i), F.col("_hash").alias(h)).distinct()
    text_hash = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(i)) & (text_hash == F.col(h)), "left_anti")


def cut_spans(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """Every column of ``docs``; texts with hits lose the hit words and become their other words, lower-cased, joined by a space."""
    _, found = hits(docs, items, size)
    i, h, gone = (free(docs.columns, n) for n in ("_i", "_h", "_gone"))
    spans = found.select(F.col("_id").alias(i), F.col("_hash").alias(h), _covered().alias(gone))
    text_hash = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col(i)) & (text_hash == F.col(h)), "left")
    kept = bind(words(docs["text"]), lambda a: F.array_join(F.filter(a, lambda w, k: ~F.array_contains(gone, k + 1)), " "))
    return joined.select(*[
        (F.when(F.col(gone).isNull(), docs["text"]).otherwise(kept).alias("text") if c == "text" else docs[c]) for c in docs.columns
    ])
