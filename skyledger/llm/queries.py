"""The registered queries of the operators, with their reference SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import decontaminate, fingerprints, jaccard, language, license_texts, licenses, minhash, mixing, negatives, spelling, substrings, token_counts, token_files, urls

#: Rules of the URL filter: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_versions(_table(spark, sf_dir, "documents"))


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), pieces)


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), license_texts.TEMPLATES)


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(_table(spark, sf_dir, "documents"))


def token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.read_index(spark, folder)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(_table(spark, sf_dir, "documents"))


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"), plant=199)


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(rows.withColumn("label", label), F.pmod("vec_id", F.lit(100)) == 0)


QUERIES = {
    "op1_url_filters": url_filters,
    "op2_document_fingerprints": document_fingerprints,
    "op3_token_counts": token_lengths,
    "op4_license_scans": license_scans,
    "op5_ngram_jaccard_join": ngram_jaccard_join,
    "op6_token_id_output": token_id_output,
    "op7_substring_dedup": substring_dedup,
    "op8_benchmark_decontamination": benchmark_decontamination,
    "op9_language_id": language_id,
    "op10_mixing": source_mixing,
    "op11_minhash_near_dedup": minhash_near_dedup,
    "op12_spelling_variants": spelling_variants,
    "op13_hard_negatives": hard_negatives,
}

_WORDS8 = (
    "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

ORACLE = {
    "op8_benchmark_decontamination": f"""
with d as (select row_number() over () as r, doc_id, {_WORDS8} as w from documents),
b as (select item_id, {_WORDS8} as w from benchmark),
g as (select distinct item_id, least(len(w), 13) as n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as gram
  from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) as i from b where len(w) > 0)),
p as (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from g) where len(w) >= n),
h as (select p.r, p.i, p.n, g.item_id from p join g on g.n = p.n and g.gram = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
c as (select r, count(distinct k) as n_hit from (select r, unnest(generate_series(i, i + n - 1)) as k from h) group by r),
t as (select r, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as items from h group by r)
select d.doc_id, len(d.w) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.items, '')) as items_sha256,
  coalesce(c.n_hit, 0) > 0 and 20 * coalesce(c.n_hit, 0) >= len(d.w) as contaminated
from d left join c on c.r = d.r left join t on t.r = d.r""",
    "op10_mixing": """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as total, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by source),
o as (select *, row_number() over (order by total / w, source nulls last) as k from s),
f as (select *, (sum(total) over () - 3 * coalesce(sum(total) over (order by k rows between unbounded preceding and 1 preceding), 0))
  / (sum(w) over (order by k rows between current row and unbounded following)) as level from o),
l as (select level from f where 3 * total >= level * w order by k limit 1),
t as (select source, total, least(total * 3.0::double, (select level from l) * w) as target from f),
x as (select d.doc_id, d.source, d.size, t.total, t.target, md5('mix|' || coalesce(d.doc_id::varchar, 'null')) as draw from d join t on d.source is not distinct from t.source),
y as (select *, case when size > 0 then floor(target / total)::bigint else 0 end as whole,
  sum(size) over (partition by source order by draw, doc_id, size rows unbounded preceding) as run from x)
select doc_id, size, total as source_size, target,
  (size * least(3, whole + case when size > 0 and run - size / 2 <= target - whole * total then 1 else 0 end))::bigint as taken from y""",
}


ORACLE["op13_hard_negatives"] = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = c.label as alike, c.vec_id, list_inner_product(a.v, c.v)::bigint as score
  from e a join e c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where alike
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id,
  positive_score, score as negative_score from p join s using (anchor_id)
where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 10"""


def load() -> tuple[dict, dict]:
    return QUERIES, ORACLE
