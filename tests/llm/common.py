"""Plain versions of the operators' words, and small hard tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def documents(spark, texts, ids=None, langs=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs or ["en"] * len(texts))[k], (sources or ["s"] * len(texts))[k], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    """The table with more columns, named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["n_words", "size", "target", "taken", "score", "lang_pred", "component_id", "n", "key", "region", "kept", "_id", "_text", "start",
             "host", "path", "rule", "verdict", "items", "contaminated", "_size", "_row", "_h", "_i", "hash"]
    return docs.select("*", *[F.lit("clash").alias(c) for c in names])


#: Null, empty and blank texts, ties, a repeated row, a long word and other scripts.
HARD = [None, "", " \t\n", "one", "one two", "one two three", "One TWO three", "one two three", "É é ÀÀ ß 中文 字", "x" * 5000,
        "a b c d e f g h i j " * 300, "a b c d e f g h i j " * 300, "line.\n\nline.\nline.", "  . , !?", "0 1 2 3 <|endoftext|> \x1c\x1d end  \n\n  "]
