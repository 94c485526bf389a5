"""URL filters: a path-template tree per host, with templates rejected by smoothed labelled purity.

Paths are cut into segments and the tree is built from the root, level by level, over counts of
distinct (host, path) pairs. At each node:

* segments of one shape (digits, letters and digits, other; with their extension) that are at
  least as many as the distinct paths below each become one wildcard branch, such as ``{9}`` or
  ``{a9}.html``;
* the literal branches left are held against the most frequent one: those whose label rate and
  next-segment shapes lie within a Hoeffding bound of it are merged into one branch ``{~}``, and
  those left over likewise into ``{~2}`` and so on. Where one of the two has no labels, the
  next-segment shapes alone decide, if the bound is tight enough to tell any apart.

A template's share of blocked labels is smoothed towards its parent's, from the host down, and
a template is rejected when it reaches ``threshold``. Labels are 1 (block), 0 (allow) or null.

Defined cases: a null url or one without ``://`` has empty host and path; the empty table gives
an empty result; repeated urls get one verdict, count once for templates and as often as they
occur for a template's share; paths of any length are read segment by segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest of ``rules(verdict, host, path)`` that fits: struct(rule, verdict), or null.

    The rules are a written list of the caller's, so they go into the plan as they are.
    """
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    empty = F.lit(None).cast("struct<rule:string,verdict:string>")
    return empty if out is None else out.otherwise(empty)


def shape(segment: Column) -> Column:
    """Wildcard name of a segment: what it is made of, and its extension."""
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "{9}").when(stem.rlike(r"^[A-Za-z]+$"), "{a}")
        .when(stem.rlike(r"^[A-Za-z0-9_-]+$"), "{a9}").otherwise("{*}")
    )
    return F.concat(kind, F.coalesce(F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1), F.lit("")))


_FAMILY = "_host string, _prefix string, _segment string, _branch string"


def _families(alpha: float):
    """The branches of one node -> branch names of those that are like a more frequent sibling, family by family."""
    bound = (0.5 * log(2.0 / alpha)) ** 0.5

    def close(x, n, y, m):
        n, m = np.maximum(n, 1e-9), max(m, 1e-9)
        return np.abs(x / n - y / m) < bound * (1 / np.sqrt(n) + 1 / np.sqrt(m))

    def run(node: pa.Table) -> pa.Table:
        rows = sorted(node.to_pylist(), key=lambda r: (r["paths"], r["_segment"]), reverse=True)
        n, labelled, blocked, leaf, digits = (np.array([r[c] for r in rows], float) for c in ("paths", "labelled", "blocked", "leaf", "digits"))
        left, names, families = np.arange(len(rows)), [None] * len(rows), 0
        while len(left) > 1:
            a = left[0]
            alike = left[close(leaf[left], n[left], leaf[a], n[a]) & close(digits[left], n[left], digits[a], n[a])]
            # without labels to compare, a bound that excludes no share says nothing
            mixed = (labelled[alike] > 0) != (labelled[a] > 0)
            alike = alike[~mixed | (bound * (1 / np.sqrt(n[alike]) + 1 / np.sqrt(n[a])) < 1)]
            told = alike[labelled[alike] > 0]
            if len(told):  # the anchor if it has labels, else the most frequent branch that has
                k = a if labelled[a] > 0 else told[0]
                alike = alike[(labelled[alike] == 0) | close(blocked[alike], labelled[alike], blocked[k], labelled[k])]
            if len(alike) > 1:
                families += 1
                for i in alike:
                    names[i] = "{~}" if families == 1 else f"{{~{families}}}"
            left = np.setdiff1d(left, np.append(alike, a))
        made = [(r["_host"], r["_prefix"], r["_segment"], name) for r, name in zip(rows, names, strict=True) if name]
        return pa.table({c: pa.array([m[i] for m in made], pa.string()) for i, c in enumerate(("_host", "_prefix", "_segment", "_branch"))})
    return run


def _merged(branches: DataFrame, alpha: float) -> DataFrame:
    """(host, prefix, segment) -> branch ``{~}``, ``{~2}``, ... for literals that are like a sibling.

    A node's most frequent branch is held against all others; those alike make a family, and the
    rest goes on in the same way. Literals of a shape are fewer than eight or than the root of
    the node's paths, else they are a wildcard, so a node is small.
    """
    several = branches.groupBy("_host", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_host", "_prefix")
    return branches.join(several, ["_host", "_prefix"]).select(
        "_host", "_prefix", "_segment", "paths", "labelled", "blocked", "leaf", "digits"
    ).groupBy("_host", "_prefix").applyInArrow(_families(alpha), _FAMILY)


def template_tree(paths: DataFrame, distinct: int = 8, alpha: float = 0.05) -> DataFrame:
    """Template of each distinct (host, path).

    ``paths(_host, _path, rows, labelled, blocked)`` are counts of distinct pairs. Each level
    groups by (host, template so far, segment) with partial sums and joins the node decisions
    back on (host, template so far), a join that adaptive execution may split for a hot host.
    Decisions count each distinct path once. A node with one path has nothing to decide, so its
    path is finished at once; the levels end when no path has a segment left.
    """
    parts = F.split(F.regexp_replace("_path", "^/", ""), "/", -1)
    state = paths.withColumn("_parts", parts).withColumn("_prefix", F.lit(""))
    given, done, level = ["_host", "_path", "rows", "labelled", "blocked"], None, 0
    while True:
        nodes = state.groupBy("_host", "_prefix").agg(F.count(F.lit(1)).alias("_n"))
        state = cut(state.join(nodes, ["_host", "_prefix"]))
        over = F.size("_parts") <= level
        rest = F.concat("_prefix", F.lit("/"), F.array_join(F.slice("_parts", level + 1, F.greatest(F.size("_parts") - level, F.lit(1))), "/"))
        finished = state.where(over | (F.col("_n") == 1)).select(*given, F.when(over, F.col("_prefix")).otherwise(rest).alias("template"))
        done = finished if done is None else done.unionAll(finished)
        live = state.where(~over & (F.col("_n") > 1)).drop("_n").withColumn("_segment", F.get("_parts", F.lit(level)))
        if live.isEmpty():
            return done
        following = F.get("_parts", F.lit(level + 1))
        branches = cut(live.groupBy("_host", "_prefix", "_segment").agg(
            F.count(F.lit(1)).alias("paths"), F.count_if(F.col("labelled") > 0).alias("labelled"),
            F.coalesce(F.sum(F.when(F.col("labelled") > 0, F.col("blocked") / F.col("labelled"))), F.lit(0.0)).alias("blocked"),
            F.count_if(following.isNull()).alias("leaf"), F.count_if(following.rlike("^[0-9]")).alias("digits"),
        ).withColumn("_shape", shape(F.col("_segment"))))
        kinds = branches.groupBy("_host", "_prefix", "_shape").agg(F.count(F.lit(1)).alias("_kinds"), F.sum("paths").alias("_paths"))
        # as many values as pages below each, or more: an id, a date or a slug
        wild = kinds.where((F.col("_kinds") >= distinct) & (F.col("_paths") <= F.col("_kinds") * F.col("_kinds"))).select(
            "_host", "_prefix", "_shape", F.lit(1).alias("_wild"))
        decided = cut(branches.join(wild, ["_host", "_prefix", "_shape"], "left"))
        merged = _merged(decided.where("_wild is null"), alpha)
        choice = decided.where("_wild = 1").select("_host", "_prefix", "_segment", F.col("_shape").alias("_branch")).unionAll(merged)
        state = live.join(choice, ["_host", "_prefix", "_segment"], "left").withColumn(
            "_prefix", F.concat("_prefix", F.lit("/"), F.coalesce("_branch", "_segment"))).drop("_branch", "_segment")
        level += 1


def template_purity(tree: DataFrame, strength: float = 10.0) -> DataFrame:
    """Smoothed blocked share of each (host, template): the template's towards its first branch's, that towards the host's, that towards all urls'."""
    first = F.regexp_extract("template", r"^(/[^/]*)", 1)
    counts = cut(tree.groupBy("_host", first.alias("_first"), "template").agg(F.sum("labelled").alias("n"), F.sum("blocked").alias("k")))
    n_all, k_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    prior = F.lit((k_all + 1.0) / (n_all + 2.0))

    def smoothed(parent: Column) -> Column:
        return (F.col("k") + F.lit(strength) * parent) / (F.col("n") + F.lit(strength))

    hosts = counts.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select("_host", smoothed(prior).alias("_p1"))
    firsts = counts.groupBy("_host", "_first").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(hosts, "_host").select(
        "_host", "_first", smoothed(F.col("_p1")).alias("_p2"))
    return counts.join(firsts, ["_host", "_first"]).select("_host", "template", smoothed(F.col("_p2")).alias("purity"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], threshold: float = 0.5, key: str = "page_id") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, template and purity (null where a rule decides).

    The rules' verdicts are the labels; urls without a rule get the verdict of their template.
    """
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.col(key).alias("_key"), host.alias("_host"), path.alias("_path"))
    ruled = cut(named.withColumn("_r", longest_rule(F.col("_host"), F.col("_path"), rules)))
    labelled = F.count("_r.verdict")
    paths = ruled.groupBy("_host", "_path").agg(
        F.count(F.lit(1)).alias("rows"), labelled.alias("labelled"), F.count_if(F.col("_r.verdict") == "block").alias("blocked"))
    tree = template_tree(cut(paths))
    judged = tree.join(template_purity(tree), ["_host", "template"]).select("_host", "_path", "template", "purity")
    verdict = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return ruled.join(judged, ["_host", "_path"], "left").select(
        F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_r.rule").alias("rule"),
        F.coalesce("_r.verdict", verdict).alias("verdict"), "template",
        F.when(F.col("_r.rule").isNull(), F.col("purity")).alias("purity"),
    )
