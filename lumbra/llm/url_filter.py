"""URL filters: gradient-boosted trees on lexical features, after allow and block rules; DataFrame functions only.

Features are expressions on the url: lengths of url, host and path, depths of path and host, digit ratio, entropy of the host's
characters, number of parameters, hyphens, longest label, and suffix statistics: the smoothed block rate of the host's last label over
the labelled sample. A url's own fold (of ``FOLDS``, by a hash of the url) doesn't count in the rate that the trees are fitted on, so they don't see their labels
in it. Trees are fitted by histogram boosting (logistic loss, Newton leaves) on a bounded sample of labelled urls
(``SAMPLE_ROWS``, by a hash of the url); the fitted trees are one SQL expression and the rates one small table, so
judging a url needs no shuffle and no Python.

Labels are a table (url, block). Where none is given, those urls are labelled that a rule decides; as rules look at the host's suffix, suffix
statistics are then left out, else the trees would only repeat the rules.

A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with the rule's path; the longest
fitting rule wins, and of equally long ones the first by code point. Rules are a bounded list (``MAX_RULES``).

Defined results: null urls and urls without ``://`` have empty host and path and are judged by the trees; null labels are none, a url with several
labels counts with the largest; without labels of both verdicts the trees are the prior (allow without labels); repeated rows are judged alike;
an empty table gives an empty table; results take the place of columns of the same name.
"""

from __future__ import annotations

import math
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowest

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_RULES = 500
SAMPLE_ROWS = 20_000
FOLDS, PRIOR_WEIGHT = 5, 5
TREES, DEPTH, RATE, BINS, LEAST = 30, 3, 0.3, 32, 5
_URL = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        got = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, got) if out is None else out.when(fits, got)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    u = F.coalesce(url, F.lit(""))
    labels = F.split(host, r"\.")
    n = F.greatest(F.length(host), F.lit(1)).cast("double")
    letters = F.filter(F.split(host, ""), lambda c: c != "")
    # Entropy from the sorted characters' counts: each distinct character once.
    entropy = F.aggregate(
        F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda d: d == c)) / n), F.lit(0.0), lambda s, p: s - p * F.log2(p)
    )
    digits = F.length(F.regexp_replace(u, "[^0-9]", "")).cast("double")
    return {
        "length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("double"), "host_depth": F.size(labels).cast("double"),
        "digit_ratio": digits / F.greatest(F.length(u), F.lit(1)), "entropy": entropy,
        "parameters": F.regexp_count(u, F.lit(r"[?&;][^=&;#]+=")).cast("double"), "hyphens": (F.length(u) - F.length(F.replace(u, F.lit("-")))).cast("double"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"), "secure": F.lower(u).startswith("https").cast("double"),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Prior logit and trees; a tree is (feature, cut, left, right) or a leaf's value. Rows with x <= cut go left."""
    share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or share in (0.0, 1.0):
        return (6.0 if share == 1.0 else -6.0), []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    base = math.log(share / (1 - share))
    logit, trees = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if depth:
            for f in range(x.shape[1]):
                k = len(cuts[f]) + 1
                gs, hs, ns = (np.bincount(binned[rows, f], w, k)[:-1].cumsum() for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (f, int(gain.argmax())))
        if best[1] is None:
            value = -RATE * total_g / (total_h + 1)
            logit[rows] += value
            return float(value)
        f, b = best[1]
        left = binned[rows, f] <= b
        return (f, float(cuts[f][b]), grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p), DEPTH))
    return base, trees


def _expression(tree, columns: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, cut, left, right = tree
    return F.when(columns[f] <= cut, _expression(left, columns)).otherwise(_expression(right, columns))


NAMES = ["length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "entropy", "parameters", "hyphens", "longest_label", "secure"]


class UrlModel:
    """Suffix statistics (None where they are left out) and trees; ``logit`` is a Column expression."""

    def __init__(self, rows: list, with_suffixes: bool):
        y = np.array([float(r["block"]) for r in rows])
        x = np.array([[r[n] for n in NAMES] for r in rows]).reshape(len(rows), len(NAMES))
        self.prior = float(y.mean()) if len(y) else 0.0
        self.rates: dict[str, float] | None = None
        if with_suffixes:
            fold = np.array([r["fold"] for r in rows], np.int64)
            names, of = np.unique([r["suffix"] for r in rows], return_inverse=True) if rows else ([], np.zeros(0, np.int64))
            blocked, n = np.bincount(of, y, len(names)), np.bincount(of, minlength=len(names))
            own = of * FOLDS + fold
            in_fold, n_fold = np.bincount(own, y, len(names) * FOLDS), np.bincount(own, minlength=len(names) * FOLDS)
            rate = lambda b, k: (b + PRIOR_WEIGHT * self.prior) / (k + PRIOR_WEIGHT)
            self.rates = dict(zip(map(str, names), rate(blocked, n).tolist(), strict=True))  # no more than rows of the sample
            x = np.column_stack([x, rate(blocked[of] - in_fold[own], n[of] - n_fold[own])])
        self.base, self.trees = boost(x, y)

    def logit(self, columns: list[Column]) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _expression(tree, columns)
        return total


def parsed(pages: DataFrame) -> DataFrame:
    """Columns (_all, _url) with host, path and the fitting rule."""
    return pages.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url"))).withColumn("_rule", rule_of(F.col("_host"), F.col("_path")))


def fit_urls(pages: DataFrame, labels: DataFrame | None = None, rows: int = SAMPLE_ROWS) -> UrlModel:
    """From labels (url, block); without them from the urls of ``pages`` that a rule decides. Block is the positive class."""
    if labels is None:
        got = parsed(pages.select(F.col("url").cast("string").alias("_url"))).where(F.col("_rule").isNotNull()).select("_url", (F.col("_rule.verdict") == "block").cast("int").alias("block"))
    else:
        got = labels.select(F.col("url").cast("string").alias("_url"), F.col("block").cast("int").alias("block")).where("block is not null").groupBy("_url").agg(F.max("block").alias("block"))
    got = parsed(lowest(got, [F.xxhash64("_url"), F.col("_url"), F.col("block")], rows))
    fold = F.pmod(F.xxhash64("_url", F.lit(1)), F.lit(FOLDS)).alias("fold")
    got = got.select(suffix_of(F.col("_host")).alias("suffix"), fold, "block", *(c.alias(n) for n, c in features(F.col("_url"), F.col("_host"), F.col("_path")).items()))
    return UrlModel(got.collect(), labels is not None)


def judge(pages: DataFrame, model: UrlModel, columns: list[str]) -> DataFrame:
    """``columns`` of every page with host, path, rule, the trees' block probability and the verdict."""
    results = ("host", "path", "rule", "block_score", "verdict")
    whole = F.struct(*[F.col(f"`{c}`") for c in columns if c not in results], F.lit(0).alias("_")).alias("_all")
    got = parsed(pages.select(whole, F.col("url").cast("string").alias("_url")))
    got = got.select("*", *(c.alias(f"_{n}") for n, c in features(F.col("_url"), F.col("_host"), F.col("_path")).items()))
    inputs = [F.col(f"_{n}") for n in NAMES]
    if model.rates is not None:
        rates = pages.sparkSession.createDataFrame([*model.rates.items()], "_suffix string, _rate double")
        got = got.join(F.broadcast(rates), suffix_of(F.col("_host")) == F.col("_suffix"), "left")  # no more rows than the sample has
        inputs.append(F.coalesce("_rate", F.lit(model.prior)))
    got = got.withColumn("_score", 1 / (1 + F.exp(-model.logit(inputs))))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_score") >= 0.5, "block").otherwise("allow"))
    named = dict(zip(results, (F.col("_host"), F.col("_path"), F.col("_rule.rule"), F.col("_score"), verdict), strict=True))
    return got.select(*[F.col(f"_all.`{c}`").alias(c) for c in columns if c not in results], *(c.alias(n) for n, c in named.items()))
