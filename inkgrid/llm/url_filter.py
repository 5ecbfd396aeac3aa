"""URL filters: allow and block rules by host and path, gradient-boosted trees on lexical features for the rest.

The trees are trained on labelled URLs, at most ``max_training_rows`` of them (the lowest hashes, so the same at every
run). Suffix statistics are exact: how many labelled URLs, and how many blocked ones, a host's last label and last two labels
have. They are counted out of fold: hosts are dealt into folds by hash, and a URL sees the counts of the other folds only, in
training and in judging alike, so no URL sees its own label or its host's. Counts are pre-aggregated and joined by host; the hosts' table is
broadcast where it is known to be small, else shuffled.

A URL that is null or has no ``://`` has an empty host and path, fits no rule and gets the trees' verdict on an empty URL.
Repeated rows get a row each; equal rules of both verdicts block. Where all labels are
alike the trees say that label; without labelled URLs they allow all. Empty tables give empty tables. Other columns are not read. Long URLs are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, materialise

#: The rules of op2, as (verdict, host and path).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_END = re.compile("[/?#]")
_QUERY = re.compile("[?#]")


def host_and_path(url: str | None) -> tuple[str, str]:
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    m = _END.search(rest)
    host, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
    m = _QUERY.search(rest)
    return host.translate(_UPPER), rest[: m.start()] if m else rest


class Rules:
    """Rules by host; the longest that fits a URL wins, and block wins between equals."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] == "allow")):
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append((rule, slash + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while host:
            for rule, start, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            host = host.partition(".")[2]
        return best


@dataclass(frozen=True)
class UrlParams:
    rules: list = field(default_factory=lambda: RULES)
    trees: int = 60
    columns: float = 0.5  # share of the features that a tree may use
    seed: int = 7
    depth: int = 3
    bins: int = 32
    rate: float = 0.2
    l2: float = 1.0
    folds: int = 8
    broadcast_bytes: int = 8 << 20
    prior_rows: float = 20.0
    max_training_rows: int = 20_000
    threshold: float = 0.5


FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "host_entropy", "parameters", "longest_run", "suffix_rate", "suffix_rows", "domain_rate"]


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def suffixes(host: str) -> tuple[str, str]:
    """The last label and the last two."""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def fold_of(host: str, folds: int) -> int:
    return xxhash.xxh64_intdigest(host.encode()) % folds


def lexical(url: str | None, host: str, path: str, rates: tuple[float, float, float]) -> list[float]:
    u = url or ""
    query = u.partition("?")[2].partition("#")[0]
    return [
        len(u), len(host), len(path), sum(1 for x in path.split("/") if x), host.count(".") + 1 if host else 0,
        sum(c.isdigit() for c in u) / max(1, len(u)), host.count("-"), _entropy(u), _entropy(host),
        query.count("&") + 1 if query else 0, max(map(len, re.split("[^A-Za-z]+", u))), *rates,
    ]


class BoostedTrees:
    """Histogram gradient boosting for the logistic loss; full binary trees of a fixed depth, each on a sample of the features, so that no one feature decides alone."""

    def __init__(self, p: UrlParams):
        self.p, self.start, self.edges, self.trees = p, 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = self.p
        rate = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 1e-6
        self.start = math.log(rate / (1 - rate))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = self._bin(x)
        raw = np.full(len(y), self.start)
        rng, few = np.random.default_rng(p.seed), max(1, math.ceil(p.columns * x.shape[1]))
        for _ in range(p.trees):
            q = 1 / (1 + np.exp(-raw))
            tree, leaf = self._grow(binned, y - q, q * (1 - q), np.sort(rng.choice(x.shape[1], few, replace=False)))
            self.trees.append(tree)
            raw += tree[2][leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)

    def _grow(self, binned, g, h, features):
        p, n = self.p, 1 << self.p.depth
        feature, cut, node = np.zeros(n, int), np.full(n, p.bins), np.zeros(len(g), int)
        for level in range(p.depth):
            width = 1 << level
            best = np.full(width, 1e-9)
            for f in features.tolist():
                flat = node * p.bins + binned[:, f]
                gs = np.bincount(flat, g, width * p.bins).reshape(width, p.bins).cumsum(1)
                hs = np.bincount(flat, h, width * p.bins).reshape(width, p.bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + p.l2) + (gt - gs) ** 2 / (ht - hs + p.l2) - gt**2 / (ht + p.l2)
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                at = np.flatnonzero(better) + width
                feature[at], cut[at] = f, k[better]
            own = node + width
            node = node * 2 + (binned[np.arange(len(g)), feature[own]] > cut[own])
        value = p.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + p.l2)
        return (feature, cut, value), node

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        if self.trees:
            binned = self._bin(x)
            for feature, cut, value in self.trees:
                node = np.zeros(len(x), int)
                for level in range(self.p.depth):
                    own = node + (1 << level)
                    node = node * 2 + (binned[np.arange(len(x)), feature[own]] > cut[own])
                raw += value[node]
        return 1 / (1 + np.exp(-raw))


RATES = ["suffix_rate", "suffix_rows", "domain_rate"]


@dataclass
class UrlModel:
    trees: BoostedTrees
    hosts: DataFrame  # host, fold and RATES of every host that the statistics were asked for
    prior: float


def with_hosts(urls: DataFrame, url: str = "url") -> DataFrame:
    """All columns, and _host."""

    def run(batches):
        for b in batches:
            hosts = [host_and_path(u)[0] for u in column_of(b, url).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hosts, pa.string())], names=[*b.schema.names, "_host"])

    return urls.mapInArrow(run, T.StructType([*urls.schema.fields, T.StructField("_host", T.StringType())]))


def host_statistics(counts: DataFrame, prior: float, p: UrlParams) -> DataFrame:
    """host and RATES from counts (host, n, y) of labelled URLs by host."""

    def keyed(batches):
        for b in batches:
            hosts = column_of(b, "host").to_pylist()
            found = [suffixes(h) for h in hosts]
            folds = pa.array([fold_of(h, p.folds) for h in hosts], pa.int32())
            yield pa.RecordBatch.from_arrays([*(column_of(b, k) for k in ("host", "n", "y")), folds, *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))], names=["host", "n", "y", "fold", "last", "domain"])

    hosts = counts.mapInArrow(keyed, "host string, n long, y double, fold int, last string, domain string")
    out = hosts.select("host", "fold", "last", "domain")
    for key in ("last", "domain"):
        by_fold = hosts.groupBy(key, "fold").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        # a suffix has at most as many rows here as there are folds
        whole = by_fold.groupBy(key).agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.collect_list(F.struct("fold", "n", "y")).alias("f"))
        own = F.coalesce(F.expr("filter(f, v -> v.fold = fold)[0]"), F.expr("named_struct('fold', fold, 'n', 0L, 'y', 0D)"))
        out = out.join(whole, key).withColumn("own", own)
        n, y = F.col("n") - F.col("own.n"), F.col("y") - F.col("own.y")
        out = out.withColumn(f"{key}_rate", (y + p.prior_rows * prior) / (n + p.prior_rows)).withColumn(f"{key}_rows", F.log1p(n)).drop("n", "y", "f", "own")
    return out.select("host", F.col("last_rate").alias("suffix_rate"), F.col("last_rows").alias("suffix_rows"), F.col("domain_rate").alias("domain_rate"))


def fit(labelled: DataFrame, params: UrlParams | None = None, url: str = "url", label: str = "label") -> UrlModel:
    """Learns from rows of a URL and a label (1: block)."""
    p = params or UrlParams()
    used = with_hosts(labelled.select(url, F.col(label).cast("double").alias("_y")), url)
    counts = materialise(used.groupBy(F.col("_host").alias("host")).agg(F.count("_y").alias("n"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("y")), "url-hosts")
    total = counts.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    prior = (total["y"] or 0.0) / max(1, total["n"] or 0)
    hosts = materialise(host_statistics(counts, prior, p), "url-suffixes")
    sample = used.where(F.col("_y").isNotNull()).withColumn("_h", F.xxhash64(url)).orderBy("_h", url, "_y").limit(p.max_training_rows)
    rows = sample.join(hosts, sample["_host"] == hosts["host"]).orderBy("_h", url, "_y").toArrow()
    urls, y = rows[url].to_pylist(), np.array(rows["_y"].to_pylist(), float)
    x = np.array([lexical(u, *host_and_path(u), r) for u, *r in zip(urls, *(rows[k].to_pylist() for k in RATES))]).reshape(-1, len(FEATURES))
    return UrlModel(BoostedTrees(p).fit(x, y), hosts, prior)


def ruled(pages: DataFrame, params: UrlParams | None = None, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """keep, url, host, path, and rule and rule_verdict (null where no rule fits)."""
    p, keep = params or UrlParams(), keep or ["page_id"]
    rules = p.rules

    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        r = Rules(rules)
        for b in batches:
            parts = [host_and_path(u) for u in column_of(b, "url").to_pylist()]
            found = [r.find(*x) or (None, None) for x in parts]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[i] for x in y], pa.string()) for y in (parts, found) for i in (0, 1))], names=[*b.schema.names, "host", "path", "rule", "rule_verdict"])

    used = pages.select(*keep, url).toDF(*names, "url")
    out = used.mapInArrow(run, T.StructType([*used.schema.fields, *(T.StructField(k, T.StringType()) for k in ("host", "path", "rule", "rule_verdict"))]))
    return out.toDF(*keep, url, "host", "path", "rule", "rule_verdict")


def judged(pages: DataFrame, model: UrlModel, params: UrlParams | None = None, url: str = "url", keep: list[str] | None = None) -> DataFrame:
    """keep, host, path, rule, block_probability and verdict: the rule's, else the trees'. Hosts without statistics get the labels' rate."""
    p, keep = params or UrlParams(), keep or ["page_id"]
    sent = pages.sparkSession.sparkContext.broadcast((model.trees, model.prior))  # trees of a fixed size
    own = [f"k{i}" for i in range(len(keep))]
    base = ruled(pages, p, url, keep).toDF(*own, "url", "host", "path", "rule", "rule_verdict")
    size = model.hosts.agg(F.sum(F.octet_length("host") + 40).alias("b")).first()["b"] or 0
    hosts = model.hosts.withColumnRenamed("host", "_of")
    joined = base.join(F.broadcast(hosts) if size <= p.broadcast_bytes else hosts, base["host"] == hosts["_of"], "left").drop("_of")

    def run(batches):
        trees, prior = sent.value
        for b in batches:
            urls, at, paths = (column_of(b, k).to_pylist() for k in ("url", "host", "path"))
            rates = zip(*(column_of(b, k).to_pylist() for k in RATES))
            x = np.array([lexical(u, h, q, r if r[0] is not None else (prior, 0.0, prior)) for u, h, q, r in zip(urls, at, paths, rates)]).reshape(-1, len(FEATURES))
            prob = trees.probability(x)
            verdict = [v or ("block" if q >= p.threshold else "allow") for v, q in zip(column_of(b, "rule_verdict").to_pylist(), prob)]
            yield pa.RecordBatch.from_arrays([*(column_of(b, k) for k in [*own, "host", "path", "rule"]), pa.array(prob), pa.array(verdict, pa.string())], names=[*own, "host", "path", "rule", "block_probability", "verdict"])

    out = joined.mapInArrow(run, T.StructType([*(base.schema[k] for k in [*own, "host", "path", "rule"]), T.StructField("block_probability", T.DoubleType()), T.StructField("verdict", T.StringType())]))
    return out.toDF(*keep, "host", "path", "rule", "block_probability", "verdict")


#: Our own choice: words that hosts of adult, gambling, pharmacy and spam sites carry; a URL whose host has one is labelled 1.
SEED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "viagra", "xxx")


def labelled_by_seeds(pages: DataFrame, words: tuple[str, ...] = SEED_WORDS, url: str = "url") -> DataFrame:
    """All URLs, labelled by seed words between the dots and hyphens of their hosts (1: block). The trees see no words."""

    def run(batches):
        for b in batches:
            urls = column_of(b, url)
            label = [int(any(w in words for w in re.split("[.-]", host_and_path(u)[0]))) for u in urls.to_pylist()]
            yield pa.RecordBatch.from_arrays([urls, pa.array(label, pa.int32())], names=["url", "label"])

    return pages.select(url).mapInArrow(run, "url string, label int")
