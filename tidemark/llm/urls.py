"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Linear, fit

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = 1 << 14
GRAMS = (3, 4, 5)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

# The small labelled table: url, 1 for unwanted. Host words of unwanted sites beside words of ordinary ones, on the same
# endings and paths, so that neither says anything.
LABELLED = tuple(
    (f"http://{host}.{ending}{path}", label)
    for label, hosts in (
        (1, ("casino-win", "best-casino", "online-casino", "free-bets", "sport-bets", "bets-now", "cheap-pills",
             "pills-shop", "poker-star", "free-poker", "slots-bonus", "jackpot-win", "viagra-shop", "cheap-viagra",
             "payday-loans", "quick-loans", "xxx-videos", "porn-tube", "free-porn", "crack-serial", "warez-free",
             "torrent-movies", "replica-watches", "adult-dating", "hot-dating", "click-bonus", "free-money",
             "get-rich", "buy-followers", "cheap-meds", "spam-links", "link-farm", "ads-server", "track-click",
             "adult-video")),
        (0, ("news", "daily-news", "wiki", "docs", "library", "museum", "university", "school", "science", "weather",
             "city-council", "history", "recipes", "garden", "travel", "music", "forum", "support", "research",
             "garment", "thinker", "nations", "station", "theory", "there", "another", "letters", "stories",
             "reading", "therein", "farmers-market", "addresses", "adults-education", "clinic", "tracks", "book-shop",
             "flower-shop", "free-software", "online-library", "best-recipes", "sport-news", "quick-start",
             "cheap-flights", "video-lectures", "hot-springs", "link-list", "buy-local")),
    )
    for host in hosts
    for ending, path in (("example.com", "/en/1"), ("example.org", "/de/2.html"), ("example.net", "/fr/3/"))
)


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lower-cased, path up to ``?`` or ``#``; else both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """``value`` of the longest rule that fits a host (or one above it) and begins the path; null without one."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(value(rule))).otherwise(found)
    return found


def _features(host: str, path: str) -> list[int]:
    """Hashed n-grams of the host's labels and of the path's parts, each kept apart and marked at its ends."""
    found = set()
    for kind, text in (("h", host), ("p", path)):
        for part in text.replace("/", ".").split("."):
            marked = f"^{part}$"
            found.update(zlib.crc32(f"{kind}{n}{marked[k:k + n]}".encode()) % FEATURES
                         for n in GRAMS for k in range(len(marked) - n + 1))
    return sorted(found)


def train(labelled: DataFrame, rows: int = 5000) -> Linear:
    """Fit P(unwanted) on at most ``rows`` of the labelled urls (url, label), by hash; null labels are left out."""
    host, path = parsed(F.col("url"))
    sample = (
        labelled.where(F.col("label").isNotNull()).select(host.alias("host"), path.alias("path"), "url", "label")
        .orderBy(F.xxhash64("url"), "url", "label").limit(rows).collect()
    )
    lists = [_features(r["host"], r["path"]) for r in sample]
    sizes = [len(x) for x in lists]
    index = np.concatenate([np.asarray(x, np.int64) for x in lists]) if lists else np.zeros(0, np.int64)
    # Each url weighs alike however long it is.
    value = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
    return fit(np.repeat(np.arange(len(sizes)), sizes), index, value, np.array([float(r["label"]) for r in sample]),
               FEATURES, rate=0.1, ridge=1e-2)


def judge(pages: DataFrame, model: Linear, rules: Sequence[Rule] = RULES, threshold: float = 0.8) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none), verdict (block or allow), p_unwanted.

    The verdict is the rule's; without one the model blocks from ``threshold`` on. A null url or one without ``://``
    has an empty host and path and is allowed. No shuffle; only page_id and url are read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def unwanted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        linear: Linear = shared.value
        for hosts, paths in batches:
            lists = [_features(h, p) for h, p in zip(hosts, paths, strict=True)]
            margin = np.array([linear.weights[x].sum() / np.sqrt(max(len(x), 1)) for x in lists])
            yield pd.Series(linear.probability(margin))

    host, path = parsed(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    host, path = F.col("host"), F.col("path")
    scored = split.withColumn("p_unwanted", unwanted(host, path))
    own = F.when((host != "") & (F.col("p_unwanted") >= threshold), "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", matched(host, path, rules, lambda r: r.name).alias("rule"),
        F.coalesce(matched(host, path, rules, lambda r: r.verdict), own).alias("verdict"), "p_unwanted")
