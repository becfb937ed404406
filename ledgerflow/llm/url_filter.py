"""URL rules and a logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver on a small labelled table (a documented bound); judging is an expression of
built-in functions in the scan's own stage: no shuffle, no Python on executors, no join.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (host, path prefix, verdict); a rule fits its host and all subdomains.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: The labelled URLs that the model is fitted on (1: block).  At most MAX_ROWS rows are taken.
MAX_ROWS = 10_000
LABELLED = tuple(
    [(u, 1) for u in (
        "http://cheap-pills.test/buy/viagra", "https://www.best-pills-online.test/order", "http://spam-farm.test/links/1", "https://link-farm.test/page/22",
        "http://casino-royal.test/bonus", "https://online-casino.test/slots/free-spins", "http://win-money.test/lottery/claim", "https://free-iphone.test/prize/winner",
        "http://xxx-videos.test/watch/77", "https://adult-cams.test/live", "http://payday-loans.test/apply-now", "https://cheap-loans.test/fast-cash",
        "http://replica-watches.test/sale", "https://cheap-watches.test/discount/99", "http://crypto-double.test/invest", "https://bet-sport.test/odds/football",
        "http://download-crack.test/keygen/serial", "https://warez-torrent.test/full-crack", "http://hot-singles.test/meet", "https://click-here.test/offer?id=1",
        "https://blog.cheap-pills.test/en/12", "http://m.spam-farm.test/fr/40", "https://www.spam-farm.test/de/9", "http://poker-bonus.test/en/5",
    )] + [(u, 0) for u in (
        "https://www.library.test/en/catalogue/12", "http://news.daily.test/2021/05/politics", "https://docs.python.test/3/library/os.html", "http://museum.test/exhibitions",
        "https://university.test/departments/history", "http://blog.gardening.test/en/roses/44", "https://m.weather.test/de/berlin", "http://recipes.test/fr/soup/88.html",
        "https://en.encyclopedia.test/wiki/Physics", "http://city-council.test/minutes/2020", "https://journal.test/articles/10-1000", "http://forum.linux.test/thread/5521",
        "https://www.theatre.test/es/programme/3", "http://school.test/timetable.html", "https://blog.travel.test/en/norway/fjords", "http://health.test/topics/nutrition",
        "https://maps.test/en/853/", "http://archive.test/en/960", "https://radio.test/es/478?page=2", "http://books.test/fr/414", "https://thereader.test/en/671",
        "http://station.test/en/25#top", "https://m.gallery.test/en/685", "https://www.hospital.test/en/474.html",
    )]
)


@dataclass(frozen=True)
class UrlModel:
    buckets: int = 2048
    gram: int = 3
    rounds: int = 400
    rate: float = 2.0
    ridge: float = 1e-3


def split_url(url: str | None) -> tuple[str, str]:
    """The plain meaning of host and path, for the labelled table and tests."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:end], rest[end:]
    cut = min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:cut]


def grams(host: str, path: str, model: UrlModel) -> list[int]:
    """Bucket of each character n-gram of '^host$' and of '~path$'."""
    return [zlib.crc32(s[i : i + model.gram].encode()) % model.buckets for s in (f"^{host}$", f"~{path}$") for i in range(len(s) - model.gram + 1)]


@lru_cache(maxsize=8)
def fit(rows: tuple[tuple[str, int], ...] = LABELLED, model: UrlModel = UrlModel()) -> tuple[tuple[float, ...], float]:
    """(weight of each bucket, bias) by full-batch gradient descent; features are n-gram shares."""
    seen = []
    for url, label in rows[:MAX_ROWS]:
        found = grams(*split_url(url), model)
        seen.append(([(g, found.count(g) / len(found)) for g in set(found)], label))
    weights, bias = [0.0] * model.buckets, 0.0
    for _ in range(model.rounds):
        step, shift = {}, 0.0
        for features, label in seen:
            z = bias + sum(weights[g] * v for g, v in features)
            miss = label - 1 / (1 + math.exp(-z))
            shift += miss / len(seen)
            for g, v in features:
                step[g] = step.get(g, 0.0) + miss * v
        bias += 0.1 * model.rate * shift
        for g, v in step.items():
            weights[g] += model.rate * (v - model.ridge * weights[g])
    return tuple(round(w, 6) for w in weights), round(bias, 6)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def _adder(table: Column, s: Column, model: UrlModel):
    """The step that adds the weight of the n-gram of s at a place."""

    def step(total: Column, at: Column) -> Column:
        bucket = F.crc32(F.encode(F.substr(s, at, F.lit(model.gram)), "UTF-8")) % model.buckets
        return total + F.get(table, bucket.cast("int"))

    return step


def url_filter(df: DataFrame, url_col: str = "url", rules=RULES, labelled=LABELLED, model: UrlModel = UrlModel(), threshold: float = 0.5) -> DataFrame:
    """All columns of df, and host, path, rule, verdict, block_score (the model's probability).

    The longest rule that fits decides, else the model; a probability of exactly the threshold allows.  A null url, or one
    without '://', has an empty host and path and gets the model's verdict on them.  Columns of df with one of these
    names are replaced.  Rows are judged alone, so repeated rows get equal verdicts, an empty table gives an empty one,
    and a url is taken whole, however long.
    """
    weights, bias = fit(tuple(labelled), model)
    made = ["host", "path", "rule", "verdict", "block_score"]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in made]
    host, path = host_path(F.col(f"`{url_col}`"))
    rows = df.select(*keep, host.alias("__u_h"), path.alias("__u_p"))
    h, p = F.col("__u_h"), F.col("__u_p")
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    total, count = F.lit(0.0), F.lit(0)
    for s in (F.concat(F.lit("^"), h, F.lit("$")), F.concat(F.lit("~"), p, F.lit("$"))):
        n = F.length(s) - (model.gram - 1)
        part = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), _adder(table, s, model))
        total = total + F.when(n > 0, part).otherwise(F.lit(0.0))
        count = count + F.greatest(n, F.lit(0))
    rows = rows.withColumn("__u_s", 1 / (1 + F.exp(-(F.lit(bias) + total / F.greatest(count, F.lit(1))))))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest stands outermost
        fits = ((h == domain) | F.endswith(h, F.lit("." + domain))) & F.startswith(p, F.lit(prefix))
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    judged = F.when(F.col("__u_s") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(*keep, h.alias("host"), p.alias("path"), rule.alias("rule"), F.coalesce(verdict, judged).alias("verdict"), F.col("__u_s").alias("block_score"))
