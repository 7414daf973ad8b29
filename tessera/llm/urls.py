"""URL filter: host and path rules first, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import BASE, code_points, mix

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: The labelled URL table: names and paths of sites that a crawl wants (ALLOWED) or does not (BLOCKED). Each stands for some urls (see labelled).
BLOCKED = [
    "casinoroyal/slots", "lucky-casino/bonus", "poker-room/tables", "slots-jackpot/play", "roulette-live/spin", "jackpot-city/signup", "bet-online/odds", "sportsbetting/live", "bingo-win/cards", "gambling-tips/win",
    "viagra-online/order", "pharmacy-discount/buy", "pillshop/cart", "weight-loss-pills/trial", "buy-steroids/order", "cheap-meds/checkout", "discount-pharma/pills", "male-enhance/trial",
    "adserver/banner", "adclick/redirect", "trackpixel/1x1.gif", "popunder-ads/load", "tracking-beacon/collect", "affiliate-tracker/go", "clicktrack/out", "banner-exchange/ads", "ads-network/serve",
    "spammail/unsubscribe", "link-farm/links", "seo-spam/backlinks", "freetraffic/hits", "spamblog/posts", "bulk-mailer/list", "content-farm/articles", "spam-host/redirect",
    "xxxvideos/hot", "adult-dating/join", "sex-cams/live", "porn-videos/free", "nude-pics/gallery", "adultshop/toys", "escort-girls/city", "hot-xxx/clips", "adult-chat/rooms",
    "payday-loans/apply", "quick-cash/loan", "crypto-doubler/invest", "forex-signals/win", "get-rich-now/start", "bitcoin-giveaway/claim",
    "replica-watches/sale", "cheap-handbags/buy", "fake-rolex/shop", "outlet-sneakers/discount", "free-iphone/winner", "prize-claim/you-won", "lottery-winner/claim", "free-gifts/claim",
    "warez-download/crack", "keygen-serial/get", "torrent-movies/free", "cracked-software/download", "malware-host/exe", "phishing-login/bank",
]
ALLOWED = [
    "citylibrary/catalog", "gardening/roses", "morningnews/politics", "university/research", "python-docs/tutorial", "weather/forecast", "history/rome", "museum/exhibits", "cooking/soups", "science/papers", "musicforum/thread", "hospital/visitors", "nature/forests",
    "philosophy/essays", "primary-school/lessons", "citymaps/streets", "railway/timetable", "parliament/debates", "health/articles", "radio/programme", "books/chapter", "encyclopedia/entry", "farmers/harvest", "travel/journal", "town-council/minutes", "preprints/physics",
    "orchestra/season", "botany/plants", "astronomy/stars", "recipes/bread", "engineering/bridges", "language/grammar", "poems/autumn", "geology/rocks", "volunteers/about", "carpentry/joints", "football/results", "chess/openings", "national-archive/letters", "steel/works",
    "law/statutes", "charity/report", "painting/oil", "birds/songs", "mountains/paths", "ocean/currents", "kitchen/notes", "teachers/plans", "village/church", "rivers/fish", "grammar/verbs", "knitting/patterns", "cinema/reviews", "physics/optics", "opera/libretto",
    "translation/notes", "tradition/dances", "fiction/stories", "question/answers", "editors/letters", "reader/columns", "winter/walks", "linen/weaving",
]
#: How hosts and paths look in a crawl; both classes are shown in all of these shapes, so that none of them says anything.
PREFIXES, SUFFIXES = ("", "www.", "m.", "blog."), (".example.com", ".com", ".example.org", ".org", ".example.net", ".net")
SHAPES = ("/", "/en/12", "/fr/3407.html", "/de/40/", "/es/5811", "/en/8265/", "/fr/77", "/de/6130.html")


def labelled(sites: list[str]) -> list[str]:
    """Urls of labelled sites: each under four hosts, once with its own path and three times with a common one."""
    out = []
    for i, site in enumerate(sites):
        name, _, path = site.partition("/")
        for k in range(4):
            host = PREFIXES[(i + k) % len(PREFIXES)] + name + SUFFIXES[(i // 4 + k) % len(SUFFIXES)]
            out.append(host + (SHAPES[(i // 2 + 3 * k) % len(SHAPES)] if k else f"/{path}"))
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://` or for a null."""
    at = F.locate("://", url)
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + F.lit(3))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


_SAID = "__verdict of the rule"


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text (host and path, like `net/`), and its verdict; nulls if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    chain = lambda values: reduce(lambda c, fv: c.when(fv[0], F.lit(fv[1])), list(zip(fits, values, strict=True))[1:], F.when(fits[0], F.lit(values[0])))
    return chain([h + p for _, h, p in ordered]), chain([v for v, _, _ in ordered])


def ngram_ids(text: str, bits: int, low: int = 3, high: int = 5) -> np.ndarray:
    """Hashed ids of all character n-grams of `^text$`, low to high characters long."""
    c = code_points(f"^{text}$").astype(np.uint64) + np.uint64(1)
    found = []
    for n in range(low, min(high, len(c)) + 1):
        h = np.full(len(c) - n + 1, n, np.uint64)
        for i in range(n):
            h = h * BASE + c[i : len(c) - n + 1 + i]
        found.append(mix(h) >> np.uint64(64 - bits))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def features(host: str, path: str, bits: int) -> np.ndarray:
    """Ids of the distinct n-grams of host and path; the two have ids of their own."""
    return np.unique(np.concatenate([ngram_ids(host, bits), ngram_ids(path, bits) + (1 << bits)]))


def train(blocked: list[str], allowed: list[str], bits: int = 18, steps: int = 300, rate: float = 1.0, l2: float = 1e-3, prior: float = 0.4) -> np.ndarray:
    """Weights (the bias last) of the logistic regression, by gradient descent over the labelled table.

    The classes weigh as `prior` (the share of blocked urls to be expected) says, whatever their numbers of rows. Only the n-grams of the
    table get a weight; a url without any of them is judged by the bias.
    """
    blocked, allowed = labelled(blocked), labelled(allowed)
    rows = [features(*_cut(u), bits) for u in blocked + allowed]
    known, column = np.unique(np.concatenate(rows), return_inverse=True)
    y = np.array([1.0] * len(blocked) + [0.0] * len(allowed))
    share = np.where(y > 0, prior / max(1, len(blocked)), (1 - prior) / max(1, len(allowed)))
    size = np.array([len(r) for r in rows])
    x = np.zeros((len(rows), len(known)), np.float32)
    x[np.repeat(np.arange(len(rows)), size), column] = np.repeat(1 / np.sqrt(np.maximum(1, size)), size)
    # the weights stay sums of rows, so the descent runs over the rows' own coefficients and products
    inner, of, bias = (x @ x.T).astype(np.float64), np.zeros(len(rows)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(inner @ of + bias, -30, 30)))
        miss = share * (p - y) * 4
        of -= rate * (miss + l2 * of)
        bias -= rate * miss.sum()
    out = np.zeros((2 << bits) + 1)
    out[known], out[-1] = of @ x, bias
    return out


def held_out_accuracy(blocked: list[str], allowed: list[str], folds: int = 5) -> tuple[float, float]:
    """(share of blocked, share of allowed urls judged right) by models that were not trained on them."""
    right = [0, 0]
    for f in range(folds):
        keep = lambda urls, f=f: [u for i, u in enumerate(urls) if i % folds != f]
        w = train(keep(blocked), keep(allowed))
        for kind, urls in enumerate((blocked, allowed)):
            right[kind] += sum((probability(*_cut(u), w) >= 0.5) == (kind == 0) for u in labelled(urls[f::folds]))
    return right[0] / len(labelled(blocked)), right[1] / len(labelled(allowed))


def probability(host: str, path: str, weights: np.ndarray, bits: int = 18) -> float:
    """That a url is unwanted."""
    ids = features(host, path, bits)
    z = weights[ids].sum() / np.sqrt(max(1, len(ids))) + weights[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _cut(url: str) -> tuple[str, str]:
    host, slash, path = url.partition("/")
    return host, slash + path


def score_urls(df: DataFrame, weights: np.ndarray, bits: int = 18) -> DataFrame:
    """Add block_score: the probability that a url is unwanted, from its columns host and path."""
    sent = df.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = sent.value
        for hosts, paths in parts:
            known: dict = {}
            out = np.empty(len(hosts))
            for i, key in enumerate(zip(hosts, paths, strict=True)):
                if (s := known.get(key)) is None:
                    s = known[key] = probability(*key, w, bits)
                out[i] = s
            yield pd.Series(out)

    return df.withColumn("block_score", score("host", "path"))


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, threshold: float = 0.5) -> DataFrame:
    """Judge every row's url: adds host, path, rule, block_score and verdict (allow or block).

    A null url, or one without `://`, has an empty host and path; no rule fits it and the model judges the empty strings. Other columns
    are kept; columns named like those added are replaced. The model is trained on the two labelled lists, which are parameters. Equal urls
    are judged alike, repeated rows each; two rules of one length go by host, then path; an empty table gives no rows; a very long url is
    judged whole.
    """
    host, path = split_url(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    rule, said = rule_column(F.col("host"), F.col("path"), rules)
    df = score_urls(df.withColumns({"rule": rule, _SAID: said}), train(blocked, allowed))
    return df.withColumn("verdict", F.coalesce(_SAID, F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))).drop(_SAID)


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.round("block_score", 9).alias("block_score"))
