"""URL filters: rules first, then naive Bayes over the words of hosts and paths.

Hosts write names in one piece. A unigram Viterbi splits each part of a host into words of the
pages themselves; multinomial naive Bayes then scores host and path tokens. Pages whose host holds a
seed word are its bad examples, all others its good ones. What makes a page an example tells nothing
by itself: a token's odds count only examples that some other word made, so a seed weighs no more
than what stands beside other seeds. Rules say nothing about what they don't fit, so their verdicts
are no examples. All counts are exact and stay in tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import add_columns
from .store import cut

#: Rules as (action, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Words of hosts that no training corpus wants, by kind: adult, gambling, drugs, spam and malware, advertising.
SEEDS = [
    "adult", "porn", "porno", "sex", "sexy", "xxx", "escort", "escorts", "nude", "erotic", "webcam",
    "casino", "casinos", "bet", "bets", "betting", "poker", "slots", "roulette", "lottery", "jackpot",
    "pills", "viagra", "cialis", "pharma", "steroids", "weed",
    "spam", "malware", "phish", "phishing", "warez", "crack", "cracked", "keygen", "torrent", "torrents",
    "ads", "adserver", "advert", "banner", "popup", "track", "tracker", "tracking", "clickbait", "clicks",
]
#: No longer word enters the unigram model. Long names are cut up so many letters at a time.
LONGEST, BLOCK = 30, 2000
#: Odds of tokens at least this frequent are broadcast, at most 1 / FREQUENT of them; the others' are joined. Results are the same.
FREQUENT = 1 / 20_000
#: A page is blocked from this log-odds on.
THRESHOLD = 0.0

_PART = r"([\p{L}\p{N}]+)"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, action) of the longest rule that fits, else null; of two as long the later one in the alphabet."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action")))
        for a, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(w, n): all words of the texts, and seeds, with their counts; a table."""
    words = texts.select(F.explode(F.split(F.lower(F.regexp_replace(text, "<[^>]*>", " ")), r"[^\p{L}]+")).alias("w")).where(f"w <> '' and length(w) <= {LONGEST}")
    seeds = texts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SEEDS))).alias("w"), F.lit(1).cast("long").alias("n"))
    return cut(words.groupBy("w").agg(F.count("*").alias("n")).unionByName(seeds).groupBy("w").agg(F.max("n").alias("n")), "words")


def split_name(name: str, logs: dict[str, float], unknown: float, longest: int = LONGEST) -> list[str]:
    """The most likely words of a name; a letter that no word covers costs `unknown`, and such letters stay together."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
    for j in range(1, len(name) + 1):
        for i in range(max(0, j - longest), j):
            log = logs.get(name[i:j])
            if log is None:
                if j - i > 1:
                    continue
                log = unknown
            if best[i][0] + log > best[j][0]:
                best[j] = (best[i][0] + log, i)
    cuts, j = [], len(name)
    while j:
        cuts.append((best[j][1], j))
        j = best[j][1]
    out, loose = [], False
    for i, j in reversed(cuts):
        known = name[i:j] in logs
        if not known and loose:
            out[-1] += name[i:j]
        else:
            out.append(name[i:j])
        loose = not known
    return out


def _pieces(parts: DataFrame) -> DataFrame:
    """(name, w): all pieces of a part up to the longest word, in time that grows with its length; a long part is named by its digest."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, part in zip(b.column("name").to_pylist(), b.column("part").to_pylist(), strict=True):
                for at in range(0, len(part), BLOCK):
                    stretch = part[at : at + BLOCK + LONGEST - 1]
                    w = sorted({stretch[i : i + k] for i in range(min(BLOCK, len(stretch))) for k in range(1, min(LONGEST, len(stretch) - i) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(w), pa.string()), pa.array(w, pa.string())], names=["name", "w"])

    return parts.select("name", "part").mapInArrow(cut_up, "name string, w string")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of distinct hosts: each part split on its own, with the counts of all its pieces that are words."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1
    part_of = F.explode(F.array_distinct(F.regexp_extract_all("host", F.lit(_PART), 1))).alias("part")
    parts = hosts.select(part_of).distinct().withColumn("name", F.when(F.length("part") > LONGEST, F.sha2("part", 256)).otherwise(F.col("part")))
    found = _pieces(parts).join(counts, "w").groupBy("name").agg(F.collect_set(F.struct("w", "n")).alias("known"))  # of a part's pieces those that are words
    found = parts.join(found, "name", "left")

    def split(batch: pa.RecordBatch) -> list:
        out = []
        for part, known in zip(batch.column("part").to_pylist(), batch.column("known").to_pylist(), strict=True):
            logs = {x["w"]: math.log(x["n"] / total) for x in known or []}
            out.append(split_name(part, logs, math.log(1 / total) - 3))
        return [pa.array(out, pa.list_(pa.string()))]

    words = add_columns(found, "words array<string>", split).select("part", "words")
    placed = hosts.select("host", F.posexplode(F.regexp_extract_all("host", F.lit(_PART), 1)).alias("at", "part")).join(words, "part")
    return placed.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))


def tokens(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, path, n, tokens) of the distinct hosts and paths of pages: the host's words, then the path's, numbers as one token; a table."""
    pairs = pages.groupBy("host", "path").agg(F.count("*").alias("n"))
    words = host_words(pages.select("host").distinct(), counts)
    of_path = F.transform(F.regexp_extract_all("path", F.lit(_PART), 1), lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("p:0")).otherwise(F.concat(F.lit("p:"), F.lower(x))))
    of_host = F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda x: F.concat(F.lit("h:"), x))
    return cut(pairs.join(words, "host", "left").select("host", "path", "n", F.concat(of_host, of_path).alias("tokens")), "urls")


def train(pairs: DataFrame) -> tuple[DataFrame, float]:
    """(t, n, odds) of all tokens, a table, and the log-odds of a page.

    odds is the token's log-odds of bad over good, with one added to its counts of each. A page is bad
    for a token if its host holds a seed other than that token.
    """
    seeds = F.array(*[F.lit("h:" + w) for w in SEEDS])
    marked = pairs.select("n", "tokens", F.size(F.array_intersect("tokens", seeds)).alias("seeds"))
    pages, bad_pages = marked.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("seeds") > 0, F.col("n"))), F.lit(0))).first()
    each = marked.select("n", "seeds", F.explode("tokens").alias("t"))
    bad = F.col("seeds") - F.when(F.col("t").isin(*["h:" + w for w in SEEDS]), 1).otherwise(0) > 0
    by = cut(each.groupBy("t").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("bad")), "tokens")
    total, total_bad, v = by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    odds = F.log((F.col("bad") + 1) / (total_bad + v + 1)) - F.log((F.col("n") - F.col("bad") + 1) / (total - total_bad + v + 1))
    return by.select("t", "n", odds.alias("odds")), math.log((bad_pages + 1) / (pages - bad_pages + 1))


def score_pairs(pairs: DataFrame, odds: DataFrame, prior: float) -> DataFrame:
    """(host, path, words, score): each pair's log-odds, the prior and those of its tokens, repeats included."""
    total = odds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = pairs.select("host", "path", F.explode("tokens").alias("t"))
    often = odds.where(F.col("n") >= FREQUENT * total).select("t", "odds")
    there = each.join(F.broadcast(often), "t", "left")
    rare = there.where("odds is null").drop("odds").join(odds.where(F.col("n") < FREQUENT * total).select("t", "odds"), "t")
    # Tokens of each kind are summed up before the two meet.
    sums = [x.groupBy("host", "path").agg(F.sum("odds").alias("odds")) for x in (there.where("odds is not null"), rare)]
    score = sums[0].unionByName(sums[1]).groupBy("host", "path").agg(F.sum("odds").alias("odds"))
    return pairs.join(score, ["host", "path"], "left").select("host", "path", F.col("tokens").alias("words"), F.round(F.coalesce("odds", F.lit(0.0)) + prior, 9).alias("score"))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, words, score): one row for each row of pages.

    A rule's verdict stands; else a page with log-odds above THRESHOLD is blocked. Null urls and
    those without :// have empty host and path, and only the prior speaks. Repeated rows count each.
    """
    base = pages.select(F.col(key).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    pairs = tokens(base, word_counts(pages, text))
    scored = base.join(score_pairs(pairs, *train(pairs)), ["host", "path"]).withColumn("fits", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    verdict = F.coalesce(F.col("fits.action"), F.when(F.col("score") > THRESHOLD, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(key), "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "words", "score")
