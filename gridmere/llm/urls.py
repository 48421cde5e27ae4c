"""URL filters: rules, and a naive Bayes classifier on segmented host names and paths.

Host names such as `cheappills` are split into words by a unigram Viterbi search, host labels and path parts alike; a
multinomial naive Bayes model over the words scores host and path. The unigram lexicon counts in how many distinct hosts
and paths a word stands by itself, and adds page-independent seed words. A host label that is one piece tells nothing about
words, as it may be joined, and does not count; parts of paths and of labels with hyphens do, unless other words put
together are likelier. A name is split into known words only, or stays whole: `pharma` is no word of `pharmacology`. The model is
fitted on all URLs, where a host that has a seed word of unwanted sites counts as an example of block (weak labels: no
table has labels of URLs). Rules stand above the model: a rule fits its host and all subdomains if the path starts with
the rule's, and the longest one that fits wins.

Null URLs and those without `://` have empty host and path, fit no rule and are allowed unless the empty word list is
likelier under block. Repeated URLs get equal verdicts. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Words of unwanted sites: the model's weak labels, and part of the lexicon. Fixed values.
SEEDS = "ads adult bet bets betting casino cheap click clicks crack farm free gambling loan loans malware payday pharma phish pills poker porn prize replica sex spam tracker track viagra warez win winner xxx".split()
#: Seed words that alone make a host an example of block. Fixed values.
STRONG = frozenset("ads adult bets betting casino gambling malware payday pharma phish pills poker porn spam viagra warez xxx".split())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Greatest number of lexicon words, the most frequent ones, and of model words that are broadcast, beyond which weights are
#: joined; longest word.
LEXICON, MODEL_WORDS, LONGEST = 300_000, 100_000, 24
#: (verdict, host, path) of the rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for decision, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi: the split whose words have the greatest product of probabilities."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: log(n / total) for w, n in counts.items()}
        self.unknown = [log(10 / (total * 10.0**n)) for n in range(LONGEST + 1)]

    def split(self, text: str) -> list[str]:
        cost, unknown = self.cost, self.unknown
        best, back = [0.0], [0]
        for end in range(1, len(text) + 1):
            top, start = -1e300, end - 1
            for a in range(max(0, end - LONGEST), end):
                word = text[a:end]
                s = best[a] + (cost[word] if word in cost else unknown[end - a])
                if s > top:
                    top, start = s, a
            best.append(top)
            back.append(start)
        out, end = [], len(text)
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]


def words_of(segmenter: Segmenter, host: str, path: str, memory: dict[str, list[str]]) -> list[str]:
    """Words of host (`h:`) and path (`p:`); numbers count as one word."""
    out = []
    for kind, text in (("h:", host), ("p:", path)):
        for part in re.findall(r"[^\W\d_]+|\d+", text):
            if part[0].isdigit():
                out.append(kind + "#")
                continue
            part = part.lower()
            if part not in memory:
                if len(memory) > 100_000:
                    memory.clear()
                split = segmenter.split(part)
                memory[part] = split if all(w in segmenter.cost for w in split) else [part]
            out += [kind + w for w in memory[part]]
    return out


def explained(counts: dict[str, int]) -> set[str]:
    """Words that are not as likely as others, of three letters at least, put together: joined names."""
    total = sum(counts.values()) or 1
    cost = {w: log(n / total) for w, n in counts.items()}
    out = set()
    for word, own in cost.items():
        best = {0: 0.0}
        for end in range(3, len(word) + 1):
            ways = [best[a] + cost[word[a:end]] for a in best if 3 <= end - a < len(word) and word[a:end] in cost]
            if ways:
                best[end] = max(ways)
        if best.get(len(word), -1e300) >= own:
            out.add(word)
    return out


def lexicon(parts: DataFrame) -> dict[str, int]:
    """In how many distinct hosts and paths a word stands by itself, and the seed words as often as the median one."""
    letters = lambda text: F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    labels = F.filter(F.transform(F.split("host", r"\."), letters), lambda words: F.size(words) > 1)
    found = [parts.select("host").distinct().select(F.flatten(labels).alias("words")), parts.select("path").distinct().select(letters(F.col("path")).alias("words"))]
    words = found[0].unionByName(found[1]).select(F.explode(F.array_distinct("words")).alias("word"))
    counted = words.filter(f"word <> '' AND length(word) <= {LONGEST}").groupBy("word").count().orderBy(F.desc("count"), "word").limit(LEXICON)
    counts = {r["word"]: r["count"] for r in counted.collect()}
    usual = sorted(counts.values())[len(counts) // 2] if counts else 1
    counts |= {s: max(counts.get(s, 0), usual) for s in SEEDS}
    joined = explained(counts).difference(SEEDS)
    return {w: n for w, n in counts.items() if w not in joined}


def _tokens(parts: DataFrame, counts: dict[str, int]) -> DataFrame:
    """(token, label, n) of each batch of URLs."""
    shared = parts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, memory = Segmenter(shared.value), {}
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(segmenter, host, path, memory)
                label = int(any(w[2:] in STRONG for w in words if w[0] == "h"))
                for w in [*words, "url"]:
                    found[w, label] = found.get((w, label), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["token", "label", "n"])

    return parts.select("host", "path").mapInArrow(run, "token string, label int, n long")


def fit(parts: DataFrame, counts: dict[str, int], smooth: float = 1.0) -> tuple[DataFrame, float, float]:
    """(token, odds): log odds of block by word, those of a word that the model lacks, and those of URLs at large."""
    sums = _tokens(parts, counts).groupBy("token").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    by_token, _ = written(sums, "tokens")
    urls = by_token.filter("token = 'url'").first()
    bad, good, size = by_token.filter("token <> 'url'").agg(F.sum("bad"), F.sum("good"), F.count(F.lit(1))).first()
    if not size:
        return by_token.select("token", F.lit(0.0).alias("odds"), F.lit(0).cast("long").alias("n")).limit(0), 0.0, -log(2)
    base = log((good + smooth * (size + 1)) / (bad + smooth * (size + 1)))
    odds = by_token.filter("token <> 'url'").select("token", (F.log((F.col("bad") + smooth) / (F.col("good") + smooth)) + base).alias("odds"), (F.col("bad") + F.col("good")).alias("n"))
    return odds, base, log((urls["bad"] + 1) / (urls["good"] + 2))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, spam_score, words)."""
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    counts = lexicon(parts)
    model, base, prior = fit(parts, counts)
    top = {r["token"]: r["odds"] for r in model.orderBy(F.desc("n"), "token").limit(MODEL_WORDS).collect()}
    whole = model.count() <= MODEL_WORDS  # else the rarer words' weights are joined to the URLs that have them
    shared = pages.sparkSession.sparkContext.broadcast((counts, top, base, prior))
    rule, decision = rule_of(F.col("host"), F.col("path"), rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, odds, other, prior = shared.value
        segmenter, memory = Segmenter(known), {}
        for batch in batches:
            sums, texts, rare = [], [], []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                words = words_of(segmenter, h, p, memory)
                sums.append(prior + sum(odds.get(w, other if whole else 0.0) for w in words))
                texts.append(" ".join(words))
                rare.append([] if whole else [w for w in words if w not in odds])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.float64()), pa.array(texts, pa.string()), pa.array(rare, pa.list_(pa.string()))], names=[*batch.schema.names, "total", "words", "rare"])

    kind = pages.schema[id_col].dataType.simpleString()
    ruled = parts.select(id_col, "host", "path", rule.alias("rule"), decision.alias("ruled"))
    scored = ruled.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, ruled string, total double, words string, rare array<string>")
    if not whole:
        scored, _ = written(scored, "urls")
        wanted = scored.filter(F.size("rare") > 0).select("host", "path", "rare").dropDuplicates(["host", "path"]).select("host", "path", F.explode("rare").alias("token"))
        more = wanted.join(model.select("token", "odds"), "token", "left").groupBy("host", "path").agg(F.sum(F.coalesce("odds", F.lit(base))).alias("more"))
        scored = scored.join(more, ["host", "path"], "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    score = 1 / (1 + F.exp(-F.greatest(F.least("total", F.lit(60.0)), F.lit(-60.0))))
    judged = scored.withColumn("spam_score", score)
    own = F.when(F.col("spam_score") >= 0.5, "block").otherwise("allow")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "spam_score", "words")
