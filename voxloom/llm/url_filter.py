"""URL filter: host and path rules, and a character language-model ratio for what no rule decides. DataFrame functions only.

Two smoothed variable-order Markov models of characters are learned, one from the URLs that a rule allows and one from
those that a rule blocks. A character's probability after its context interpolates all orders up to ``ORDER``:
``p_k = (n(context, char) + ALPHA * p_(k-1)) / (n(context) + ALPHA)``, so an order that has not seen its context hands on
the shorter one's value, and below order 0 every code point has the same chance; the chances of all characters after a
context add up to 1. Counts are exact and grow with the URLs: a table by order and string. What a position contributes
depends on its last ``ORDER + 1`` characters only, so the ratio is computed once for each distinct string of that length
and joined to the positions of the distinct URLs; it travels as a whole number of 1e-12, so sums do not depend on their order.

A URL's score is the difference of its two log-likelihoods divided by the characters predicted. The threshold is
calibrated on URLs that the counts have not seen (the first digit of the URL's MD5 decides): the point at which both
classes, taken as normal, err alike.

Edge cases: a null URL or one without ``://`` has an empty host and path, so no rule fits; a null URL scores as an empty
one; without allowed or without blocked URLs to learn from there is no ratio, and what no rule decides is allowed; repeated
rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import materialize, maybe_broadcast

ORDER = 3
ALPHA = 0.5
CODE_POINTS = 0x110000
#: Parts of a log-likelihood that are summed as whole numbers.
UNIT = 1e12
#: Rows of a table of strings (under 100 bytes each) and of URLs up to which it may be broadcast.
BROADCAST_ROWS, BROADCAST_URLS = 200_000, 50_000
#: Stand-ins for what precedes and ends a URL.
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", False),
    Rule("example.com", "/en/7", True),
    Rule("net", "/de/", True),
    Rule("example.net", "/de/8", False),
    Rule("org", "/es/", False),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, allowed) of the longest rule that fits the host, or a parent domain of it, and the path's start."""
    name, allowed = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        allowed = F.when(fits, F.lit(rule.allow)).otherwise(allowed)
    return name, allowed


def padded(url: Column) -> Column:
    return F.concat(F.lit(START * ORDER), F.coalesce(url, F.lit("")), F.lit(END))


def grams_of(url: Column) -> Column:
    """For each predicted character, the URL's and the end, the last ORDER + 1 characters."""
    text = padded(url)
    return F.transform(F.sequence(F.lit(1), F.length(text) - ORDER), lambda i: F.substring(text, i, F.lit(ORDER + 1)))


def _keys(gram: Column) -> Column:
    """(kind, key) of the counts that a string's last character needs: of each order its context's and its own."""
    found = []
    for k in range(ORDER + 1):
        found.append(F.struct(F.lit(2 * k).alias("kind"), F.substring(gram, ORDER + 1 - k, k).alias("key")))
        found.append(F.struct(F.lit(2 * k + 1).alias("kind"), F.substring(gram, ORDER + 1 - k, k + 1).alias("key")))
    return F.array(*found)


def count_strings(urls: DataFrame) -> DataFrame:
    """(kind, key, a, r): how often contexts (even kinds) and contexts with their character occur in (url, allowed)."""
    grams = urls.select("allowed", F.explode(grams_of(F.col("url"))).alias("gram"))
    longest = grams.groupBy("gram").agg(F.count_if("allowed").alias("a"), F.count_if(~F.col("allowed")).alias("r"))
    each = longest.select(F.explode(_keys(F.col("gram"))).alias("k"), "a", "r")
    return each.groupBy("k.kind", "k.key").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))


def gram_ratios(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, part): log of the two models' chances of a string's last character, in units, for each distinct gram."""
    need = grams.distinct().select("gram", F.explode(_keys(F.col("gram"))).alias("k")).select("gram", "k.kind", "k.key")
    found = need.join(maybe_broadcast(model, model.count(), BROADCAST_ROWS), ["kind", "key"], "left")
    columns = [F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(side))), F.lit(0)).alias(f"{side}{kind}") for kind in range(2 * ORDER + 2) for side in "ar"]
    counted = found.groupBy("gram").agg(*columns)

    def chance(side: str) -> Column:
        p = F.lit(1.0 / CODE_POINTS)
        for k in range(ORDER + 1):
            p = (F.col(f"{side}{2 * k + 1}") + ALPHA * p) / (F.col(f"{side}{2 * k}") + ALPHA)
        return F.ln(p)

    return counted.select("gram", F.round((chance("a") - chance("r")) * UNIT).cast("long").alias("part"))


def scores(urls: DataFrame, model: DataFrame) -> DataFrame:
    """(url, score) of each distinct URL (null as empty): log-likelihood of the accepted model less that of the rejected one by character."""
    rows = urls.select(F.coalesce("url", F.lit("")).alias("url")).distinct().select("url", F.explode(grams_of(F.col("url"))).alias("gram"))
    ratios = materialize(gram_ratios(rows.select("gram"), model), "url-ratios")
    joined = rows.join(maybe_broadcast(ratios, ratios.count(), BROADCAST_ROWS), "gram")
    return joined.groupBy("url").agg((F.sum("part") / UNIT / F.count(F.lit(1))).alias("score"))


def fit(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, threshold) tables from (url, allowed), of distinct URLs; threshold is one row, null where a class is missing."""
    labelled = labelled.distinct()
    counted = F.substring(F.md5(F.col("url").cast("binary")), 1, 1) > "3"
    model = materialize(count_strings(labelled.filter(counted)), "url-model")
    held = labelled.filter(~counted)
    scored = held.join(scores(held, model), "url")
    stats = scored.agg(
        *(f(F.when(F.col("allowed") == flag, F.col("score"))).alias(f"{name}_{kind}")
          for name, f in (("mean", F.avg), ("sd", F.stddev_pop)) for kind, flag in (("a", True), ("r", False)))
    )
    spread = F.greatest(F.col("sd_a") + F.col("sd_r"), F.lit(1e-9))
    threshold = (F.col("mean_a") * F.greatest("sd_r", F.lit(5e-10)) + F.col("mean_r") * F.greatest("sd_a", F.lit(5e-10))) / spread
    return model, materialize(stats.select(threshold.alias("threshold")), "url-threshold")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, score): the longest rule's verdict, else the models' (score is null where a rule decides)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, allowed = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", host.alias("host"), path.alias("path")).select("*", name.alias("rule"), allowed.alias("allowed"))
    model, threshold = fit(rows.filter(F.col("rule").isNotNull()).select("url", "allowed"))
    open_ = rows.filter(F.col("rule").isNull()).select("url")
    scored = materialize(scores(open_, model).withColumnRenamed("url", "s_url"), "url-scores")
    scored = maybe_broadcast(scored, scored.count(), BROADCAST_URLS)
    out = rows.join(scored, F.col("rule").isNull() & (F.coalesce("url", F.lit("")) == F.col("s_url")), "left")
    by_model = F.coalesce(F.col("score") >= threshold.scalar(), F.lit(True))
    verdict = F.when(F.coalesce("allowed", by_model), "allow").otherwise("block")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))
