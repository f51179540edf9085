"""URL filters: rules by host and path, and a character language-model ratio for what no rule judges.

URLs judged by a rule teach two variable-order Markov models over characters, one of accepted and one of rejected URLs.
Rules judge by the end of the host and the beginning of the path, so these are taken out of every URL first, as far as
its rule looked (the last label and the first segment at least): the models learn the rest. Contexts of three, two, one
and no characters are mixed by Witten-Bell smoothing: a context counts against the next shorter one as often as it was
seen against how many different characters followed it. A URL's score is the difference of its two log-likelihoods
divided by its length. The cutoff is calibrated on three sixteenths of the judged URLs, kept from training: the score
that a share of RISK of the accepted ones fall below, found by counts in ever finer ranges. URLs under it are blocked. With
fewer than LEAST accepted URLs to calibrate on, or without rejected ones to learn from, nothing is blocked by the models.

Only DataFrame functions are used. Characters are mapped to an alphabet of 51 first (a to z, one for all digits, URL
punctuation, one for the rest, an end mark), so the table of 4-grams has 51 ** 4 rows at most however many URLs there are. Each
distinct text is scored once; only hashes travel with its grams. The table of ratios is broadcast up to BROADCAST rows;
beyond, grams are salted, as each URL has the same first ones.

Edge cases: null urls and urls without "://" have empty host and path, fit no rule and are scored as text; empty urls
are scored by their end mark; long urls are scored whole; scores are rounded to nine places, and equal ones (ties) get
one verdict; repeated rows get equal verdicts, each in a row of its own; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txweave.llm.common import cut


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]
RISK = 0.01
LEAST = 100
ORDER = 3
ALPHABET = 51
BROADCAST = 200_000
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty without a scheme."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules: list[Rule] = RULES) -> Column:
    """The longest rule that fits: rule (host and path in one string), verdict, host and path lengths; null where none
    fits."""
    kind = "struct<rule:string,verdict:string,host:int,path:int>"
    found = F.lit(None).cast(kind)
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        mine = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(len(r.host)).alias("host"), F.lit(len(r.path)).alias("path"))
        found = F.when(fits, mine.cast(kind)).otherwise(found)
    return found


def unjudged_part(url: Column, host: Column, path: Column, rule: Column) -> Column:
    """The URL without the host's end and the path's beginning."""
    last = F.length(F.regexp_extract(host, r"([^.]*)\z", 1))
    first = F.length(F.regexp_extract(path, r"^(/[^/]*/?)", 1))
    h = F.greatest(F.coalesce(rule["host"], F.lit(0)), last)
    p = F.greatest(F.coalesce(rule["path"], F.lit(0)), first)
    at = F.instr(url, "://")
    begin = at + 3 + F.length(host)
    cut_out = F.concat(F.substring(url, F.lit(1), at + 2 + F.length(host) - h), F.substring(url, begin + p, F.length(url)))
    return F.when(at > 0, cut_out).otherwise(F.coalesce(url, F.lit("")))


def normal(url: Column) -> Column:
    """The URL in the small alphabet, with ORDER start marks and an end mark."""
    u = F.translate(url, UPPER, LOWER)
    u = F.regexp_replace(u, "[0-9]", "9")
    u = F.regexp_replace(u, r"[^a-z9:/?#\[\]@!&'()*+,;=._~%-]", "|")
    return F.concat(F.lit("^" * ORDER), u, F.lit("$"))


def grams(chars: Column) -> Column:
    """The (ORDER + 1)-grams of a text, an array."""
    return F.transform(F.sequence(F.lit(1), F.length(chars) - ORDER), lambda i: F.substring(chars, i, F.lit(ORDER + 1)))


def smoothed(counts: DataFrame) -> DataFrame:
    """gram, p_allow, p_block from gram, allow, block: the probability of the last character after those before."""
    sides = ["allow", "block"]
    below: DataFrame | None = None
    for order in range(ORDER + 1):
        key = F.substring(F.col("gram"), F.lit(ORDER + 1 - order), F.lit(order + 1))
        level = counts.groupBy(key.alias("key")).agg(*(F.sum(s).alias(s) for s in sides))
        level = level.withColumns({"context": F.left("key", F.lit(order)), "shorter": F.right("key", F.lit(order))})
        seen = level.groupBy("context").agg(*(F.sum(s).alias(f"{s}_n") for s in sides), *(F.sum((F.col(s) > 0).cast("long")).alias(f"{s}_t") for s in sides))
        level = level.join(seen, "context")
        if below is None:
            level = level.withColumns({f"p_{s}": (F.col(s) + 1.0) / (F.col(f"{s}_n") + ALPHABET) for s in sides})
        else:
            level = level.join(below, "shorter")
            mixed = lambda s: F.when(F.col(f"{s}_n") == 0, F.col(f"b_{s}")).otherwise((F.col(s) + F.col(f"{s}_t") * F.col(f"b_{s}")) / (F.col(f"{s}_n") + F.col(f"{s}_t")))
            level = level.withColumns({f"p_{s}": mixed(s) for s in sides})
        below = level.select(F.col("key").alias("shorter"), *(F.col(f"p_{s}").alias(f"b_{s}") for s in sides))
    return below.select(F.col("shorter").alias("gram"), *(F.col(f"b_{s}").alias(f"p_{s}") for s in sides))


def order_statistic(rows: DataFrame, column: str, rank: int, bins: int = 4096) -> float:
    """The value with `rank` values below it (ties by turns): counts in equal ranges, then in the range that holds it."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        ranges = rows.where(F.col(column).between(low, high)).groupBy(at.alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(ranges.collect()):  # `bins` rows at most
            if rank < r.n:
                low, high = r.low, r.high
                break
            rank -= r.n
    return low


def judged(pages: DataFrame, rules: list[Rule] = RULES, risk: float = RISK, least: int = LEAST, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, host, path, rule, score, verdict of each row of `pages`."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", by_rule(F.col("host"), F.col("path"), rules))
    held = F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin("0", "1", "2")
    chars = normal(unjudged_part(F.col("url"), F.col("host"), F.col("path"), F.col("found")))
    rows = cut(rows.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("by_rule"), F.coalesce(held, F.lit(False)).alias("held"), chars.alias("chars")))
    taught = lambda v: F.coalesce(F.sum(((F.col("by_rule") == v) & ~F.col("held")).cast("long")), F.lit(0))
    counts = cut(rows.select("by_rule", "held", F.explode(grams(F.col("chars"))).alias("gram")).groupBy("gram").agg(taught("allow").alias("allow"), taught("block").alias("block")))
    ratios = cut(smoothed(counts).select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio")))
    texts = rows.select("chars").distinct().select(F.xxhash64("chars").alias("key"), F.length("chars").alias("size"), F.explode(grams(F.col("chars"))).alias("gram"))
    if ratios.count() <= broadcast:
        joined = texts.join(F.broadcast(ratios), "gram")
    else:
        salted = ratios.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = texts.withColumn("_salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["gram", "_salt"])
    scores = joined.groupBy("key", "size").agg(F.round(F.avg("ratio"), 9).alias("score"))
    scored = cut(rows.join(scores, (F.xxhash64("chars") == F.col("key")) & (F.length("chars") == F.col("size"))).drop("chars", "key", "size"))
    known = scored.where("held and by_rule = 'allow'")
    n, taught_both = known.count(), scored.where("not held").select("by_rule").where("by_rule is not null").distinct().count() == 2
    cutoff = order_statistic(known, "score", int(risk * n)) if n >= least and taught_both else float("-inf")
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= cutoff, "allow").otherwise("block"))
    return scored.select("page_id", "url", "host", "path", "rule", "score", verdict.alias("verdict"))
