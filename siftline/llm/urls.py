"""URL filters: explicit rules first, mined association rules for the rest.

URLs are sets of tokens. FP-growth mines token combinations that go with a bad
label; combinations with enough support and confidence become rules. A rule is
indexed under its rarest token, so a URL meets only the rules that one of its
tokens leads to, and those are checked token by token.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import ascii_lower, broadcast_if_small, scratch_table

BAD = "label=bad"


@dataclass(frozen=True)
class Rule:
    """A host (and its subdomains) with a path beginning, and what to do."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The share of the labelled URLs that a combination has to stand in with a bad
#: label. Of the URLs that have it, the share of bad ones has to be at least
#: MIN_CONFIDENCE, ERRORS standard errors below what is seen (Wilson's bound):
#: small counts are not believed, at any size of the corpus.
MIN_SUPPORT, MIN_CONFIDENCE, ERRORS = 0.004, 0.5, 3.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last that fits wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels and the words of those that have
    several, path segments with digits drawn together, file ending, query keys
    and whether there is a fragment."""
    mark = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind + "="), x))
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_replace(x, "(?s)=.*", ""))
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    segments = F.split(F.regexp_replace(path, "[0-9]+", "0"), "/")
    return F.array_sort(F.array_distinct(F.concat(
        mark("scheme", F.array(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))),
        mark("host", labels), mark("word", words), mark("path", segments),
        mark("ending", F.array(F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1))), mark("query", keys),
        mark("fragment", F.array(F.when(text.contains("#"), "yes").otherwise(""))),
    )))


def telling_tokens(labelled: DataFrame) -> DataFrame:
    """``(token, stands_for, n)``: the tokens that rules are made of. Of tokens
    that are in the same labelled URLs, always together, one stands for all;
    tokens of every URL tell nothing and are left out."""
    each = labelled.select(F.xxhash64("row").alias("h"), F.xxhash64("row", F.lit(1)).alias("h2"), F.explode("tokens").alias("token"))
    # Sums of two hashes of the rows tell sets of rows apart.
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    where = each.groupBy("token").agg(F.count("*").alias("n"), big("h").alias("h"), big("h2").alias("h2"))
    lead = where.groupBy("n", "h", "h2").agg(F.min("token").alias("stands_for"))
    return where.join(lead, ["n", "h", "h2"]).filter(F.col("n") < labelled.count()).select("token", "stands_for", "n")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, tokens, n, n_bad, confidence, lift, rare) from rows with
    ``tokens`` and a boolean ``bad``. Combinations are at most as many as the
    support allows, whatever the number of URLs. Rules that hold all tokens of
    another rule decide nothing more and are left out."""
    labelled = scratch_table(labelled.select("tokens", "bad").withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    telling = scratch_table(telling_tokens(labelled), "url-tokens")
    leads = telling.filter("token = stands_for").select("token")
    each = labelled.select("row", "bad", F.explode_outer("tokens").alias("token")).join(leads, "token", "left_semi")
    items = each.groupBy("row", "bad").agg(F.collect_list("token").alias("tokens"))  # as many as a URL has
    items = scratch_table(items.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")), "url-items")
    total, n_bad = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    found = FPGrowth(itemsCol="items", minSupport=min_support * total / max(1, items.count())).fit(items).freqItemsets if n_bad else None
    if found is None:
        found = items.sparkSession.createDataFrame([], "items array<string>, freq long")
    found = scratch_table(found, "url-itemsets")
    bad = found.filter(F.array_contains("items", BAD)).select(F.array_sort(F.array_remove("items", BAD)).alias("tokens"), F.col("freq").alias("n_bad"))
    both = bad.join(found.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n")), "tokens").withColumn("confidence", F.col("n_bad") / F.col("n"))
    c, z = F.col("confidence"), ERRORS * ERRORS / F.col("n")
    least = (c + z / 2 - F.sqrt(z * (c * (1 - c) + z / 4))) / (1 + z)
    rules = both.withColumn("lift", c / (n_bad / max(1, total))).filter((least >= min_confidence) & (F.col("lift") > 1))
    # The rarest token of each rule, by its count over the labelled URLs.
    lone = rules.select("tokens", F.explode("tokens").alias("token")).join(telling.select("token", F.col("n").alias("count")), "token")
    rare = lone.groupBy("tokens").agg(F.min_by("token", F.struct("count", "token")).alias("rare"))
    rules = scratch_table(rules.join(rare, "tokens"), "url-rules-all")
    wider = rules.select(F.col("tokens").alias("needs"), F.col("rare").alias("token"))
    held = rules.select("tokens", F.explode("tokens").alias("token")).join(wider, "token").filter("needs <> tokens")
    held = held.filter(F.forall("needs", lambda t: F.array_contains("tokens", t))).select("tokens").distinct()
    return scratch_table(rules.join(held, "tokens", "left_anti").withColumn("rule_id", F.array_join("tokens", " & ")), "url-rules")


def matching_sets(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``tokens`` that hold all tokens of some rule."""
    table = rules.select(F.col("tokens").alias("needs"), F.col("rare").alias("token"))
    met = token_sets.withColumn("token", F.explode("tokens")).join(table, "token")
    return met.filter(F.forall("needs", lambda t: F.array_contains("tokens", t))).select("tokens").distinct()


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[Rule] = (), min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE, id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict
    (``allow`` or ``block``), and mined (what the mined rules alone say).

    ``labels`` has doc_id, quality and toxic; a page whose id carries a label of
    low quality or toxicity is a bad example, one with other labels a good one;
    null labels and ids are left out. A null URL, or one without ``://``, has
    an empty host and path. Without labels nothing is mined and URLs that no
    explicit rule fits are allowed. Repeated rows are judged one by one; an
    empty table gives an empty table; other columns are not looked at.
    """
    url = F.col("url")
    seen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    seen = seen.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    seen = scratch_table(seen.select("page_id", "host", "path", url_tokens(url, F.col("host"), F.col("path")).alias("tokens")), "urls")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    known = known.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad).alias("bad"))
    labelled = seen.join(known, "page_id").select("tokens", "bad")
    mined = matching_sets(seen.select("tokens").distinct(), mine_rules(labelled, min_support, min_confidence))
    blocked = broadcast_if_small(scratch_table(mined.withColumn("hit", F.lit(True)), "blocked-sets"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    said = F.when(F.col("hit"), "block").otherwise("allow")
    return seen.join(blocked, "tokens", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, said).alias("verdict"), said.alias("mined")
    )
