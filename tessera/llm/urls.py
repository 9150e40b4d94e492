"""URL filters: host and path rules, and association rules mined from labelled URLs.

A URL is a set of tokens. Tokens that come in exactly the same labelled URLs are one class: a template's
shared tokens then are one item and not all their combinations. FP-growth finds combinations of classes that
come with a label; rules that have enough support and confidence, and aren't implied by a shorter rule
as good, are kept in an inverted index that lists each rule under the tokens of its rarest class. A rule
matches a URL that has a token of each of its classes; a URL tests the rules listed under its tokens
where it is read, and only the best of each list is shuffled. The rule without tokens, that of the
labels' majority, decides the rest. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import stage_table

# The rules of the filter, as (host suffix, path prefix, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

_LABEL = "label="


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (as ``hostpath``) and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for suffix, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(prefix)
        name, verdict = F.when(fits, suffix + prefix).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: scheme, each domain suffix, sub-domain labels, path segments with digits
    folded, the last segment's extension, query keys and pairs, and if it has a fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, n - i + 1, i), ".")))
    folded = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), F.regexp_replace(F.lower(s), "[0-9]+", "0")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda s: s != "")
    found = F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
            F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")),
            folded,
            F.transform(pairs, lambda s: F.concat(F.lit("key="), F.lower(F.element_at(F.split(s, "="), 1)))),
            F.transform(pairs, lambda s: F.concat(F.lit("pair="), F.lower(s))),
            F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        )
    )
    return F.when(url.contains("://"), found).otherwise(F.array().cast("array<string>"))


def token_classes(labelled: DataFrame, least: int) -> DataFrame:
    """``item``, ``members``: tokens in ``least`` labelled rows or more, those in exactly the same rows together; the first of
    them stands for all. A class is told by its number of rows and a sum of the rows' hashes."""
    each = labelled.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").cast("decimal(20,0)").alias("row"))
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("row").alias("rows")).where(F.col("n") >= least)
    return counted.groupBy("n", "rows").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("members")).select("item", "members")


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.6, least: int = 30) -> DataFrame:
    """Rules ``rule_id``, ``items``, ``classes``, ``verdict``, ``confidence``, ``support`` from columns ``tokens`` and ``label``.

    ``support`` is a share of the labelled rows and ``least`` a number of them; both must be met, so the number of
    frequent tokens is at most the mean number of tokens divided by it, whatever the size of the input. Rules may have
    any number of items. An item stands for its class: any of ``classes``' tokens will do. A rule goes if a rule with a
    subset of its items has the same verdict and at least its confidence.
    """
    rows = labelled.count()
    share = min(1.0, max(support, least / max(rows, 1)))
    floor = max(least, math.ceil(share * rows))
    classes = stage_table(token_classes(labelled, floor), "url-classes")
    known = sorted(r["item"] for r in classes.select("item").collect())  # bounded by the support, as FP-growth's own items
    baskets = labelled.select(F.array_append(F.filter("tokens", lambda t: t.isin(known) if known else F.lit(False)), F.concat(F.lit(_LABEL), F.col("label"))).alias("items"))
    # FP-growth reads its input twice and needs the number of rows
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence, numPartitions=int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    sets = model.freqItemsets.where(F.col("freq") >= floor)
    verdicts = F.filter("items", lambda x: x.startswith(_LABEL))
    split = sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(_LABEL))).alias("items"), F.element_at(F.array_append(verdicts, F.lit(None).cast("string")), 1).alias("verdict"), "freq")
    with_label = split.where("verdict is not null and size(items) > 0")
    alone = split.where("verdict is null").select("items", F.col("freq").alias("of"))
    rules = with_label.join(alone, "items").withColumn("confidence", F.col("freq") / F.col("of")).where(F.col("confidence") >= confidence)
    rules = rules.select("items", F.substring("verdict", len(_LABEL) + 1, 1000).alias("verdict"), "confidence", F.col("freq").alias("support"))
    rules = stage_table(rules, "url-rules-all")
    # a rule's subsets were mined as well, so there are no more of them than frequent sets
    nothing = F.array(F.array().cast("array<string>"))
    subsets = F.aggregate("items", nothing, lambda acc, t: F.concat(acc, F.transform(acc, lambda x: F.array_append(x, t))))
    parts = rules.select(F.col("items").alias("long"), "verdict", F.col("confidence").alias("c"), F.explode(F.filter(subsets, lambda x: (F.size(x) > 0) & (F.size(x) < F.size("items")))).alias("items"))
    shadowed = parts.join(rules.select("items", "verdict", F.col("confidence").alias("c2")), ["items", "verdict"]).where("c2 >= c").select(F.col("long").alias("items"), "verdict").distinct()
    kept = rules.join(shadowed, ["items", "verdict"], "left_anti").withColumn("rule_id", F.xxhash64("items", "verdict"))
    spread = kept.select("rule_id", F.explode("items").alias("item")).join(classes, "item").groupBy("rule_id").agg(F.array_sort(F.collect_list("members")).alias("classes"))
    return stage_table(kept.join(spread, "rule_id").select("rule_id", "items", "classes", "verdict", "confidence", "support"), "url-rules")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The best rule of each ``url``: by confidence, then number of items, support and rule_id.

    The index has a row for each token of a class that is the rarest of some rule, with all those rules. It meets
    the URLs' tokens in an equi-join, and a rule fits where the URL has a token of each of its classes. The index is
    small by its support bound, and the planner broadcasts it only while it is under the session's
    threshold.
    """
    listed = rules.select("rule_id", F.explode("classes").alias("members"))
    rarity = listed.groupBy("members").agg(F.count(F.lit(1)).alias("n"))
    anchor = listed.join(rarity, "members").groupBy("rule_id").agg(F.min(F.struct("n", "members")).alias("a"))
    rule = F.struct("confidence", F.size("items").alias("needs"), "support", "rule_id", "verdict", "classes")
    index = rules.join(anchor, "rule_id").select(F.explode("a.members").alias("token"), rule.alias("rule")).groupBy("token").agg(F.collect_list("rule").alias("rules"))
    index = stage_table(index, "url-index")
    hits = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    fits = F.filter("rules", lambda r: F.forall(r["classes"], lambda c: F.arrays_overlap(c, "tokens")))
    first = hits.select("url", F.array_max(F.transform(fits, lambda r: F.struct(*(r[c].alias(c) for c in ("confidence", "needs", "support", "rule_id", "verdict"))))).alias("best")).where("best is not null")
    best = first.groupBy("url").agg(F.max("best").alias("best"))
    return best.select("url", F.col("best.verdict").alias("mined"), F.col("best.rule_id").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def majority(labelled: DataFrame, confidence: float = 0.6) -> str | None:
    """The verdict of the rule without tokens: the label of ``confidence`` of the rows, if there is one."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    total = sum(counts.values())
    return next((v for v in ("allow", "block") if total and counts.get(v, 0) >= confidence * total), None)


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", support: float = 0.002, confidence: float = 0.6) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every page, and the mined rule's id and confidence.

    A fixed rule decides where one fits; else the best mined rule; else the rule without tokens, and without
    that too the URL is allowed. A labelled page is one whose id has a label row: ``block`` if any of its labels says
    low quality or toxic. Null and odd URLs have an empty host and path and no mined rule; URLs may have any length;
    rules that tie in confidence, number of items and support go by their id; repeated rows give repeated results;
    empty tables give an empty result or no mined rules; other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    marks = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.when(F.max(bad), "block").otherwise("allow").alias("label"))
    labelled = rows.where(F.col("url").contains("://")).join(marks, "page_id").select(tokens_of(F.col("url")).alias("tokens"), "label")
    # every row is matched where it is read, and equal URLs meet as their best rule alone
    urls = rows.where("url is not null").select("url", tokens_of(F.col("url")).alias("tokens"))
    labelled = stage_table(labelled, "url-labels")
    found = match(urls, mine(labelled, support, confidence))
    rest = majority(labelled, confidence) or "allow"
    out = rows.join(found, "url", "left").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("mined"), F.lit(rest)).alias("verdict"), "mined_rule", "mined_confidence")
