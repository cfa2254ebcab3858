"""URL filtering by mined association rules.

A labelled URL becomes a basket of tokens (host names, path words, query keys, file ending) and its label. Spark's
FP-growth finds the token combinations that go with low quality in two thirds of them; rules below a support, a confidence
or a lift are pruned, so is a rule that says no more than a shorter one, and so is one that doesn't hold on the last
third. No token and no combination is left out: where URLs have too many frequent tokens for all their subsets to be
listed, only combinations are grown that can still say more than every shorter one, level by level. URLs meet the rules through an inverted index: a rule stands under its rarest token, so a URL only looks at the
rules of the tokens it has. Fixed host and path rules come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodgetrail.session import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = "label=low"
#: Share of the URLs mined, confidence and lift a rule needs.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.001, 0.6, 2.0
#: URLs that a rule needs at least, among those mined and among those held out.
MIN_ROWS, MIN_HELD_OUT = 20, 5
#: Frequent tokens of a URL up to which FP-growth lists all frequent combinations; where a URL has more, free sets are grown.
FP_TOKENS = 14

#: Host (and subdomains), path beginning, verdict.
FIXED_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def _rest(url: Column) -> Column:
    """What stands after the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column) -> Column:
    """The longest fixed rule that fits, as a struct of ``rule`` and ``verdict``; null if none does."""
    longest = sorted(FIXED_RULES, key=lambda r: len(r[0] + r[1]), reverse=True)
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, start, verdict in reversed(longest):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL; numbers in paths are one token, so ids don't make rules."""
    pieces = F.filter(F.split(host, r"\."), lambda x: x != "")
    names = F.transform(pieces, lambda x: F.concat(F.lit("host:"), x))
    parts = F.filter(F.split(F.translate(path, _UPPER, _LOWER), r"[/._-]+"), lambda x: x != "")
    words = F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "^[0-9]+$", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0)), lambda x: x != "")
    scheme = F.filter(F.array(F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z]+)://", 1)), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.concat(
        names, words, F.transform(keys, lambda x: F.concat(F.lit("key:"), x)), F.transform(scheme, lambda x: F.concat(F.lit("scheme:"), F.lower(x))))))


def _strong(sets: DataFrame, size: Row) -> DataFrame:
    """Rules of enough confidence and lift from sets (``rule_tokens``) with the URLs that hold them, ``low`` ones among ``freq``."""
    confidence = F.col("low") / F.col("freq")
    found = sets.withColumns({
        "confidence": confidence, "lift": confidence * size.n / size.low, "support": F.col("low") / F.lit(size.n)})
    return found.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("lift") >= MIN_LIFT))


def _listed_rules(baskets: DataFrame, size: Row, least: float) -> DataFrame:
    """The rules that no shorter one makes needless, from all frequent combinations of ``own`` by FP-growth."""
    items = F.concat("own", F.when(F.col("low"), F.array(F.lit(LOW))).otherwise(F.array().cast("array<string>")))
    frequent = FPGrowth(itemsCol="items", minSupport=least / size.n, numPartitions=_partitions(baskets.sparkSession)).fit(
        baskets.select(items.alias("items"))).freqItemsets
    # The support counts all mined URLs, also those without a frequent token.
    sets = stage(frequent.where(F.col("freq") >= least).select(F.array_sort("items").alias("items"), "freq"), "url-sets")
    with_label = sets.where(F.array_contains("items", LOW) & (F.size("items") > 1)).select(F.array_remove("items", LOW).alias("rule_tokens"), F.col("freq").alias("low"))
    alone = sets.where(~F.array_contains("items", LOW)).withColumnRenamed("items", "rule_tokens")
    kept = stage(_strong(with_label.join(alone, "rule_tokens"), size).select("rule_tokens", "confidence", "lift", "support"), "url-rules")
    # A rule is pruned where a shorter one with at least its confidence has only tokens of this one.
    shorter = kept.select(F.col("rule_tokens").alias("less"), F.col("confidence").alias("at_least"), F.element_at("rule_tokens", 1).alias("first"))
    tied = kept.withColumn("first", F.explode("rule_tokens")).join(shorter, "first").where(
        (F.size("less") < F.size("rule_tokens")) & (F.col("at_least") >= F.col("confidence"))
        & (F.size(F.array_except("less", "rule_tokens")) == 0)).select("rule_tokens").distinct()
    return kept.join(tied, "rule_tokens", "left_anti")


def _grown_rules(baskets: DataFrame, size: Row, least: float) -> DataFrame:
    """The same rules, by growing sets of ``own`` a token at a time.

    A rule that says more than every shorter one loses a URL of good quality with each of its tokens: if one token excluded
    none, the rule without it would have at least its confidence. Every part of such a set is such a set too, and so is
    enough low quality, so a set grows from its parts alone and no rule is missed. A set without URLs of good quality
    ends there. Beside a set stand the URLs that hold it, as the tokens that may still be added; equal ones are one row.
    """
    rest = baskets.groupBy(F.col("own").alias("rest")).agg(F.count_if("low").alias("low"), F.count_if(~F.col("low")).alias("high"))
    left = stage(rest.where(F.size("rest") > 0).select(F.array().cast("array<string>").alias("held"), "rest", "low", "high"), "url-sets-left")
    grown, parts = [], None
    while True:
        counted = left.select("held", F.explode("rest").alias("token"), "low", "high").groupBy("held", "token").agg(
            F.sum("low").alias("low"), F.sum("high").alias("high")).where(F.col("low") >= least)
        sets = counted.select(F.concat("held", F.array("token")).alias("rule_tokens"), "held", "token", "low", "high")
        if parts is None:
            sets = sets.where(F.col("high") < size.n - size.low).withColumn("best", F.lit(0.0))
        else:
            without = F.transform("rule_tokens", lambda x: F.array_remove("rule_tokens", x))
            beside = sets.withColumn("part", F.explode(without)).join(parts, "part").groupBy(*sets.columns).agg(
                F.count(F.lit(1)).alias("parts"), F.min("part_high").alias("fewest"), F.max("part_best").alias("best"))
            sets = beside.where((F.col("parts") == F.size("rule_tokens")) & (F.col("high") < F.col("fewest"))).drop("parts", "fewest")
        sets = stage(sets, "url-sets")
        grown.append(sets.select("rule_tokens", "low", (F.col("low") + F.col("high")).alias("freq"), "best"))
        going = sets.where("high > 0")
        if going.isEmpty():
            break
        parts = going.select(F.col("rule_tokens").alias("part"), F.col("high").alias("part_high"),
                             F.greatest("best", F.col("low") / (F.col("low") + F.col("high"))).alias("part_best"))
        open_tokens = going.groupBy("held").agg(F.collect_list("token").alias("open"))
        still = left.join(open_tokens, "held").select("held", F.array_intersect("rest", "open").alias("rest"), "low", "high")
        longer = still.select("held", "rest", "low", "high", F.posexplode("rest").alias("at", "token")).where(F.col("at") + 1 < F.size("rest"))
        left = stage(longer.groupBy(
            F.concat("held", F.array("token")).alias("held"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest")).agg(
            F.sum("low").alias("low"), F.sum("high").alias("high")), "url-sets-left")
    # Parts that are no rules themselves have less confidence than any rule.
    return _strong(reduce(DataFrame.unionByName, grown), size).where("confidence > best").select("rule_tokens", "confidence", "lift", "support")


_RULES = "rule_tokens array<string>, confidence double, lift double, support double, held_out_rows long, held_out_precision double"


def mine(labelled: DataFrame) -> DataFrame:
    """Rules from rows of ``url``, ``tokens`` and ``low`` (true or false).

    Returns ``rule_tokens`` (sorted), ``confidence``, ``lift`` and ``support`` among the URLs mined, and ``held_out_rows`` and
    ``held_out_precision`` among the third of the URLs (by a hash, so copies of a URL stay together) that isn't.
    Null tokens and labels are left out; a table with too few rows for any rule gives none.
    """
    spark = labelled.sparkSession
    held_out = F.pmod(F.xxhash64("url"), F.lit(3)) == 1
    rows = stage(labelled.where("tokens IS NOT NULL AND low IS NOT NULL").select("tokens", "low", held_out.alias("held_out")), "labelled-urls")
    mined = rows.where("NOT held_out")
    size = mined.agg(F.count(F.lit(1)).alias("n"), F.count_if("low").alias("low")).first()
    least = max(MIN_ROWS, MIN_SUPPORT * size.n)
    if size.low < least:
        return spark.createDataFrame([], _RULES)
    often = mined.select(F.explode("tokens").alias("token"), "low").groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("low").alias("low")).where(F.col("n") >= least)
    ranked = mined.select("tokens").distinct().withColumn("token", F.explode("tokens")).join(often.select("token"), "token")
    own = ranked.groupBy("tokens").agg(F.array_sort(F.collect_set("token")).alias("own"))
    baskets = stage(mined.join(own, "tokens").select("own", "low"), "url-baskets")
    widest = baskets.agg(F.max(F.size("own"))).first()[0] or 0
    pruned = stage((_listed_rules if widest <= FP_TOKENS else _grown_rules)(baskets, size, least), "url-rules-pruned")
    unseen = rows.where("held_out").groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("low").alias("low"))
    proof = met(unseen.select("tokens"), pruned).join(unseen, "tokens").groupBy("rule_tokens").agg(
        F.sum("n").alias("held_out_rows"), (F.sum("low") / F.sum("n")).alias("held_out_precision"))
    return pruned.join(proof, "rule_tokens").where(
        (F.col("held_out_rows") >= MIN_HELD_OUT) & (F.col("held_out_precision") >= MIN_CONFIDENCE)).select(*T.StructType.fromDDL(_RULES).names)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def met(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens`` of ``baskets`` with every rule (``rule_tokens``, ``confidence``) that holds for them, through an inverted index."""
    often = rules.select(F.explode("rule_tokens").alias("token")).groupBy("token").count()
    terms = rules.withColumn("token", F.explode("rule_tokens")).join(often, "token")
    index = terms.groupBy("rule_tokens", "confidence").agg(F.min(F.struct("count", "token")).getField("token").alias("token"))
    return baskets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").where(
        F.size(F.array_except("rule_tokens", "tokens")) == 0).select("tokens", "rule_tokens", "confidence")


def match(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens`` of ``baskets`` for which a rule holds, with the most confident one (of equals the greatest tokens)."""
    best = F.max(F.struct("confidence", F.concat_ws(" ", "rule_tokens").alias("mined_rule")))
    return met(baskets, stage(rules, "url-rule-index")).groupBy("tokens").agg(best.alias("b")).select("tokens", "b.confidence", "b.mined_rule")


def held_out_report(rules: DataFrame) -> DataFrame:
    """How many rules there are, the held-out URLs they fit (a URL counts once per rule) and the share of low quality among those."""
    right = F.sum(F.col("held_out_rows") * F.col("held_out_precision"))
    return rules.agg(F.count(F.lit(1)).alias("rules"), F.coalesce(F.sum("held_out_rows"), F.lit(0)).alias("held_out_rows"), (right / F.sum("held_out_rows")).alias("precision"))


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Judge every URL.

    Returns ``key``, ``host``, ``path``, ``rule`` (the fixed rule, or null), ``verdict`` (allow or block) and
    ``mined_rule`` (the mined rule that blocks it, or null). ``labels`` says by ``label_key`` which pages are of low
    quality (``label`` 0). A URL that no rule fits is allowed; null URLs and those without ``://`` have empty host and
    path and no token. Repeated rows are each judged; other columns are not looked at.
    """
    rows = pages.select(pages[key].alias(key), pages[url].alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rows = rows.withColumn("tokens", tokens_of(F.col("_url"), F.col("host"), F.col("path")))
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(label_key).alias(key), (F.col(label) == 0).alias("low"))
    rules = mine(rows.join(known, key).select(F.col("_url").alias("url"), "tokens", "low"))
    fixed = fixed_rule(F.col("host"), F.col("path"))
    rows = stage(rows.drop("_url").withColumn("_fixed", fixed), "urls")
    open_ones = rows.where("_fixed IS NULL").select("tokens").distinct()
    blocked = stage(match(open_ones, rules), "blocked-urls")
    out = rows.join(blocked, "tokens", "left")
    verdict = F.coalesce(F.col("_fixed.verdict"), F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow"))
    return out.select(key, "host", "path", F.col("_fixed.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_fixed").isNull(), F.col("mined_rule")).alias("mined_rule"))
