"""Operator 4: URL filter, with DataFrame operations only.

Rules give the labelled URLs: the longest rule that fits a URL's host and path
allows or blocks it. Gradient-boosted trees learn from those what their URLs
look like (length, depth, digit ratio, entropy, parameter counts, suffix
statistics) and judge the URLs that no rule covers.

The suffix statistics are counted over all labelled URLs. The trees are fitted
on at most about ``train_rows`` labelled rows (chosen by a hash of the URL, so
the choice does not depend on partitioning); every URL is scored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["n_url", "n_host", "n_path", "depth", "digit_ratio", "entropy", "n_params", "n_labels", "n_hyphens",
            "has_fragment", "has_extension", "tld_rate", "tld_log", "domain_rate", "domain_log"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is
    ``host/path``: it fits its host and all subdomains if the path starts with
    the rule's (which begins at the rule's first slash)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, said in sorted(rules, key=lambda r: len(r[0])):  # the longest is tried first, being outermost
        of, slash, rest = what.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, what).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for an empty one."""
    n = F.length(text)
    counts = F.transform(F.array_distinct(F.split(text, "")),
                         lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(
        F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda total, x: total - x / n * F.log2(x / n)))


def with_lexical(urls: DataFrame) -> DataFrame:
    """Lexical features of columns url (not null), host and path."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    return (urls.withColumn("n_url", F.length(url)).withColumn("n_host", F.length(host))
            .withColumn("n_path", F.length(path))
            .withColumn("depth", F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))))
            .withColumn("digit_ratio", (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n)
            .withColumn("entropy", _entropy(url))
            .withColumn("n_params", F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))))
            .withColumn("n_labels", F.size(labels))
            .withColumn("n_hyphens", F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))))
            .withColumn("has_fragment", url.contains("#").cast("int"))
            .withColumn("has_extension", path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"))
            .withColumn("tld", F.substring_index(host, ".", -1))
            .withColumn("domain", F.substring_index(host, ".", -2)))


def _with_suffix_rates(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Smoothed share of blocked URLs and log count of each URL's last one and
    two host labels, counted over all labelled URLs (unknown suffix: the
    prior). Each statistic has a row per suffix; the adaptive join broadcasts
    it if small and splits hot suffixes if not."""
    blocked = (F.col("verdict") == "block").cast("double")
    for suffix in ("tld", "domain"):
        stats = labelled.groupBy(suffix).agg(
            ((F.sum(blocked) + 1) / (F.count("*") + 2)).alias(f"{suffix}_rate"),
            F.log1p(F.count("*").cast("double")).alias(f"{suffix}_log"))
        urls = urls.join(stats, suffix, "left").fillna({f"{suffix}_rate": 0.5, f"{suffix}_log": 0.0})
    return urls


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          train_rows: int = 20_000, trees: int = 12, depth: int = 4) -> DataFrame:
    """One row per row of ``pages``: the id, host, path, rule (null: none
    fits), verdict (allow or block).

    A null URL or one without ``://`` has empty host and path. If the rules
    label URLs of one class only, that class is the verdict of all others; if
    they label none, the verdict is allow. Repeated rows and URLs are judged
    alike."""
    own = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    own = own.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.select("*", rule.alias("rule"), verdict.alias("verdict"))
    by_rule = own.where("rule is not null").select("page_id", "host", "path", "rule", "verdict")
    rest = own.where("rule is null")
    suffixes = own.select("verdict", F.substring_index("host", ".", -1).alias("tld"),
                          F.substring_index("host", ".", -2).alias("domain")).where("verdict is not null")
    known = {r.verdict: r.n for r in suffixes.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    if len(known) < 2:
        said = F.lit(next(iter(known), "allow"))
        return by_rule.union(rest.select("page_id", "host", "path", "rule", said))

    share = min(1.0, train_rows / sum(known.values()))
    chosen = own.where("rule is not null").where(
        F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    names = VectorAssembler(inputCols=FEATURES, outputCol="features")
    train = names.transform(_with_suffix_rates(with_lexical(chosen), suffixes)).select(
        "features", (F.col("verdict") == "block").cast("double").alias("label"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(cut_lineage(train))
    scored = model.transform(names.transform(_with_suffix_rates(with_lexical(rest), suffixes)))
    said = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return by_rule.union(scored.select("page_id", "host", "path", "rule", said))
