"""URL verdicts: rules by host and path, and boosted trees on lexical features where no rule fits.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts with the
rule's; the longest rule wins. Rules are a parameter of at most `MOST_RULES` entries and become
one map literal, looked up once a suffix length. The trees learn from labelled URLs (1: block), of
which about `trees.MOST_LABELLED` are used; suffix statistics are the smoothed shares of blocked
URLs among those with the same top-level domain and the same last two labels, at most one row a
labelled URL and therefore broadcast.

A null URL, or one without `://`, has an empty host and path, fits no rule, and is scored on what
features it has. Repeated rows are judged each. Without labelled URLs, or with one label only, the
score is the share of blocked ones (0 without any). Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankflow.llm import trees
from rankflow.session import cut

MOST_RULES = 10_000
Rule = tuple[str, str, str]
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_length",
    "hyphens", "has_fragment", "has_extension", "is_https", "top_rate", "domain_rate", "top_count", "domain_count",
]


def split_url(urls: DataFrame) -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumns({"host": lower, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def apply_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule (like `net/es/`) and rule_verdict, null where none fits; needs host and path."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    by_host: dict[str, list[Column]] = {}
    for host, path, verdict in rules:
        entry = F.struct(F.lit(len(host + path)).alias("n"), F.lit(host + path).alias("rule"), F.lit(path).alias("path"), F.lit(verdict).alias("verdict"))
        by_host.setdefault(host, []).append(entry)
    lookup = F.create_map(*(x for h, entries in by_host.items() for x in (F.lit(h), F.array(*entries))))
    deepest = max(h.count(".") + 1 for h in by_host)
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in range(1, deepest + 1))))
    fitting = F.filter(
        F.flatten(F.filter(F.transform(suffixes, lambda s: F.element_at(lookup, s)), F.isnotnull)),
        lambda r: F.startswith(F.col("path"), r["path"]),
    )
    best = F.array_max(fitting)
    return urls.withColumns({"rule": best["rule"], "rule_verdict": best["verdict"]})


def _features(urls: DataFrame) -> DataFrame:
    """The features of the URL itself, and its top-level domain and last two labels."""
    url = F.coalesce("url", F.lit(""))
    size = F.length("_url")
    chars = F.split("_url", "")
    share = lambda c: (size - F.length(F.replace(F.col("_url"), c, F.lit("")))) / size
    entropy = F.aggregate(
        F.transform(F.filter(F.array_distinct(chars), lambda c: c != ""), share), F.lit(0.0), lambda a, p: a - p * F.log2(p)
    )
    count = lambda col, what: (F.length(col) - F.length(F.replace(col, F.lit(what), F.lit("")))).cast("double")
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    flag = lambda c: c.cast("double")
    return urls.withColumn("_url", url).withColumns(
        {
            "url_length": size.cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/"), "labels": count(F.col("host"), ".") + 1,
            "digit_ratio": F.when(size > 0, F.length(F.regexp_replace("_url", "[^0-9]", "")) / size).otherwise(0.0),
            "entropy": F.when(size > 0, entropy).otherwise(0.0), "parameters": count(query, "="),
            "query_length": F.length(query).cast("double"), "hyphens": count(F.col("host"), "-"),
            "has_fragment": flag(F.contains(F.col("_url"), F.lit("#"))), "has_extension": flag(F.rlike("path", F.lit(r"\.[a-z]{2,5}$"))),
            "is_https": flag(F.startswith(F.col("_url"), F.lit("https:"))),
            "_top": F.substring_index("host", ".", -1), "_domain": F.substring_index("host", ".", -2),
        }
    ).drop("_url")


class UrlModel:
    """Trees and suffix statistics fitted on labelled URLs (url, label with 1 for block)."""

    def __init__(self, labelled: DataFrame):
        rows = trees.bounded(labelled.where("label IS NOT NULL").select("url", "label"), F.col("url"))
        plain = cut(_features(split_url(rows)))
        rate = (F.sum("label") + 1) / (F.count("*") + 2)
        stats = lambda key, name: plain.groupBy(key).agg(rate.alias(f"{name}_rate"), F.log1p(F.count("*")).alias(f"{name}_count"))
        self.top = cut(stats("_top", "top"))
        self.domain = cut(stats("_domain", "domain"))
        self.scorer = trees.fit(self._with_rates(plain), FEATURES, "label", trees=20)

    def _with_rates(self, rows: DataFrame) -> DataFrame:
        joined = rows.join(F.broadcast(self.top), "_top", "left").join(F.broadcast(self.domain), "_domain", "left")
        return joined.fillna(0.5, ["top_rate", "domain_rate"]).fillna(0.0, ["top_count", "domain_count"]).drop("_top", "_domain")

    def score(self, urls: DataFrame) -> DataFrame:
        """Adds score, the probability of block; needs url, host and path."""
        return self.scorer.score(self._with_rates(_features(urls))).drop(*FEATURES)


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score. Without `labelled`, the URLs that rules decide are the labels."""
    ruled = apply_rules(split_url(pages.select("page_id", "url")), rules)
    if labelled is None:
        labelled = ruled.where("rule IS NOT NULL").select("url", (F.col("rule_verdict") == "block").cast("int").alias("label"))
    scored = UrlModel(labelled).score(ruled)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
