"""URL filter: rules first, then empirical-Bayes reputation of hosts.

Hosts with few labelled pages say little by themselves. Their share of bad pages is shrunk by
beta-binomial priors: all pages give the prior of a suffix, the suffix that of a registered domain,
the domain that of a host. The weight of each prior is estimated from how far the shares of the
level below spread (method of moments). How uncertain a prior is goes on to the levels below it. A
host is blocked if a lower bound of its posterior share of bad pages lies above a threshold, so
hosts of which little is known are let through.

Suffix is the last label of a host, registered domain the last two: no list of public suffixes is
at hand.

Edges: a null url, or one without ``://``, has empty host and path, fits no rule, and is judged as
the host ''. Repeated rows are pages of their own. With no labelled page at all nothing is
blocked. Other columns of the input are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Rules (host, path): what they say of a url, by contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Standard deviations below the posterior mean, and the share of bad pages that blocks.
Z, THRESHOLD = 1.645, 0.5
#: Limits of a prior's weight, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"^(?s).*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, parts, 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))
    return F.translate(host, A_TO_Z, A_TO_Z.lower()), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does.

    A rule fits its host and all below it, if the path starts with the rule's. Of equally long
    rules the first by text wins. ``rules`` is a short list, tried from the longest on.
    """
    text = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(
        rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True
    ):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return text, verdict


def _prior(groups: DataFrame) -> tuple[float, float]:
    """Mean share and weight of the beta prior of groups with ``bad`` of ``n`` pages."""
    row = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("square"),
    ).first()
    if not row["n"]:
        return 0.0, LEAST_WEIGHT
    mean = row["bad"] / row["n"]
    spread = max(0.0, row["square"] / row["n"] - mean * mean)
    chance = mean * (1 - mean)
    excess = spread - chance * row["k"] / row["n"]
    weight = MOST_WEIGHT if excess <= 0 else (chance - spread) / excess
    return mean, min(MOST_WEIGHT, max(LEAST_WEIGHT, weight))


def host_reputation(labelled: DataFrame, z: float = Z) -> DataFrame:
    """Posterior share of bad pages of every ``host`` in ``labelled`` (host, bad 0/1 or null).

    One row per host: ``labelled_pages``, ``mean`` and ``lower`` bound. Hosts without labels get
    what their domain and suffix say.
    """
    labels = F.split(F.col("host"), r"\.")
    last_two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    hosts = (
        labelled.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
        .withColumn("domain", last_two)
        .withColumn("suffix", F.element_at(labels, -1))
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean, suffix_weight = _prior(suffixes.filter("n > 0"))
    _, domain_weight = _prior(domains.filter("n > 0"))
    _, host_weight = _prior(hosts.filter("n > 0"))

    def shrunk(prior: Column, prior_variance: Column, weight: float) -> list[Column]:
        pages = F.col("n") + F.lit(weight)
        mean = (prior * weight + F.col("bad")) / pages
        inherited = F.pow(F.lit(weight) / pages, F.lit(2)) * prior_variance
        return [mean.alias("mean"), (mean * (1 - mean) / (pages + 1) + inherited).alias("variance")]

    of_suffix = suffixes.select("suffix", *shrunk(F.lit(mean), F.lit(0.0), suffix_weight))
    of_domain = domains.join(of_suffix, "suffix").select(
        "suffix", "domain", *shrunk(F.col("mean"), F.col("variance"), domain_weight)
    )
    return (
        hosts.join(of_domain, ["suffix", "domain"])
        .select(
            "host",
            F.col("n").alias("labelled_pages"),
            *shrunk(F.col("mean"), F.col("variance"), host_weight),
        )
        .select("host", "labelled_pages", "mean", (F.col("mean") - z * F.sqrt("variance")).alias("lower"))
    )


def judge_urls(
    pages: DataFrame, rules=RULES, z: float = Z, threshold: float = THRESHOLD
) -> DataFrame:
    """Per page ``host``, ``path``, the ``rule`` that fits and the ``verdict``.

    Pages that a rule fits are the labelled ones: blocked is bad. The others are judged by their
    host's reputation. Only pages are split among tasks where a host has many: what is joined is
    one row per host.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumn("rule", rule).withColumn("by_rule", verdict)
    bad = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    reputation = host_reputation(judged.select("host", bad.alias("bad")), z)
    blocked = reputation.select("host", (F.col("lower") > threshold).alias("blocked"))
    by_host = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.join(blocked, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict")
    )
