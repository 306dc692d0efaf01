"""Url rules, and the reputation of hosts by empirical Bayes. DataFrame functions only.

Labelled pages are outcomes of their host. The share of bad pages of a host is shrunk to that of its registered
domain, that one's to its suffix, and that one's to all; how strongly, the spread of the shares at each level says
(beta-binomial, method of moments). A host is blocked if its posterior share is above a threshold with enough
probability, that is, if the lower quantile of its beta posterior is; the posterior is integrated on a grid of log odds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import looked_up, lower_ascii, sent_if_small, stored

#: Public suffixes of two labels, under which names are registered; others have one label. A parameter
#: of ``judge``: a run over all countries passes its own list.
TWO_LABEL_SUFFIXES = (
    "ac.at", "ac.il", "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.th", "ac.uk", "ac.za", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke",
    "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.eg", "com.hk", "com.mx", "com.my",
    "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "edu.tw",
    "gob.mx", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "nhs.uk", "or.at",
    "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.in", "org.nz", "org.tw", "org.uk", "org.za", "sch.uk",
)

#: The share of bad pages above which a host is blocked, and the probability that it takes.
THRESHOLD, SURE = 0.5, 0.95

#: Cells of the grid, and standard deviations that it reaches to either side.
CELLS, REACH = 400, 12


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_labels), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_labels), F.substring_index(host, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule (verdict, host, path) that fits, else null; of equally long ones block wins."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):  # the last that fits stands
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def shrunk(level: DataFrame, kappa: float) -> DataFrame:
    """Posterior a, b of each row's share of bad pages, from its n, bad and the prior mean m; and their mean, ``post``."""
    a, b = F.col("m") * kappa + F.col("bad"), (1 - F.col("m")) * kappa + F.col("n") - F.col("bad")
    return level.withColumns({"a": a, "b": b, "post": a / (a + b)})


def strength(level: DataFrame) -> float:
    """Pages that the prior of this level counts for: the correlation within a node by moments, as a beta prior's a + b."""
    row = level.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))).alias("q"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not row["k"] or row["n"] <= row["k"]:
        return 1.0
    rho = min(max((row["q"] - row["k"]) / (row["n"] - row["k"]), 1e-3), 0.9)
    return 1 / rho - 1


def above(a: Column, b: Column, share: float) -> Column:
    """Probability that a share with a beta(a, b) posterior is above ``share``.

    On the scale of log odds u the density is in proportion to t ** a * (1 - t) ** b with t = 1 / (1 + exp(-u)), smooth
    for any a and b; the cell that ``share`` lies in counts in part.
    """
    odds = math.log(share / (1 - share))
    sd = F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b))
    grid = F.struct((2 * REACH * sd / CELLS).alias("h"), (F.log(a / b) - REACH * sd).alias("from"), a.alias("a"), b.alias("b"), (a * F.log(a / (a + b)) + b * F.log(b / (a + b))).alias("top"))

    def sums(g: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            u = g["from"] + (i + 0.5) * g["h"]
            density = F.exp(-g["a"] * F.log1p(F.exp(F.least(-u, F.lit(700.0)))) - g["b"] * F.log1p(F.exp(F.least(u, F.lit(700.0)))) - g["top"])
            part = F.least(F.greatest((u - odds) / g["h"] + 0.5, F.lit(0.0)), F.lit(1.0))
            return F.struct((s["all"] + density).alias("all"), (s["over"] + density * part).alias("over"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(CELLS - 1)), F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("over")), step)

    return F.transform(F.transform(F.array(grid), sums), lambda s: F.try_divide(s["over"], s["all"]))[0]


def reputation(hosts: DataFrame, threshold: float = THRESHOLD, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, n_pages, mean, above: the posterior share of bad pages, and the probability that it is above the threshold, from rows (host, n_pages, n, bad), one for each host."""
    hosts = hosts.withColumns({"domain": domain_of(F.col("host"), two_labels), "suffix": suffix_of(F.col("host"), two_labels)})
    domains = stored(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    suffixes = suffixes.withColumn("m", F.lit((total["bad"] + 0.5) / (total["n"] + 1)))
    suffixes = shrunk(suffixes, strength(suffixes))
    domains = domains.join(sent_if_small(stored(suffixes.select("suffix", F.col("post").alias("m")))), "suffix")
    domains = shrunk(domains, strength(domains))
    hosts = hosts.join(sent_if_small(stored(domains.select("domain", F.col("post").alias("m")))), "domain")
    hosts = shrunk(hosts, strength(hosts))
    # a share is above the threshold with a probability of at most mean / threshold (Markov), so most need no integral
    can_be = F.col("post") > SURE * threshold
    return hosts.select("host", "n_pages", F.col("post").alias("mean"), F.when(can_be, above(F.col("a"), F.col("b"), threshold)).otherwise(F.lit(0.0)).alias("above"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], threshold: float = THRESHOLD, two_labels: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and of the host bad_share and bad_above, the probability that its share is above the threshold (0 where it can't be likely): one row for each row of ``pages``.

    ``outcomes`` has rows (page_id, bad: 0 or 1); those with nulls are left out and each repeated one counts. A null
    url, or one without ``://``, has an empty host, which has a reputation like any other. Without outcomes all hosts
    have the same share, one half. Repeated pages are judged each; an empty table gives no rows. Rules are a list
    given by the caller, tried one by one in one expression. Other columns are ignored.
    """
    url = F.col("url").cast("string")
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    bad = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("int").alias("bad")).where("page_id is not null and bad is not null")
    seen = bad.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = stored(split.join(seen, "page_id", "left").groupBy("host").agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad")))
    known = stored(reputation(hosts, threshold, two_labels))
    ruled = looked_up(split, known, ["host"], "n_pages").withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("above") > SURE, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), F.col("mean").alias("bad_share"), F.col("above").alias("bad_above"))
