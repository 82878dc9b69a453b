"""URL allow and block verdicts: rules first, gradient-boosted trees for the rest.

DataFrame operations only: URLs are parsed, matched, binned and scored by built-in
functions; trees are grown from grouped sums of gradients and become one SQL
expression.  What comes to the driver is a row per (leaf, feature, bin).

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.
Path: from there up to ``?``, ``#`` or the end.  A null URL or one without ``://`` has an
empty host and path, fits no rule, and is judged by the trees (whose features are then
those of an empty URL).  A rule is a host and a path, written ``host/path``; it fits its
host and all subdomains if the URL's path starts with the rule's; the longest rule wins.

The trees learn from the URLs that rules judge: a rule's verdict is the label.  At most
about ``sample_rows`` of them are used, chosen by a hash of key and URL.  Without two
classes in the sample every other URL gets the majority verdict, or ``allow``.

Rows are independent: repeated rows and keys give repeated rows, a null key is kept, and an empty table gives
an empty result.  URLs are read whole, however long.  Columns that aren't named are not read, so
their names may clash with any.  Of rules of equal length the one that sorts last wins; only equal ones fit alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.shared import materialize, thinned

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENTROPY_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789-._/?=&"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules written as ``allow host/path`` or ``block host/path``."""
    out = []
    for line in lines:
        verdict, where = line.split(" ", 1)
        host, slash, path = where.partition("/")
        out.append(Rule(verdict, host.lower(), slash + path))
    return out


def url_host(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", url) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def match_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest fitting rule's text, else null; rules are given by the caller, one branch each."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text)).otherwise(out)
    return out


def rule_verdict(rules: list[Rule], rule: Column) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Lexical features; ratios and entropy are scaled to whole numbers, so bins are exact."""
    text = F.lower(F.coalesce(url, F.lit("")))
    length = F.length(text)
    at_least_one = F.greatest(length, F.lit(1))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    terms = []
    for sign in ENTROPY_SIGNS:
        share = (length - F.length(F.replace(text, F.lit(sign), F.lit("")))) / at_least_one
        terms.append(F.when(share > 0, -share * F.log2(share)).otherwise(0.0))
    entropy = terms[0]
    for t in terms[1:]:
        entropy = entropy + t
    count = lambda s, sign: F.length(s) - F.length(F.replace(s, F.lit(sign), F.lit("")))
    return {
        "length": length,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "path_depth": count(path, "/"),
        "host_labels": count(host, "."),
        "hyphens": count(host, "-"),
        "digit_ratio": F.floor(1000 * (length - F.length(F.regexp_replace(text, "[0-9]", ""))) / at_least_one),
        "path_digits": F.length(path) - F.length(F.regexp_replace(path, "[0-9]", "")),
        "entropy": F.floor(100 * entropy),
        "parameters": F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0),
        "fragment": F.locate("#", text).cast("boolean").cast("int"),
        "secure": text.startswith("https").cast("int"),
    }


@dataclass
class Trees:
    """Boosted trees of depth 2 over cut features; ``rates`` (``kind, k, rate``) has the block rates, per mille, of the sample's suffixes, ``base`` that of all its rows."""

    bias: float = 0.0
    trees: list = field(default_factory=list)
    rates: DataFrame | None = None
    base: int = 0


def suffix_keys(host: Column, path: Column) -> dict[str, Column]:
    """What suffix statistics are kept of: the host's last label, its second last, and the path's first part."""
    return {
        "suffix_1": F.element_at(F.split(host, r"\."), -1),
        "suffix_2": F.when(F.size(F.split(host, r"\.")) > 1, F.element_at(F.split(host, r"\."), -2)).otherwise(""),
        "first_part": F.regexp_extract(path, r"^/([^/]*)", 1),
    }


def _featured(urls: DataFrame, model: Trees) -> DataFrame:
    """``urls`` with the features ``f_...``; a suffix that the sample hasn't has the sample's block rate."""
    out = urls
    for name, key in suffix_keys(F.col("_host"), F.col("_path")).items():
        out = out.withColumn("f_" + name, F.lit(model.base))
        if model.rates is not None:  # a row for each suffix of the sample, so sample_rows bounds the broadcast
            rates = F.broadcast(model.rates.filter(F.col("kind") == name).select(F.col("k").alias("_k"), F.col("rate").alias("_rate")))
            out = out.drop("f_" + name).withColumn("_own", key).join(rates, F.col("_own") == F.col("_k"), "left").withColumn("f_" + name, F.coalesce("_rate", F.lit(model.base))).drop("_own", "_k", "_rate")
    for name, f in features(F.col("_url"), F.col("_host"), F.col("_path")).items():
        out = out.withColumn("f_" + name, f.cast("long"))
    return out


def train(urls: DataFrame, rules: list[Rule], *, sample_rows: int = 20_000, rounds: int = 8, rate: float = 0.5, bins: int = 16, ridge: float = 1.0, suffix_rows: int = 5) -> Trees:
    """Fit on about ``sample_rows`` of the rows of ``urls`` (``_key, _url, _host, _path, _rule``) that a rule judges.

    A suffix has a rate of its own if it has ``suffix_rows`` rows of the sample.
    """
    known = urls.filter("_rule is not null").withColumn("_y", (rule_verdict(rules, F.col("_rule")) == "block").cast("double"))
    total = known.count()
    if not total:
        return Trees()
    known = materialize(known.filter(thinned(["_key", "_url"], total, sample_rows)).select("_url", "_host", "_path", "_y"), "url-sample")
    n, y = known.agg(F.count("*"), F.sum("_y")).first()
    if not n:
        return Trees()
    model = Trees(bias=math.log((y + 0.5) / (n - y + 0.5)))
    model.base = int(1000 * y / n)
    kinds = F.explode(F.create_map(*[x for name, key in suffix_keys(F.col("_host"), F.col("_path")).items() for x in (F.lit(name), key)])).alias("kind", "k")
    seen = known.select("_y", kinds).filter("k is not null").groupBy("kind", "k").agg(F.count("*").alias("n"), F.sum("_y").alias("b")).filter(F.col("n") >= suffix_rows)
    # with a prior of 10 rows at the sample's rate
    model.rates = materialize(seen.select("kind", "k", F.floor(1000 * (F.col("b") + 10 * y / n) / (F.col("n") + 10)).cast("int").alias("rate")), "url-suffixes")
    if y == 0 or y == n:
        return model
    sample = _featured(known, model)
    names = sorted(c for c in sample.columns if c.startswith("f_"))
    cuts = sample.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 1000).alias(c) for c in names]).first().asDict()
    cuts = {c: sorted(set(v)) for c, v in cuts.items()}
    sample = materialize(sample.select(*names, "_y"), "url-features")
    # one row for each (features' bins, label): trees need no more
    binned = sample.select("_y", *[sum((F.when(F.col(c) > x, 1).otherwise(0) for x in cuts[c]), F.lit(0)).alias(c) for c in names])
    binned = materialize(binned.groupBy("_y", *names).agg(F.count("*").alias("_n")), "url-bins")
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).alias("bin")) for c in names]))
    margin = F.lit(model.bias)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-margin))
        graded = binned.select(*names, (F.col("_n") * (F.col("_y") - p)).alias("_g"), (F.col("_n") * p * (1 - p)).alias("_h"))
        tree = _grow(graded, stacked, cuts, rate, ridge)
        if tree is None:
            break
        model.trees.append(tree)
        margin = margin + _tree_column(tree, {c: (lambda cut, c=c: F.col(c) > cuts[c].index(cut)) for c in names})
    return model


def _best(rows: list, cuts: dict[str, list], ridge: float):
    """The split with the largest gain of (feature, bin, gradient sum, hessian sum) rows."""
    by: dict[str, dict[int, tuple[float, float]]] = {}
    for r in rows:
        by.setdefault(r.f, {})[r.bin] = (r.g, r.h)
    best = (1e-6, None, None, None, None)
    for f in sorted(by):
        g, h = sum(x for x, _ in by[f].values()), sum(x for _, x in by[f].values())
        left_g = left_h = 0.0
        for i, cut in enumerate(cuts[f]):
            a, b = by[f].get(i, (0.0, 0.0))
            left_g, left_h = left_g + a, left_h + b
            gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
            if gain > best[0]:
                best = (gain, f, cut, left_g / (left_h + ridge), (g - left_g) / (h - left_h + ridge))
    return best


def _grow(graded: DataFrame, stacked: Column, cuts: dict[str, list], rate: float, ridge: float):
    """A tree of depth 2: [feature, cut, below, above]; below and above are leaves or the like."""
    sums = lambda d, *by: d.groupBy(*by, "s.f", "s.bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect()  # noqa: E731  a row for each side, feature and bin
    rows = graded.withColumn("s", stacked)
    _, f, cut, below, above = _best(sums(rows), cuts, ridge)
    if f is None:
        return None
    side = F.col(f) > cuts[f].index(cut)
    halves = sums(rows.withColumn("side", side), "side")
    parts = []
    for way, value in ((False, below), (True, above)):
        _, f2, cut2, low, high = _best([r for r in halves if r.side is way], cuts, ridge)
        parts.append(rate * value if f2 is None else [f2, cut2, rate * low, rate * high])
    return [f, cut, *parts]


def _tree_column(tree, above: dict) -> Column:
    if not isinstance(tree, list):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(above[f](cut), _tree_column(high, above)).otherwise(_tree_column(low, above))


def blocked(model: Trees) -> Column:
    """The chance of ``block`` of a featured row."""
    margin = F.lit(model.bias)
    used: set[str] = set()

    def visit(t):
        if isinstance(t, list):
            used.add(t[0])
            visit(t[2])
            visit(t[3])

    for t in model.trees:
        visit(t)
    for t in model.trees:
        margin = margin + _tree_column(t, {c: (lambda cut, c=c: F.col(c) > cut) for c in used})
    return 1 / (1 + F.exp(-margin))


def parsed(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url") -> DataFrame:
    text = F.col(url).cast("string")
    out = pages.select(F.col(key).alias("_key"), text.alias("_url"), url_host(text).alias("_host"), url_path(text).alias("_path"))
    out = out.withColumns({"_host": F.coalesce("_host", F.lit("")), "_path": F.coalesce("_path", F.lit(""))})
    return out.withColumn("_rule", match_rule(rules, F.col("_host"), F.col("_path")))


def judge(pages: DataFrame, rules: list[Rule], *, key: str = "page_id", url: str = "url", threshold: float = 0.5, **options) -> DataFrame:
    """``key, host, path, rule, verdict, score`` of each row; ``score`` is the trees' chance of ``block``."""
    urls = parsed(pages, rules, key=key, url=url)
    model = train(urls, rules, **options)
    out = _featured(urls, model).withColumn("score", blocked(model))
    verdict = F.coalesce(rule_verdict(rules, F.col("_rule")), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return out.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), verdict.alias("verdict"), "score")
