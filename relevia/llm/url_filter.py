"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

All of it is DataFrame expressions and aggregates. Features are cut into at most 16 bins; each
level of a tree is one aggregate of gradients by leaf, feature and bin over the training rows, and
only these sums (a number that does not depend on the rows) reach the driver, which picks one
split for the whole level. So a tree is a lookup by a few comparisons, and the model one sum.

Features are counts and shares of the url's characters, its entropy, depth, parameters, and
statistics of suffixes and sections: the smoothed share of blocked urls among labelled ones with
the same last labels of the host or the same first folder. A training row takes these shares
from the half of the labelled urls that it is not in.

The fit uses a bounded sample of labelled urls (``most_rows``, chosen by a hash); the suffix
statistics have no more rows than the sample and are broadcast for that reason. Every url is judged.

Nulls: a null url, or one without `://`, has an empty host and path, fits no rule, and is judged by
its features, which are zero where there is nothing to count. Null labels are not learned from. Equal
urls get equal verdicts; repeated rows are kept. Without labels of both kinds every url that
no rule fits is allowed. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevia.session import materialize

MOST_ROWS = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://`, up to the first of `/ ? #`, A-Z lower-cased; then up to `?` or `#`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


@dataclass(frozen=True)
class Rule:
    """``text`` is a host with the start of a path, like `net/`; it fits the host and its subdomains."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, slash, start = self.text.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)


def rule_columns(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, nulls if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    pick = lambda what: F.coalesce(*[F.when(r.fits(host, path), F.lit(what(r))) for r in ordered], F.lit(None).cast("string"))
    return pick(lambda r: r.text), pick(lambda r: r.verdict)


def _share(text: Column, pattern: str) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(pattern)) / F.length(text)).otherwise(0.0)


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    parts = F.transform(
        F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), lambda c: n - F.length(F.replace(text, c, F.lit("")))
    )
    total = F.aggregate(parts, F.lit(0.0), lambda acc, k: acc - k / n * F.log2(k / n))
    return F.when(n > 0, total).otherwise(0.0)


#: Suffixes and sections whose labelled urls are counted.
def suffix_keys(host: Column, path: Column) -> dict[str, Column]:
    labels = F.split(host, "\\.")
    last = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), F.lit(k)), ".")
    section = F.regexp_extract(path, "^/([^/]*)/", 1)
    return {
        "suffix1": last(1),
        "suffix2": last(2),
        "suffix3": last(3),
        "section": section,
        "suffix1_section": F.concat_ws("/", last(1), section),
        "suffix2_section": F.concat_ws("/", last(2), section),
    }


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    whole = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(whole, "\\?([^#]*)", 1)
    return {
        "length": F.length(whole),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "depth": F.regexp_count(path, F.lit("/")),
        "labels": F.size(F.split(host, "\\.")),
        "digit_share": _share(whole, "[0-9]"),
        "host_digit_share": _share(host, "[0-9]"),
        "path_digits": F.regexp_count(path, F.lit("[0-9]")),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "mark_share": _share(whole, "[^A-Za-z0-9]"),
        "entropy": _entropy(whole),
        "host_entropy": _entropy(host),
        "parameters": F.regexp_count(query, F.lit("[^&=]+=")),
        "fragment": F.contains(whole, F.lit("#")).cast("int"),
        "secure": whole.startswith("https://").cast("int"),
        "ends_in_slash": path.endswith("/").cast("int"),
        "extension": F.regexp_extract(path, "\\.([A-Za-z0-9]{1,5})$", 1) != "",
    }


@dataclass(frozen=True)
class Trees:
    """Splits (feature, bin) of each level and leaf values of each tree; ``edges`` has each feature's bin edges."""

    names: list[str]
    edges: dict[str, list[float]]
    base: float
    trees: list[tuple[list[tuple[str, int]], list[float]]] = field(default_factory=list)

    def bins(self, values: dict[str, Column]) -> dict[str, Column]:
        """The bin of each feature: the number of edges below the value."""
        out = {}
        for name in self.names:
            steps = [(values[name].cast("double") > e).cast("int") for e in self.edges[name]]
            out[name] = sum(steps, F.lit(0))
        return out

    @staticmethod
    def leaf(splits: list[tuple[str, int]], bins: dict[str, Column]) -> Column:
        return sum(((bins[name] > at).cast("int") * (1 << level) for level, (name, at) in enumerate(splits)), F.lit(0))

    def margin(self, bins: dict[str, Column]) -> Column:
        out = F.lit(self.base)
        for splits, values in self.trees:
            out = out + F.element_at(F.array(*[F.lit(v) for v in values]), self.leaf(splits, bins) + 1)
        return out


def _logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def grow_trees(
    rows: DataFrame, names: list[str], edges: dict[str, list[float]], trees: int, depth: int, rate: float, ridge: float = 1.0
) -> Trees:
    """Boost on ``rows``: one bin column per name, ``n`` rows and ``y`` blocked ones among them."""
    total = rows.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    if not total["n"] or total["y"] in (0, total["n"]):
        return Trees(names, edges, -20.0 if not total["n"] or not total["y"] else 20.0)
    import math

    odds = total["y"] / total["n"]
    model = Trees(names, edges, math.log(odds / (1 - odds)))
    bins = {name: F.col(name) for name in names}
    for _ in range(trees):
        p = _logistic(model.margin(bins))
        scored = rows.select(*names, (F.col("y") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        splits: list[tuple[str, int]] = []
        for _ in range(depth):
            cells = scored.withColumn("leaf", Trees.leaf(splits, bins))
            parts = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(n).alias("bin")) for i, n in enumerate(names)]))
            sums = cells.select("leaf", "g", "h", parts.alias("part")).groupBy("leaf", "part.f", "part.bin")
            sums = sums.agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            best = None
            for f, name in enumerate(names):
                for at in range(len(edges[name])):
                    sides: dict[tuple[int, bool], list[float]] = {}
                    for r in sums:
                        if r["f"] == f:
                            side = sides.setdefault((r["leaf"], r["bin"] > at), [0.0, 0.0])
                            side[0] += r["g"]
                            side[1] += r["h"]
                    gain = sum(g * g / (h + ridge) for g, h in sides.values())
                    # sums differ in their last digits from run to run; names settle equal gains
                    if best is None or gain > best[0] * (1 + 1e-9):
                        best = (gain, name, at)
            if best is None:
                break
            splits.append(best[1:])
        leaves = scored.groupBy(Trees.leaf(splits, bins).alias("leaf")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        values = [0.0] * (1 << len(splits))
        for r in leaves:
            values[r["leaf"]] = round(rate * r["g"] / (r["h"] + ridge), 9)
        model.trees.append((splits, values))
    return model


@dataclass(frozen=True)
class UrlModel:
    trees: Trees
    shares: DataFrame
    prior: float

    def margin(self, urls: DataFrame, keys: list[str]) -> DataFrame:
        """``urls`` (with a column per key and lexical feature) and their margin."""
        rows = _with_shares(urls, self.shares.select("kind", "value", F.col("share")), keys, self.prior)
        bins = self.trees.bins({n: F.col(n) for n in self.trees.names})
        return rows.withColumn("margin", self.trees.margin(bins))


def _with_shares(rows: DataFrame, shares: DataFrame, keys: list[str], prior: float) -> DataFrame:
    """One share column per key kind, the prior where nothing is known."""
    for kind in keys:
        own = shares.filter(F.col("kind") == kind).select(F.col("value").alias(kind), F.col("share").alias(f"share_{kind}"))
        # at most one row per sampled url
        rows = rows.join(F.broadcast(own), kind, "left").withColumn(f"share_{kind}", F.coalesce(f"share_{kind}", F.lit(prior)))
    return rows


def fit_urls(
    labelled: DataFrame, most_rows: int = MOST_ROWS, trees: int = 12, depth: int = 3, bins: int = 16, rate: float = 0.4, smooth: float = 5.0
) -> UrlModel:
    """Learn from ``labelled`` (url, blocked 0 or 1), at most about ``most_rows`` of its rows."""
    known = labelled.filter("blocked in (0, 1)").select("url", F.col("blocked").cast("int").alias("y"))
    count = known.count()
    chosen = known.withColumn("turn", F.monotonically_increasing_id())
    # the turn spreads copies of one url; the sample is written, so it stays as it is
    chosen = chosen.filter(F.pmod(F.xxhash64("url", "turn"), F.lit(1 << 30)) < most_rows / max(1, count) * (1 << 30))
    host, path = url_parts(F.col("url"))
    keys, lexical = suffix_keys(host, path), lexical_features(F.col("url"), host, path)
    sample = chosen.select(
        "y",
        F.pmod(F.xxhash64("url"), F.lit(2)).alias("half"),
        *[c.cast("double").alias(n) for n, c in lexical.items()],
        *[c.alias(n) for n, c in keys.items()],
    )
    sample = materialize(sample, "url-sample")
    total = sample.agg(F.sum("y"), F.count("y")).first()
    prior = (total[0] or 0) / max(1, total[1])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in keys])).alias("key")
    counts = sample.select("half", "y", kinds).groupBy("key.kind", "key.value", "half")
    counts = materialize(counts.agg(F.sum("y").alias("y"), F.count("y").alias("n")), "url-counts")
    share = (F.sum("y") + smooth * prior) / (F.sum("n") + smooth)
    shares = counts.groupBy("kind", "value").agg(share.alias("share"))
    halves = []
    for half in (0, 1):
        # shares of the other half
        other = counts.filter(F.col("half") != half).groupBy("kind", "value").agg(share.alias("share"))
        halves.append(_with_shares(sample.filter(F.col("half") == half), other, list(keys), prior))
    names = [*lexical, *[f"share_{k}" for k in keys]]
    rows = materialize(halves[0].unionByName(halves[1]).select("y", *names), "url-rows")
    cuts = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(n, cuts, 10_000).alias(n) for n in names]).first()
    edges = {n: sorted(set(found[n] or [])) for n in names}
    values = {n: F.col(n) for n in names}
    binned = rows.select("y", *[c.alias(n) for n, c in Trees(names, edges, 0.0).bins(values).items()])
    cells = materialize(binned.groupBy(*names).agg(F.count("y").alias("n"), F.sum("y").alias("y")), "url-cells")
    return UrlModel(grow_trees(cells, names, edges, trees, depth, rate), shares, prior)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url", **options) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row.

    Urls that a rule judges are the labelled ones the trees learn from; the trees judge all
    others, and ``score`` is their chance of being blocked for every url.
    """
    host, path = url_parts(F.col("url"))
    text, verdict = rule_columns(rules, F.col("host"), F.col("path"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", text).withColumn("ruled", verdict)
    labelled = rows.filter("ruled is not null").select("url", (F.col("ruled") == "block").cast("int").alias("blocked"))
    model = fit_urls(labelled, **options)
    keys = suffix_keys(F.col("host"), F.col("path"))
    lexical = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    wide = rows.select("page_id", "host", "path", "rule", "ruled", *[c.alias(n) for n, c in keys.items()], *[c.cast("double").alias(n) for n, c in lexical.items()])
    judged = model.margin(wide, list(keys))
    method = F.when(F.col("margin") > 0, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), _logistic(F.col("margin")).alias("score")
    )
