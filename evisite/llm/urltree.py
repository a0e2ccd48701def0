"""Operator 4: URL filter with host and path rules and a path-template tree.

Rules come first: a rule (host, path prefix) fits its host and all subdomains; the longest wins, of equally long ones the
one whose text is greater, of the same text ``block``. Other pages are judged by the template of their path. The tree of
each host is built level by level: segments that look like numbers, codes or dates, and rare ones among many siblings,
become wildcards; siblings whose next segments and labels don't differ from those of all siblings together (chi-square and
two-proportion tests, or a negligible effect) are merged. Segments below ``depth`` levels are generalised by their form only.

The labels are the rules' own verdicts, or a column of the caller's. The purity of a template is its labelled share of bad
pages, smoothed by ``prior`` pseudo-labels from each of two sides: from its parent in the tree of the host (itself smoothed by
its own parent, up to the host and to all pages), and from the same template on all hosts (smoothed by all pages). So a
branch without labels is judged by what surrounds it: it is rejected if its host and its template are both known to be bad.
A template is rejected if its purity reaches ``reject``.

All steps are group-bys and equi-joins on counts by (host, template, segment), hosts salted by path; nothing holds a whole host.

Cases: a null url, or one without ``://``, has empty host and path and gets the verdict of that template. Repeated rows
are judged alike. Without any label all purities are 0.5; a purity equal to the limit rejects. Urls of any
length are judged whole; segments beyond ``depth`` (6) are generalised by their form. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisite.llm.common import settle, unsettle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16  # parts of a host with many paths in joins
SHAPES = ("end", "blank", "number", "file", "mixed", "word")


def host_and_path(url) -> tuple[F.Column, F.Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(host, path, rules: list[tuple[str, str]]) -> F.Column:
    """The longest fitting rule as struct(rule, action), or null. ``rules``: (action, "host/path"), a parameter list."""
    by_host: dict[str, list] = {}
    for action, rule in rules:
        name, slash, prefix = rule.partition("/")
        by_host.setdefault(name, []).append((slash + prefix, rule, action))
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,action:string>")
    entries = [F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r"), F.lit(a).alias("a")) for p, r, a in v]) for v in by_host.values()]
    table = F.map_from_arrays(F.array(*map(F.lit, by_host)), F.array(*entries))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    known = F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table, s), F.array().cast("array<struct<p:string,r:string,a:string>>"))))
    fits = F.filter(known, lambda e: F.startswith(path, e["p"]))
    return F.array_max(F.transform(fits, lambda e: F.struct(F.length(e["r"]).alias("size"), e["r"].alias("rule"), e["a"].alias("action"))))


def shape(segment) -> F.Column:
    """The kind of the next segment."""
    return (
        F.when(segment.isNull(), "end")
        .when(segment == "", "blank")
        .when(segment.rlike(r"^[0-9]+$"), "number")
        .when(segment.rlike(r"^[^.]*[0-9][^.]*\.[A-Za-z0-9]{1,5}$"), "file")
        .when(segment.rlike("[0-9]"), "mixed")
        .otherwise("word")
    )


def generalised(segment) -> F.Column:
    """A segment with numbers, codes and dates as wildcards; endings of files stay."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z0-9]{1,5})$", 1)
    code = segment.rlike(r"^[0-9._-]+(\.[A-Za-z0-9]{1,5})?$") | segment.rlike(r"^[0-9a-fA-F-]{8,}(\.[A-Za-z]{1,5})?$") | segment.rlike("[0-9]{3,}")
    return F.when(code, F.concat(F.lit("*"), F.when(ending.rlike("[A-Za-z]"), ending).otherwise(F.lit("")))).otherwise(segment)


def salted(table: DataFrame) -> DataFrame:
    """``table`` once for each salt."""
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def templates(paths: DataFrame, depth: int = 6, rare_share: float = 0.01, many: int = 20) -> DataFrame:
    """``(host, path, n, known, bad)`` to the same with ``template`` and ``steps``, its prefixes from the host's root on."""
    segs = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    at = paths.withColumn("segs", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segs)).withColumn("template", F.lit("")).withColumn("steps", F.array(F.lit("")))
    at = settle(at.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")))
    deepest = at.agg(F.max(F.size("segs"))).first()[0] or 0
    for level in range(1, min(depth, deepest) + 1):
        inner = at.withColumn("raw", F.try_element_at("segs", F.lit(level))).filter("raw is not null")
        inner = inner.withColumn("seg", generalised(F.col("raw"))).withColumn("next", shape(F.try_element_at("segs", F.lit(level + 1))))
        kinds = [F.sum(F.when(F.col("next") == k, F.col("n")).otherwise(0)).alias(k) for k in SHAPES]
        sums = settle(inner.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"), *kinds))
        whole = sums.groupBy("host", "template").agg(F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "known", "bad", *SHAPES)])
        both = sums.withColumn("salt", F.pmod(F.xxhash64("seg"), F.lit(SALTS)).cast("int")).join(salted(whole), ["host", "template", "salt"])
        expected = [F.col("n") * F.col(f"all_{k}") / F.col("all_n") for k in SHAPES]
        chi = reduce(lambda x, y: x + y, [F.when(e > 0, (F.col(k) - e) ** 2 / e).otherwise(0.0) for k, e in zip(SHAPES, expected)])
        alike = (chi < 11.07) | (chi / F.col("n") < 0.01)
        rate, all_rate = F.col("bad") / F.col("known"), F.col("all_bad") / F.col("all_known")
        deviation = F.sqrt(F.greatest(all_rate * (1 - all_rate), F.lit(1e-4)) / F.col("known"))
        judged_alike = (F.col("known") == 0) & (F.col("all_known") == 0) | (F.col("known") > 0) & (F.abs(rate - all_rate) <= 2 * deviation)
        rare = (F.col("children") > many) & (F.col("n") < rare_share * F.col("all_n"))
        to = F.when(rare, F.lit("*")).when((F.col("children") > 1) & alike & F.coalesce(judged_alike, F.lit(False)), F.lit("+")).otherwise(F.col("seg"))
        named = both.select("host", "template", "seg", to.alias("to"))
        moved = inner.join(salted(named), ["host", "template", "seg", "salt"]).withColumn("template", F.concat("template", F.lit("/"), "to"))
        moved = moved.withColumn("steps", F.concat("steps", F.array("template")))
        ended = at.filter(F.size("segs") < level)
        before, at = at, settle(ended.unionByName(moved.select(*at.columns)))
        unsettle(before, sums)
    rest = F.slice("segs", depth + 1, F.greatest(F.size("segs"), F.lit(1)))
    tail = F.concat(F.lit("/"), F.array_join(F.transform(rest, generalised), "/"))
    deep = F.size("segs") > depth
    whole = F.when(deep, F.concat("template", tail)).otherwise(F.col("template"))
    return at.select("host", "path", "n", "known", "bad", "salt", whole.alias("template"), F.when(deep, F.concat("steps", F.array(whole))).otherwise(F.col("steps")).alias("steps"))


def purities(leaves: DataFrame, prior: float) -> DataFrame:
    """``(host, template, purity)`` of each template that a path ends at."""
    counts = [F.sum("known").alias("known"), F.sum("bad").alias("bad")]
    ends = settle(leaves.groupBy("host", "template", "steps").agg(*counts))
    nodes = ends.select("host", F.explode("steps").alias("step"), "known", "bad").groupBy("host", "step").agg(*counts)
    alike = ends.groupBy("template").agg(F.sum("known").alias("t_known"), F.sum("bad").alias("t_bad"))
    total = ends.agg(*counts).select(((F.coalesce("bad", F.lit(0)) + prior) / (F.coalesce("known", F.lit(0)) + 2 * prior)).alias("rate"))
    rate = F.lit(total.first()[0])
    parents = ends.select("host", "template", F.posexplode("steps").alias("level", "step")).filter(F.col("step") != F.col("template"))
    chain = F.array_sort(F.collect_list(F.struct("level", "known", "bad")))  # as many as a template has levels
    above = parents.join(nodes, ["host", "step"]).groupBy("host", "template").agg(chain.alias("chain"))
    parent = F.aggregate(F.coalesce("chain", F.array().cast("array<struct<level:int,known:bigint,bad:bigint>>")), rate, lambda p, e: (e["bad"] + prior * p) / (e["known"] + prior))
    other = (F.col("t_bad") + prior * rate) / (F.col("t_known") + prior)
    own = ends.join(above, ["host", "template"], "left").join(alike, "template")
    return own.select("host", "template", ((F.col("bad") + prior * (parent + other)) / (F.col("known") + 2 * prior)).alias("purity"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], reject: float = 0.8, prior: float = 2.0, label_col: str | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every row of ``pages``."""
    host, path = host_and_path(F.col(url_col))
    label = F.lit(None).cast("boolean") if label_col is None else F.col(label_col).cast("boolean")
    cut = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), label.alias("label"))
    hit = match_rules(F.col("host"), F.col("path"), rules)
    rows = settle(cut.withColumn("hit", hit).select("page_id", "host", "path", "label", F.col("hit.rule").alias("rule"), F.col("hit.action").alias("action")))
    bad = F.when(F.col("label").isNotNull(), F.col("label")).otherwise(F.col("action") == "block")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count(bad).alias("known"), F.sum(F.coalesce(bad.cast("long"), F.lit(0))).alias("bad"))
    leaves = templates(paths)
    of = settle(purities(leaves, prior))
    judged = leaves.select("host", "path", "template", "salt").join(salted(of), ["host", "template", "salt"]).select("host", "path", "template", "purity")
    out = rows.join(judged, ["host", "path"])
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", own).alias("verdict"), "template", "purity")
