"""URL filters by a path-template tree for every host.

1. A URL's path is cut into segments; numbers, long hexadecimal and mixed identifiers become typed wildcards at once.
   What is left is counted by host and typed path: all that follows works on these counts, not on pages.
2. Level by level, a node whose children are more than MOST_CHILDREN different segments has a variable place: those
   with less than RARE of its pages become a wildcard, one for all whose labels are like the other children's within the
   Hoeffding bound, one for those that are worse, one for those that are better. Frequent segments stay. So a node has
   at most 1 / RARE + 3 children, whatever its pages.
3. In each host's tree, sibling branches whose distributions (labels, ends, segments below) differ by less than the
   Hoeffding bound, all the way down, are merged into one.
4. A template is rejected if its labelled purity, smoothed by PRIOR pseudo-labels of even odds, reaches REJECT.

Labels come from the caller, or else from what pages hold: the text of a page is bad where it is no prose (symbols,
capitals, exclamations or repeated words make up more than a share of it), and good otherwise. So labels differ from page
to page of a host, and names of hosts say nothing. A list of host and path rules decides before the method, the longest
fitting rule first; its verdict is the label of the pages that it fits.

Defined results: a null URL, or one without ://, has an empty host and path, no rule, and is judged by the template of
the empty path; a page whose content is null or without words has no label, nor has any where the table has no content;
page ids may be null or repeat (each row is judged, and counted, for itself); URLs and pages of any length are read
whole; a table without rows gives none. Of children that tie none goes before the other: a child's place depends on its
own share of the pages.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.batches import fresh_name
from quillon.runtime import cut, forget, ship

DEPTH, MOST_CHILDREN, RARE = 4, 12, 0.01
#: Confidence of the merging test, pseudo-labels, and the purity that rejects.
ALPHA, PRIOR, REJECT = 0.05, 4.0, 0.8
#: Shares of a page's characters (symbols, capitals) and words (exclamation marks, repeated words) beyond which it is no prose.
SYMBOLS, CAPITALS, EXCLAIMED, REPEATED = 0.02, 0.3, 0.3, 0.6
#: The Hoeffding bound is this by the sum of 1 / sqrt(pages) of both sides.
_SCALE = math.sqrt(0.5 * math.log(2 / ALPHA))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (ASCII capitals lower-cased) and the path; both empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked last, so first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def with_noise(df: DataFrame, html: str, name: str) -> DataFrame:
    """df with whether a page's text (its article's, if it has one) is no prose; null without words.

    Each step is a column of its own, so that none is worked out again for every measure that needs it.
    """
    article, text, words = (fresh_name([*df.columns, name], n) for n in ("_article", "_text", "_words"))
    out = df.withColumn(article, F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*)</article>", 1))
    whole = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " ")
    out = out.withColumn(text, F.regexp_replace(F.when(F.col(article) != "", F.col(article)).otherwise(whole), r"(?s)<!--.*?-->|<[^>]*>|&(?:lt|gt|quot|nbsp|#\d+);", " "))
    out = out.withColumn(text, F.trim(F.replace(F.col(text), F.lit("&amp;"), F.lit("&"))))
    out = out.withColumn(words, F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    t, w = F.col(text), F.col(words)
    dropped = lambda characters: F.length(t) - F.length(F.translate(t, characters, ""))
    strange = dropped("%$&#*@^~{}|\\=+_") > SYMBOLS * F.length(t)
    capitals = F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}+", ""))
    loud = (capitals > CAPITALS * F.length(t)) | (dropped("!") > EXCLAIMED * F.size(w))
    again = 1 - F.size(F.array_distinct(w)) / F.size(w) > REPEATED
    return out.withColumn(name, F.when(F.size(w) > 0, strange | loud | again)).drop(article, text, words)


def typed_path(path: Column) -> Column:
    """The path with numbers, hexadecimal and mixed identifiers as wildcards; what lies beyond DEPTH segments as one more."""
    seg = F.split(F.regexp_replace(path, r"\A/", ""), "/")

    def kind(s: Column) -> Column:
        s = F.regexp_replace(s, r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "{uuid}")
        s = F.when(F.length(s) >= 16, F.regexp_replace(s, r"\b(?=[0-9a-zA-Z]*[0-9])(?=[0-9a-zA-Z]*[a-zA-Z])[0-9a-zA-Z]{16,}\b", "{id}")).otherwise(s)
        return F.regexp_replace(s, r"[0-9]+", "{n}")

    shown = F.transform(F.slice(seg, 1, DEPTH), kind)
    return F.concat_ws("/", shown, F.when(F.size(seg) > DEPTH, F.lit("**")))


def _generalised(counts: DataFrame) -> DataFrame:
    """host, typed, template, n, bad, good: rare segments at variable places of each host's tree as *, *bad or *good.

    Each level is written, as it names the one before three times: a plan of all would have 3 to the power of levels leaves.
    """
    out = counts.withColumn("seg", F.split("typed", "/")).withColumn("template", F.lit(""))
    before = None
    for k in range(DEPTH + 1):
        child = F.get("seg", F.lit(k))
        # two steps, so a host's many children are counted in many tasks
        kids = out.where(child.isNotNull()).groupBy("host", "template", child.alias("child")).agg(*[F.sum(c).alias(f"{c}_c") for c in ("n", "bad", "good")])
        nodes = kids.groupBy("host", "template").agg(F.count("*").alias("children"), *[F.sum(f"{c}_c").alias(f"{c}_all") for c in ("n", "bad", "good")]).where(F.col("children") > MOST_CHILDREN)
        rare = kids.join(nodes, ["host", "template"]).where(F.col("n_c") < RARE * F.col("n_all"))
        rest = F.col("n_all") - F.col("n_c")
        bound = _SCALE * (1 / F.sqrt("n_c") + 1 / F.sqrt(rest))
        more = {c: F.col(f"{c}_c") / F.col("n_c") - (F.col(f"{c}_all") - F.col(f"{c}_c")) / rest for c in ("bad", "good")}
        wild = F.when((more["bad"] > bound) | (more["good"] < -bound), "*bad").when((more["good"] > bound) | (more["bad"] < -bound), "*good").otherwise("*")
        out = out.withColumn("child", child).join(rare.select("host", "template", "child", wild.alias("wild")), ["host", "template", "child"], "left")
        out = out.withColumn("template", F.when(F.col("child").isNull(), F.col("template")).otherwise(F.concat_ws("/", F.when(F.lit(k > 0), F.col("template")), F.coalesce("wild", "child")))).drop("wild", "child")
        level = cut(out, "level")
        forget(before)
        out = before = level
    return out.drop("seg")


class _Node:
    def __init__(self):
        self.n = self.bad = self.good = self.ends = 0.0
        self.children: dict[str, _Node] = {}

    def absorb(self, other: _Node) -> None:
        for f in ("n", "bad", "good", "ends"):
            setattr(self, f, getattr(self, f) + getattr(other, f))
        for k, c in other.children.items():
            self.children.setdefault(k, _Node()).absorb(c)


def _alike(a: _Node, b: _Node) -> bool:
    bound = _SCALE * (1 / math.sqrt(max(a.n, 1)) + 1 / math.sqrt(max(b.n, 1)))
    shares = [(a.bad, b.bad), (a.good, b.good), (a.ends, b.ends)]
    names = a.children.keys() | b.children.keys()
    none = _Node()
    shares += [(a.children.get(k, none).n, b.children.get(k, none).n) for k in names]
    if any(abs(x / max(a.n, 1) - y / max(b.n, 1)) > bound for x, y in shares):
        return False
    return all(_alike(a.children[k], b.children[k]) for k in names if k in a.children and k in b.children)


def _merged(node: _Node) -> dict[str, list[str]]:
    """Merge like children, the most frequent first; for each merged branch the segments that it stands for."""
    classes: list[tuple[_Node, list[str]]] = []
    for name, child in sorted(node.children.items(), key=lambda kv: (-kv[1].n, kv[0])):
        for into, names in classes:
            if _alike(into, child):
                into.absorb(child)
                names.append(name)
                break
        else:
            classes.append((child, [name]))
    node.children = {"|".join(names): c for c, names in classes}
    return {"|".join(names): names for _, names in classes}


def _purities(root: _Node) -> dict[tuple[str, ...], float]:
    """Smoothed share of bad labels at the end of each template (tuple of segments), after merging."""
    out: dict[tuple[str, ...], float] = {}

    def walk(node: _Node, paths: list[tuple[str, ...]]) -> None:
        for p in paths:
            out[p] = (node.bad + PRIOR / 2) / (node.bad + node.good + PRIOR)
        for key, names in _merged(node).items():
            walk(node.children[key], [p + (n,) for p in paths for n in names])

    walk(root, [()])
    return out


def _host_tree(rows: pd.DataFrame) -> pd.DataFrame:
    root = _Node()
    for t, n, bad, good in zip(rows["template"], rows["n"], rows["bad"], rows["good"]):
        node = root
        for seg in [None, *t.split("/")]:
            node = node.children.setdefault(seg, _Node()) if seg is not None else node
            node.n, node.bad, node.good = node.n + n, node.bad + bad, node.good + good
        node.ends += n
    known = _purities(root)
    return pd.DataFrame({"host": rows["host"], "template": rows["template"], "bad_share": [known.get(tuple(t.split("/")), 0.5) for t in rows["template"]]})


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], bad: Column | None = None, good: Column | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, typed_path and bad_share (the template's smoothed purity) of every page.

    bad and good: conditions over the columns host, path, rule, ruled (its verdict) and noise (whether the page's text is
    no prose; null if unknown) that label a page; by default a rule's verdict labels it, and noise where none fits.
    """
    ship(pages.sparkSession)
    url = F.col(url_col)
    host, path = host_and_path(url)
    shown = html_col.lower() in {c.lower() for c in pages.columns}
    narrow = pages.select(F.col(id_col).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"), (F.col(html_col) if shown else F.lit(None).cast("string")).alias("html"))
    narrow = with_noise(narrow, "html", "noise").drop("html")
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    narrow = narrow.select("*", rule.alias("rule"), ruled.alias("ruled"), typed_path(F.col("path")).alias("typed"))
    if bad is None:
        bad = F.coalesce(F.col("ruled") == "block", F.col("noise"))
    if good is None:
        good = ~bad
    ones = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    counts = cut(narrow.groupBy("host", "typed").agg(F.count("*").alias("n"), ones(bad).alias("bad"), ones(good).alias("good")), "paths")
    general = _generalised(counts)
    trees = general.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    shares = trees.groupBy("host").applyInPandas(_host_tree, "host string, template string, bad_share double")
    verdicts = general.select("host", "typed", "template").join(shares, ["host", "template"]).select("host", "typed", "bad_share")
    of_method = F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")
    return narrow.join(verdicts, ["host", "typed"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", of_method).alias("verdict"), F.col("typed").alias("typed_path"), "bad_share")
