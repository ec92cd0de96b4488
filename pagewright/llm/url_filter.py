"""URL filters: listed rules first, then a path-template tree per host, in DataFrame functions only.

Tree: segments of a path get a lexical class where they are plainly variable (numbers, hashes, dates), which makes the
path's shape. Labels are the pages that the listed rules judge, or counts that the caller gives. What other hosts'
labels say of a shape (each host with a label votes with its own share of bad pages, smoothed towards ``prior``) stands
in for ``strength`` labelled pages of the host itself, so that evidence reaches hosts and branches without labels.
Level by level, siblings merge when they are alike. A child's evidence puts it into one of five classes of shares, equally
wide where chance is equally large (by the arcsine of the root), and its own labels move it to the class of its own
share when they contradict the evidence: ``min_labelled`` of them or more, ``apart`` standard deviations away. Children of one
class are one wildcard, a child that is alone in its class keeps its segment. So whether two siblings merge depends on the two
of them, and neither on how many others there are nor on what those are like. A template is then a path from the root to a
leaf; its purity is the smoothed share of bad pages among its labelled ones. Urls that no rule fits get the verdict of
their template: block at ``min_purity``, else allow.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and its (empty) template's
verdict; repeated rows give repeated results; an empty table gives an empty one. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

# The rules of the query, as verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class UrlParams:
    #: Levels of the tree; what lies deeper is one wildcard.
    depth: int = 4
    #: Classes of shares: siblings of one class are alike.
    classes: int = 5
    #: Labels that move a child out of the class of its evidence: so many, and so many standard deviations away.
    min_labelled: int = 5
    apart: float = 3.0
    prior: float = 0.2
    strength: float = 4.0
    min_purity: float = 0.7


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.char_length(text))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_columns(rules) -> tuple[Column, Column]:
    """The rule that fits and its verdict; the longest rule is asked first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def masked(segment: Column) -> Column:
    """The lexical class of a variable segment, its ending kept; other segments as they are."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), "<n>")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("<n>"), F.regexp_extract(segment, r"\.[A-Za-z]+$", 0)))
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), "<date>")
        .when(segment.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$"), "<hex>")
        .otherwise(segment)
    )


def with_evidence(shapes: DataFrame, params: UrlParams) -> DataFrame:
    """``shapes`` with ``expected``: the share of bad pages that the other hosts' labels let expect of a shape."""
    share = F.try_divide(F.col("bad"), F.col("labelled"))
    votes = shapes.groupBy("shape").agg(F.sum(share).alias("votes"), F.count_if(F.col("labelled") > 0).alias("voters"))
    others = F.coalesce("votes", F.lit(0.0)) - F.coalesce(share, F.lit(0.0)), F.col("voters") - F.when(F.col("labelled") > 0, 1).otherwise(0)
    expected = (others[0] + params.prior * params.strength) / (others[1] + params.strength)
    return shapes.join(votes, "shape").withColumn("expected", expected).drop("votes", "voters")


def smoothed(bad: Column, labelled: Column, expected: Column, params: UrlParams) -> Column:
    return (bad + params.strength * expected) / (labelled + params.strength)


def classed(share: Column, params: UrlParams) -> Column:
    """The class of a share, from 0: chance moves shares of one number of labels equally far in any class."""
    return F.least(F.floor(F.asin(F.sqrt(share)) * (2 * params.classes / pi)), F.lit(params.classes - 1)).cast("int")


def templates(shapes: DataFrame, params: UrlParams) -> DataFrame:
    """host, shape, template, purity for rows of host, shape (array of masked segments), pages, labelled, bad."""
    scratch = Scratch(shapes.sparkSession, "url-filter")
    # Each level reads what the one before wrote: its rows are used several times.
    tree = scratch.write(with_evidence(shapes, params).withColumn("template", F.lit("").cast("string")), "tree-0")
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.sum(F.col("expected") * F.col("pages")).alias("hoped"), F.sum("pages").alias("pages")]
    share = smoothed(F.col("bad"), F.col("labelled"), F.col("hoped") / F.col("pages"), params)
    for level in range(params.depth):
        child = tree.withColumn("segment", F.coalesce(F.get("shape", F.lit(level)), F.lit("\0")))
        own = child.groupBy("host", "template", "segment").agg(*sums).withColumn("hope", F.col("hoped") / F.col("pages"))
        z = F.try_divide(F.col("bad") - F.col("labelled") * F.col("hope"), F.sqrt(F.col("labelled") * F.col("hope") * (1 - F.col("hope"))))
        contradicted = (F.col("labelled") >= params.min_labelled) & (F.abs(F.coalesce(z, F.lit(0.0))) >= params.apart)
        which = classed(F.when(contradicted, share).otherwise(F.col("hope")), params)
        usual = classed(F.lit(params.prior), params)
        kind = F.when(F.col("segment") == "\0", "").when(which == usual, "/*").otherwise(F.concat(F.lit("/*"), which.cast("string")))
        own = scratch.write(own.select("host", "template", "segment", kind.alias("kind")), f"children-{level}")
        alike = own.groupBy("host", "template", "kind").agg(F.count(F.lit(1)).alias("alike"))
        step = F.when((F.col("kind") == "") | ((F.col("alike") > 1)), F.col("kind")).otherwise(F.concat(F.lit("/"), "segment"))
        step = own.join(alike, ["host", "template", "kind"]).select("host", "template", "segment", step.alias("step"))
        tree = child.join(step, ["host", "template", "segment"]).withColumn("template", F.concat("template", "step")).drop("segment", "step")
        tree = scratch.write(tree, f"tree-{level + 1}")
        scratch.drop(f"tree-{level}", f"children-{level}")
    tree = tree.withColumn("template", F.concat("template", F.when(F.size("shape") > params.depth, "/**").otherwise("")))
    purity = tree.groupBy("host", "template").agg(*sums).select("host", "template", share.alias("purity"))
    return tree.select("host", "shape", "template").join(purity, ["host", "template"])


def url_filter(pages: DataFrame, rules=RULES, params: UrlParams = UrlParams()) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict, "shape": F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), masked)})
    bad = F.when(F.col("ruled") == "block", 1).otherwise(0)
    known = F.when(F.col("ruled").isNotNull(), 1).otherwise(0)
    counted = rows.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.sum(known).alias("labelled"), F.sum(bad).alias("bad"))
    judged = templates(counted, params)
    out = rows.join(judged, ["host", "shape"], "left")
    own = F.when(F.col("purity") >= params.min_purity, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
