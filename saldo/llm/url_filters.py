"""URL filters: a path-template tree per host, judged by smoothed labelled purity. DataFrame functions only.

Rules (host, path, verdict) decide where one fits; the longest wins. What they decide are the labels from which the
other URLs are judged. Per host the segments of all paths form a tree. At each level a segment that looks like an
identifier becomes a wildcard of its kind. Other segments with fewer than SUPPORT pages are one wildcard, apart for those
whose labels lean to blocking; all others are branches of their own, however many, and are merged if what hangs below them
and its labels are alike. A place with fewer than SUPPORT pages is left as it is, with all that hangs below it; others are
followed to any depth. What is left of a path is its template. A template's share of blocked labels in its host is smoothed towards that of its paths in the host's domain,
in all hosts, and of all pages, in turn, each counting as PRIOR labelled pages; from PURITY on the template is rejected.

Counts are combined before every shuffle and kept per host and place of the tree, never per host alone.

Defined cases: a null URL, or one without `://`, has an empty host and path and the verdict of all labelled pages; equal
rows get equal verdicts; without any label nothing is blocked. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.llm.components import written

#: Pages from which on a segment is judged by itself.
SUPPORT = 5
#: Parts into which shares are cut where branches are compared.
PARTS = 10
#: Labelled pages that a coarser estimate counts for.
PRIOR = 4.0
#: Share of blocked labels from which a template is rejected.
PURITY = 0.6
#: Distance of the distributions below two branches (half the sum of absolute differences) up to which they are merged.
ALIKE = 0.2
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host(url: Column) -> Column:
    rest = F.expr("substring(_u, instr(_u, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.translate(
        F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )).otherwise("")


def path(url: Column) -> Column:
    rest = F.expr("substring(_u, instr(_u, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path."""
    df = df.withColumn("_u", F.coalesce(F.col(url), F.lit("")))
    return df.withColumns({"host": host(F.col("_u")), "path": path(F.col("_u"))}).drop("_u")


def with_rule(df: DataFrame, rules=RULES) -> DataFrame:
    """df with the longest rule that fits (its text, host and path) and that rule's verdict; null without one.

    A rule fits its host and all subdomains, if the path starts with the rule's. The list is part of the plan.
    """
    # The longest text first; each rule is one condition.
    rule = verdict = None
    for name, start, decision in sorted(rules, key=lambda x: (-len(x[0] + x[1]), x)):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return df.withColumns({"rule": none if rule is None else rule, "labelled": none if verdict is None else verdict})


def wildcard(segment: Column) -> Column:
    """The kind of identifier a segment is, or the segment itself."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return (
        F.when(segment == "", F.lit(""))
        .when(stem.rlike("^[0-9]+$"), F.concat(F.lit("{number}"), ending))
        .when(stem.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(F.lit("{date}"), ending))
        .when(stem.rlike("^[0-9A-Fa-f-]{8,}$") & stem.rlike("[0-9]"), F.concat(F.lit("{code}"), ending))
        .when(F.length(F.regexp_replace(stem, "[^0-9]", "")) * 2 > F.length(stem), F.concat(F.lit("{mixed}"), ending))
        .otherwise(segment)
    )


def _segments() -> Column:
    """The segments of a path, generalised."""
    return F.transform(F.slice(F.split("path", "/"), 2, F.size(F.split("path", "/"))), wildcard)


def _kind(segment: Column) -> Column:
    """Wildcards and the end of a path by name, other segments as one."""
    return F.when(segment.startswith("{") | (segment == ""), segment).otherwise("{word}")


#: Half the sum of absolute differences between the shares below the branches a and b.
_DISTANCE = """aggregate(map_keys(map_concat(map_filter(a.kinds, (k, v) -> NOT map_contains_key(b.kinds, k)), b.kinds)), 0D,
    (s, k) -> s + abs(coalesce(a.kinds[k], 0) / a.total - coalesce(b.kinds[k], 0) / b.total)) / 2"""
#: The kinds below a branch with their shares in whole parts, as a text.
_MIX = f"""array_join(array_sort(transform(filter(map_entries(kinds), x -> round(x.value * {PARTS} / total) > 0),
    x -> concat(x.key, '=', cast(round(x.value * {PARTS} / total) AS int)))), '/')"""


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, labelled, pages, share) with the template of each shape.

    Level by level from the root: at each place of the tree (host, template so far) segments of too few pages become one
    wildcard by what their labels lean to; the others are merged with the first sibling below which the shares of
    continuations and of labels are alike. Siblings with the same shares in whole parts are compared as one, so what a
    place lists is bounded by the mixes there are, not by its siblings. Levels end with the deepest place that has enough
    pages; whether there is one passes the driver.
    """
    tree, level = shapes.withColumn("template", F.col("shape")), 0
    # Where a path has no label, the one that such paths lean to elsewhere; an even share is no evidence.
    label = F.when(F.col("labelled") != "", F.col("labelled")).when(F.col("share") > 0.5, "block").otherwise("allow")
    so_far = lambda: F.array_join(F.slice("template", 1, level), "/").alias("so_far")
    # Places with a next segment and enough pages.
    places = lambda: tree.where(F.size("template") > level).groupBy("host", so_far()).agg(F.sum("pages").alias("n")).where(F.col("n") >= SUPPORT)
    while not places().isEmpty():
        place = tree.withColumns(
            {
                "so_far": so_far(),
                "here": F.get("template", F.lit(level)),
                "kind": F.concat_ws(" ", _kind(F.coalesce(F.get("template", F.lit(level + 1)), F.lit("{end}"))), label),
            }
        )
        keys = ["host", "so_far", "here"]
        below = place.where("here <> '' AND here NOT LIKE '{%'").groupBy(*keys, "kind").agg(
            F.sum("pages").alias("pages"), F.sum(F.when(label == "block", F.col("pages")).otherwise(0)).alias("blocked")
        )
        # Continuations are wildcards of few kinds with at most two labels.
        branches = below.groupBy(keys).agg(
            F.sum("pages").alias("total"), F.sum("blocked").alias("blocked"), F.map_from_entries(F.collect_list(F.struct("kind", "pages"))).alias("kinds")
        )
        wild = F.when(F.col("blocked") * 2 > F.col("total"), "{any blocked}").otherwise("{any}").alias("now")
        few = branches.where(F.col("total") < SUPPORT).join(places().drop("n"), ["host", "so_far"]).select(*keys, wild)
        supported = branches.where(F.col("total") >= SUPPORT).withColumn("mix", F.expr(_MIX))
        # The first branch by name stands for all of its mix.
        mixes = supported.groupBy("host", "so_far", "mix").agg(
            F.min("here").alias("here"),
            F.min_by(F.struct("total", "kinds"), "here").alias("b"),
            F.count(F.lit(1)).alias("n"),
        )
        listed = (
            mixes.groupBy("host", "so_far")
            .agg(F.collect_list(F.struct("here", "b.total", "b.kinds", "mix", "n")).alias("found"))
            .withColumn("found", F.expr("array_sort(found, (a, b) -> CASE WHEN a.here < b.here THEN -1 WHEN a.here > b.here THEN 1 ELSE 0 END)"))
            # The first of those alike leads them; one that is like no leader before it becomes one.
            .withColumn("leaders", F.expr(f"aggregate(found, slice(found, 1, 0), (x, b) -> IF(exists(x, a -> {_DISTANCE} <= {ALIKE}), x, concat(x, array(b))))"))
            .withColumn("found", F.expr(f"transform(found, b -> struct(b.mix AS mix, b.n AS n, filter(leaders, a -> {_DISTANCE} <= {ALIKE})[0].here AS first))"))
            .withColumn("shared", F.expr("transform(filter(leaders, a -> aggregate(filter(found, x -> x.first = a.here), 0L, (s, x) -> s + x.n) > 1), a -> a.here)"))
            .select("host", "so_far", "shared", F.explode("found").alias("m"))
            .where(F.array_contains("shared", F.col("m.first")))
            .select("host", "so_far", "m.mix", F.concat(F.lit("{like "), "m.first", F.lit("}")).alias("now"))
        )
        change = few.unionByName(supported.join(listed, ["host", "so_far", "mix"]).select(*keys, "now"))
        now = F.concat(F.slice("template", 1, level), F.array("now"), F.expr(f"slice(template, {level + 2}, size(template))"))
        tree = written(
            place.join(change, keys, "left").select(
                "host", "shape", "labelled", "pages", "share", F.when(F.col("now").isNull(), F.col("template")).otherwise(now).alias("template")
            ),
            "templates",
        )
        level += 1
    return tree


def with_share(shapes: DataFrame) -> DataFrame:
    """shapes with domain and share: the blocked share of such paths in the host's domain, leaning on all hosts."""
    shapes = shapes.withColumn("domain", F.substring_index("host", ".", -2))
    # Where nothing is labelled nothing is rejected: all pages together count for no more than an even share.
    every = shapes.agg(*_labels()).select(F.least(F.coalesce(F.try_divide("b", "l"), F.lit(0.0)), F.lit(0.5)).alias("share"))
    share = shapes.groupBy("shape").agg(*_labels()).join(F.broadcast(every)).select("shape", _smooth().alias("share"))
    share = shapes.groupBy("domain", "shape").agg(*_labels()).join(share, "shape").select("domain", "shape", _smooth().alias("share"))
    return shapes.join(share, ["domain", "shape"])


def _labels() -> list[Column]:
    count = lambda label: F.sum(F.when(label, F.col("pages")).otherwise(0))
    return [count(F.col("labelled") == "block").alias("b"), count(F.col("labelled") != "").alias("l")]


def _smooth() -> Column:
    return (F.col("b") + PRIOR * F.col("share")) / (F.col("l") + PRIOR)


def purity(tree: DataFrame) -> DataFrame:
    """(host, shape, template, blocked_share): the smoothed share of blocked labels of every shape's template."""
    tree = tree.withColumn("template", F.concat(F.lit("/"), F.array_join("template", "/")))
    # What a host's template leans on is the mean over its pages.
    mean = (F.sum(F.col("pages") * F.col("share")) / F.sum("pages")).alias("share")
    found = tree.groupBy("host", "template").agg(*_labels(), mean).select("host", "template", _smooth().alias("blocked_share"))
    return tree.select("host", "shape", "template").distinct().join(found, ["host", "template"])


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """Host, path, rule and verdict of every page; then its template and that one's share of blocked labels."""
    rows = with_rule(with_parts(pages.select("page_id", "url")), rules).withColumn("shape", _segments())
    label = F.coalesce("labelled", F.lit("")).alias("labelled")
    shapes = written(rows.groupBy("host", "shape", label).agg(F.count(F.lit(1)).alias("pages")), "shapes")
    share = written(purity(templates(with_share(shapes))), "purity")
    by_method = F.when(F.col("blocked_share") >= PURITY, "block").otherwise("allow")
    return rows.join(share, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("labelled", by_method).alias("verdict"), "template", "blocked_share"
    )
