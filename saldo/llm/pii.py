"""Personal data: spans by rules, and further candidates by gradient-boosted trees. DataFrame functions only.

The rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers with a country code. Generators of high
recall propose further, overlapping spans: of every run of digits and signs all windows of consecutive groups of digits
whose number of digits a phone or card may have, and addresses with the signs written out. Boosted trees score each candidate by its format (digits, groups, separators,
check digit, parts) and its context (characters beside it, words before it). They learn from all different texts:
a candidate is positive where a rule agrees with it, a number also as the rule's number without its country code; windows
that cut or cross a rule's number are negative. What the rule itself asks for (the plus sign, the at sign) is no
feature, so that the same format and context without it can score as high. On the fourth of the texts kept from learning,
the lowest threshold per kind is taken at which PRECISION of the candidates above it agree with a rule; a kind without
such a threshold gets none. Spans above the threshold that meet no span of a rule are added, of numbers that overlap the
one of the best score; those of the rules stay.

Candidates of the same features and label are one row with their number as its weight, so the trees see every candidate and
learn from a table that hardly grows with the documents. For that only the runs of different texts are shuffled, not the
texts; spans are then found row by row inside expressions over the text. Matches never cross the runs of characters they may consist of, so each text is scanned once per kind of run, and the
patterns are applied to the short runs. Positions are code points, the end exclusive.

Defined cases: a null text counts as empty and has no span; equal rows get equal spans; without both kinds of examples
nothing is learned and only the rules' spans are returned. Other columns pass through untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import isqrt

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.llm.components import written

KINDS = ("email", "ip", "card", "phone")
TREES = 12
DEPTH = 3
PRECISION = 0.95
BEFORE, AFTER = 24, 8
#: Partial sums are kept for so many matches each.
STEP = 256

_LOCAL = r"A-Za-z0-9._%+\-"
_DOMAIN = r"A-Za-z0-9\-"
#: Stands for a dot that is not between two characters of a domain; does not occur in runs otherwise.
_DOT = r"\x02"
#: Runs that hold every address, and every number.
_MAIL_RUN = rf"(?<![{_LOCAL}@])[{_LOCAL}]*+@[{_LOCAL}@]*+"
_NUMBER_RUN = r"\+?\(?[0-9](?:[0-9+().\x20\-]*[0-9])?"
_MAIL = rf"(?:(?<![{_LOCAL}{_DOT}])|\G)[{_LOCAL}{_DOT}]++@[{_DOMAIN}]++\.[{_DOMAIN}.]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x20\-]+"
_PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
_WRITTEN_MAIL = (
    rf"(?i)(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?(?:[(\[{{]at[)\]}}]|@)\x20?[{_DOMAIN}]{{1,63}}+"
    rf"\x20?(?:[(\[{{]dot[)\]}}]|\.)\x20?[A-Za-z]{{2,24}}"
)
#: Where one number may end and the next begin: a sign of a new sentence or column, or a parenthesis not after a country code.
_BREAK = r"\.\x20|\x20\x20|(?<!^)(?<!^[0-9]{1,3}[\x20.\-]{0,2})\("
_WORDS = "tel|phone|fax|call|mobile|mail|contact|card|visa|credit|account|address|host|server"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, hit, before, after>> of the leftmost non-overlapping matches of a Java pattern.

    The parts between matches come from a split by the same pattern; positions are sums of lengths, by steps.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def place(r: Column) -> Column:
        lengths = F.transform(r.hits, lambda m, i: F.length(m) + F.length(F.get(r.gaps, i)))
        steps = lambda n: F.transform(
            F.sequence(F.lit(0), F.floor(F.size(n) / STEP).cast("int")),
            lambda k: _total(F.slice(n, k * STEP + 1, STEP)),
        )
        return let(
            lengths,
            lambda n: let(
                steps(n),
                lambda sums: F.transform(
                    r.hits,
                    lambda m, i: F.struct(
                        (
                            _total(F.slice(sums, F.lit(1), F.floor(i / STEP).cast("int")))
                            + _total(F.slice(n, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))
                            + F.length(F.get(r.gaps, i))
                        ).alias("start"),
                        m.alias("hit"),
                        F.right(F.get(r.gaps, i), F.lit(BEFORE)).alias("before"),
                        F.left(F.get(r.gaps, i + 1), F.lit(AFTER)).alias("after"),
                    ),
                ),
            ),
        )

    return let(parts, lambda r: F.when(F.size(r.hits) > 0, place(r)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    doubled = lambda x: F.when(x > 9, x - 9).otherwise(x)
    return let(
        digits,
        lambda d: F.aggregate(
            F.sequence(F.lit(1), F.length(d)),
            F.lit(0),
            lambda a, i: a + doubled(F.substr(d, i, F.lit(1)).cast("int") * (1 + (F.length(d) - i) % 2)),
        )
        % 10
        == 0,
    )


def _span(kind: str, start: Column, text: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(text)).cast("int").alias("end")
    )


def _within(runs: Column, kind: str, change, pattern: str, valid) -> Column:
    """Spans of the valid matches of a pattern within runs, each changed first without changing its length."""
    spans = lambda run: F.transform(
        F.filter(F.coalesce(matches(change(run.hit), pattern), F.array()), lambda m: valid(m.hit)),
        lambda m: _span(kind, run.start + m.start, m.hit),
    )
    return F.flatten(F.transform(runs, spans))


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _ip_valid(text: Column) -> Column:
    small = lambda x: F.length(F.regexp_replace(x, "^0+(?=[0-9])", "")) <= 3
    return F.forall(F.split(text, r"\."), lambda x: small(x) & (F.right(x, F.lit(3)).cast("int") <= 255))


def _card_valid(text: Column) -> Column:
    return let(_digits(text), lambda d: F.when(_between(F.length(d), 14, 19), luhn(d)).otherwise(False))


def _phone_valid(text: Column) -> Column:
    return _between(F.length(_digits(text)), 10, 15)


def _lone_separators(text: Column) -> Column:
    """text with an x for every space or hyphen that is not between two digits."""
    return F.regexp_replace(text, r"(?<![0-9])[\x20\-]|[\x20\-](?![0-9])", "x")


def with_runs(df: DataFrame, text: str) -> DataFrame:
    """df with the runs that may hold addresses (_mails), written-out addresses (_written) and numbers (_numbers)."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,hit:string,before:string,after:string>>")
    found = lambda test, pattern: F.coalesce(F.when(test, matches(t, pattern)), none)
    return df.withColumns(
        {
            "_mails": found(F.instr(t, "@") > 0, _MAIL_RUN),
            "_written": found(F.instr(t, "@") + F.instr(F.lower(t), "at)") + F.instr(F.lower(t), "at]") + F.instr(F.lower(t), "at}") > 0, _WRITTEN_MAIL),
            "_numbers": found(t.rlike("[0-9]"), _NUMBER_RUN),
        }
    )


_PLACED = ("_mails", "_written", "_numbers")


def with_base(df: DataFrame) -> DataFrame:
    """df with _base: the rules' spans (start, kind, end), sorted."""
    same = lambda x: x
    bad_dots = lambda x: F.regexp_replace(x, rf"(?<![{_DOMAIN}])\.|\.(?![{_DOMAIN}])", "\x02")
    mails, numbers = F.col("_mails"), F.col("_numbers")
    spans = F.concat(
        _within(mails, "email", bad_dots, _MAIL, lambda m: F.lit(True)),
        _within(numbers, "ip", same, _IP, _ip_valid),
        _within(numbers, "card", _lone_separators, _CARD, _card_valid),
        _within(numbers, "phone", same, _PHONE, _phone_valid),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return df.withColumn(
        "_base", F.when((F.size(mails) > 0) | (F.size(numbers) > 0), F.sort_array(spans)).otherwise(none)
    )


FEATURES = (
    "kind", "digits", "length", "groups", "longest", "different", "parens", "dots", "hyphens", "spaces", "check",
    "letter_before", "letter_after", "digit_beside", "open_before", "word_before", "gap", "breaks",
)


def _features(c: Column) -> Column:
    """What the trees see of a candidate (kind, hit, before, after)."""
    count = lambda signs: (F.length(c.hit) - F.length(F.translate(c.hit, signs, ""))).cast("double")
    yes = lambda test: F.when(test, 1.0).otherwise(0.0)
    groups = F.filter(F.split(c.hit, "[^0-9]+"), lambda x: x != "")
    digits = _digits(c.hit)
    return F.array(
        c.kind.cast("double"),
        F.length(digits).cast("double"),
        F.length(c.hit).cast("double"),
        F.size(groups).cast("double"),
        F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        F.size(F.array_distinct(F.split(digits, ""))).cast("double"),
        count("()"),
        count("."),
        count("-"),
        count(" "),
        yes(F.length(digits).between(8, 19) & luhn(digits)),
        yes(c.before.rlike(r"\p{L}$")),
        yes(c.after.rlike(r"^\p{L}")),
        yes(c.before.rlike("[0-9]$") | c.after.rlike("^[0-9]")),
        yes((c.before == "") | c.before.rlike(r"[\s\"'(\[<:=]\+?$")),
        yes(c.before.rlike(rf"(?i)({_WORDS})")),
        F.array_max(F.transform(F.split(c.hit, "[0-9]+"), F.length)).cast("double"),
        (F.size(F.split(c.hit, _BREAK)) - 1).cast("double"),
    )


#: Groups of digits that a candidate has at most: one digit each of the longest card.
GROUPS = 19


def candidates(keep=lambda c: c, choose=lambda found: found) -> Column:
    """array<struct> of what the generators propose: keep(start, kind, end, national, features), chosen from within a run.

    national: what stands before is a country code.
    """

    def made(c: Column) -> Column:
        return keep(
            F.struct(
                c.start.alias("start"),
                c.kind.alias("kind"),
                (c.start + F.length(c.hit)).cast("int").alias("end"),
                c.before.rlike(r"\+[0-9]{1,3}[\x20().\-]*$").alias("national"),
                let(c, _features).alias("features"),
            )
        )

    def shape(kind: str, start: Column, hit: Column, before: Column, after: Column) -> Column:
        return F.struct(
            start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
            hit.alias("hit"), before.alias("before"), after.alias("after"),
        )

    def joined(groups: Column) -> Column:
        return F.array_join(F.transform(groups, lambda g: F.concat(g.before, g.hit)), "")

    def windows(run: Column, groups: Column) -> Column:
        """(start, hit, before, after) of all windows of groups with 7 to 19 digits."""
        n = F.size(groups)

        def window(i: Column, k: Column) -> Column:
            # An opening parenthesis belongs to what follows it.
            own = F.slice(groups, i, k)
            first = own[0]
            opened = F.length(F.regexp_extract(first.before, r"\($", 0))
            gap = F.substr(first.before, F.lit(1), F.length(first.before) - opened)
            head = F.slice(groups, F.greatest(F.lit(1), i - BEFORE), F.least(F.lit(BEFORE), i - 1))
            tail = F.slice(groups, i + k, F.lit(AFTER))
            return F.struct(
                (run.start + first.start - opened).alias("start"),
                F.concat(F.right(first.before, opened), first.hit, joined(F.slice(own, F.lit(2), k))).alias("hit"),
                F.right(F.concat(F.when(i <= BEFORE, run.before).otherwise(""), joined(head), gap), F.lit(BEFORE)).alias("before"),
                F.left(
                    F.concat(joined(tail), F.element_at(groups, F.least(n, i + k - 1 + AFTER)).after, F.when(i + k - 1 + AFTER > n, run.after).otherwise("")),
                    F.lit(AFTER),
                ).alias("after"),
            )

        # Groups of digits: a window is left as soon as it holds too many digits.
        digits = lambda i, k: F.aggregate(F.slice(groups, i, k), F.lit(0), lambda x, g: x + F.length(g.hit))
        return F.flatten(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda i: F.transform(
                    F.filter(F.sequence(F.lit(1), F.least(F.lit(GROUPS), n - i + 1)), lambda k: _between(digits(i, k), 7, 19)),
                    lambda k: window(i, k),
                ),
            )
        )

    def of_numbers(run: Column) -> Column:
        enough = F.length(_digits(run.hit)) >= 7
        found = let(matches(run.hit, "[0-9]+"), lambda groups: windows(run, groups))
        phones = lambda w: F.filter(w, lambda m: ~F.contains(m.hit, F.lit("+")) & (F.length(_digits(m.hit)) <= 15))
        cards = lambda w: F.filter(w, lambda m: m.hit.rlike(r"^\(?[0-9]+(?:[\x20\-][0-9]+)*$") & (F.length(_digits(m.hit)) >= 12))
        # A card has no parenthesis.
        bare = lambda m: F.struct(
            (m.start + F.length(m.hit) - F.length(F.ltrim(m.hit, F.lit("(")))).alias("start"),
            F.ltrim(m.hit, F.lit("(")).alias("hit"), F.concat(m.before, F.regexp_extract(m.hit, r"^\(?", 0)).alias("before"), m.after.alias("after"),
        )
        one = lambda kind: lambda m: shape(kind, m.start, m.hit, m.before, m.after)
        parts = F.coalesce(matches(run.hit, r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"), F.array())
        ips = F.transform(
            parts,
            lambda m: shape(
                "ip",
                run.start + m.start,
                m.hit,
                # Beside the run stand the characters beside its first or last match.
                F.when(m.start > 0, F.coalesce(m.before, F.lit(""))).otherwise(run.before),
                F.when(m.start + F.length(m.hit) < F.length(run.hit), F.coalesce(m.after, F.lit(""))).otherwise(run.after),
            ),
        )
        numbers = let(
            found,
            lambda w: F.concat(F.transform(phones(w), one("phone")), F.transform(F.transform(cards(w), bare), one("card"))),
        )
        return F.concat(F.when(enough, numbers).otherwise(F.array()), ips)

    def of_run(run: Column) -> Column:
        address = F.array(shape("email", run.start, run.hit, run.before, run.after))
        return choose(F.transform(F.when(run.address, address).otherwise(of_numbers(run)), made))

    # Features stand in the plan once: numbers and addresses take the same way.
    marked = lambda runs, address: F.transform(
        runs, lambda r: F.struct(r.start.alias("start"), r.hit.alias("hit"), r.before.alias("before"), r.after.alias("after"), F.lit(address).alias("address"))
    )
    return F.flatten(F.transform(F.concat(marked("_numbers", False), marked("_written", True)), of_run))


def _meets(c: Column, spans: Column, kind: Column | None = None) -> Column:
    test = lambda s: (s.start < c.end) & (c.start < s.end)
    return F.exists(spans, (lambda s: test(s) & (s.kind == kind)) if kind is not None else test)


def _agrees(c: Column, spans: Column) -> Column:
    """Whether a rule agrees with a candidate: a number is the rule's, all of it or all after its country code."""
    number = (c.kind == KINDS.index("phone")) | (c.kind == KINDS.index("card"))
    same = lambda s: (s.kind == c.kind) & (s.end == c.end) & (s.start <= c.start) & ((c.start - s.start <= 2) | c.national)
    return F.when(number, F.exists(spans, same)).otherwise(_meets(c, spans, c.kind))


@dataclass(frozen=True)
class Model:
    """The trees as an SQL expression over the features f, and the least score per kind (None: nothing is added)."""

    score: str
    thresholds: tuple[float | None, ...]


_TEST = re.compile(r"IF\(f\[(\d+)\] <= ([-\d.e+]+)D, ")
_NUMBER = re.compile(r"([-\d.e+]+)D?")
_CONDITION = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)")


def _tree_as_sql(lines: list[str], at: int = 0) -> tuple[str, int]:
    """A tree's description as nested IF; the place after it."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return f"{float(line.split(':')[1])!r}D", at + 1
    condition = _CONDITION.match(line)
    yes, at = _tree_as_sql(lines, at + 1)
    no, at = _tree_as_sql(lines, at + 1)  # past the line of the opposite condition
    return f"IF(f[{condition[2]}] <= {float(condition[4])!r}D, {yes}, {no})", at


def trees_as_sql(model) -> str:
    parts = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]
        parts.append(f"{weight!r}D * {_tree_as_sql(lines)[0]}")
    return " + ".join(parts)


def examples(docs: DataFrame, text: str = "text") -> DataFrame:
    """(held, kind, features, label, n): how many candidates of all different texts have these features and this label.

    held: of texts that are kept from learning.
    """
    found = with_runs(docs.select(F.col(text).alias("text")).where("text RLIKE '[0-9@]'"), "text")
    found = found.select(F.xxhash64("text").alias("digest"), *_PLACED).where("size(_mails) + size(_written) + size(_numbers) > 0")
    found = with_base(found.dropDuplicates(["digest"]))
    # A row per run, with the rules' spans that meet it.
    own = lambda run: F.filter("_base", lambda s: (s.start < run.start + F.length(run.hit)) & (run.start < s.end))
    none = F.filter("_numbers", lambda run: F.lit(False))
    numbers = F.transform("_numbers", lambda run: F.struct(F.array(run).alias("_numbers"), none.alias("_written"), own(run).alias("_base")))
    addresses = F.transform("_written", lambda run: F.struct(none.alias("_numbers"), F.array(run).alias("_written"), own(run).alias("_base")))
    runs = found.select("digest", F.explode(F.concat(numbers, addresses)).alias("run")).select("digest", "run.*")
    each = runs.select((F.col("digest") % 4 == 0).alias("held"), "_base", F.explode(candidates()).alias("c"))
    label = _agrees(F.col("c"), F.col("_base")).cast("double").alias("label")
    return each.select("held", "c.kind", "c.features", label).groupBy("held", "kind", "features", "label").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Learn from the candidates of all documents, equal texts once."""
    nothing = Model("0D", (None,) * len(KINDS))
    rows = written(examples(docs, text), "examples")
    values = [F.col("features")[i].alias(x) for i, x in enumerate(FEATURES)]
    learned = rows.where("NOT held").select(*values, "label", F.col("n").cast("double").alias("n"))
    seen = learned.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    if seen["least"] == seen["most"]:
        return nothing
    columns = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
    # Splits are looked for in a sample of more rows than the square of the bins: with so many bins, in all rows.
    trees = GBTClassifier(
        maxIter=TREES, maxDepth=DEPTH, seed=1, labelCol="label", featuresCol="vector", weightCol="n", maxBins=max(32, isqrt(seen["n"]) + 1)
    )
    score = trees_as_sql(trees.fit(columns.transform(learned).select("vector", "label", "n")))
    # Thresholds from the part that was not learned from: the lowest that keeps the precision down to it.
    held = rows.where("held").select("kind", "label", "n", _scored(score, F.col("features")).alias("score"))
    by_score = held.groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("n")).alias("right"), F.sum("n").alias("n"))
    above = Window.partitionBy("kind").orderBy(F.desc("score"))
    kept = by_score.select("kind", "score", (F.sum("right").over(above) / (F.sum("n").over(above) + 1)).alias("precision"))
    least = {x["kind"]: x["least"] for x in kept.where(F.col("precision") >= PRECISION).groupBy("kind").agg(F.min("score").alias("least")).collect()}
    return Model(score, tuple(least.get(i) for i in range(len(KINDS))))


def _trees(score: str) -> list[tuple[float, tuple | float]]:
    """Weight and root of each tree of a score, SQL as trees_as_sql writes it; an inner node is (feature, limit, yes, no)."""
    at = 0

    def value() -> tuple | float:
        nonlocal at
        if test := _TEST.match(score, at):
            at = test.end()
            yes = value()
            at += len(", ")
            no = value()
            at += len(")")
            return int(test[1]), float(test[2]), yes, no
        number = _NUMBER.match(score, at)
        at = number.end()
        return float(number[1])

    found = []
    while at < len(score):
        weight = value()
        at += len(" * ")
        found.append((weight, value()))
        at += len(" + ")
    return found


def _scored(score: str, f: Column) -> Column:
    """The score over an array of features.

    The trees are arrays of numbers, filled up to the same depth, and not part of the plan: each node of the plan costs the
    driver time and memory.
    """
    trees = _trees(score)

    def depth(node) -> int:
        return 1 + max(map(depth, node[2:])) if isinstance(node, tuple) else 0

    levels = max((depth(root) for _, root in trees), default=0)
    inner = 2**levels - 1
    features, limits, leaves = [], [], []
    for weight, root in trees:
        nodes = [root]
        for i in range(inner):
            # A leaf above the last level stands for both its sides.
            feature, limit, yes, no = nodes[i] if isinstance(nodes[i], tuple) else (0, 0.0, nodes[i], nodes[i])
            features.append(feature)
            limits.append(limit)
            nodes += [yes, no]
        leaves += [weight * x for x in nodes[inner:]]
    numbers = lambda values, kind: F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")
    features, limits, leaves = numbers(features, "int"), numbers(limits, "double"), numbers(leaves, "double")

    def leaf(tree: Column) -> Column:
        down = lambda i, _: 2 * i + F.when(F.get(f, F.get(features, tree * inner + i)) <= F.get(limits, tree * inner + i), 1).otherwise(2)
        return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), down) - inner if levels else F.lit(0)

    if not trees:
        return F.lit(0.0)
    every = F.sequence(F.lit(0), F.lit(len(trees) - 1))
    return F.aggregate(every, F.lit(0.0), lambda total, tree: total + F.get(leaves, tree * (inner + 1) + leaf(tree)))


def _best(found: Column) -> Column:
    """Of scored candidates, the best that do not overlap a better one; of equal scores the one of fewer breaks, the longer, the first."""
    rank = lambda c: F.struct(-c.score, c.breaks, c.start - c.end, c.start, c.kind)
    order = lambda a, b: F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1).otherwise(0)
    kind = "array<struct<start:int,kind:int,end:int,score:double,breaks:double>>"
    return F.aggregate(
        F.array_sort(found, order),
        F.array().cast(kind),
        lambda kept, c: F.when(_meets(c, kept), kept).otherwise(F.concat(kept, F.array(c)).cast(kind)),
    )


def with_spans(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with _base (the rules' spans) and _spans (those and the added ones), sorted arrays of (start, kind, end)."""
    df = with_base(with_runs(df, text))
    limits = F.array(*[F.lit(x).cast("double") for x in model.thresholds])
    some = any(x is not None for x in model.thresholds)
    spans = F.col("_base")
    if some:
        # Features and scores live for one candidate at a time; what is kept of a run are the best that do not overlap.
        score = lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end"), let(c.features, trees).alias("score"), c.features[FEATURES.index("breaks")].alias("breaks"))
        trees = lambda f: _scored(model.score, f)
        good = lambda found: F.filter(found, lambda c: (c.score >= F.get(limits, c.kind)) & ~_meets(c, F.col("_base")))
        df = df.withColumn("cand", F.when((F.size("_numbers") > 0) | (F.size("_written") > 0), candidates(score, lambda found: _best(good(found)))))
        more = F.transform("cand", lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end")))
        spans = F.sort_array(F.array_union("_base", F.coalesce(more, F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    df = df.withColumn("_spans", spans).drop(*_PLACED)
    return df.drop("cand") if some else df


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with [EMAIL], [IP], [CARD] or [PHONE] in place of each span; of spans that meet, the first one's kind."""
    names = F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS])

    def join(merged: Column) -> Column:
        pieces = F.transform(
            merged,
            lambda s, i: F.concat(
                F.substr(
                    text,
                    F.when(i > 0, F.get(merged, i - 1).end).otherwise(0) + 1,
                    s.start - F.when(i > 0, F.get(merged, i - 1).end).otherwise(0),
                ),
                F.get(names, s.kind),
            ),
        )
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(merged, -1).end + 1))

    # Spans that meet become one, from the first one's start to the largest end.
    merge = F.expr(
        "aggregate(_spans, cast(array() AS array<struct<start:int,kind:int,end:int>>), (a, s) -> "
        "IF(size(a) > 0 AND element_at(a, -1).end > s.start, "
        "concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, element_at(a, -1).kind AS kind, "
        "greatest(element_at(a, -1).end, s.end) AS end))), concat(a, array(s))))"
    )
    return F.when(F.size(spans) > 0, let(merge, join)).otherwise(text)


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the spans in text redacted, and n_chars (if there) to match."""
    columns = docs.columns
    out = with_spans(docs, model).withColumn("text", redacted(F.col("text"), F.col("_spans")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*columns)


def found(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of every document."""
    docs = docs.select("doc_id", "text")
    rows = with_spans(docs, fit(docs))
    of_kind = lambda kind: F.filter("_base", lambda s: s.kind == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{x}") for k, x in enumerate(KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(as_text(F.col("_base")), 256).alias("base_sha256"), as_text(F.col("_spans")).alias("spans")
    )
