"""Cases in which the operators on training text once did less than the whole job."""

import random
import textwrap

from pyspark.sql import functions as F

from saldo.llm import html_rendering, language_id, license_scan, pii, url_filters


def verdicts(spark, urls):
    """Verdict and template of every URL."""
    pages = spark.createDataFrame(enumerate(urls), "page_id long, url string")
    return {urls[r.page_id]: (r.verdict, r.template) for r in url_filters.judged(pages).collect()}


def test_many_sections_of_a_host_are_judged_apart(spark):
    for sections in (10, 40):
        urls = [f"http://h.net/{x}/{i}" for x in ("es", "fr") for i in range(20)]
        clean = [f"http://h.net/s{chr(97 + k // 26)}{chr(97 + k % 26)}/{i}" for k in range(sections) for i in range(6)]
        rare = [f"http://h.net/rare{chr(97 + k)}/1" for k in range(20)]
        got = verdicts(spark, urls + clean + rare)
        assert {got[x][0] for x in urls} == {"block"}
        assert {got[x][0] for x in clean + rare} == {"allow"}
        assert not {got[x][1] for x in urls} & {got[x][1] for x in clean + rare}


def test_deep_branches_are_judged_apart(spark):
    deep = "http://h.net/es/b/c/d/e/f/g/h", "http://k.net/a/b/c/d/e/f/g/h"
    rules = [("k.net", "/a/b/c/d/e/f/g/h/spam/", "block")]
    urls = [f"{deep[1]}/{x}/{w}/{i}" for x in ("spam", "docs") for w in ("u", "v") for i in range(20)]
    pages = spark.createDataFrame(enumerate([*urls, *[deep[0] + "/x" * 200]]), "page_id long, url string")
    got = {urls[r.page_id]: (r.verdict, r.template) for r in url_filters.judged(pages, rules).collect() if r.page_id < len(urls)}
    assert {x: v[0] for x, v in got.items()} == {x: "block" if "/spam/" in x else "allow" for x in urls}
    assert not {got[x][1] for x in urls if "/spam/" in x} & {got[x][1] for x in urls if "/docs/" in x}


def test_text_of_formulas_and_drawings_is_shown():
    render = html_rendering.render
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='tex'>x=2</annotation></semantics></math>"
    assert render(f"<p>If {formula} then") == "If x=2 then"
    drawing = "<svg><title>t</title><defs/><desc>d</desc><defs><text>no</text></defs><path d='M0'/><text x=1>Sales</text><text>2020</text></svg>"
    assert render(f"<p>a</p>{drawing}<p>b") == "a\n\nSales\n2020\n\nb"
    assert render("<svg><g display='none'><text>x</text></g></svg><desc>y</desc>") == "y"


def licenses(text):
    """Text and license of the blocks that are confirmed."""
    loaded = license_scan.Templates(tuple(sorted(license_scan.TEMPLATES.items())))
    return [(text[x[0] : x[1]], license_scan.NAMES.get(x[2], x[2])) for x in license_scan.judged(text, loaded) if x[-1]]


def test_wrapped_notices_are_confirmed():
    for name in ("MIT-permission", "BSD-2-Clause", "Apache-2.0-header"):
        for width in (20, 45, 72):
            lines = textwrap.wrap(license_scan.TEMPLATES[name], width, break_long_words=False, break_on_hyphens=False)
            notice = "\n".join(lines)
            assert licenses(f"A title\n\n{notice}\n\nAnd more.") == [(notice, license_scan.NAMES.get(name, name))]
            marked = "\r\n".join("   " + x for x in lines)
            assert [x[1] for x in licenses(marked)] == [license_scan.NAMES.get(name, name)]


def test_every_template_of_a_block_is_confirmed():
    long = "The code samples that go with this article, unless the author says otherwise, are released under the MIT License."
    assert licenses(long) == [(long, "MIT")]
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert licenses(two) == [("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0")]
    again = "Released under the MIT License.\n" * 3
    assert licenses(again) == [("Released under the MIT License.", "MIT")] * 3


def test_numbers_beside_numbers_are_found(spark):
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(600):
        texts.append(f"please call +1 ({number(3)}) 555-{number(4)} today number {i}")
        texts.append(f"order {number(12)} was shipped, item {i} of {number(9)}")
    model = pii.fit(spark.createDataFrame(enumerate(texts), "doc_id long, text string"))
    lists = {
        "call (743) 555-3824 (212) 555-0199 today": ["(743) 555-3824", "(212) 555-0199"],
        "call (743) 555-3824. 2024 was long": ["(743) 555-3824"],
        "call " + " ".join(["(743) 555-3824"] * 40): ["(743) 555-3824"] * 40,
    }
    given = spark.createDataFrame(enumerate(lists), "doc_id long, text string")
    rows = pii.with_spans(given, model).select("text", "_spans").collect()
    assert {r.text: [r.text[s.start : s.end] for s in r._spans] for r in rows} == lists
    proposed = pii.with_runs(spark.createDataFrame([("pay 4111 1111 1111 1111 2025 or 555-123-4567. 20240501",)], "t string"), "t")
    spans = proposed.select("t", F.explode(pii.candidates()).alias("c")).collect()
    assert {"4111 1111 1111 1111", "555-123-4567"} <= {r.t[r.c.start : r.c.end] for r in spans}


def test_languages_by_all_words_of_a_text(spark):
    rng = random.Random(6)
    made = lambda letters, n: ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(n)]
    words = {"aa": made("abcdefgh", 300), "bb": made("mnopqrst", 300)}
    rows = [(" ".join(rng.choices(words[x], k=150)), x) for x in words for _ in range(20)]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    # Of the one language many words of a small vocabulary, of the other a list of more different words.
    long = " ".join(rng.choices(words["aa"][:60], k=3000)) + " " + " ".join(words["bb"][:200])
    given = spark.createDataFrame([(long,), (" ".join(words["bb"][:200]),)], "text string")
    got = {r.text: r.p.lang_pred for r in given.select("text", language_id.prediction(model).alias("p")).collect()}
    assert got == {long: "aa", " ".join(words["bb"][:200]): "bb"}
