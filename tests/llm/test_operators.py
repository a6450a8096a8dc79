"""Operators over tables, against brute force, with nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saldo.llm import (
    fingerprints,
    html_rendering,
    jaccard_join,
    language_id,
    license_scan,
    packing,
    pii,
    quality_rules,
    sampled_pieces,
    url_filters,
)
from saldo.llm.components import components
from saldo.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, kept int, cand int, _base int"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, lower=True):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, near copies, and columns with names the operators use."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    texts = [None, "", " \n ", "Wort", "a b c d", "a B c d e f g", "A b c d e f g", "a b c d e f g h", "x " * 30_000, "5" * 40_000]
    for _ in range(40):  # a family of near copies
        copy = list(base)
        for _ in range(rng.randrange(12)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 8
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(80))) for _ in range(30)]
    texts += ["mail a.b@c.org or +1 (743) 555-3824, 4111 1111 1111 1111 at 10.0.0.255 and 300.1.1.1", "@@a@b..c@d.e_f@g.h"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s", None][i % 2], None if t is None else len(t), 1, 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, *rows[5][1:]), (None, *rows[0][1:]), (11, *rows[0][1:]), (12, "other words stand here now", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def links(rows):
    """Component and links of every row, by brute force over all pairs of rows."""
    sets = [shingles(r.text) for r in rows]
    parent, count = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                count[i] += 1
                count[j] += 1
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(root(i)), r.doc_id) if x is not None]
        least[root(i)] = min(ids) if ids else None
    return [(r.doc_id, len(sets[i]), least[root(i)], count[i]) for i, r in enumerate(rows)]


def in_order(rows):
    return sorted(rows, key=repr)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 480)] + [(5, 5)]
    parent = list(range(500))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert sorted(map(tuple, found)) == sorted((x, root(x)) for x in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(odd):
    rows = odd.collect()
    got = [tuple(r) for r in jaccard_join.joined(odd).collect()]
    assert in_order(got) == in_order(x[:3] for x in links(rows))
    assert jaccard_join.joined(odd.limit(0)).count() == 0


@pytest.mark.parametrize(("classes", "shingles"), [(3, 1 << 19), (256, 300)])
def test_jaccard_join_in_small_blocks(odd, monkeypatch, classes, shingles):
    monkeypatch.setattr(jaccard_join, "BLOCK", classes)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(jaccard_join.links_across, "__defaults__", (classes,))
    got = [tuple(r) for r in jaccard_join.joined(odd).collect()]
    assert in_order(got) == in_order(x[:3] for x in links(odd.collect()))


def test_jaccard_join_moves_texts_and_sets_alike_at_every_size(spark, monkeypatch):
    plans, write = {}, jaccard_join.written

    def seen(df, name):
        plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString())
        return write(df, name)

    monkeypatch.setattr(jaccard_join, "written", seen)
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (2, text + " eleven"), (3, text), (4, "none of these")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.joined(docs).collect())) == [(1, 6, 1), (2, 7, 1), (3, 6, 1), (4, 1, 4)]
    for name in ("classes", "links"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name]


def test_first_of_each(odd):
    kept = jaccard_join.first_of_each(odd).collect()
    assert kept[0].asDict().keys() == odd.limit(1).collect()[0].asDict().keys()
    want = links(odd.collect())
    assert sum(not shingles(r.text) for r in kept) == sum(n == 0 for _, n, _, _ in want)
    with_set = [r for r in kept if shingles(r.text)]
    assert all(x[3] == 0 for x in links(with_set)), "linked rows are left"
    assert {x[2] for x in want if x[1]} == {x[2] for x in links(with_set)}


def test_fingerprints(odd):
    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()
    given = odd.sparkSession.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(given).collect()}
    rows.sort(key=lambda r: -r.doc_id)
    for i, row in enumerate(rows):
        text, after = row.text or "", rows[(i + 1) % len(rows)].text or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        mine = got[row.doc_id]
        assert (mine.n_chars, mine.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((mine.near_edited, edited), (mine.near_next, after)):
            a, b = shingles(text, lower=False), shingles(other, lower=False)
            assert abs(value - (len(a & b) / len(a | b) if a | b else 1.0)) < 0.2
    assert fingerprints.edited_fingerprints(odd).count() == odd.count()
    assert fingerprints.edited_fingerprints(odd.limit(0)).count() == 0
    same = fingerprints.with_fingerprint(odd.select("doc_id", "text")).where("doc_id = 5").select("fingerprint").distinct()
    assert same.count() == 1


def test_packing(odd):
    import public_tokenizers

    ids = packing.ids_of(public_tokenizers.path(packing.VOCABULARY))
    got = packing.packed(odd).collect()
    assert sum(r.length for r in got) == sum(len(ids.whole(r.text or "")) + 1 for r in odd.collect())
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in got) // 1024) + 1
    long = [r for r in got if r.doc_id == 8]
    assert sorted((r.piece, r.length == 1024) for r in long)[1:] == [(i, True) for i in range(1, len(long))]
    coded = [*ids.whole(odd.where("doc_id = 8").first().text).tolist(), 2]
    for r in long:
        part = coded[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    assert packing.packed(odd.limit(0)).count() == 0


KINDS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: card(re.sub("[ -]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
)
NO_MODEL = pii.Model("0D", (None,) * 4)


def card(digits):
    twice = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(digits))]
    return 14 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m[0])]
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(found))


def test_personal_data_rules(spark, odd):
    rng = random.Random(3)
    parts = ["@", ".", "..", "a", "b-c", "_", "%", "+", "+1 ", "5", "12", "4111 1111 1111 1111", "4111-1111-1111-1111", "(743) 555-3824",
             "1.2.3.4", "300.1.1.1", "255.255.255.255", " ", "  ", "-", "\n", "é", "x@y.z", "foo.bar@mail.example.com", ".@", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    given = spark.createDataFrame(enumerate(texts), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = pii.with_spans(given, NO_MODEL).select("text", pii.as_text(F.col("_base")).alias("b")).collect()
    assert [(r.text, r.b) for r in got if r.b != spans(r.text)] == []


def test_personal_data_of_very_long_texts(spark):
    texts = ["a" * 300_000, "5 " * 100_000, "a@" * 50_000, "a@b" + ".c" * 30_000, "a@b.co " * 3_000, "+" * 100_000, "+1 555 555 5555 " * 3_000]
    given = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    got = pii.with_spans(given, NO_MODEL).select("doc_id", F.size("_base").alias("n"), "_base").collect()
    assert [r.n for r in sorted(got, key=lambda r: r.doc_id)] == [0, 0, 0, 1, 3_000, 0, 3_000]
    assert max(s.end for r in got for s in r._base if r.doc_id == 6) == 16 * 3_000 - 1


def test_personal_data_learned(spark):
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(600):
        texts.append(f"please call +1 ({number(3)}) 555-{number(4)} today number {i}")
        texts.append(f"order {number(12)} was shipped, item {i} of {number(9)}")
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    model = pii.fit(docs)
    assert model.thresholds[pii.KINDS.index("phone")] is not None
    new = spark.createDataFrame([(1, "please call 1 (743) 555-3824 today"), (2, "order 123456789012 was shipped"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.with_spans(new, model).select("doc_id", pii.as_text(F.col("_spans")).alias("s")).collect()}
    assert got == {1: "phone:12:28", 2: "", 3: ""}
    assert pii.fit(docs.limit(0)) == NO_MODEL
    base = pii.with_spans(docs, model).where("exists(_base, b -> NOT array_contains(_spans, b))")
    assert base.count() == 0


def test_redaction(odd):
    rows = {r.doc_id: r for r in pii.redact(odd, NO_MODEL).collect()}
    text = odd.where("text LIKE 'mail%'").first()
    assert rows[text.doc_id].text == "mail [EMAIL] or [PHONE], [CARD] at [IP] and 300.1.1.1"
    assert rows[text.doc_id].n_chars == len(rows[text.doc_id].text)
    assert (rows[0].text, rows[0].n_chars, rows[9].text) == (None, None, "5" * 40_000)


def test_quality_rules(spark, odd):
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(12))
    rows = [(i, "\n".join(line() for _ in range(8)), "en", "s") for i in range(300)]
    rows += [(1000 + i, re.sub(" ", "%%% ### ", rows[i][1]), "en", "s") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert all(got[i].kept for i in range(300))
    assert not any(got[1000 + i].kept for i in range(30))
    assert not any(r.base_failed for r in got.values())
    few = quality_rules.judged(odd).collect()
    assert len(few) == odd.count()
    assert all(r.base_failed and not r.kept for r in few if r.doc_id in (0, 1, 2, 8))
    assert quality_rules.judged(odd.limit(0)).count() == 0
    stay = quality_rules.keep_sound(docs.withColumns({"kept": F.lit(1), "v": F.lit(2)}))
    assert stay.count() == 300 and stay.columns == [*docs.columns, "kept", "v"]


def test_minimum_covariance_determinant_centre(spark):
    rng = random.Random(4)
    rows = [("en", "s", [rng.gauss(1.6, 0.1), abs(rng.gauss(0, 0.1)), 0.0, abs(rng.gauss(0.1, 0.1))]) for _ in range(800)]
    rows += [("en", "s", [rng.gauss(3.0, 0.1), 1.0, 1.0, 1.5]) for _ in range(150)]
    model = quality_rules.fit(spark.createDataFrame(rows, "lang string, source string, v array<double>"))
    found = model.where("level = 0").first()
    assert found.whole == 950
    assert abs(found.centre[0] - 1.6) < 0.03 and found.centre[2] < 0.01


def test_language_identification(spark, odd):
    path = f"{FOLDER}/documents.parquet"
    docs = spark.read.parquet(path)
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    rows = language_id.identified(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2, 9)} == {"und"}
    assert language_id.identified(odd.limit(0)).count() == 0


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :], re.S)[0]


def test_url_filters(spark):
    urls = [None, "foo", "HTTP://WWW.Example.COM/en/x?y", "://", "http://a.net/es/1", "http://a.net", "http://a.net#x/en/", "http://ÀB.net/es/" + "z/" * 40]
    urls += [f"http://h.org/blog/slug{i * 7}x/post" for i in range(40)] + [f"http://x.example.com/en/{i}" for i in range(50)]
    urls += [f"http://x.example.com/de/{i}" for i in range(50)] + [f"http://y.org/{x}/{i}" for i in range(9) for x in ("en", "de")]
    pages = spark.createDataFrame([(i, u, 1, "t") for i, u in enumerate(urls)] + [(3, "://", 1, "t")], "page_id long, url string, host int, template string")
    got = url_filters.judged(pages).collect()
    assert len(got) == len(urls) + 1
    by_id = {r.page_id: r for r in got}
    for i, url in enumerate(urls):
        row = by_id[i]
        assert (row.host, row.path) == url_parts(url)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (row.host == h or row.host.endswith("." + h)) and row.path.startswith(p)]
        assert row.rule == (max(fits)[1] if fits else None)
        if fits:
            assert row.verdict == max(fits)[2]
        elif row.host == "y.org":
            assert row.verdict == ("block" if "/en/" in url else "allow")
        else:
            assert row.verdict == "allow"
    assert {r.template for r in got if r.host == "h.org"} == {"/blog/{any}/post"}
    assert url_filters.judged(pages.limit(0)).count() == 0


def test_html_and_licenses_and_pieces(spark, odd):
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (None, "")], "page_id long, html string")
    assert in_order(map(tuple, html_rendering.extract(pages).collect())) == in_order([(1, "a"), (2, None), (None, "")])
    assert license_scan.scan(odd).count() == 0
    notice = odd.sparkSession.createDataFrame([(None, "x\nReleased under the MIT License."), (1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.end, r.license) for r in license_scan.scan(notice).collect()] == [(None, 2, 33, "MIT")]
    got = sampled_pieces.sampled(odd).collect()
    assert in_order((r.doc_id, r.decoded_sha256) for r in got) == in_order(
        (r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect()
    )
    coded = sampled_pieces.encode(odd)
    back = sampled_pieces.decode(coded).collect()
    assert in_order((r.doc_id, r.text) for r in back) == in_order((r.doc_id, r.text or "") for r in odd.collect())


def test_pipeline_stages(spark, odd):
    """Each stage against what the operators' own tests establish, on a small table."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, FOLDER)
        docs = docs.cache()
        if name == "best_fit_packing":
            break
        assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language_identification":
            assert docs.count() >= 0.97 * before.count()
        if name == "quality":
            assert docs.join(labels.where("quality = 0"), "doc_id").count() == 0
        if name == "near_duplicates":
            assert {r.doc_id for r in docs.collect()} == {i for i, n, c, _ in links(before.collect()) if i == c or not n}
        if name == "personal_data":
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                assert spans(r.text) == ""
                assert r.n_chars == len(r.text)
                assert (r.text == texts[r.doc_id]) == (spans(texts[r.doc_id]) == "")
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, FOLDER).count() >= 0
        assert stage(spark, odd.limit(0), FOLDER).count() == 0


def test_registered():
    assert sorted(int(x.split("_")[0][2:]) for x in QUERIES if x.startswith("op")) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
