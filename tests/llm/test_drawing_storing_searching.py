"""Resampling, token files and lexical search against brute force, with odd rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from saldo.llm import lexical_search, perfect_hash, resampling, token_files, word_ids, words
from saldo.llm.queries import ORACLE, QUERIES
from saldo.session import new_folder
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, score long, rank int, n int, row int, part int, term string, shard int, weight int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "straße", "中文", "x9"]
    rows = [(i * 7, " ".join(rng.choices(vocabulary, weights=range(154, 0, -1), k=rng.randrange(90)))) for i in range(150)]
    rows += [(1, None), (2, ""), (3, " .,\n"), (4, "Word, WORD; word's é"), (5, "long " * 40_000), (6, "z" * 70_000)]
    rows += [rows[20]] * 3 + [(None, rows[21][1]), (None, None), (8, rows[22][1]), (9, rows[22][1])]
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "t", 6, 7) for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "w1 w2 W3 w140 w150"), (2, "É straße nothing"), (3, None), (4, ""), (5, "long w1"), (6, "w0 w0 w153 x9"), (6, "w7")]
    rows += [(7, "z" * 70_000), (None, "w9 word")]
    return spark.createDataFrame(rows, "item_id long, text string")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_matrices_of_equal_length_give_the_same_checksums():
    rng = random.Random(1)
    parts = [rng.randbytes(rng.choice([0, 1, 2, 3, 8, 8, 40, 300])) for _ in range(500)]
    bounds = np.append(0, np.cumsum([len(x) for x in parts]))
    found = resampling.crcs(np.frombuffer(b"".join(parts), dtype=np.uint8), bounds)
    assert found.tolist() == [zlib.crc32(x) for x in parts]


@pytest.mark.parametrize("chunk", [1 << 20, 60, 7])
@pytest.mark.parametrize(("shortest", "longest"), [(1, 1), (1, 3), (2, 2)])
def test_features_do_not_depend_on_how_texts_are_cut(monkeypatch, chunk, shortest, longest):
    monkeypatch.setattr(words, "CHUNK", chunk)
    rng = random.Random(5)
    texts = [None, "", " ", "A b", "y" * 50] + ["".join(rng.choices("aB é0,\n中", k=rng.randrange(120))) for _ in range(80)]
    n_words, n_features, found = resampling.features(pa.array(texts), shortest, longest, 1000)
    ends = np.cumsum(n_features)
    for i, text in enumerate(texts):
        own = terms(text)
        runs = [" ".join(own[a : a + n]) for n in range(shortest, longest + 1) for a in range(len(own) - n + 1)]
        assert n_words[i] == len(own)
        assert sorted(found[ends[i] - n_features[i] : ends[i]]) == sorted(zlib.crc32(x.encode()) % 1000 for x in runs)


def drawn(docs, target, least=20, percent=10):
    """(doc_id, n_features, weight, score, rank) of every row, by brute force."""
    count = {"s": Counter(), "t": Counter()}
    for side, rows in (("s", docs), ("t", target)):
        for _, text in rows:
            count[side].update(zlib.crc32(x.encode()) % 10_000 for x in terms(text))
    s_all, t_all = sum(count["s"].values()), sum(count["t"].values())

    def gain(b):
        ratio = float(count["t"][b] + 1) * float(s_all + 10_000) / (float(count["s"][b] + 1) * float(t_all + 10_000))
        return math.floor(1000 * math.log(ratio))

    rows = []
    for key, text in docs:
        own = terms(text)
        weight = sum(gain(zlib.crc32(x.encode()) % 10_000) for x in own)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = i + 1
    return sorted(map(str, rows))


def test_resampling(odd, items):
    target = [(r.item_id, r.text) for r in items.collect()]
    for percent in (10, 55, 100):
        found = resampling.resampled(odd, items, percent=percent)
        assert sorted(str(list(r)) for r in found.collect()) == drawn(pairs(odd), target, percent=percent)


def test_resampling_of_nothing_and_from_nothing(odd, items):
    assert resampling.resampled(odd.limit(0), items).collect() == []
    found = resampling.resampled(odd, items.limit(0))
    assert sorted(str(list(r)) for r in found.collect()) == drawn(pairs(odd), [])
    assert not resampling.resampled(odd, items, least=10**6).where("rank IS NOT NULL").collect()


def ranking(docs, items, k):
    own = [(key, Counter(terms(text))) for key, text in docs]
    n_docs, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    found = []
    for item, wanted in asked.items():
        scores = []
        for key, c in own:
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, total)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in wanted & c.keys()
            )
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        found += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores)[:k])]
    return sorted(map(str, found))


@pytest.mark.parametrize("k", [1, 5, 50, 1000])
def test_search(odd, items, k):
    found = lexical_search.search(odd, items, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(str(tuple(r)) for r in found.collect()) == ranking(pairs(odd), [tuple(r) for r in items.collect()], k)


def test_search_with_items_in_groups_and_with_nothing(odd, items):
    found = lexical_search.search(odd, items, 5, group_bytes=30_000)
    assert sorted(str(tuple(r)) for r in found.collect()) == ranking(pairs(odd), [tuple(r) for r in items.collect()], 5)
    assert lexical_search.search(odd.limit(0), items).collect() == []
    assert lexical_search.search(odd, items.limit(0)).collect() == []
    assert lexical_search.search(odd, items.where("item_id = 3")).collect() == []


def test_accumulators_are_limited_and_survivors_exact():
    """With one rare term of a high bound, most documents of the common term get no accumulator; the best are the same."""
    rng = np.random.default_rng(3)
    n, size = 4000, 12
    held = rng.random((n, size)) < np.linspace(0.01, 0.9, size)
    counts = np.where(held, rng.integers(1, 4, (n, size)), 0)
    docs, which = np.nonzero(counts)
    bounds = np.searchsorted(docs, np.arange(n + 1))
    block = lexical_search.Block(which, counts[docs, which], bounds, np.full(n, 100), size)
    weight = lexical_search.weights((counts > 0).sum(axis=0), n)
    share = (1_000_000_000 * counts) // (1000 * counts + 2000)
    scores = (share * weight * (counts > 0)).sum(axis=1)
    order = np.lexsort((np.arange(n), -scores))
    for floor in (0, int(scores[order[3]])):
        found, got = block.search(np.arange(size), weight, 10, floor)
        assert (got == scores[found]).all()
        best = {d for d in order[:10].tolist() if scores[d] >= floor}
        assert best <= set(found.tolist()) and len(found) < 40


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers

    return word_ids.WordIds(public_tokenizers.path(word_ids.VOCABULARY))


def direct(coder, text):
    return coder._tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [1 << 21, 50])
def test_ids_are_those_of_whole_texts(monkeypatch, coder, chunk):
    monkeypatch.setattr(word_ids, "CHUNK", chunk)
    rng = random.Random(3)
    signs = "ab ABÉéßÿÀ×÷ '’.,-!0 19\n\t\r_<|>sStT́中　   İΣςµ\x00\x1f"
    texts = [None, "", "it's we'll .'s 'S <|endoftext|> é É x"]
    texts += ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(1500)]
    assert [x.tolist() for x in coder(pa.array(texts))] == [direct(coder, x) for x in texts]


def test_perfect_hash_numbers_every_key_once():
    rng = np.random.default_rng(9)
    for keys in (np.empty(0, np.uint64), np.array([0], np.uint64), np.arange(5000).astype(np.uint64), np.unique(rng.integers(0, 2**63, 50_000)).astype(np.uint64)):
        hashed = perfect_hash.PerfectHash.of(keys)
        assert np.array_equal(np.sort(hashed.numbers(keys)), np.arange(len(keys)))
    assert hashed.numbers(np.empty(0, np.uint64)).tolist() == []


def in_files(coder, docs):
    rows, start = [], 0
    for key, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*direct(coder, text), 2]
        rows.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_token_files(spark, odd, coder):
    found = token_files.digests(odd).collect()
    expected = in_files(coder, pairs(odd))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((a, c, d) for a, _, c, d in expected)
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found] == [r[0] for r in expected]
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    assert token_files.digests(odd.limit(0)).collect() == []


def test_keyed_access(spark, odd, coder):
    folder = new_folder(spark, "tokens")
    token_files.write(odd, folder)
    files = token_files.TokenFiles(spark, folder)  # as another session would open it
    texts = {}
    for key, text in pairs(odd):
        texts.setdefault(key, []).append([*direct(coder, text), 2])
    for key in (0, 140, 1, 5, 6, 8):
        assert sorted(x.tolist() for x in files.get(key)) == sorted(texts[key])
    assert files.get(10) == [] and files.get(-1) == []
    some = files.read(spark.createDataFrame([(140,), (140,), (10,), (None,)], "key long")).collect()
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in some) == sorted(texts[140] + texts[None])


def test_a_key_on_several_shards(spark, coder):
    """An id that most rows share is spread over shards and still found whole."""
    rows = [(i, f"one {i}") for i in range(20)] + [(7, f"copy {i % 3}") for i in range(200)] + [(None, "n")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = token_files.write(docs, new_folder(spark, "tokens"))
    assert files.places(spark.createDataFrame([(7,)], "k long")).count() > 1
    expected = sorted([*direct(coder, t), 2] for k, t in rows if k == 7)
    assert sorted(x.tolist() for x in files.get(7)) == expected
    found = token_files.digests(docs).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((k, n) for k, _, n, _ in in_files(coder, rows))


@pytest.mark.parametrize("name", ["op11_resampling", "op13_lexical_search"])
def test_against_sql(spark, name):
    assert name in ORACLE
    assert compare(spark, connect(FOLDER), FOLDER, name) is None


def test_token_files_of_the_given_documents(spark, coder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_token_files"](spark, FOLDER).collect())) == sorted(in_files(coder, docs))
