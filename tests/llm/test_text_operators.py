"""Operators that work on single texts, against brute force."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from saldo.llm import fingerprints, html_rendering, language_id, packing, quality_rules, sampled_pieces
from saldo.llm.shingles import shingle_sets
from tests.llm.best_fit import sweep

WORDS = re.compile("[^\x20\x09-\x0d]+")
TEXTS = st.text(st.sampled_from(list(" \n\tabAB'é1.,|▁　\U0001f600")), max_size=60)


def shingle_words(text, size=5):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXTS, max_size=12))
def test_shingles_count_as_word_tuples(texts):
    column = pa.array([*texts, None], pa.string())
    assert [len(x) for x in shingle_sets(column, lower=True)] == [len(shingle_words(x)) for x in texts] + [0]


def test_shingles_of_long_texts():
    texts = ["x" * 600_000, "ab cd " * 150_000, " " * 300_000 + "q", "w%d " % 1 + "".join(f"w{i} " for i in range(90_000))]
    assert [len(x) for x in shingle_sets(pa.array(texts), lower=True)] == [len(shingle_words(x)) for x in texts]


def test_sketches_estimate_unequal_documents():
    rng = np.random.default_rng(1)
    large = np.unique(rng.integers(0, 2**64, 40_000, dtype=np.uint64))
    small = large[rng.permutation(len(large))[:2_000]]
    small.sort()
    a, b = fingerprints.sketch(small), fingerprints.sketch(large)
    resemblance, contained = fingerprints.compare(a, b)
    assert contained == 1.0
    assert abs(resemblance - len(small) / len(large)) < 0.01
    both = fingerprints.merge(fingerprints.sketch(large[::2]), fingerprints.sketch(large[1::2]))
    assert (both == b).all()
    assert (fingerprints.from_text(fingerprints.to_text(a)) == a).all()
    few = small[:10]
    assert fingerprints.compare(fingerprints.sketch(few), fingerprints.sketch(few[:5])) == (0.5, 0.5)
    none = few[:0]
    assert fingerprints.compare(none, none) == (1.0, 1.0)
    assert fingerprints.compare(none, few) == (0.0, 0.0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30) | TEXTS, min_size=1, max_size=8))
def test_ids_are_the_tokenizers(texts):
    path = public_tokenizers.path(packing.VOCABULARY)
    ids = packing.ids_of(path)
    assert [x.tolist() for x in ids(pa.array(texts, pa.string()))] == [ids.whole(x).tolist() for x in texts]


def test_ids_with_a_full_memo(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 300)
    rng = random.Random(5)
    words = ["".join(rng.choices("aeilnrst\u00e9", k=rng.randint(1, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, weights=range(400, 0, -1), k=30)) + rng.choice(["", ".\n42", " it's", "\n\n"]) for _ in range(300)]
    for most in (20, 60, 300):
        ids = packing.Ids(public_tokenizers.path(packing.VOCABULARY), most)
        assert [x.tolist() for x in ids(pa.array(texts, pa.string()))] == [ids.whole(x).tolist() for x in texts]


def test_runs_are_coded_once():
    ids = packing.Ids(public_tokenizers.path(packing.VOCABULARY))
    tokenize, calls = ids._memo._tokenize, []
    ids._memo._tokenize = lambda run: calls.append(run) or tokenize(run)
    words = ["".join(x) for x in itertools.product("abcdefghijklmnopqrst", repeat=4)] + ["".join(x) for x in itertools.product("uvwxyzABCDEFGHIJKLMN", repeat=4)]
    texts = pa.array([" " + " ".join(words[i : i + 5000]) for i in range(0, len(words), 5000)], pa.large_string())
    first = [x.tolist() for x in ids(texts)]
    assert [x.tolist() for x in ids(texts)] == first
    assert len(calls) == len(set(calls)) == len(words)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_sweep_is_best_fit_decreasing(counts):
    left, order = [], []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [x for x in left if x >= length]
            if fits:
                best = min(fits)
                left.remove(best)
                left.append(best - length)
            else:
                left.append(64 - length)
            order.append(length)
    used: dict[int, list] = {}
    placed = 0
    for length, low, high, first, each, offset in sweep(counts, 64):
        for rank in range(low, high):
            nth = rank - low
            used.setdefault(first + nth // each, []).append((offset + nth % each * length, length))
            placed += 1
    assert placed == sum(counts.values())
    assert len(used) == len(left)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30) | TEXTS, min_size=1, max_size=8), st.integers(0, 9))
def test_sampled_pieces_are_lossless_and_seeded(texts, seed):
    tables = sampled_pieces.pieces(public_tokenizers.path(sampled_pieces.VOCABULARY), 1.0)
    keys, column = np.arange(len(texts), dtype=np.uint64), pa.array(texts, pa.string())
    found = list(sampled_pieces.segment(keys, column, tables, seed))
    assert [sampled_pieces.decoded(x, tables) for x in found] == texts
    alone = [next(sampled_pieces.segment(keys[i : i + 1], column[i : i + 1], tables, seed)) for i in range(len(texts))]
    assert [x.tolist() for x in found] == [x.tolist() for x in alone]


def test_sampled_pieces_follow_the_lattice():
    tables = sampled_pieces.pieces(public_tokenizers.path(sampled_pieces.VOCABULARY), 1.0)

    def segmentations(text):
        if not text:
            yield (), 1.0
        for k in range(1, len(text) + 1):
            if found := tables.weights.get(text[:k]):
                for rest, weight in segmentations(text[k:]):
                    yield (found[1], *rest), found[0] * weight

    n = 20_000
    known = dict(segmentations(" then"))
    total = sum(known.values())
    counts: dict = {}
    for ids in sampled_pieces.segment(np.arange(n, dtype=np.uint64), pa.array(["then"] * n), tables, 0):
        counts[tuple(ids.tolist())] = counts.get(tuple(ids.tolist()), 0) + 1
    assert set(counts) <= set(known)
    assert max(abs(counts.get(x, 0) / n - w / total) for x, w in known.items()) < 0.015


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from(list("ab |#\n\tÉ")), max_size=80))
def test_quality_statistics(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    got = quality_rules.text_statistics(pa.array([text]))[0].as_py()
    assert got == {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(x in "#*$%&|<>" for x in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(again),
        "n_lines": len(lines),
    }


def test_chi_squared():
    # The survival function for four degrees of freedom is exp(-x / 2) * (1 + x / 2).
    x = quality_rules.chi_squared_quantile(1 - 1e-5, 4)
    assert np.exp(-x / 2) * (1 + x / 2) == pytest.approx(1e-5, rel=1e-4)
    assert quality_rules.chi_squared_quantile(0.95, 1) == pytest.approx(3.841459, rel=1e-5)


def test_letters_only_count_for_languages():
    assert language_id.different_words("The THE, dog-1 dog_2 Été") == "the dog été"
    assert language_id.different_words("123 !?") == ""


def test_html_layout():
    render = html_rendering.render
    assert render("<p>a<p>b<br>c") == "a\n\nb\nc"
    assert render("<ul><li>x<li>y<ol start=3><li>one<li>two</ol></ul>z") == "- x\n- y\n  3. one\n  4. two\n\nz"
    assert render("<table><tr><th>Name<th>N<tr><td>abc<td>1<br>2<tr><td>d</table>") == "Name | N\nabc  | 1\n     | 2\nd"
    assert render("<div hidden>a</div><i style='display: none'>b</i><script>if (a<b) '</p>'</script>c &amp; d") == "c & d"
    assert render("<pre>  k\n   l</pre>") == "  k\n   l"
    assert render("<b>x <p>y</b> z") == "x\n\ny z"
    assert [render(x) for x in ("", "<", "a<b c", "<p x=\"")][:2] == ["", "<"]
    assert render("<div>" * 50_000 + "x") == "x"
    assert render("<table><tr><td>" * 500 + "x") == "x"


def test_crc_of_pieces_is_over_all_ids():
    ids = np.array([1, 2, 50_000], dtype="<u4")
    assert zlib.crc32(ids[2:].tobytes(), zlib.crc32(ids[:2])) == zlib.crc32(ids.tobytes())
