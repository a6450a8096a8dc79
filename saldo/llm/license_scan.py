"""License scans by conditional compression.

Paragraphs that hold a word of licensing are taken in windows of words (white space folded; a short paragraph is one window,
a long one is cut into overlapping windows, shorter ones for shorter templates, so that every notice lies whole in one and
makes up a good part of it). Each window is compressed alone and with each of its templates as a zstandard raw-content
dictionary. What a dictionary saves is measured against what the template costs alone,
so a long window does not hide a short template, and templates are ranked by that. Every one that saves at least SAVED of
its own cost is a winner, and its wording is compared where the window has runs of its words: text and template are aligned
word by word, and the differences (words missing, added, or changed) may be at most DIFFERENT of the template's words, and
none of them a number, a negation or another word that makes another license of it. Each part that confirms a template is a
block; of parts that overlap the longest match stays, so a text that has all of one license and more is the other. Candidate
lines without one are compressed alone and with every dictionary; the template that makes the line smallest is named.

The work is linear in the text: windows are of bounded size, and a template is aligned with stretches of about its own length.

Defined cases: null and empty texts have no block; blocks with no confirmed template are returned without a license;
of equal ranks the first template by name wins; equal rows give equal results. Positions are code points, the end
exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.llm.license_texts import TEXTS

#: The wording of each template, and the license that it states.
_NAMED = TEXTS | {"MIT-permission": TEXTS["MIT-grant"]}  # an earlier name
TEMPLATES = {name: wording for name, (_, wording) in _NAMED.items()}
NAMES = {name: license_name for name, (license_name, _) in _NAMED.items()}
#: What a block must hold to be compressed at all.
CANDIDATE = (
    r"(?i)licen[cs]|copyright|spdx|redistribut|permission\s+(?:is|to)\s|creative\s+commons|all\s+rights\s+reserved|public\s+domain"
)
#: Least share by which an unconfirmed template must make a block smaller to be named.
SMALLER = 0.35
#: Largest share of a template's words that may differ.
DIFFERENT = 0.15
#: Lines with more words than this are cut into sentences where nothing is confirmed.
LONG = 120
#: Share of a template's cost that its dictionary must save for its wording to be compared.
SAVED = 0.25
#: Templates up to so many words have windows of their own, WIDE times as long.
LENGTHS = (12, 48, 192)
WIDE = 4
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_DECISIVE = re.compile(r"^(?:.*\d.*|no|not|non|without|nc|nd|sa|by(?:-\w+)*|lesser|affero|general)$")


def words(text: str) -> list[str]:
    return [x.lower() for x in _WORD.findall(text)]


def aligned(template: list[str], block: list[str]) -> tuple[int, bool, int, int]:
    """Differences between a template and the part of a block most like it; whether one of them is decisive; that part.

    Rows are template words, columns block words; the template may begin and end anywhere in the block.
    """
    width = len(block) + 1
    steps = np.zeros((len(template) + 1, width), dtype=np.int32)
    steps[:, 0] = np.arange(len(template) + 1)
    codes: dict[str, int] = {}
    have = np.array([codes.setdefault(x, len(codes)) for x in block], dtype=np.int64)
    offset = np.arange(width)
    for i, word in enumerate(template, 1):
        row = steps[i - 1] + 1
        row[1:] = np.minimum(row[1:], steps[i - 1, :-1] + (have != codes.get(word, -1)))
        # Added words cost one each: a running minimum of what is left of each place.
        steps[i] = np.minimum.accumulate(row - offset) + offset
    j = end = len(block) - int(np.argmin(steps[-1, ::-1]))  # of equal ones the last, which matches more words
    i, count, decisive = len(template), int(steps[-1, j]), False
    while i:
        if j and steps[i, j] == steps[i - 1, j - 1] + (template[i - 1] != block[j - 1]):
            if template[i - 1] != block[j - 1]:
                decisive |= bool(_DECISIVE.match(template[i - 1]) or _DECISIVE.match(block[j - 1]))
            i, j = i - 1, j - 1
        elif steps[i, j] == steps[i - 1, j] + 1:
            decisive |= bool(_DECISIVE.match(template[i - 1]))
            i -= 1
        else:
            decisive |= bool(_DECISIVE.match(block[j - 1]))
            j -= 1
    return count, decisive, j, end


def wording(template: list[str], block: list[str]) -> tuple[int, bool]:
    """Differences between a template and the part of a block most like it; whether one of them is decisive."""
    return aligned(template, block)[:2]


def _seeds(template: list[str]) -> dict[tuple[str, str], list[int]]:
    """Where each pair of neighbouring words stands in a template."""
    found: dict[tuple[str, str], list[int]] = {}
    for i, pair in enumerate(zip(template, template[1:], strict=False)):
        found.setdefault(pair, []).append(i)
    return found


def places(template: list[str], seeds: dict, block: list[str]) -> Iterator[tuple[int, int, int]]:
    """First word, end and differences of each part of a block that confirms a template.

    A difference spoils two pairs of words at most, and shifts what follows by one. So a part has pairs enough whose places
    say that it begins about here; around these it is aligned.
    """
    size, most = len(template), int(DIFFERENT * len(template))
    if not most:
        at = 0
        while at + size <= len(block):
            if block[at] == template[0] and block[at : at + size] == template:
                yield at, at + size, 0
                at += size
            else:
                at += 1
        return
    need = max(1, size - 1 - 2 * most)
    begins = sorted(j - i for j, pair in enumerate(zip(block, block[1:], strict=False)) for i in seeds.get(pair, ()))
    past = low = 0
    while low < len(begins):
        high = bisect_right(begins, begins[low] + 2 * most)
        if high - low < need:
            low += 1
            continue
        first, end = max(past, begins[low] - most), min(len(block), begins[high - 1] + size + most)
        count, decisive, start, stop = aligned(template, block[first:end])
        # What begins up to the last of these places lies within; so the next part begins behind it, or behind this one.
        behind = begins[high - 1]
        if count <= most and not decisive:
            yield first + start, first + stop, count
            past = behind = first + stop
        low = max(bisect_right(begins, begins[low]), bisect_right(begins, behind - most - 1))


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        import zstandard

        settings = dict(
            window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=3, target_length=32,
            strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_dict_id=0, write_checksum=0,
        )
        parameters = zstandard.ZstdCompressionParameters(**settings)
        self.names = [x for x, _ in templates]
        self.words = [words(x) for _, x in templates]
        self._seeds = [_seeds(x) for x in self.words]
        longest = max(map(len, self.words), default=0)
        limits = sorted({min([*(x for x in LENGTHS if x >= len(w)), max(longest, 1)]) for w in self.words})
        #: Templates by the length of their windows.
        self.groups = {
            WIDE * limit: [i for i, w in enumerate(self.words) if below < len(w) <= limit]
            for below, limit in zip([0, *limits], limits, strict=False)
        }
        self._alone = zstandard.ZstdCompressor(compression_params=parameters)
        self._with = [
            zstandard.ZstdCompressor(
                compression_params=parameters,
                dict_data=zstandard.ZstdCompressionDict(x.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for _, x in templates
        ]
        self._cost = [len(self._alone.compress(x.lower().encode())) for _, x in templates]

    def judge(self, block: str) -> tuple[str | None, float, int | None, bool]:
        """The confirmed template (or the best), its reduction and differences, and whether it is confirmed."""
        reductions = self.reductions(block)
        own, best = words(block), None
        for i in self._ranked(reductions):
            count, decisive = wording(self.words[i], own)
            found = (self.names[i], reductions[i], count, not decisive and count <= DIFFERENT * len(self.words[i]))
            if found[3]:
                return found
            best = best or (found if reductions[i] >= SMALLER else None)
        return best or (None, max(reductions), None, False)

    def reductions(self, block: str) -> list[float]:
        """Per template the share by which it makes a block smaller."""
        data = block.lower().encode()
        alone = len(self._alone.compress(data))
        return [1 - len(x.compress(data)) / alone for x in self._with]

    def _ranked(self, reductions: list[float]) -> list[int]:
        """Places of the templates, what makes the block smallest first."""
        return sorted(range(len(reductions)), key=lambda i: (-reductions[i], -len(self.words[i]), i))

    def reduction(self, block: str, i: int) -> float:
        """The share by which one template makes a block smaller."""
        data = block.lower().encode()
        return 1 - len(self._with[i].compress(data)) / len(self._alone.compress(data))

    def winners(self, block: str, among: list[int]) -> list[int]:
        """Of some templates those that save enough of their own cost, by rank."""
        data = block.lower().encode()
        alone = len(self._alone.compress(data))
        saved = {i: (alone - len(self._with[i].compress(data))) / self._cost[i] for i in among}
        return sorted((i for i in among if saved[i] >= SAVED), key=lambda i: (-saved[i], i))

    def windows(self, own: list[str]) -> Iterator[tuple[int, int, list[int]]]:
        """First word, end and templates of the windows; a part half as long as a window lies in one whole."""
        for size, among in self.groups.items():
            for first in range(0, max(1, len(own) - size // 2), size // 2):
                yield first, min(len(own), first + size), among

    def confirmed(self, own: list[str], winners: Callable[[int, int, list[int]], list[int]]) -> list[tuple[int, int, int, int]]:
        """First word, end, differences and template of the parts of a paragraph that confirm one, in order.

        winners: of a window's templates those to compare with it. Of parts that overlap the one of most matching words stays.
        """
        found = set()
        for low, high, among in self.windows(own):
            for i in winners(low, high, among):
                found |= {(low + a, low + b, n, i) for a, b, n in places(self.words[i], self._seeds[i], own[low:high])}
        out, taken = [], bytearray(len(own))
        for x in sorted(found, key=lambda x: (x[2] - len(self.words[x[3]]), x[2], x[0], x[3])):
            if not any(taken[x[0] : x[1]]):
                taken[x[0] : x[1]] = b"\1" * (x[1] - x[0])
                out.append(x)
        return sorted(out)


@lru_cache(maxsize=4)
def _loaded(templates: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(templates)


def paragraphs(text: str) -> Iterator[list[tuple[int, str]]]:
    """Starts and texts of the adjacent lines that are not blank, where one is a candidate or the lines together are."""
    test, at, lines = re.compile(CANDIDATE), 0, []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            lines.append((at, line))
        elif lines:
            if test.search(" ".join(x.strip() for _, x in lines)):
                yield lines
            lines = []
        at += len(line) + 1


def sentences(at: int, line: str) -> Iterator[tuple[int, str]]:
    """Start and text of the candidate sentences of a line."""
    test, inner = re.compile(CANDIDATE), 0
    for gap in [*_SENTENCE.finditer(line), None]:
        piece = line[inner : gap.start() if gap else len(line)]
        if test.search(piece):
            yield at + inner, piece
        inner = gap.end() if gap else inner


def judged(text: str, loaded: Templates) -> list[tuple]:
    """(start, end, template, reduction, differences, confirmed) of the candidate blocks.

    Paragraphs are searched whole, with white space folded. What confirms a template gives a block: its line or lines, or,
    where these confirm several or hold more than the one, its sentences. Candidate lines with nothing confirmed are blocks
    without a license; those of more than LONG words by sentence.
    """
    out, test = [], re.compile(CANDIDATE)
    for lines in paragraphs(text):
        starts = [at for at, _ in lines]
        first, last = starts[0], lines[-1][0] + len(lines[-1][1])
        inside = text[first:last]
        spans = [(x.start() + first, x.end() + first) for x in _WORD.finditer(inside)]
        folded = lambda a, b: " ".join(text[spans[a][0] : spans[b - 1][1]].split())  # noqa: B023, E731

        def winners(a: int, b: int, among: list[int]) -> list[int]:
            block = folded(a, b) if a < b else ""  # noqa: B023
            return loaded.winners(block, among) if test.search(block) else []

        found = loaded.confirmed(words(inside), winners)
        # The sentences of the paragraph; what stands between them is white space.
        gaps = [(x.start() + first, x.end() + first) for x in _SENTENCE.finditer(inside)]
        cuts, ends = [first, *(x for _, x in gaps)], [*(x for x, _ in gaps), last]
        line = lambda at: bisect_right(starts, at) - 1  # noqa: B023, E731
        hits = [(spans[a][0], spans[b - 1][1], count, i) for a, b, count, i in found]
        holds = Counter(k for a, b, _, _ in hits for k in range(line(a), line(b - 1) + 1))
        for n, (a, b, count, i) in enumerate(hits):
            k, m = line(a), line(b - 1)
            block = starts[k], starts[m] + len(lines[m][1])
            smaller = None if any(holds[x] > 1 for x in range(k, m + 1)) else loaded.reduction(text[slice(*block)], i)
            if smaller is None or smaller < SMALLER:
                block = max(block[0], cuts[bisect_right(cuts, a) - 1]), min(block[1], ends[bisect_right(cuts, b - 1) - 1])
                # In a sentence with another notice, the notice alone.
                if (n and hits[n - 1][1] > block[0]) or (n + 1 < len(hits) and hits[n + 1][0] < block[1]):
                    block = (a, b)
                smaller = loaded.reduction(text[slice(*block)], i)
            out.append((*block, loaded.names[i], smaller, count, True))
        for k, (at, value) in enumerate(lines):
            if holds[k] or not test.search(value):
                continue
            parts = sentences(at, value) if value.count(" ") >= LONG else [(at, value)]
            out += [(start, start + len(x), *loaded.judge(x)) for start, x in parts]
    return sorted(out, key=lambda x: x[:2])


RESULT = "doc_id long, start long, `end` long, template string, license string, reduction double, differences int, confirmed boolean"


def scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One row per candidate block of each document; templates: license and wording by name."""
    given = tuple(sorted((templates or TEXTS).items()))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.bool_()]
    names = ["doc_id", "start", "end", "template", "license", "reduction", "differences", "confirmed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, licenses = _loaded(tuple((x, wording) for x, (_, wording) in given)), {x: y for x, (y, _) in given}
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, end, name, smaller, count, confirmed in judged(text, loaded):
                    license_name = licenses[name] if confirmed else None
                    out.append((key, start, end, name, license_name, smaller, count, confirmed))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE)).mapInArrow(run, RESULT)
