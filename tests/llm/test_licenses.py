"""License scans: wordings, licenses that are nearly alike, and ranked against every template compared."""

import random
import time

from saldo.llm import license_scan
from saldo.llm.license_texts import TEXTS


def loaded_templates():
    return license_scan.Templates(tuple(sorted((x, wording) for x, (_, wording) in TEXTS.items())))


def confirmed(text, loaded):
    return [(TEXTS[x[2]][0], text[x[0] : x[1]]) for x in license_scan.judged(text, loaded) if x[-1]]


def test_license_wording():
    loaded = loaded_templates()
    for name, (license_name, text) in TEXTS.items():
        found = license_scan.judged(f"Read this.\n\n{text}\n\nAnd that.", loaded)
        assert [(x[2], x[4], x[5]) for x in found] == [(name, 0, True)], name
        wrapped = text.replace(" ", "\n", len(text) // 120).replace(", ", ",\n    ")
        assert [x[0] for x in confirmed(wrapped, loaded)] == [license_name], name
    changed = license_scan.judged("A line.\nLicensed under the Apache License, Version 1.1.", loaded)
    assert [(x[0], x[1], x[-1]) for x in changed] == [(8, 55, False)]
    inside = "Hello to all of you. Released under the MIT License. And more of the same follows here."
    assert [(x[2], inside[x[0] : x[1]]) for x in license_scan.judged(inside, loaded)] == [
        ("MIT", "Released under the MIT License.")
    ]
    assert license_scan.judged("", loaded) == [] == license_scan.judged(" \n ", loaded)


def test_licenses_are_told_apart_by_what_one_of_them_has():
    loaded = loaded_templates()
    two, three = TEXTS["BSD-2-Clause"][1], TEXTS["BSD-3-Clause"][1]
    assert [x[0] for x in confirmed(f"{two}\n\n{three}", loaded)] == ["BSD-2-Clause", "BSD-3-Clause"]
    assert [x[0] for x in confirmed(three[: three.index("THIS SOFTWARE")], loaded)] == ["BSD"]
    assert [x[0] for x in confirmed("# SPDX-License-Identifier: MIT\nimport os", loaded)] == ["MIT"]
    assert confirmed("SPDX-License-Identifier: Elsewhere-1.0", loaded) == []
    assert confirmed("Licensed under CC BY-ND 4.0.", loaded) == []
    later = TEXTS["GPL-2.0-or-later"][1]
    assert [x[0] for x in confirmed(later.replace("software: you", "software; you"), loaded)] == ["GPL-2.0-or-later"]
    assert [x[0] for x in confirmed(later.replace("version 2", "version 3"), loaded)] == ["GPL-3.0-or-later"]
    both = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert [x[0] for x in confirmed(both, loaded)] == ["MIT", "Apache-2.0"]
    article = "The code samples that go with this article, unless the author says otherwise, are released under the MIT License."
    assert [x[0] for x in confirmed(article, loaded)] == ["MIT"]


def plain_places(template, block):
    """Parts that confirm a template, by aligning it with the whole block again and again."""
    parts, found = [(0, len(block))], []
    while parts:
        low, high = parts.pop()
        count, decisive, first, end = license_scan.aligned(template, block[low:high])
        if high > low and count <= license_scan.DIFFERENT * len(template):
            if not decisive:
                found.append((low + first, low + end, count))
            parts += [(low, low + first), (low + end, high)]
    return sorted(found)


def notices(rng):
    """A paragraph of notices with some words changed, and others between them."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        own = rng.choice(list(TEXTS.values()))[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, len(own) // 12])):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1])] = rng.choice([[], ["word"], ["license"], [own[at]]])
            own = own or ["x"]
        out += own + [rng.choice(["the", "license", "of", "our", "text"]) for _ in range(rng.randrange(40))]
    return " ".join(out)


def test_winners_are_all_that_the_wording_confirms():
    """Compression keeps no template from being found: the same as with every template compared in every window."""
    loaded, rng = loaded_templates(), random.Random(2)
    for _ in range(60):
        text = notices(rng)
        own = license_scan.words(text)
        spans = [x.span() for x in license_scan._WORD.finditer(text)]
        ranked = loaded.confirmed(own, lambda a, b, among: loaded.winners(text[spans[a][0] : spans[b - 1][1]], among))  # noqa: B023
        assert ranked == loaded.confirmed(own, lambda a, b, among: among), text


def test_places_are_those_of_whole_alignments():
    rng = random.Random(3)
    for _ in range(300):
        size = rng.choice([2, 5, 8, 15, 40])
        template = [rng.choice("abcdefghijklmnopqrstuvw") + str(i % 7 or "") * 0 for i in range(size)]
        block = []
        for _ in range(rng.randrange(4)):
            part = list(template)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(part))
                part[at : at + rng.choice([0, 1])] = rng.choice([[], ["zz"]])
                part = part or ["q"]
            block += part + ["zz"] * rng.randrange(3 * size // 2, 2 * size)
        found = list(license_scan.places(template, license_scan._seeds(template), block))
        assert [(b - a, n) for a, b, n in found] == [(b - a, n) for a, b, n in plain_places(template, block)], (template, block)


def test_a_paragraph_of_notices_takes_time_in_proportion():
    loaded = loaded_templates()
    one = "Released under the MIT License. " + "Licensed under the Apache License, Version 2.0. "
    seconds = {}
    for n in (500, 2000):
        start = time.perf_counter()
        found = license_scan.judged(one * n, loaded)
        seconds[n] = time.perf_counter() - start
        assert len(found) == 2 * n and all(x[-1] for x in found)
    assert seconds[2000] < 8 * seconds[500]
    text = "license " + "words of a text without any line " * 20_000
    assert [x[-1] for x in license_scan.judged(text, loaded)] == [False]


def test_wording_is_an_edit_distance():
    wording = license_scan.wording
    assert wording(["a", "b", "c"], ["x", "a", "b", "c", "y"]) == (0, False)
    assert wording(["a", "b", "c"], ["a", "c"]) == (1, False)
    assert wording(["version", "2"], ["version", "3"]) == (1, True)
    assert wording(["may", "use"], ["may", "not", "use"]) == (1, True)
    assert wording(["a"], []) == (1, False)
