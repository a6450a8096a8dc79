"""HTML rendering: what a browser shows, grids with spans, and generated trees against a plain recursion."""

import random

import pytest

from saldo.llm import html_rendering
from saldo.llm.html_rendering import Cell, render


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr><td colspan=2>Head<td>C<tr><td>a<td>bb<td>c</table>", "Head   | C\na | bb | c"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A | b\n  | c\nd | e"),
        ("<table><tr><td colspan=9>only one<tr><td>x</table>", "only one\nx"),
        ("<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</table>", "A | b\n  | c\n  | d"),
        ("<table><tr><td colspan=2>a long heading<tr><td>x<td>y</table>", "a long heading\nx | y"),
        ("<input type=checkbox value=1>a<input type=password value=secret><input value=shown><input type=submit value=Go>", "ashownGo"),
        ("<details><summary>More</summary>inside</details>z", "More\nz"),
        ("<details open><summary>More</summary>inside</details>z", "More\ninside\nz"),
        ("<p style='visibility:hidden'>a <b style='visibility: visible'>b</b> c</p>d", "b\n\nd"),
        ("<p style='display:none'>a <b style='visibility: visible; display: inline'>b</b></p>d", "d"),
        ("<style>.x{display:none} #y, i { visibility : hidden }</style><p class='a x'>no<p>yes<b id=y>no</b><i>no</i>", "yes"),
        ("<style>p{display:none}p.on{display:block}</style><p>no<p class=on>yes<p class=on style='display:none'>no", "yes"),
        ("<style>@media print{p{display:none}} /* b{display:none} */ u{display:none!important}</style><p>a<u style='display:inline'>c</u>", "a"),
        ("<style>div p{display:none}</style><div><p>a</div>", "a"),
        ("<ul><li style='visibility:hidden'>a<li>b</ul>", "- b"),
        ("<div hidden>a</div><div hidden style='display:block'>b</div>", "b"),
    ],
)
def test_what_a_browser_shows(page, text):
    assert render(page) == text


def plain_grid(rows):
    """Columns of all cells by a table of places."""
    held, out = set(), []
    for y, row in enumerate(rows):
        x, placed = 0, []
        for cell in row:
            while (y, x) in held:
                x += 1
            width = 0
            while width < cell.columns and (y, x + width) not in held:
                width += 1
            for dy in range(min(cell.rows, len(rows) - y)):
                held.update((y + dy, x + dx) for dx in range(width))
            placed.append((x, width))
            x += width
        out.append(placed)
    last = max((x for row in out for x, _ in row), default=0)
    return [[(x, min(w, last - x + 1)) for x, w in row] for row in out]


def test_grids_against_a_table_of_places():
    rng = random.Random(1)
    for _ in range(400):
        rows = [[Cell("c", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 4])) for _ in range(rng.randrange(5))] for _ in range(rng.randrange(6))]
        assert [[(x, w) for x, w, _ in row] for row in html_rendering.grid(rows)] == plain_grid(rows)


def test_cells_of_a_column_stand_below_each_other():
    rng = random.Random(2)
    for _ in range(200):
        rows = [[Cell("x" * rng.randrange(1, 6), rng.choice([1, 1, 2]), rng.choice([1, 1, 2])) for _ in range(rng.randrange(1, 5))] for _ in range(rng.randrange(1, 5))]
        lines, starts = html_rendering._table(rows), {}
        for line, row in zip(lines, html_rendering.grid(rows), strict=True):
            at = 0
            for x, _, cell in row:
                found = line.index(cell.text, at)
                at = found + len(cell.text)
                starts.setdefault(x, set()).add(found)
        assert all(len(x) == 1 for x in starts.values()), lines


def test_spans_do_not_blow_up():
    page = "<table>" + "<tr><td rowspan=60000 colspan=1000>x" * 3000 + "</table>"
    assert render(page).split() == ["x"] * 3000


INLINE, BLOCK = ("b", "i", "span", "em"), ("div", "section", "article", "blockquote")


def generated(rng, depth, words, shown, seen):
    """Markup of a random tree; words takes those that are to be shown."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if kind < 0.45 or not depth:
            word = f"w{rng.randrange(10**6)}"
            out.append(word + rng.choice([" ", "\n", "&nbsp; "]))
            if shown and seen:
                words.append(word)
            continue
        tag = rng.choice(INLINE if kind < 0.7 else BLOCK)
        how = rng.choice(["", "", "", "hidden", "style='display:none'", "style='VISIBILITY: hidden'", "style=visibility:visible", "class=gone", "class='k faint'", "id=back"])
        inner_shown = shown and how not in ("hidden", "style='display:none'", "class=gone")
        inner_seen = {"style='VISIBILITY: hidden'": False, "class='k faint'": False, "style=visibility:visible": True, "id=back": True}.get(how, seen)
        out.append(f"<{tag} {how}>{generated(rng, depth - 1, words, inner_shown, inner_seen)}</{tag}> ")
    return "".join(out)


def test_generated_trees_show_just_what_is_visible():
    rng = random.Random(3)
    sheet = "<style>.gone{display:none}.k.faint{visibility:hidden}#back{visibility:visible}</style>"
    for _ in range(400):
        words = []
        page = sheet + "<body>" + generated(rng, 5, words, True, True)
        assert render(page).split() == words, page


def test_pages_as_a_table(spark):
    long = "<div><ul>" + "<li>item <b>of</b> a list" * 20_000 + "</ul><style>b{display:none}</style></div>"
    rows = [(1, long, "x"), (1, long, "x"), (2, "", "x"), (3, None, "x"), (None, "<p>a", "x"), (4, "<p>a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = html_rendering.extract(pages).collect()
    assert len(found) == 6 and html_rendering.extract(pages.limit(0)).collect() == []
    by_id = {r.page_id: r.text for r in found}
    assert by_id[1] == "\n".join(["- item a list"] * 20_000)
    assert (by_id[2], by_id[3], by_id[None], by_id[4]) == ("", None, "a", "a")
    assert sum(r.page_id == 1 and r.text == by_id[1] for r in found) == 2


def test_row_spans_hold_in_tables_of_any_size():
    for n in (50, 300, 1500):
        rows = [[Cell("a", 1, 65_534), Cell("b", 700)], *[[Cell("c", 1, 65_534)] for _ in range(n)]]
        assert [[(x, w) for x, w, _ in row] for row in html_rendering.grid(rows)] == [[(0, 1), (1, min(n, 700))], *[[(k, 1)] for k in range(1, n + 1)]]
    page = "<table><tr><td rowspan=0>A<td colspan=900>h<td>z" + "<tr><td colspan=900>c<td>d" * 300 + "</table>"
    assert render(page).split("\n") == ["A | h | z", *["  | c | d"] * 300]


def test_columns_without_a_first_cell_take_no_place():
    assert render("<table><tr><td colspan=900>a<td>b<tr><td colspan=900>cc<td>d</table>") == "a  | b\ncc | d"
