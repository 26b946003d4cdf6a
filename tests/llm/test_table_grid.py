"""Tables and pages of random shape, against a plain reading of what must be shown."""

import random
import re

import pytest

from briefloom.llm import htmltext


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tbody><tr><td rowspan=9>a<td>b</tbody><tbody><tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tr><td rowspan=2 colspan=2>ab<td>x<tr><td>y</table>", "ab  x\n    y"),
        ("<table><tr><td rowspan='x'>a<td colspan='-1'>b<tr><td>c<td>d</table>", "a  b\nc  d"),
    ],
)
def test_spanned_rows(html, text):
    assert htmltext.visible_text(html) == text


def plain_grid(rows):
    """Every cell's first column, by marking all places that cells cover."""
    covered, placed = set(), []
    for i, row in enumerate(rows):
        column = 0
        for word, across, down in row:
            while (i, column) in covered:
                column += 1
            placed.append((i, column, across, word))
            covered |= {(r, c) for r in range(i, i + down if down else len(rows)) for c in range(column, column + across)}
            column += across
    return placed


def test_random_tables_are_aligned():
    rng, numbers = random.Random(8), iter(range(100_000))
    for _ in range(300):
        rows = [[(f"w{next(numbers)}", rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3, 0])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{w}</td>" for w, a, d in row) for row in rows) + "</table>"
        placed = plain_grid(rows)
        width = {}
        for _, column, across, word in placed:
            if across == 1:
                width[column] = max(width.get(column, 0), len(word))
        lines = htmltext.visible_text(html).split("\n")
        assert len(lines) == len(rows)
        reached = {}  # of each row: where its last text ends, if that is beyond its column
        for i, column, across, word in placed:
            at = sum(width.get(c, 0) for c in range(column)) + 2 * column
            found = re.search(rf"\b{word}\b", lines[i]).start()
            assert found == at or found > at and reached.get(i, 0) > 0
            room = sum(width.get(c, 0) for c in range(column, column + across)) + 2 * (across - 1)
            reached[i] = reached.get(i, 0) + max(0, len(word) - room)


def some_html(rng, numbers, depth, seen, hidden):
    """Random markup; puts the words that are visible into `seen`, in order."""
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["text", "text", "p", "div", "ul", "ol", "table", "hide", "script", "b", "h2", "blockquote"]) if depth else "text"
        inside = lambda hide=hidden: some_html(rng, numbers, depth - 1, seen, hide)
        if kind == "text":
            word = f"w{next(numbers)}"
            out.append(word + rng.choice([" ", "\n", "  "]))
            if not hidden:
                seen.append(word)
        elif kind in ("ul", "ol"):
            out.append(f"<{kind}>" + "".join(f"<li>{inside()}" + rng.choice(["", "</li>"]) for _ in range(rng.randint(1, 3))) + f"</{kind}>")
        elif kind == "table":
            # one line in each cell, so that words are read in order
            def cell():
                word = f"w{next(numbers)}"
                if not hidden:
                    seen.append(word)
                return f"<td>{word}"

            out.append("<table>" + "".join("<tr>" + cell() + cell() for _ in range(rng.randint(1, 3))) + "</table>")
        elif kind == "hide":
            mark = rng.choice(["hidden", "style='display:none'", 'style="visibility: hidden"', "class=gone"])
            out.append(f"<div {mark}>{inside(True)}</div>")
        elif kind == "script":
            out.append(rng.choice(["<script>var s1 = '<p>';</script>", "<style>.gone{display:none} .s2{color:red}</style>", "<!-- s3 -->", "<template>s4</template>"]))
        else:
            out.append(f"<{kind}>{inside()}</{kind}>")
    return " ".join(out)


def test_random_pages_keep_every_visible_word_in_order():
    rng, numbers = random.Random(9), iter(range(1_000_000))
    for _ in range(400):
        seen = []
        html = "<style>.gone{display:none}</style>" + some_html(rng, numbers, 4, seen, False)
        text = htmltext.visible_text(html)
        assert re.findall(r"\bw\d+\b", text) == seen, html
        assert not re.search(r"\bs\d\b|[<>]w|display", text)


def test_blocks_of_a_page_against_a_plain_layout():
    """Headings, paragraphs and flat lists: lines and the empty lines between them, from the parts alone."""
    rng = random.Random(10)
    for _ in range(200):
        html, lines = "", []
        for k in range(rng.randint(1, 8)):
            kind = rng.choice(["p", "h3", "div", "ul", "ol"])
            if kind in ("ul", "ol"):
                items = [f"i{k}x{j}" for j in range(rng.randint(1, 3))]
                html += f"<{kind}>" + "".join(f"<li>{x}" for x in items) + f"</{kind}>"
                block = [(f"{j + 1}. " if kind == "ol" else "- ") + x for j, x in enumerate(items)]
            else:
                html += f"<{kind}>t{k}</{kind}>\n"
                block = [f"t{k}"]
            spaced = kind != "div"
            if lines and (spaced or lines[-1][1]):
                lines.append(("", False))
            lines += [(x, spaced) for x in block]
        assert htmltext.visible_text(html) == "\n".join(x for x, _ in lines)
