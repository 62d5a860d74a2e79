"""One page's words as lines in reading order and as tables, from geometry alone.

Words are (x0, y0, x1, y1, text, size), top-left origin. The rules are those of
operators.layout and operators.tables, for a reader that holds one page at a time.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import pairwise

from leafmill.operators.layout import CROSSED_SHARE, FLANK_SHARE, GUTTER_SHARE, LEAST_BOXES, LEAST_ROWS, MOST_COLUMNS, SAME_LINE

#: Rulings that differ by less are one line; a filled box that is thinner is a ruling.
SNAP, THIN = 3.0, 2.0
#: Rows and columns that a table without rulings has at least, and the gap between its columns in letter heights.
LEAST_TABLE_ROWS, COLUMN_GAP, ALIGNED = 3, 1.2, 4.0


def baseline_rows(words: list[tuple]) -> list[list[tuple]]:
    """Words from the top, a row ending where y steps by over SAME_LINE; each row from the left."""
    rows: list[list[tuple]] = []
    for w in sorted(words, key=lambda w: (w[1], w[0])):
        if rows and abs(w[1] - rows[-1][-1][1]) <= SAME_LINE:
            rows[-1].append(w)
        else:
            rows.append([w])
    return [sorted(r, key=lambda w: w[0]) for r in rows]


def pieces(row: list[tuple], gap: float) -> list[list[tuple]]:
    """A row broken where a gap reaches `gap`."""
    made, reach = [[row[0]]], row[0][2]
    for w in row[1:]:
        if w[0] - reach >= gap:
            made.append([])
        made[-1].append(w)
        reach = max(reach, w[2])
    return made


def gutters(words: list[tuple], width: float) -> list[float]:
    """Middles of the gaps that part columns, from the left."""
    rows = baseline_rows(words)
    if len(words) < LEAST_BOXES or len(rows) < LEAST_ROWS or width <= 0:
        return []
    least, flank = max(2, int(width * GUTTER_SHARE)), max(2, int(len(rows) * FLANK_SHARE))
    spans = [[(p[0][0], max(w[2] for w in p)) for p in pieces(r, least)] for r in rows]
    left, right = int(min(w[0] for w in words)), int(max(w[2] for w in words))
    steps = defaultdict(int)
    for a, b in (s for row in spans for s in row):
        steps[int(a)] += 1
        steps[int(b) + 1] -= 1
    made, crossed, start = [], 0, None
    for x in range(left, right + 1):
        crossed += steps[x]
        if crossed <= len(rows) * CROSSED_SHARE:
            start = x if start is None else start
        elif start is not None:
            sides = [sum(any(test(s) for s in row) for row in spans) for test in (lambda s: s[1] <= start, lambda s: s[0] >= x)]  # noqa: B023
            if x - start >= least and min(sides) >= flank:
                made.append((start + x) / 2)
            start = None
    return made


def columns(words: list[tuple], width: float) -> tuple[list[float], bool]:
    """(cuts, looks_tabular): more than MOST_COLUMNS columns are a table, read row by row."""
    cuts = gutters(words, width)
    return ([], True) if len(cuts) + 1 > MOST_COLUMNS else (cuts, False)


def lines(words: list[tuple], cuts: list[float]) -> list[list[tuple]]:
    """Lines column by column, each column from the top."""
    by_column: dict[int, list[tuple]] = defaultdict(list)
    for w in words:
        by_column[sum((w[0] + w[2]) / 2 >= c for c in cuts)].append(w)
    return [row for _, some in sorted(by_column.items()) for row in baseline_rows(some)]


def _snapped(values: list[float]) -> list[float]:
    made: list[list[float]] = []
    for v in sorted(values):
        if made and v - made[-1][-1] <= SNAP:
            made[-1].append(v)
        else:
            made.append([v])
    return [sum(g) / len(g) for g in made]


def grids(rulings: list[tuple[float, float, float, float]]) -> list[tuple[list[float], list[float]]]:
    """(xs, ys) of every group of rulings that meet; a grid has two lines each way at least."""
    level = [r for r in rulings if r[3] - r[1] <= THIN and r[2] - r[0] > THIN]
    upright = [r for r in rulings if r[2] - r[0] <= THIN and r[3] - r[1] > THIN]
    every, group = level + upright, list(range(len(level) + len(upright)))

    def top(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    for i, a in enumerate(level):
        for j, b in enumerate(upright, len(level)):
            if a[0] - SNAP <= b[0] <= a[2] + SNAP and b[1] - SNAP <= a[1] <= b[3] + SNAP:
                group[top(i)] = top(j)
    found: dict[int, tuple[list[float], list[float]]] = defaultdict(lambda: ([], []))
    for i, r in enumerate(every):
        if i < len(level):
            found[top(i)][1].append((r[1] + r[3]) / 2)
        else:
            found[top(i)][0].append((r[0] + r[2]) / 2)
    made = [(_snapped(xs), _snapped(ys)) for xs, ys in found.values()]
    return sorted(((xs, ys) for xs, ys in made if len(xs) > 1 and len(ys) > 1), key=lambda g: (g[1][0], g[0][0]))


def _said(words: list[tuple]) -> str:
    """Words of a cell line by line: one is on a line if it overlaps it by over half of the shorter height."""
    made: list[list] = []
    for w in sorted(words, key=lambda w: (w[1], w[0])):
        if made and min(made[-1][1], w[3]) - max(made[-1][0], w[1]) > 0.5 * min(made[-1][1] - made[-1][0], w[3] - w[1]):
            made[-1] = [max(made[-1][0], w[1]), min(made[-1][1], w[3]), [*made[-1][2], w]]
        else:
            made.append([w[1], w[3], [w]])
    return " ".join(w[4] for line in made for w in sorted(line[2], key=lambda w: w[0]))


def filled(words: list[tuple], xs: list[float], ys: list[float]) -> list[list[str]]:
    """The grid's rows: a word belongs to the cell that holds its centre; blank rows are left out."""
    held = defaultdict(list)
    for w in words:
        x, y = (w[0] + w[2]) / 2, (w[1] + w[3]) / 2
        for r, (top, bottom) in enumerate(pairwise(ys)):
            for c, (left, right) in enumerate(pairwise(xs)):
                if left <= x <= right and top <= y <= bottom:
                    held[r, c].append(w)
    rows = [[_said(held[r, c]) for c in range(len(xs) - 1)] for r in range(len(ys) - 1)]
    return [r for r in rows if any(r)]


def whitespace_tables(words: list[tuple]) -> list[tuple[list[list[str]], tuple]]:
    """Runs of rows whose pieces stand under each other, by their left or right ends."""
    made, run = [], []

    def close() -> None:
        if len(run) >= LEAST_TABLE_ROWS:
            inside = [w for r in run for p in r for w in p]
            box = (min(w[0] for w in inside), min(w[1] for w in inside), max(w[2] for w in inside), max(w[3] for w in inside))
            made.append(([[" ".join(w[4] for w in p) for p in r] for r in run], box))
        run.clear()

    for row in baseline_rows(words):
        now = pieces(row, COLUMN_GAP * max(w[3] - w[1] for w in row))
        under = run and len(run[-1]) == len(now) and all(abs(a[0][0] - b[0][0]) <= ALIGNED or abs(a[-1][2] - b[-1][2]) <= ALIGNED for a, b in zip(run[-1], now))
        if len(now) < 2 or not under:
            close()
        if len(now) > 1:
            run.append(now)
    close()
    return made


def tables(words: list[tuple], rulings: list[tuple], prose: bool) -> list[tuple[list[list[str]], str, tuple]]:
    """(rows, basis, box): ruled tables, or else what gaps suggest; prose in columns is no table."""
    ruled = [(filled(words, xs, ys), "ruled", (xs[0], ys[0], xs[-1], ys[-1])) for xs, ys in grids(rulings)]
    ruled = [t for t in ruled if t[0]]
    return ruled or ([] if prose else [(rows, "whitespace", box) for rows, box in whitespace_tables(words)])
