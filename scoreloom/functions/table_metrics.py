"""Table metrics on parsed tables: grid similarity, tree edit distance, record match and header accuracy. Kernels for one pair of tables each."""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np

from . import kernels, prose
from .grids import Cell, Table, html_tables

#: Header texts of columns agree from here on; names of columns without a header; cells that count as empty (fixed values).
COLUMN, NAMELESS = 0.9, "col_"
EMPTY = ("", "nan", "NaN", "NAN", "none", "None", "-", "—", "n/a", "N/A")
#: Cells of the larger table beyond which a ratio of dimensions above SKIP_RATIO scores 0 without a kernel.
SKIP_CELLS, SKIP_RATIO = 2500, 1.5


# --- grid similarity ----------------------------------------------------------------------------------------------------------------------


def cell_grid(t: Table) -> list[list[str]]:
    return [[prose.cell(x) for x in row] for row in t.matrix(clip=True)]


def grits(true: list[list[str]], got: list[list[str]]) -> dict:
    """f, and the aligned rows and columns, of two grids."""
    sizes = [(len(g), len(g[0]) if g else 0) for g in (true, got)]
    large = max(a * b for a, b in sizes) > SKIP_CELLS
    if large and any(max(x) > SKIP_RATIO * max(1, min(x)) for x in zip(*sizes, strict=True)):
        return {"f": 0.0, "rows": [], "cols": []}
    return kernels.grid_similarity(true, got)


def paired(true: list[Table], got: list[Table]) -> tuple[list[int | None], dict[tuple[int, int], dict]]:
    """(the partner of each true table, results of all pairs) by assignment on grid similarity."""
    ours, theirs = [cell_grid(t) for t in true], [cell_grid(t) for t in got]
    all_ = {(i, j): grits(a, b) for i, a in enumerate(ours) for j, b in enumerate(theirs)}
    worth = np.array([[all_[i, j]["f"] for j in range(len(theirs))] for i in range(len(ours))]).reshape(len(ours), len(theirs))
    partner = dict(kernels.assign(-worth))
    return [partner.get(i) for i in range(len(ours))], all_


# --- trees -----------------------------------------------------------------------------------------------------------------------------------


@dataclasses.dataclass
class Node:
    tag: str
    colspan: int = 1
    rowspan: int = 1
    text: str = ""
    children: list[Node] = dataclasses.field(default_factory=list)
    inner: int = 0  # elements within a cell, which count for the size of the tree alone


class _TreeReader(HTMLParser):
    VOID = ("br", "hr", "img", "input", "wbr", "col")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.roots: list[Node] = []
        self.open: list[Node] = []
        self.cell: Node | None = None
        self.within: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.cell is not None and (self.within or tag not in ("td", "th", "tr", "tbody", "thead", "tfoot")):
            self.cell.inner += 1
            self.cell.text += f"<{tag}>"
            if tag not in self.VOID:
                self.within.append(tag)
            return
        self.cell = None
        if tag in ("td", "th"):
            self._close(("td", "th"), ("tr",))
        elif tag == "tr":
            self._close(("td", "th", "tr"), ("tbody", "thead", "tfoot", "table"))
        elif tag in ("tbody", "thead", "tfoot"):
            self._close(("td", "th", "tr", "tbody", "thead", "tfoot"), ("table",))
        if not self.open and tag != "table":
            return
        spans = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and (v or "").isdigit()}
        node = Node(tag, spans.get("colspan", 1), spans.get("rowspan", 1))
        (self.open[-1].children if self.open else self.roots).append(node)
        if tag not in self.VOID:
            self.open.append(node)
        if tag in ("td", "th"):
            self.cell, self.within = node, []

    def _close(self, tags, stop):
        while self.open and self.open[-1].tag in tags and self.open[-1].tag not in stop:
            self.open.pop()

    def handle_endtag(self, tag):
        if self.within:
            if tag in self.within:
                while self.within.pop() != tag:
                    pass
                self.cell.text += f"</{tag}>"
            return
        if any(n.tag == tag for n in self.open):
            while self.open.pop().tag != tag:
                pass
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.text += data


def trees(markup: str) -> list[Node]:
    """A tree for each top-level table."""
    reader = _TreeReader()
    reader.feed(markup)
    reader.close()
    return reader.roots


def size(n: Node) -> int:
    return 1 + n.inner + sum(map(size, n.children))


def postorder(root: Node) -> tuple[list[Node], np.ndarray, list[int]]:
    """(nodes in postorder, the leftmost leaf of each, the key roots)."""
    nodes, left = [], []

    def visit(n: Node) -> int:
        first = None
        for c in n.children:
            at = visit(c)
            first = at if first is None else first
        nodes.append(n)
        left.append(len(nodes) - 1 if first is None else first)
        return left[-1]

    visit(root)
    return nodes, np.array(left), sorted({v: i for i, v in enumerate(left)}.values())


def renames(a: list[Node], b: list[Node], variant: str) -> np.ndarray:
    """What it costs to turn a node into another: 1 for another tag or span; for cells the share of edits (teds), of emptiness (teds_struct_bool) or nothing."""
    code = {k: i for i, k in enumerate(dict.fromkeys((n.tag, n.colspan, n.rowspan) for n in (*a, *b)))}
    ka, kb = (np.array([code[n.tag, n.colspan, n.rowspan] for n in x]) for x in (a, b))
    out = (ka[:, None] != kb[None]).astype(float)
    if variant == "teds_struct":
        return out
    at = [[i for i, n in enumerate(x) if n.tag == "td"] for x in (a, b)]
    texts = [[prose.cell(x[i].text) for i in own] for x, own in zip((a, b), at, strict=True)]
    if at[0] and at[1]:
        if variant == "teds_struct_bool":
            differ = (np.array(texts[0], object).astype(bool)[:, None] != np.array(texts[1], object).astype(bool)[None]).astype(float)
        else:
            differ = kernels.edit_shares(*texts)
        out[np.ix_(*at)] = np.maximum(out[np.ix_(*at)], differ)
    return out


def tree_distance(a: Node, b: Node, variant: str = "teds") -> float:
    """Zhang and Shasha's edit distance of ordered trees, a numpy step for each node of the first in each pair of key roots.

    A leaf becomes one node of the other tree, the rest of which is inserted. Two nodes that are alike and have leaves alone (rows of cells) differ as
    these do in sequence, all pairs of one size at once. Only pairs of the other key roots need the forests.
    """
    (na, la, roots_a), (nb, lb, roots_b) = postorder(a), postorder(b)
    change = renames(na, nb, variant)
    tree = np.zeros((len(na), len(nb)))
    sizes = [np.arange(len(x)) - left + 1 for x, left in ((na, la), (nb, lb))]
    for j in range(len(nb)):
        leaves = sizes[0] == 1
        tree[leaves, j] = sizes[1][j] - 1 + change[leaves, lb[j] : j + 1].min(axis=1)
    for i in range(len(na)):
        leaves = sizes[1] == 1
        tree[i, leaves] = sizes[0][i] - 1 + change[la[i] : i + 1, leaves].min(axis=0)
    roots_a, roots_b = ([k for k in roots if s[k] > 1 or len(s) == 1] for roots, s in ((roots_a, sizes[0]), (roots_b, sizes[1])))
    flat = [np.array([i for i, n in enumerate(x) if n.children and not any(c.children for c in n.children)], int) for x in (na, nb)]
    alike = bool(len(flat[0]) and len(flat[1]) and not change[np.ix_(*flat)].any())
    for n in set(sizes[0][flat[0]] - 1) if alike else ():
        for m in set(sizes[1][flat[1]] - 1):
            x, y = flat[0][sizes[0][flat[0]] == n + 1], flat[1][sizes[1][flat[1]] == m + 1]
            line = [np.full((len(x), len(y)), float(k)) for k in range(m + 1)]
            own = change[(la[x][:, None] + np.arange(n)).ravel()][:, (lb[y][:, None] + np.arange(m)).ravel()].reshape(len(x), n, len(y), m)
            for i in range(n):
                left, line[0] = line[0], line[0] + 1
                for k in range(m):
                    keep = line[k + 1]
                    line[k + 1] = np.minimum(np.minimum(line[k + 1], line[k]) + 1, left + own[:, i, :, k])
                    left = keep
            tree[np.ix_(x, y)] = line[m]
    done = [set(f.tolist()) if alike else set() for f in flat]
    for j in roots_b:
        y = lb[j]
        q = np.arange(y, j + 1)
        whole, place, back = lb[q] == y, np.arange(j - y + 2.0), lb[q] - y
        mine = q[whole]
        spot = mine - y + 1
        for i in roots_a:
            if i in done[0] and j in done[1]:
                continue
            x = la[i]
            forest = np.empty((i - x + 2, j - y + 2))
            forest[0] = place
            for s, p in enumerate(range(x, i + 1), 1):
                above, line, first = forest[s - 1], forest[s], la[p] - x
                line[0] = s
                apart = forest[first, back]
                apart += tree[p, y : j + 1]
                if not first:
                    np.copyto(apart, above[:-1] + change[p, y : j + 1], where=whole)
                np.minimum(above[1:] + 1, apart, out=line[1:])
                line -= place
                np.minimum.accumulate(line, out=line)
                line += place
                if not first:
                    tree[p, mine] = line[spot]
    return float(tree[-1, -1])


VARIANTS = ("teds", "teds_struct", "teds_struct_bool")


def teds(true: Node, got: Node, variant: str = "teds") -> float:
    return max(0.0, 1 - tree_distance(got, true, variant) / max(size(true), size(got)))


def teds_of_pages(true: str, got: str) -> dict[str, float]:
    """Means over true tables of each variant, tables paired by the first; a true table without a partner is 0."""
    ours, theirs = trees(true), trees(got)
    if not ours or not theirs:
        return dict.fromkeys(VARIANTS, 0.0)
    worth = np.array([[teds(a, b) for b in theirs] for a in ours])
    pairs = kernels.assign(-worth)
    return {v: sum(worth[i, j] if v == "teds" else teds(ours[i], theirs[j], v) for i, j in pairs) / len(ours) for v in VARIANTS}


# --- sheets: tables as rows of normalised texts with their headers ------------------------------------------------------------------------------


def record_text(s: str) -> str:
    """A cell as records hold it: prose without dot leaders, spaces about $ % ( ) and commas between digits (one pass)."""
    s = prose.prose(re.sub(r"(?i)</?su[bp][^>]*>", "", s).translate(prose.SCRIPTS))
    s = re.sub("  +", " ", re.sub(r"\.{2,}", "", re.sub(r"(?:\.\s){2,}\.?", "", s))).strip()
    for pattern, by in ((r"\$\s+", "$"), (r"\s+%", "%"), (r"\s+\(", "("), (r"\s+\)", ")"), (r"\s+®", "®"), (r"(\d),(\d)", r"\1\2")):
        s = re.sub(pattern, by, s)
    return s


@dataclasses.dataclass
class Sheet:
    """``heads[c][r]``: the text of a header cell that begins in row r over column c; ``marked``: places that header cells cover."""

    rows: list[list[str]]
    heads: list[dict[int, str]]
    marked: set[tuple[int, int]]
    header_rows: set[int]
    n_heads: Counter  # header cells with text that reach into each row

    @property
    def width(self) -> int:
        return len(self.rows[0]) if self.rows else 0

    def without(self, gone: set[int]) -> Sheet:
        at = {r: i for i, r in enumerate(r for r in range(len(self.rows)) if r not in gone)}
        keep = lambda d: {at[r]: v for r, v in d.items() if r in at}
        return Sheet([self.rows[r] for r in at], [keep(h) for h in self.heads], {(at[r], c) for r, c in self.marked if r in at}, {at[r] for r in self.header_rows if r in at}, Counter(keep(self.n_heads)))

    def columns(self, keep: list[int], last: int | None = None) -> Sheet:
        rows = [[row[c] for c in keep] for row in self.rows[:last]]
        new = {c: i for i, c in enumerate(keep)}
        marked = {(r, new[c]) for r, c in self.marked if c in new and (last is None or r < last)}
        return Sheet(rows, [self.heads[c] for c in keep], marked, set(self.header_rows), self.n_heads)


def sheet(t: Table, text=record_text) -> Sheet:
    """Texts normalised, columns without any text dropped."""
    rows = [[text(x) for x in row] for row in t.matrix()]
    width = len(rows[0]) if rows else 0
    heads: list[dict[int, str]] = [{} for _ in range(width)]
    marked, n = set(), Counter()
    for c in t.cells():
        if c.header:
            for j in range(c.col, min(c.col + c.colspan, width)):
                heads[j][c.row] = text(c.text)
                marked |= {(c.row + i, j) for i in range(c.rowspan)}
            n.update(c.row + i for i in range(c.rowspan) if text(c.text))
    whole = Sheet(rows, heads, marked, t.header_rows(), n)
    keep = [j for j in range(width) if any(row[j] for row in rows) or any(heads[j].values())]
    return whole if len(keep) == width else whole.columns(keep)


def leading_titles(s: Sheet) -> set[int]:
    """Rows before any header that say one thing over all columns, unless all rows do."""
    out = set()
    for r, row in enumerate(s.rows):
        if r in s.header_rows or len({v.strip() for v in row}) != 1 or not row[0].strip():
            break
        out.add(r)
    return out if s.width > 1 and len(out) < len(s.rows) else set()


def column_headers(s: Sheet, titles: set[int]) -> set[int]:
    """The header rows at the top (after titles) whose texts are all in header cells."""
    begin = max(titles, default=-1) + 1
    loose = lambda r: any(v.strip() and (r, c) not in s.marked for c, v in enumerate(s.rows[r]))
    end = next((r for r in range(begin, len(s.rows)) if r not in s.header_rows or loose(r)), len(s.rows))
    out = {r for r in range(end) if r in s.header_rows}
    if out and loose(max(out)):
        out.discard(max(out))
    return out


def header_titles(s: Sheet, rows: set[int], most_top: int = 1) -> set[int]:
    """Header rows that are titles: one spanning text over all headed columns (an edge column may be bare). From the top ``most_top``, and the last row; one stays."""

    def is_title(r: int) -> bool:
        texts = [h.get(r, "").strip() for h in s.heads]
        covered = {c for c, t in enumerate(texts) if t}
        if len({t for t in texts if t}) != 1:
            return False
        headed = lambda which: {c for c, h in enumerate(s.heads) if any(q in which and t.strip() for q, t in h.items())}
        target = headed(rows - {r}) or headed(rows)
        if not target or not (target - covered) <= {min(target), max(target)}:
            return False
        return s.n_heads[r] < len(covered)

    titles, order, out = {r for r in rows if is_title(r)}, sorted(rows), set()
    if not titles:
        return set()
    begun = lambda r: any(r in h for h in s.heads)
    taken, i = 0, 0
    while i < len(order) and taken < min(len(rows) - 1, most_top) and order[i] in titles:
        out.add(order[i])
        i, taken = i + 1, taken + 1
        while i < len(order) and not begun(order[i]):  # rows that only continue cells from above go with it
            out.add(order[i])
            i += 1
    last = order[-1]
    if last in titles and last not in out and rows - out - {last}:
        out.add(last)
    return out


@dataclasses.dataclass
class Header:
    keys: list[str]
    nameless: set[str]
    rows: set[int]
    titles: set[int]
    stripped: set[str]


def distinct(keys: list[str]) -> list[str]:
    """Equal keys numbered from 0."""
    n, seen = Counter(keys), Counter()
    out = []
    for k in keys:
        out.append(f"{k}_{seen[k]}" if n[k] > 1 else k)
        seen[k] += 1
    return out


def keys_of(s: Sheet, rows: set[int], titles: set[int]) -> tuple[list[str], set[str]]:
    """A key for each column from its header texts, top down; (keys, those of columns without a header)."""
    raw = [" ".join(t for r, t in sorted(h.items()) if r in rows and r not in titles and t.strip()) for h in s.heads]
    keys = distinct([k or f"{NAMELESS}{c}" for c, k in enumerate(raw)])
    return keys, {keys[c] for c, k in enumerate(raw) if not k}


def untitled(s: Sheet, most_top: int = 1) -> tuple[Sheet, Header]:
    """The sheet without leading blank rows and titles, and its header."""
    blank = set(itertools.takewhile(lambda r: not any(v.strip() for v in s.rows[r]), range(len(s.rows))))
    s = s.without(blank)
    tops = leading_titles(s) if most_top else set()
    rows = column_headers(s, tops)
    titles = header_titles(s, rows, most_top)
    last = {max(rows)} & titles if rows else set()
    gone = tops | (titles - last)
    stripped = {h[r].strip() for r in titles for h in s.heads if h.get(r, "").strip()} | {v.strip() for r in tops for v in s.rows[r] if v.strip()}
    at = {r: i for i, r in enumerate(r for r in range(len(s.rows)) if r not in gone)}
    rows, titles = {at[r] for r in rows if r in at}, {at[r] for r in titles if r in at}
    s = s.without(gone)
    keys, nameless = keys_of(s, rows, titles)
    return s, Header(keys, nameless, rows, titles, stripped)


def is_empty(v: str) -> bool:
    return v.strip() in EMPTY


def cell_score(a: str, b: str) -> float:
    return float(is_empty(b)) if is_empty(a) else float(a == b)


def match_key(k: str) -> str:
    """A key to be matched: dashes between levels as spaces, no case."""
    return re.sub(r"\s+[-‐‑‒–—―−]\s+", " ", k).lower()


def _columns(a: list[str], b: list[str], bare_a: set[str], bare_b: set[str]) -> tuple[dict[str, str], float]:
    none = [[is_empty(k) or k in bare for k in keys] for keys, bare in ((a, bare_a), (b, bare_b))]
    like = np.array([[0.0 if none[0][i] != none[1][j] else prose.ratio(match_key(x), match_key(y)) for j, y in enumerate(b)] for i, x in enumerate(a)]).reshape(len(a), len(b))
    pairs = [(i, j) for i, j in kernels.assign(-like) if like[i, j] >= COLUMN]
    return {a[i]: b[j] for i, j in pairs}, float(np.mean([like[p] for p in pairs])) if pairs else 0.0


def align_columns(a: Header, b: Header) -> tuple[dict[str, str], float]:
    """Columns by their keys; where fewer than half find a partner, once more without a title of the other side before them."""
    best = _columns(a.keys, b.keys, a.nameless, b.nameless)
    least = min(len(a.keys), len(b.keys))
    if least <= 1 or len(best[0]) >= least / 2:
        return best
    for own, other, turned in ((a, b, False), (b, a, True)):
        for title in sorted(other.stripped):
            cut = {k: k.removeprefix(f"{title} ") for k in own.keys}
            if any(k != v for k, v in cut.items()):
                back = {v: k for k, v in cut.items()}
                bare = {cut[k] for k in own.nameless}
                short = [cut[k] for k in own.keys]
                found, score = _columns(other.keys, short, other.nameless, bare) if turned else _columns(short, other.keys, bare, other.nameless)
                found = {x: back[y] for x, y in found.items()} if turned else {back[x]: y for x, y in found.items()}
                if len(found) > len(best[0]):
                    best = found, score
    return best


def records(s: Sheet, h: Header) -> list[dict[str, str]]:
    """Rows below the header as key -> text; a title that is the last of several header rows counts as one, rows without text don't."""
    last = max(h.rows, default=-1)
    shown = {last} if len(h.rows) > 1 and last in h.titles else set()
    rows = [dict(zip(h.keys, row, strict=True)) for r, row in enumerate(s.rows) if r not in h.rows - shown]
    return [r for r in rows if any(v.strip() for v in r.values())]


def recovered(true: Header, s: Sheet, h: Header) -> Header:
    """A header in the first data row, where the true table has one and this one has none, and some text of the row is like a true key."""
    real = {k.lower() for k in true.keys if k not in true.nameless}
    row = next((r for r in range(len(s.rows)) if r not in h.rows), None)
    if not real or set(h.keys) - h.nameless or row is None:
        return h
    texts = [v.strip() for v in s.rows[row]]
    if not any(t and prose.ratio(t.lower(), k) >= COLUMN for t in texts for k in real):
        return h
    keys = distinct([t or f"{NAMELESS}{c}" for c, t in enumerate(texts)])
    return dataclasses.replace(h, keys=keys, nameless={k for k, t in zip(keys, texts, strict=True) if not t}, rows=h.rows | {row})


def demoted(true: Header, s: Sheet, h: Header) -> Header:
    """Where the true table has no header, this one's is data."""
    if set(true.keys) - true.nameless or not set(h.keys) - h.nameless:
        return h
    keys = [f"{NAMELESS}{c}" for c in range(s.width)]
    return Header(keys, set(keys), set(), set(), set())


def promoted(s: Sheet, h: Header) -> Header | None:
    """The header with the row below it, if that says one thing alone."""
    row = max(h.rows, default=-2) + 1
    if row < 1 or row >= len(s.rows) or len({v.strip() for v in s.rows[row] if v.strip()}) != 1:
        return None
    keys, nameless = keys_of(s, h.rows | {row}, h.titles)
    return dataclasses.replace(h, keys=keys, nameless=nameless, rows=h.rows | {row})


def match_records(a: list[dict], b: list[dict], columns: dict[str, str], n_columns: int, dead: set[str]) -> float:
    """Assignment of records: the sum of their scores / the larger number. A score is the matched cells / the union of both sides' columns."""
    if not a or not b:
        return float(not a and not b)
    live = [(x, y) for x, y in columns.items() if x not in dead]
    worth = np.zeros((len(a), len(b)))
    for x, y in live:
        ours, theirs = ([("" if is_empty(r[k]) else r[k]) for r in rows] for rows, k in ((a, x), (b, y)))
        code = {v: i for i, v in enumerate(dict.fromkeys([*ours, *theirs]))}
        worth += np.array([code[v] for v in ours])[:, None] == np.array([code[v] for v in theirs])[None]
    worth /= max(n_columns, 1)
    return float(sum(worth[i, j] for i, j in kernels.assign(-worth)) / max(len(a), len(b)))


def record_match(true: Sheet, ours: Header, got: Sheet, theirs: Header) -> float:
    """Table record match of a pair: headers recovered, demoted or promoted where that aligns more columns, then records assigned.

    A column whose true header is real but whose partner has none scores 0 in all its cells.
    """
    theirs = demoted(ours, got, recovered(ours, got, theirs))
    if not ours.keys or not theirs.keys:
        return 0.0
    best = align_columns(ours, theirs)
    for s, mine in ((true, True), (got, False)):
        more = promoted(s, ours if mine else theirs)
        if more:
            a, b = (more, theirs) if mine else (ours, more)
            trial = align_columns(a, b)
            if (len(trial[0]), trial[1]) > (len(best[0]), best[1]):
                best, ours, theirs = trial, a, b
    columns = best[0]
    rows = records(true, ours)
    if not columns or not rows:
        return 0.0
    dead = {x for x, y in columns.items() if x not in ours.nameless and not is_empty(x) and (y in theirs.nameless or is_empty(y))}
    return match_records(rows, records(got, theirs), columns, len(ours.keys) + len(theirs.keys) - len(columns), dead)


# --- merged tables ------------------------------------------------------------------------------------------------------------------------------

MOST_CHOICES = 256


def repeats(values: list[str], period: int) -> bool:
    """A header row that says the same (in 8 of 10 columns) in each run of ``period`` columns."""
    runs = [values[i : i + period] for i in range(0, len(values), period)]
    return all(sum(prose.ratio(x.lower(), y.lower()) >= COLUMN or not x and not y for x, y in zip(runs[0], run, strict=True)) >= 0.8 * period for run in runs[1:])


def splits(s: Sheet) -> list[tuple[int, int, int]]:
    """(segments, header rows that repeat, period) of the ways to cut a sheet into tables side by side; the first is not to cut it."""
    _, h = untitled(s)
    rows = [[head.get(r, "") for head in s.heads] for r in sorted(h.rows)]
    out = [(1, 0, 0)]
    for p in range(1, s.width // 2 + 1):
        if s.width % p == 0 and (n := sum(repeats(row, p) for row in rows)):
            out.append((s.width // p, n, p))
    return out


def joint_split(sheets: list[Sheet], wanted: int) -> list[tuple[int, int, int]] | None:
    """A way to cut each sheet so that their number comes nearest to ``wanted``: then most repeating rows, then the longest periods. None if not cutting is as good."""
    ways = [splits(s) for s in sheets]
    if np.prod([len(w) for w in ways], dtype=float) > MOST_CHOICES or not sheets:
        return None
    cost = lambda c: (abs(sum(w[0] for w in c) - wanted), -sum(w[1] for w in c), -sum(w[2] for w in c))
    best = min(itertools.product(*ways), key=cost)
    return list(best) if cost(best) < (abs(len(sheets) - wanted), 0, 0) else None


def split_merged(sheets: list[Sheet], wanted: int) -> list[Sheet]:
    """Sheets cut where the prediction has fewer tables than the truth; blank rows at the end of a part go."""
    chosen = joint_split(sheets, wanted) if wanted > len(sheets) else None
    out = []
    for s, (n, _, period) in zip(sheets, chosen or [(1, 0, 0)] * len(sheets), strict=True):
        for k in range(n):
            if n == 1:
                out.append(s)
                continue
            keep = list(range(k * period, (k + 1) * period))
            last = max((r + 1 for r, row in enumerate(s.rows) if any(row[c].strip() for c in keep)), default=0)
            out.append(s.columns(keep, last))
    return out


# --- headers -----------------------------------------------------------------------------------------------------------------------------------

PARTS = ("header_cell_count", "header_grits", "header_content_bag", "header_block_extent", "header_block_proximity", "header_block_relative_direction", "multilevel_header_depth", "header_data_alignment")


def header_text(s: str) -> str:
    return prose.prose(prose.cell(s))


def header_cells(t: Table) -> list[Cell]:
    return [dataclasses.replace(c, text=header_text(c.text)) for c in t.cells() if c.header or c.row in t.head_rows]


@dataclasses.dataclass
class Block:
    """Header cells that touch; rows and columns from low to high, high excluded."""

    cells: list[Cell]

    @property
    def box(self) -> tuple[int, int, int, int]:
        c = self.cells
        return min(x.row for x in c), min(x.col for x in c), max(x.row + x.rowspan for x in c), max(x.col + x.colspan for x in c)

    def grid(self) -> list[list[str]]:
        r, c, r2, c2 = self.box
        out = [[""] * (c2 - c) for _ in range(r2 - r)]
        for x in self.cells:
            for i in range(x.rowspan):
                for j in range(x.colspan):
                    out[x.row - r + i][x.col - c + j] = x.text
        return out


def places(c: Cell) -> set[tuple[int, int]]:
    return {(c.row + i, c.col + j) for i in range(c.rowspan) for j in range(c.colspan)}


def touching(groups: list[set[tuple[int, int]]]) -> list[list[int]]:
    """Groups of places put together where they touch by a side."""
    owner = {p: i for i, g in enumerate(groups) for p in g}
    up = list(range(len(groups)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for (r, c), i in owner.items():
        for p in ((r + 1, c), (r, c + 1)):
            if p in owner:
                up[root(i)] = root(owner[p])
    out: dict[int, list[int]] = {}
    for i in range(len(groups)):
        out.setdefault(root(i), []).append(i)
    return list(out.values())


def blocks(cells: list[Cell]) -> list[Block]:
    return sorted((Block([cells[i] for i in g]) for g in touching([places(c) for c in cells])), key=lambda b: b.box[:2])


def extent_iou(a: Block, b: Block, sizes: tuple) -> float:
    """IoU of two blocks as shares of their tables."""
    e, f = ([v / max(n, 1) for v, n in zip(x.box, (*s, *s), strict=True)] for x, s in ((a, sizes[0]), (b, sizes[1])))
    both = max(0.0, min(e[2], f[2]) - max(e[0], f[0])) * max(0.0, min(e[3], f[3]) - max(e[1], f[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(e) + area(f) - both
    return both / union if union > 0 else 0.0


def step(a: Block, b: Block) -> np.ndarray:
    """Rows and columns between two blocks, signed."""
    (r1, c1, r2, c2), (s1, d1, s2, d2) = a.box, b.box
    gap = lambda lo, hi, lo2, hi2: lo2 - hi if lo2 >= hi else -(lo - hi2) if lo >= hi2 else 0
    return np.array([gap(r1, r2, s1, s2), gap(c1, c2, d1, d2)], float)


def depth(cells: list[Cell]) -> int:
    """Levels of header cells one above another."""
    at = {p: i for i, c in enumerate(cells) for p in places(c)}
    level: dict[int, int] = {}
    for i in sorted(range(len(cells)), key=lambda i: (cells[i].row, cells[i].col)):
        c, over = cells[i], set()
        for j in range(c.col, c.col + c.colspan):
            above = next((at[r, j] for r in range(c.row - 1, -1, -1) if (r, j) in at), None)
            over |= {above} - {None, i}
        level[i] = 1 + max((level[k] for k in over if k in level), default=0)
    return max(level.values(), default=0)


def _share(a: float, b: float) -> float:
    return min(a, b) / max(a, b) if a and b else float(a == b)


def header_scores(true: Table, got: Table, aligned: dict | None = None) -> dict[str, float]:
    """The parts of header accuracy, header_perfect and the composite. ``aligned``: rows and columns of ``grits``, where known."""
    a, b = header_cells(true), header_cells(got)
    x, y = blocks(a), blocks(b)
    shape = lambda t: (len(t.rows), max((c.col + c.colspan for c in t.cells()), default=0))
    sizes = shape(true), shape(got)
    like = np.array([[grits(p.grid(), q.grid())["f"] for q in y] for p in x]).reshape(len(x), len(y))
    iou = np.array([[extent_iou(p, q, sizes) for q in y] for p in x]).reshape(len(x), len(y))
    pairs = kernels.assign(-(like + 1e-4 * iou)) if x and y else []
    over = lambda m: float(sum(m[p] for p in pairs) / max(len(x), len(y))) if x and y else float(len(x) == len(y))
    bag = sum((Counter(c.text for c in a) & Counter(c.text for c in b)).values()) / len(a) if a and b else float(len(a) == len(b))
    near, turn = [], []
    for (i, k), (j, m) in itertools.combinations(pairs, 2):
        u, v = step(x[i], x[j]), step(y[k], y[m])
        p, q = float(np.hypot(*u)), float(np.hypot(*v))
        near.append(1.0 if max(p, q) < 1e-9 else 1 - abs(p - q) / max(p, q))
        turn.append(1.0 if min(p, q) < 1e-9 else (max(-1.0, min(1.0, float(u @ v) / (p * q))) + 1) / 2)
    n_pairs = max(n * (n - 1) // 2 for n in (len(x), len(y)))
    if max(len(x), len(y)) <= 1:
        relative = (float(len(x) == len(y)),) * 2
    else:
        relative = (sum(near) / n_pairs, sum(turn) / n_pairs) if y else (0.0, 0.0)
    found = aligned or grits(cell_grid(true), cell_grid(got))
    rows, cols, at = dict(found["rows"]), dict(found["cols"]), {p: header_text(c.text) for p, c in got.spread(clip=False).items()}
    hits = sum(c.row in rows and c.col in cols and at.get((rows[c.row], cols[c.col]), "") == c.text for c in a)
    key = lambda c: (c.row, c.col, c.rowspan, c.colspan, c.text)
    out = {
        "header_cell_count": _share(len(a), len(b)), "header_grits": over(like), "header_content_bag": bag, "header_block_extent": over(iou), "header_block_proximity": relative[0],
        "header_block_relative_direction": relative[1], "multilevel_header_depth": _share(depth(a), depth(b)), "header_data_alignment": hits / len(a) if a else 1.0,
    }
    trivial = ("header_block_proximity", "header_block_relative_direction") if len(x) == len(y) <= 1 else ()
    kept = [v for k, v in out.items() if k in PARTS and k not in trivial]
    return out | {"header_perfect": float(sorted(map(key, a)) == sorted(map(key, b))), "header_composite_v3": sum(kept) / len(kept)}


def generous(true: Table, got: Table) -> Table:
    """The prediction with its top row as header where it has none but the truth has; and with the truth's block of headers at the bottom left, where its texts are there."""
    ours = header_cells(true)
    if not ours:
        return got
    out = Table([[dataclasses.replace(c) for c in row] for row in got.rows], set(got.head_rows), got.caption, got.before, got.pipe)
    if not header_cells(got) and out.rows:
        for c in out.rows[0]:
            c.header = True

    def bottom_left(t: Table, b: Block) -> bool:
        r, c, r2, c2 = b.box
        return c == 0 and r2 == len(t.rows) and r > 0 and sum(len(places(x)) for x in b.cells) == (r2 - r) * (c2 - c)

    wanted = [b for b in blocks(ours) if bottom_left(true, b)]
    if wanted and not any(bottom_left(out, b) for b in blocks(header_cells(out))):
        at = {p: header_text(c.text) for p, c in out.spread(clip=False).items()}
        for b in wanted:
            same = [p for c in b.cells for p in places(c) if kernels.block_ratio(c.text, at.get(p, "")) >= 0.8]
            group = next((g for g in touching([{p} for p in same]) if (len(out.rows) - 1, 0) in {same[i] for i in g}), [])
            chosen = {same[i] for i in group}
            for c in out.cells():
                c.header = c.header or bool(places(c) & chosen)
    return out


def consistent(t: Table) -> bool:
    """All rows are equally wide and all columns equally high."""
    at = t.spread(clip=False)
    return all(len(set(Counter(p[k] for p in at).values())) <= 1 for k in (0, 1))


# --- pages ---------------------------------------------------------------------------------------------------------------------------------------


def page_scores(true: str, got: str, split: bool = False, most_top: int = 1, teds_too: bool = False) -> dict[str, float]:
    """All table metrics of a page. A page without true tables has no scores; one without predicted tables scores 0."""
    ours, theirs = html_tables(true), html_tables(got)
    consistency = sum(map(consistent, theirs)) / len(theirs) if theirs else 1.0
    if not ours:
        return {"structural_consistency": consistency}
    partner, all_ = paired(ours, theirs)
    zero = dict.fromkeys((*PARTS, "header_perfect", "header_composite_v3"), 0.0)
    n, sums = len(ours), Counter()
    sheets = [untitled(sheet(t), most_top) for t in ours]
    parts = [sheet(t) for t in theirs]
    cut = split_merged(parts, n) if split else parts
    got_sheets = [untitled(s, most_top) for s in cut]
    if len(cut) != len(parts):  # cut tables pair anew, on their texts
        worth = np.array([[grits(a.rows, b.rows)["f"] for b, _ in got_sheets] for a, _ in sheets]).reshape(n, len(cut))
        of = dict(kernels.assign(-worth))
        record_partner = [of.get(i) for i in range(n)]
    else:
        record_partner = partner
    matches = [record_match(*sheets[i], *got_sheets[j]) if j is not None else 0.0 for i, j in enumerate(record_partner)]
    for i, j in enumerate(partner):
        sums["grits_con"] += all_[i, j]["f"] if j is not None else 0.0
        for k, v in (header_scores(ours[i], theirs[j], all_[i, j]) if j is not None else zero).items():
            sums[k] += v
        sums["exp_header_composite_v3_generous"] += header_scores(ours[i], generous(ours[i], theirs[j]), all_[i, j])["header_composite_v3"] if j is not None else 0.0
    out = {k: v / n for k, v in sums.items()}
    out |= {"table_record_match": sum(matches) / n, "table_record_match_perfect": sum(m == 1.0 for m in matches) / n, "structural_consistency": consistency}
    return out | composites(out) | (teds_of_pages(true, got) if teds_too else {})


def composites(s: dict[str, float], no_records: bool = False) -> dict[str, float]:
    """Grid similarity times header accuracy, their harmonic mean, and half grid similarity with half record match (alone where records are not supported)."""
    out, g = {}, s.get("grits_con")
    if g is None:
        return out
    for head, name in (("header_composite_v3", "table_composite_v3"), ("exp_header_composite_v3_generous", "exp_table_composite_v3_generous")):
        if (h := s.get(head)) is not None:
            out |= {name: g * h, f"{name}_harmonic": 2 * g * h / (g + h) if g + h else 0.0}
    t = s.get("table_record_match")
    return out | {"grits_trm_composite": g if no_records or t is None else (g + t) / 2}
