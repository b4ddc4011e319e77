"""Tables of a markup as grids, for kernels."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

from .prose import SUBSCRIPTS, SUPERSCRIPTS

RAISED, LOWERED = (dict(zip("0123456789", s[:10], strict=True)) for s in (SUPERSCRIPTS, SUBSCRIPTS))


@dataclass
class Cell:
    text: str
    header: bool = False
    colspan: int = 1
    rowspan: int = 1
    row: int = 0
    col: int = 0


@dataclass
class Table:
    """Rows of cells as written; ``place`` gives each its place in the span grid."""

    rows: list[list[Cell]] = field(default_factory=list)
    head_rows: set[int] = field(default_factory=set)
    caption: str = ""
    before: str = ""
    pipe: bool = False

    def place(self) -> Table:
        taken: set[tuple[int, int]] = set()
        for r, row in enumerate(self.rows):
            c = 0
            for cell in row:
                while (r, c) in taken:
                    c += 1
                cell.row, cell.col = r, c
                taken |= {(r + i, c + j) for i in range(cell.rowspan) for j in range(cell.colspan)}
                c += cell.colspan
        return self

    def cells(self) -> list[Cell]:
        return [c for row in self.rows for c in row]

    def spread(self, clip: bool = True) -> dict[tuple[int, int], Cell]:
        """Every place with the cell that covers it; ``clip`` ends spans at the last row."""
        last = len(self.rows) if clip else 1 << 30
        return {(c.row + i, c.col + j): c for c in self.cells() for i in range(min(c.rowspan, last - c.row)) for j in range(c.colspan)}

    def matrix(self, clip: bool = False) -> list[list[str]]:
        at = self.spread(clip)
        height, width = (max((p[k] for p in at), default=-1) + 1 for k in (0, 1))
        return [[at[r, c].text if (r, c) in at else "" for c in range(width)] for r in range(height)]

    def headings(self) -> tuple[dict[int, list[str]], dict[int, list[str]]]:
        """(texts of header cells by column, and by row); of a pipe table the first row and the first column."""
        by_col: dict[int, list[str]] = {}
        by_row: dict[int, list[str]] = {}
        if self.pipe:
            rows = self.matrix()
            return {c: [t] for c, t in enumerate(rows[0])}, {r: [rows[r][0]] for r in range(1, len(rows))}
        for c in self.cells():
            if c.header:
                for j in range(c.colspan):
                    by_col.setdefault(c.col + j, []).append(c.text)
                for i in range(c.rowspan):
                    by_row.setdefault(c.row + i, []).append(c.text)
        return by_col, by_row

    def header_rows(self) -> set[int]:
        return {0} if self.pipe else self.head_rows | {c.row for c in self.cells() if c.header}

    def header_cols(self) -> set[int]:
        return {0} if self.pipe else {c.col for c in self.cells() if c.header}


class _Reader(HTMLParser):
    """Top-level tables; what a nested table holds is text of the cell around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[Table] = []
        self.depth, self.cell, self.head, self.script, self.caption = 0, None, False, "", False
        self.text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append(Table(before=" ".join(" ".join(self.text).split())[-300:]))
                self.text, self.head = [], False
            elif self.cell is not None:
                self.cell.text += " "
        elif tag in ("sup", "sub"):
            self.script = tag
        elif tag == "br" and self.cell is not None:
            self.cell.text += " "
        elif self.depth == 1 and tag in ("thead", "tbody", "tfoot"):
            self.head = tag == "thead"
        elif self.depth == 1 and tag == "caption":
            self.caption = True
        elif self.depth == 1 and tag == "tr":
            self.cell = None
            self.tables[-1].rows.append([])
            if self.head:
                self.tables[-1].head_rows.add(len(self.tables[-1].rows) - 1)
        elif self.depth == 1 and tag in ("td", "th"):
            span = {k: int(v) if (v or "").strip().isdigit() and int(v) else 1 for k, v in attrs if k in ("colspan", "rowspan")}
            self.cell = Cell("", tag == "th", span.get("colspan", 1), span.get("rowspan", 1))
            if not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.tables[-1].rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("sup", "sub"):
            self.script = ""
        if tag == "caption":
            self.caption = False
        if tag == "table" and self.depth:
            self.depth -= 1
        if self.depth <= 1 and tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.script:
            data = "".join((RAISED if self.script == "sup" else LOWERED).get(ch, ch) for ch in data)
        if self.cell is not None:
            self.cell.text += data
        elif self.depth == 1 and self.caption:
            self.tables[-1].caption += data
        elif not self.depth:
            self.text.append(data)


def html_tables(markup: str) -> list[Table]:
    reader = _Reader()
    reader.feed(markup)
    reader.close()
    for t in reader.tables:
        for c in t.cells():
            c.text = c.text.strip()
        t.place()
    return reader.tables


def _is_rule(line: str) -> bool:
    return bool(line.strip()) and set(line) <= set("- :|")


def pipe_tables(markdown: str) -> list[Table]:
    """Runs of two lines or more that hold a pipe; lines of dashes are no rows, short rows are filled up."""
    lines, out, run = [*markdown.strip().split("\n"), ""], [], []
    for i, line in enumerate(lines):
        if "|" in line:
            run.append(line)
            continue
        if len(run) > 1:
            rows = []
            for text in run:
                cells = [c.strip() for c in text.split("|")]
                cells = cells[1 if cells and not cells[0] else 0 :]
                cells = cells[: -1 if cells and not cells[-1] else None]
                if cells and not _is_rule(text):
                    rows.append(cells)
            width = max(map(len, rows), default=0)
            if width:
                start = i - len(run)
                table = Table([[Cell(c) for c in [*r, *[""] * (width - len(r))]] for r in rows], before="\n".join(lines[max(0, start - 5) : start]), pipe=True)
                out.append(table.place())
        run = []
    return out


def tables(markup: str) -> list[Table]:
    """Pipe tables, then HTML tables."""
    return [*pipe_tables(markup), *html_tables(markup)]
