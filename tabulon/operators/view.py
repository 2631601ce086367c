"""Views: sorts, filters, pages, selections and extracts over a table with its edits. A view is state; rows are read when asked for."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.sources.files import exists
from tabulon.sources.layout import Layout, read_layout

from .ordering import Sorted, positions, without_keys
from .overlay import Overlay, Recovery, drop_recovery, load_recoveries, save_recovery
from .predicates import Filters, Query, highlighted, moved
from .stats import Statistics, distinct_excluding_own
from .table import ORDER, TextTable

DEFAULT_PAGE = 20
# The page sizes on offer; 0 fits the window, -1 is all rows.
PAGE_SIZES = (0, 50, 100, 250, 500, 1000, 5000, -1)
# Fixed value: seconds between saves of what can be recovered.
SAVED_EVERY = 20


def page_setting(setting: int | None) -> int:
    """The size on offer for a stored one; others become the nearest."""
    if setting in (None, 0, -1):
        return setting or 0
    return min((s for s in PAGE_SIZES if s > 0), key=lambda s: abs(s - setting))


def page_label(size: int) -> str:
    return {0: "Fit to window", -1: "All rows"}.get(size, f"{size:,} rows")


@dataclass(frozen=True)
class Selection:
    """Rows, or in select-all mode the exceptions."""

    rows: frozenset[int] = frozenset()
    all: bool = False

    def toggled(self, row: int) -> Selection:
        return replace(self, rows=self.rows ^ {row})

    def every(self) -> Selection:
        return Selection(frozenset(), True)

    def none(self) -> Selection:
        return Selection()

    def has(self, row: int) -> bool:
        return (row in self.rows) != self.all

    def count(self, matching: int) -> int:
        return matching - len(self.rows) if self.all else len(self.rows)

    def of(self, df: DataFrame) -> DataFrame:
        """The selected of a view's rows."""
        if not self.rows:
            return df if self.all else df.limit(0)
        if len(self.rows) <= 1000:
            inside = F.col(ORDER).isin(*self.rows)
            return df.where(~inside if self.all else inside)
        ids = df.sparkSession.createDataFrame([(r,) for r in self.rows], f"{ORDER} long")
        return df.join(ids, ORDER, "left_anti" if self.all else "left_semi")


@dataclass
class View:
    """What is shown of a table; changes of filters and of structure go back to the first page."""

    table: TextTable
    overlay: Overlay = field(default_factory=Overlay)
    sort: Sorted = Sorted()
    filters: Filters = Filters()
    highlight: Query = Query()
    selection: Selection = Selection()
    page_size: int = DEFAULT_PAGE
    page: int = 0
    extract: frozenset[int] | None = None
    extract_order: DataFrame | None = None
    counted: tuple | None = None

    def resolved(self) -> TextTable:
        found = self.table if self.overlay.is_empty else self.overlay.resolve(self.table)
        if self.extract_order is not None:
            rows = found.df.join(self.extract_order, ORDER)
            found = found.having(rows)
        return found

    def rows(self) -> TextTable:
        """The rows that pass all filters; their order is that of keys."""
        return self.filters.apply(self.resolved())

    def prepared(self) -> tuple[TextTable, list]:
        """The rows with their sort keys, and what to order by."""
        t, own = self.sort.prepared(self.rows())
        return t, own if self.extract_order is None else [*own[:-2], F.col("_extract").asc(), *own[-2:]]

    def ordered(self) -> DataFrame:
        t, order = self.prepared()
        return without_keys(t.df.orderBy(*order))

    def count(self) -> int:
        """The number of rows; counted once for the same filters and edits."""
        state = (self.filters, len(self.overlay.ops), len(self.overlay.undo_log), self.overlay.next_row, sum(map(len, self.overlay.edits.values())))
        if self.counted is None or self.counted[0] != state:
            self.counted = (state, self.rows().df.count())
        return self.counted[1]

    def pages(self, count: int | None = None) -> int:
        return max(1, math.ceil((self.count() if count is None else count) / self.page_size))

    def current(self) -> DataFrame:
        count = self.count()
        self.page = min(max(0, self.page), self.pages(count) - 1)
        return self.ordered().offset(self.page * self.page_size).limit(self.page_size)

    def label(self) -> str:
        n = self.count()
        first = self.page * self.page_size
        return f"Showing {min(first + 1, n):,}–{min(first + self.page_size, n):,} of {n:,}"

    def go_to(self, number: str) -> None:
        """A page by what was typed, from 1; other input changes nothing."""
        if number.strip().isdigit():
            self.page = min(max(0, int(number) - 1), self.pages() - 1)

    def resize(self, size: int) -> None:
        """Keeps the first row of the page in view."""
        self.page, self.page_size = self.page * self.page_size // size, size

    def edited(self, change: Callable[[Overlay], object]) -> View:
        """After a change of the rows there are (added, deleted, restored, undone): the first page."""
        change(self.overlay)
        return replace(self, page=0)

    def filtered(self, filters: Filters) -> View:
        return replace(self, filters=filters, page=0)

    def sorted_by(self, column: str, descending: bool | None = None) -> View:
        extract = self.extract_order is not None
        return replace(self, sort=self.sort.toggled(column, extract) if descending is None else self.sort.by(column, descending, extract), page=0)

    def cleared(self) -> View:
        """Without filters; sorts and highlights stay."""
        return self.filtered(Filters())

    def highlight_instead(self) -> View:
        query, marked = moved(self.filters.query, self.highlight)
        return replace(self, filters=replace(self.filters, query=query), highlight=marked, page=0)

    def filter_instead(self) -> View:
        marked, query = moved(self.highlight, self.filters.query)
        return replace(self, filters=replace(self.filters, query=query), highlight=marked, page=0)

    def matches(self) -> DataFrame:
        t, order = self.prepared()
        return without_keys(highlighted(t, self.highlight).orderBy(*order))

    def match(self, number: int) -> tuple[DataFrame, int]:
        """The n-th match, counted around, and its number."""
        t, order = self.prepared()
        found = highlighted(t, self.highlight).where("is_match")
        n = found.count()
        at = number % n if n else 0
        return without_keys(found.orderBy(*order).offset(at).limit(1)), at

    def distinct(self, column: str):
        return distinct_excluding_own(self.resolved(), self.filters, column, F.struct((F.col(ORDER) < 0).alias("a"), F.abs(ORDER).alias("n")))

    def statistics(self, column: str) -> Statistics:
        return Statistics.of(self.rows(), column)

    def selected(self) -> TextTable:
        t = self.rows()
        return t.having(self.selection.of(t.df))

    def extracted(self, rows: DataFrame | None = None) -> View:
        """A view of fixed rows in their present order, with filters and sorts of its own and the same edits.

        rows: row_idx of what to take; without it the selected rows."""
        t, keys = self.prepared()
        chosen = t.df.join(rows.select(ORDER).distinct(), ORDER, "left_semi") if rows is not None else self.selection.of(t.df)
        order = positions(chosen, keys, "_extract", ORDER)
        return View(self.table, self.overlay, extract_order=order, page_size=self.page_size)


class Session:
    """Open files and their sections; a section's view and edits are made when it is first shown.

    With a folder for recoveries, edits of the sections' views can be saved and come back in another session. Extracts have
    views of their own that aren't the session's, so they are never saved."""

    def __init__(self, spark, recoveries: str | None = None):
        self.spark, self.layouts, self.views = spark, {}, {}
        self.recoveries, self.saved_at, self.kept = recoveries, None, set()

    def open(self, path: str) -> Layout:
        if path not in self.layouts:
            self.layouts[path] = read_layout(path)
        return self.layouts[path]

    def view(self, path: str, section: int = 0) -> View:
        layout = self.open(path)
        if not layout.valid:
            raise ValueError(next(d.message for d in layout.diagnostics if d.severity == "error"))
        if (path, section) not in self.views:
            self.views[path, section] = View(TextTable.of_section(self.spark, layout, section))
        return self.views[path, section]

    def split(self, path: str) -> list[View]:
        """One view for each section, with the edits that it has."""
        return [self.view(path, i) for i in range(len(self.open(path).sections))]

    def has_edits(self) -> bool:
        return any(not v.overlay.is_empty for v in self.views.values())

    def save(self) -> int:
        """Saves the edits of each section that has some, and gives their number. Of others it drops what this session saved or
        opened again, never what an earlier one left."""
        if self.recoveries is None:
            return 0
        done = 0
        for (path, section), v in self.views.items():
            if not v.overlay.is_empty:
                save_recovery(self.recoveries, path, section, v.overlay)
                self.kept.add((path, section))
                done += 1
            elif (path, section) in self.kept:
                drop_recovery(self.recoveries, path, section)
                self.kept.remove((path, section))
        return done

    def save_if_due(self, now: float) -> bool:
        """Saves when SAVED_EVERY seconds have gone by since the last save; now: seconds of any steady clock."""
        if self.saved_at is not None and now - self.saved_at < SAVED_EVERY:
            return False
        self.saved_at = now
        return self.save() > 0

    def recoverable(self) -> list[Recovery]:
        """What was saved of files that are still there, the latest first."""
        found = load_recoveries(self.recoveries) if self.recoveries else []
        return sorted((r for r in found if exists(r.path)), key=lambda r: r.saved, reverse=True)

    def reopen(self, record: Recovery) -> View | None:
        """The section's view with the saved edits; None if the file no longer has that section."""
        layout = self.open(record.path)
        if not layout.valid or not 0 <= record.section < len(layout.sections):
            return None
        v = self.view(record.path, record.section)
        v.overlay, v.page, v.counted = Overlay.of(record.overlay), 0, None
        self.kept.add((record.path, record.section))
        return v

    def close(self, path: str, section: int = 0) -> None:
        """Forgets a section's view and what was saved of it."""
        self.views.pop((path, section), None)
        if self.recoveries is not None:
            drop_recovery(self.recoveries, path, section)
        self.kept.discard((path, section))
