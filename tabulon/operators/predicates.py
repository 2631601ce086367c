"""Search terms, value and pattern filters, as one Column for one filter."""

from __future__ import annotations

import operator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.text import folded, valid_regex

from .table import TextTable

CONTAINS, NOT_CONTAINS, EQUALS, NOT_EQUALS, STARTS, ENDS, REGEX = "contains", "not_contains", "equals", "not_equals", "starts_with", "ends_with", "regex"
NEGATED = {NOT_CONTAINS: CONTAINS, NOT_EQUALS: EQUALS}
# How a term is described.
VERBS = {CONTAINS: "contains", NOT_CONTAINS: "does not contain", EQUALS: "is", NOT_EQUALS: "is not", STARTS: "starts with", ENDS: "ends with", REGEX: "matches"}
#: Values of a filter up to which they stand in the plan; more are joined.
LITERAL_VALUES = 1000
FIRST_MATCHES = 250


@dataclass(frozen=True)
class Term:
    """One condition; without a column it is on any field."""

    text: str
    mode: str = CONTAINS
    column: str | None = None
    case: bool = False

    def describe(self) -> str:
        quoted = f"/{self.text}/" if self.mode == REGEX else f'"{self.text}"'
        return f"{self.column if self.column is not None else 'Any column'} {VERBS[self.mode]} {quoted}{' (case-sensitive)' * self.case}"


@dataclass(frozen=True)
class Query:
    """Terms that all, or any, must hold; terms without text don't count."""

    terms: tuple[Term, ...] = ()
    any: bool = False

    @classmethod
    def of(cls, text: str) -> Query:
        return cls((Term(text),)) if text else cls()

    def add(self, term: Term) -> Query:
        return replace(self, terms=(*self.terms, term))

    def without(self, at: int) -> Query:
        return replace(self, terms=self.terms[:at] + self.terms[at + 1 :]) if 0 <= at < len(self.terms) else self

    @property
    def used(self) -> tuple[Term, ...]:
        return tuple(t for t in self.terms if t.text)


@dataclass(frozen=True)
class Pattern:
    """A column's filter by substring or regular expression, never by case."""

    column: str
    text: str
    regex: bool = False


def _test(table: TextTable, v: Column, term: Term) -> Column:
    """The term's condition on one value, without its negation."""
    mode = NEGATED.get(term.mode, term.mode)
    if mode == REGEX:
        pattern = term.text if term.case else f"(?iu){term.text}"
        ok, _ = valid_regex(table.df.sparkSession, pattern)
        return v.rlike(pattern) if ok else F.lit(False)
    a, b = (v, F.lit(term.text)) if term.case else (folded(v), folded(F.lit(term.text)))
    return {CONTAINS: F.contains, EQUALS: operator.eq, STARTS: F.startswith, ENDS: F.endswith}[mode](a, b)


def term_holds(table: TextTable, term: Term) -> Column:
    """Any field for a plain term, no field for a negated one; a column that isn't there never has a value."""
    negated = term.mode in NEGATED
    if term.column is not None:
        i = table.ordinal(term.column)
        # a plain term holds for no blank, so it can be tested on the stored column and reach the scan
        found = F.lit(False) if i < 0 else _test(table, table.cell(i) if negated or term.mode == REGEX else table.stored(i), term)
    elif "raw" in table.df.columns and term.mode in (CONTAINS, NOT_CONTAINS) and not any(c in term.text for c in f"{table.layout.delimiter}\r\n"):
        found = _test(table, F.col("raw"), term)  # no field's end can be within the text, so the line has it as a field does
    elif table.uniform:  # plain columns stay in generated code
        found = reduce(operator.or_, (_test(table, table.cell(i), term) for i in range(len(table.names))), F.lit(False))
    else:
        found = F.exists("fields", lambda x: _test(table, x, term))
    return ~found if negated else found


def query_holds(table: TextTable, query: Query) -> Column | None:
    parts = [term_holds(table, t) for t in query.used]
    return reduce(operator.or_ if query.any else operator.and_, parts) if parts else None


@dataclass(frozen=True)
class Filters:
    """What a view is filtered by: values and patterns by column, and a query."""

    values: tuple[tuple[str, frozenset[str]], ...] = ()
    patterns: tuple[Pattern, ...] = ()
    query: Query = Query()

    def with_values(self, column: str, values: set[str] | None) -> Filters:
        rest = tuple(x for x in self.values if x[0] != column)
        return replace(self, values=rest if values is None else (*rest, (column, frozenset(values))))

    def with_pattern(self, column: str, text: str, regex: bool = False) -> Filters:
        rest = tuple(x for x in self.patterns if x.column != column)
        return replace(self, patterns=(*rest, Pattern(column, text, regex)) if text else rest)

    def apply(self, table: TextTable) -> TextTable:
        """The rows that pass, their order keys as they were. Columns that aren't there, and empty patterns, don't filter."""
        df, conditions = table.df, []
        for column, values in self.values:
            if (v := table.value(column)) is None:
                continue
            if len(values) <= LITERAL_VALUES:
                v = v if "" in values else table.stored(table.ordinal(column))
                conditions.append(v.isin(*values) if values else F.lit(False))
            else:
                wanted = df.sparkSession.createDataFrame([(x,) for x in values], "wanted string")
                df = df.join(wanted, v == F.col("wanted"), "left_semi")
        for p in self.patterns:
            if p.text and (v := table.value(p.column)) is not None:
                conditions.append(_test(table, v, Term(p.text, REGEX if p.regex else CONTAINS)))
        if (held := query_holds(table, self.query)) is not None:
            conditions.append(held)
        return table.having(df.where(reduce(operator.and_, conditions)) if conditions else df)

    def cleared(self) -> Filters:
        return Filters()


def filter_text(table: TextTable, text: str) -> TextTable:
    """Rows with the text in any field; without text the table as it is."""
    return Filters(query=Query.of(text)).apply(table) if text else table


def highlighted(table: TextTable, query: Query) -> DataFrame:
    """The table's rows with is_match, whether the query holds."""
    held = query_holds(table, query)
    return table.df.withColumn("is_match", F.lit(False) if held is None else F.coalesce(held, F.lit(False)))


def cell_marks(table: TextTable, query: Query) -> Column:
    """For each field whether any plain term marks it; a term on a column marks that one only, negated terms mark none."""
    terms = [t for t in query.used if t.mode not in NEGATED]

    def mark(x: Column, i) -> Column:
        tests = [_test(table, x, t) if t.column is None else (F.lit(table.ordinal(t.column)) == i) & _test(table, x, t) for t in terms]
        return reduce(operator.or_, tests, F.lit(False))

    if table.uniform:
        return F.array(*(mark(table.cell(i), F.lit(i)) for i in range(len(table.names))))
    return F.transform("fields", mark)


def hidden_matches(table: TextTable, query: Query, visible: list[str], order: list[Column]) -> DataFrame:
    """column: those not visible in which one of the first matching rows has a marked cell."""
    found = highlighted(table, query).where("is_match").orderBy(*order).limit(FIRST_MATCHES)
    marks = found.select(F.posexplode(cell_marks(table.having(found), query)).alias("i", "mark")).where("mark").select("i").distinct()
    hidden = F.create_map(*(x for i, n in enumerate(table.names) for x in (F.lit(i), F.lit(n))))
    return marks.where(F.col("i") < len(table.names)).select(hidden[F.col("i")].alias("column")).where(~F.col("column").isin(*visible))


def values_matching(values: list[str], text: str) -> list[str]:
    return [v for v in values if text.lower() in v.lower()]


def chosen_values(every: list[str], chosen: set[str]) -> set[str] | None:
    """The filter for a selection of listed values: all of them are no filter."""
    return None if set(every) <= chosen else chosen


def moved(source: Query, target: Query) -> tuple[Query, Query]:
    """Takes the terms of a filter to a highlight, or back."""
    return replace(source, terms=()), replace(target, terms=(*target.terms, *source.terms))
