"""Search, sorts, statistics, diff, edits, views and exports on small tables."""

from __future__ import annotations

import io
import json
import math
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_layout import BULK, CLASSIC, put

from tabulon.functions.text import number_of, shown_number, sort_key
from tabulon.operators import export as X
from tabulon.operators import predicates as P
from tabulon.operators.diff import compared
from tabulon.operators.ordering import Sorted, ordered, positions
from tabulon.operators.overlay import Overlay, load_recoveries, recovery_name, save_recovery
from tabulon.operators.predicates import Filters, Query, Term
from tabulon.operators.stats import Statistics, column_statistics, distinct_values
from tabulon.operators.table import TextTable
from tabulon.operators.view import Selection, Session, View, page_label, page_setting


@pytest.fixture
def prices(spark, tmp_path) -> TextTable:
    return TextTable.open(spark, put(tmp_path, CLASSIC))


@pytest.fixture(scope="module")
def ragged(spark) -> TextTable:
    data = [(0, ["a", "Alpha"]), (1, ["b", "beta", "x,y"]), (2, ["c", "GAMMA", "", "extra"]), (3, ["d"])]
    return TextTable(spark.createDataFrame(data, "row_idx long, fields array<string>"), ("key", "name", "more"))


def ids(t) -> list[int]:
    return sorted(r["row_idx"] for r in (t.df if isinstance(t, TextTable) else t).collect())


@pytest.mark.parametrize(("term", "rows"), [
    (Term("EXTRA"), [2]), (Term("extra", column="more"), []), (Term("beta", P.EQUALS, "name"), [1]), (Term("beta", P.EQUALS, "name", True), [1]),
    (Term("gamma", P.EQUALS, "name", True), []), (Term("a", P.NOT_CONTAINS, "name"), [3]), (Term("a", P.NOT_CONTAINS), [3]), (Term("", P.EQUALS), [0, 1, 2, 3]),
    (Term("alp", P.STARTS, "name"), [0]), (Term("MMA", P.ENDS, "name"), [2]), (Term("^.a$", P.REGEX), []), (Term("a.*a", P.REGEX, "name"), [0, 2]),
    (Term("(", P.REGEX), []), (Term("x", column="none"), []), (Term("x", P.NOT_EQUALS, "none"), [0, 1, 2, 3]), (Term("b", P.NOT_EQUALS, "key"), [0, 2, 3]),
])
def test_terms_on_ragged_rows(ragged, term, rows):
    assert ids(Filters(query=Query((term,))).apply(ragged)) == rows


def test_uniform_and_ragged_tables_agree(spark):
    df = spark.createDataFrame([(0, "ab", None), (1, "B", "c"), (2, "", "Ab")], "k long, x string, y string")
    t = TextTable.from_dataframe(df, "k")
    for q in (Query.of("b"), Query((Term("b", P.NOT_CONTAINS),)), Query((Term("ab"), Term("c")), True)):
        assert ids(Filters(query=q).apply(t)) == ids(Filters(query=q).apply(t.ragged()))


def test_lines_are_searched_as_fields_are(spark, prices):
    plain = TextTable(prices.df.drop("raw"), prices.names)
    for t in (Term("sec002"), Term("K equity"), Term("0|0"), Term("1", P.NOT_CONTAINS), Term("SEC003", case=True), Term("sec003", P.NOT_CONTAINS, None, True), Term("|")):
        assert ids(Filters(query=Query((t,))).apply(prices)) == ids(Filters(query=Query((t,))).apply(plain)), t
    assert "split" not in Filters(query=Query.of("sec")).apply(prices).df.select("row_idx")._jdf.queryExecution().optimizedPlan().toString()


def test_filters_combine(ragged):
    assert ids(Filters().with_values("name", {"beta", "GAMMA"}).with_pattern("more", "Y").apply(ragged)) == [1]
    assert ids(Filters().with_values("more", {""}).apply(ragged)) == [0, 2, 3]
    assert ids(Filters().with_values("none", {"x"}).apply(ragged)) == [0, 1, 2, 3]
    assert ids(Filters().with_values("key", set()).apply(ragged)) == []
    assert ids(Filters().with_values("key", {str(i) for i in range(2000)} | {"a"}).apply(ragged)) == [0]
    assert ids(P.filter_text(ragged, "")) == [0, 1, 2, 3]


def test_queries_describe_and_change():
    q = Query.of("a").add(Term("b", P.REGEX, "X", True))
    assert [t.describe() for t in q.terms] == ['Any column contains "a"', "X matches /b/ (case-sensitive)"]
    assert q.without(5) == q and q.without(0).terms[0].text == "b" and Query.of("") == Query()


def test_highlights(ragged):
    q = Query((Term("a"), Term("c", column="key"), Term("z", P.NOT_CONTAINS)), True)
    marks = {r["row_idx"]: r["m"] for r in ragged.df.select("row_idx", P.cell_marks(ragged, q).alias("m")).collect()}
    assert marks == {0: [True, True], 1: [False, True, False], 2: [True, True, False, True], 3: [False]}
    assert [r["column"] for r in P.hidden_matches(ragged, Query.of("x,"), ["key"], [F.col("row_idx")]).collect()] == ["more"]


def test_numbers_and_order(spark):
    values = ["10", "2", "", "abc", " 3 ", "1e1", "1,000", "-5", "0x1", "1d", "inf", "NaN", ".5", "1_0"]
    df = spark.createDataFrame(list(enumerate(values)), "k long, x string")
    t = TextTable.from_dataframe(df, "k")
    numeric = {r["x"] for r in df.where(number_of(F.col("x")).isNotNull()).collect()}
    assert numeric == {"10", "2", " 3 ", "1e1", "-5", "NaN", ".5"}
    got = [values[r["row_idx"]] for r in ordered(t, Sorted().by("x")).collect()]
    assert got[:8] == ["", "NaN", "-5", ".5", "2", " 3 ", "10", "1e1"]
    down = [r["row_idx"] for r in ordered(t, Sorted().by("x", True)).collect()]
    assert down.index(0) < down.index(5)  # equal numbers keep their order
    keyed, by = Sorted().by("x").prepared(t)
    assert [r["pos"] for r in positions(keyed.df, by).orderBy("pos").collect()] == list(range(len(values)))
    assert df.select(sort_key(F.col("x")).alias("k")).where("k.kind = 1").count() == 7


def test_composed_sorts_and_id_bytes(spark):
    t = TextTable.from_dataframe(spark.createDataFrame([(0, "b", "1", "z" * 40 + "b"), (1, "a", "1", "z" * 40 + "a"), (2, "a", "0", "y")], "k long, p string, q string, _ID string"), "k")
    assert [r["row_idx"] for r in ordered(t, Sorted().by("q").by("p")).collect()] == [2, 1, 0]
    assert [r["row_idx"] for r in ordered(t, Sorted().by("_ID")).collect()] == [2, 0, 1]  # 32 bytes tie
    assert Sorted().toggled("p").toggled("p").keys == (("p", True),) and Sorted().by("nothing").prepared(t)[1]


def test_statistics_count_all_distinct_values(spark, prices):
    for most, more in ((2, True), (3, True), (4, False)):
        r = column_statistics(prices, "PRICE", most=most).head()
        assert (r["distinct_count"], r["distinct_truncated"]) == (3, more)


def test_statistics_sum_decimals_exactly(spark):
    def summed(*values):
        t = TextTable.from_dataframe(spark.createDataFrame(list(enumerate(values)), "k long, x string"), "k")
        s = Statistics.of(t, "x")
        return s.numeric_count, s.numeric_sum, s.numeric_mean

    assert summed("0.1", "0.1", "0.1", "x", "") == (3, 0.3, 0.3 / 3)
    assert summed("9007199254740993.5", "0.25", "0.25", "-9007199254740992") == (4, 2.5, 0.625)  # 9007199254740994 as a double
    assert summed("1e300", "1", "1e-999999999", "1e-300") == (4, 1e300, 2.5e299)
    assert summed("1e-9", "1e-9") == (2, 2e-9, 1e-9)
    assert summed("Infinity", "0.1", "-1e15") == (3, math.inf, math.inf) and math.isnan(summed("NaN", "0.1")[1])
    assert summed("x", "") == (0, None, None)


def test_statistics(spark, prices):
    s = Statistics.of(prices, "PRICE")
    assert (s.row_count, s.numeric_sum, s.numeric_mean, s.min_text, s.max_text, s.distinct_count, s.fully_numeric) == (3, pytest.approx(198.45), pytest.approx(66.15), "12.90", "97.35", 3, True)
    t = TextTable.from_dataframe(spark.createDataFrame([(0, ""), (1, "1.0"), (2, "1"), (3, "x"), (4, "1")], "k long, x string"), "k")
    s = Statistics.of(t, "x")
    assert (s.row_count, s.blank_count, s.distinct_count, s.numeric_count, s.min_text, s.max_text) == (5, 1, 3, 3, "1.0", "x")
    assert s.measures()["numeric_count"] == 3 and s.measures()["blank_fraction"] == 0.2 and s.shown_measures()["numeric_mean"] == "1"
    assert "numeric_sum" not in Statistics.of(t.having(t.df.where("c1 = 'x'")), "x").measures()
    none = Statistics.of(t, "nothing")
    assert none.row_count == 0 and none.min_text is None and Statistics.of(t.having(t.df.limit(0)), "x").row_count == 0
    assert [shown_number(x) for x in (1234.5, 0.0, 1e12, 0.00001, 2.0)] == ["1,234.5", "0", "1e+12", "1e-5", "2"]


def test_distinct_values_are_the_first_seen(spark):
    t = TextTable.from_dataframe(spark.createDataFrame([(0, "z"), (1, "b"), (2, "z"), (3, "a")], "k long, x string"), "k")
    values, cut = distinct_values(t, "x", F.col("row_idx"), 2)
    assert sorted(r["value"] for r in values.collect()) == ["b", "z"] and cut.head()[0]
    assert not distinct_values(t, "x", F.col("row_idx"), 4)[1].head()[0] and distinct_values(t, "x", F.col("row_idx"), 3)[1].head()[0]
    assert distinct_values(t, "none", F.col("row_idx"))[0].count() == 0


def test_diff(spark):
    make = lambda rows: TextTable(spark.createDataFrame(rows, "row_idx long, fields array<string>"), ("_ID", "x"))
    left = make([(0, ["a", "1"]), (1, ["b", "2"]), (2, ["b", "3"]), (3, ["c"]), (4, ["d", "9"])])
    right = make([(0, ["b", "2"]), (1, ["b", "3"]), (2, ["c", ""]), (3, ["d", "8"]), (4, ["e", "0"])])
    found = compared(left, right)
    assert sorted((r["kind"], r["key"], r["left_row"]) for r in found.entries.collect() if r["left_row"] is not None) == [("changed", "b", 1), ("changed", "d", 4), ("removed", "a", 0), ("unchanged", "b", 2), ("unchanged", "c", 3)]
    assert found.summary().head().asDict() == {"added": 1, "removed": 1, "changed": 2, "unchanged": 2}
    assert found.warnings() == {"missing_key": (False, False), "repeated_key": (True, True)} and ids(found.extracted("added", left, right)) == [4]
    assert compared(left, right, "nothing").warnings()["missing_key"] == (True, True)


def test_edits_resolve_and_undo(prices):
    o = Overlay()
    o.edit(1, 2, "555.55")
    o.edit(0, 9, "beyond")
    o.delete(2)
    new = o.add(3)
    o.edit(new, 0, "NEWSEC")
    seen = {r["row_idx"]: (r["fields"], r["render_state"]) for r in o.resolve(prices).df.collect()}
    assert seen[1] == (["SEC002 ZZ Note", "0", "555.55"], "Edited") and seen[-1] == (["NEWSEC", "", ""], "Added") and 2 not in seen
    assert seen[0][0] == ["SEC001 ZZ Note", "0", "88.20"]
    o.undo()
    assert o.edits.get(new) is None
    o.undo()
    assert not o.live_added() and o.restore(2) and not o.restore(2)
    o.undo()
    o.undo()
    assert o.is_empty and not o.undo()
    o.duplicate(["x"])
    o.delete(-2)
    assert not o.live_added() and o.restore(-2) and o.states[-2] == "Duplicated"


def test_recovery(tmp_path, prices):
    o = Overlay()
    o.edit(1, 2, "5")
    o.delete(0)
    save_recovery(str(tmp_path / "r"), "/a/b.dif", 0, o)
    (tmp_path / "r" / "bad.recovery.json").write_text("{")
    (found,) = load_recoveries(str(tmp_path / "r"))
    assert found.path == "/a/b.dif" and Overlay.of(found.overlay).state() == o.state() and load_recoveries("/nowhere") == []
    assert recovery_name("/a/B.dif", 0) == recovery_name("/A/b.dif", 0) != recovery_name("/a/b.dif", 1)


def written(t: TextTable, form: str, order=None) -> bytes:
    out = io.BytesIO()
    X.export(t, order or Sorted().prepared(t)[1], X.format_of(form, t), out)
    return out.getvalue()


def test_exports(spark, prices, ragged):
    assert written(prices, "dif") == CLASSIC.replace("\n\nSEC003", "\nSEC003").encode()
    assert written(ragged, "csv") == b'key,name,more\r\na,Alpha\r\nb,beta,"x,y"\r\nc,GAMMA,,extra\r\nd\r\n'
    assert written(ragged, "tsv").split(b"\n")[2] == b"b\tbeta\tx,y"
    assert json.loads(written(ragged, "json")) == [{"key": "a", "name": "Alpha"}, {"key": "b", "name": "beta", "more": "x,y"}, {"key": "c", "name": "GAMMA", "more": ""}, {"key": "d"}]
    assert X.preview(ragged, [F.col("row_idx")], X.format_of("csv", ragged)).count(b"\r\n") == 3
    text, cut = X.clipboard(ragged, [F.col("row_idx")], "csv", ["more", "key"])
    assert text == 'more,key\n,a\n"x,y",b\n,c\n,d\n' and not cut


def test_bulk_export_round_trip(spark, tmp_path):
    t = TextTable.open(spark, put(tmp_path, BULK), 0)
    again = TextTable.open(spark, put(tmp_path, written(t, "dif").decode(), "one_bulk.dif"))
    assert [r["fields"] for r in again.df.orderBy("row_idx").collect()] == [r["fields"] for r in t.df.orderBy("row_idx").collect()]
    assert again.names == t.names and len(again.layout.sections) == 1


def test_crlf_is_kept(spark, tmp_path):
    text = CLASSIC.replace("\n\nSEC003", "\nSEC003").replace("\n", "\r\n")
    assert written(TextTable.open(spark, put(tmp_path, text)), "dif") == text.encode()


def test_names():
    assert X.file_name("/x/fixed_ext.out.20260719", "csv", date(2026, 1, 2)) == "fixed_ext.csv.20260102"
    assert X.file_name("C:\\d\\a.dif", "json", date(2026, 1, 2), " P/Q. ") == "a_P_Q.json.20260102"


def test_views(spark, prices):
    v = View(prices, sort=Sorted().by("PRICE"), page_size=2)
    assert [r["row_idx"] for r in v.current().collect()] == [2, 0] and v.pages() == 2 and v.label() == "Showing 1–2 of 3"
    v.go_to("9")
    assert [r["row_idx"] for r in v.current().collect()] == [1]
    v.resize(1)
    assert v.page == 2
    v = v.filtered(Filters(query=Query.of("SEC00")))
    assert v.page == 0 and v.highlight_instead().highlight.terms and v.cleared().count() == 3
    e = View(prices, sort=Sorted().by("PRICE", True)).extracted(prices.df.where("row_idx <> 1"))
    assert [r["row_idx"] for r in e.ordered().collect()] == [0, 2]
    m, at = View(prices, highlight=Query.of("97.3")).match(5)
    assert [r["row_idx"] for r in m.collect()] == [1] and at == 0
    s = Selection().every().toggled(1)
    assert s.count(3) == 2 and not s.has(1) and ids(View(prices, selection=s).selected()) == [0, 2]
    assert page_setting(60) == 50 and page_setting(None) == 0 and page_label(1000) == "1,000 rows"


def test_session(spark, tmp_path):
    s = Session(spark)
    path = put(tmp_path, BULK)
    views = s.split(path)
    views[1].overlay.edit(0, 0, "q")
    assert len(views) == 2 and s.has_edits() and s.view(path, 1) is views[1]
    with pytest.raises(ValueError, match="starts with none"):
        s.view(put(tmp_path, "x", "bad.dif"))


def test_added_rows_stand_last_by_id(prices):
    o = Overlay()
    o.add(3)
    o.edit(-1, 0, "AAA")
    v = View(prices, o, sort=Sorted().by("_ID", True))
    assert [r["row_idx"] for r in v.ordered().collect()] == [2, 1, 0, -1]
    assert [r["row_idx"] for r in View(prices, o, sort=Sorted().by("PRICE")).ordered().collect()] == [-1, 2, 0, 1]


def test_doubles_keep_their_digits(spark):
    values = [0.001, 1e-9, 123.456789, float("nan"), float("inf"), float("-inf"), 1e20, None, -0.0]
    t = TextTable.from_dataframe(spark.createDataFrame(list(enumerate(values)), "k long, x double"), "k")
    got = {r["row_idx"]: r["x"] for r in t.wide(["x"]).collect()}
    assert [float(got[i]) for i in (0, 1, 2, 4, 5, 6, 8)] == [0.001, 1e-9, 123.456789, float("inf"), float("-inf"), 1e20, 0.0] and got[3] == "NaN" and got[7] == ""
    assert [r["row_idx"] for r in ordered(t, Sorted().by("x")).collect()] == [7, 3, 5, 8, 1, 0, 2, 6, 4]
    assert ids(Filters(query=Query.of("456789")).apply(t)) == [2] and Statistics.of(t, "x").numeric_count == 8


def test_sorts_compare_plain_columns(spark, capsys):
    t = TextTable.from_dataframe(spark.createDataFrame([(0, "b"), (1, "2")], "k long, x string"), "k")
    ordered(t, Sorted().by("x")).explain()
    plan = capsys.readouterr().out
    assert all("RLIKE" not in line.upper() for line in plan.splitlines() if "Sort [" in line or "rangepartitioning" in line)
    assert set(ordered(t, Sorted().by("x")).columns) == set(t.df.columns)


def test_structural_edits_go_to_the_first_page(prices):
    v = View(prices, page_size=1, page=2)
    assert v.count() == 3
    v = v.edited(lambda o: o.delete(0))
    assert v.page == 0 and v.count() == 2 and View(prices, v.overlay, page=1).edited(Overlay.undo).count() == 3


def test_parts_on_end_are_the_export(spark, tmp_path):
    path = put(tmp_path, CLASSIC)
    t = TextTable.open(spark, path)
    big = TextTable.from_dataframe(spark.range(5000).selectExpr("id k", "concat('a,', id, '\\t') x"), "k")
    for table, names in ((t, ("dif", "csv", "tsv")), (big, ("csv", "tsv")), (big.having(big.df.limit(0)), ("csv",))):
        t2, order = Sorted().by(table.names[-1], True).prepared(table)
        for name in names:
            whole, parts, folder = io.BytesIO(), io.BytesIO(), str(tmp_path / f"parts-{name}-{id(table)}")
            X.export(t2, order, X.format_of(name, t2), whole)
            X.export_parts(t2, order, X.format_of(name, t2), folder)
            X.joined_parts(folder, parts)
            assert parts.getvalue() == whole.getvalue() and whole.getvalue(), name


def test_recovery_in_sessions(spark, tmp_path):
    path, folder = put(tmp_path, BULK), str(tmp_path / "saved")
    s = Session(spark, folder)
    s.split(path)[1].overlay.edit(0, 0, "q")
    assert s.save_if_due(100.0) and not s.save_if_due(110.0) and s.save_if_due(120.0)
    other = Session(spark, folder)
    assert other.view(path, 1).overlay.is_empty and other.save() == 0
    (record,) = other.recoverable()
    v = other.reopen(record)
    assert (record.path, record.section) == (path, 1) and v is other.view(path, 1) and v.overlay.edits == s.view(path, 1).overlay.edits
    v.overlay.undo() or v.overlay.edits.clear()
    assert v.overlay.is_empty and other.save() == 0 and other.recoverable() == []
    s.save()
    record.section = 9
    assert other.reopen(record) is None
    s.close(path, 1)
    assert s.recoverable() == [] and Session(spark).save() == 0
