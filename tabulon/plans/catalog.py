"""The registered queries of the core operators over the tables of a star schema, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.staging import written_text
from tabulon.functions.text import number_of, sort_key
from tabulon.operators import export as X
from tabulon.operators import predicates as P
from tabulon.operators.diff import changed_cells, compared
from tabulon.operators.ordering import Sorted, page, positions
from tabulon.operators.overlay import Overlay
from tabulon.operators.predicates import Filters, Query, Term
from tabulon.operators.stats import column_statistics, distinct_excluding_own, distinct_values
from tabulon.operators.table import ORDER, TextTable
from tabulon.operators.view import Selection, View
from tabulon.sources.layout import read_layout

Made = Callable[[SparkSession, str], DataFrame]
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id"}
_made: dict[str, Made] = {}
_sql: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> TextTable:
    return TextTable.from_dataframe(money(read(spark, sf_dir, name), columns), KEYS[name])


def money(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Doubles as amounts with two decimals, as the SQL has them."""
    return df.select(*(F.col(c).cast("decimal(18,2)").alias(c) if df.schema[c].dataType.simpleString() == "double" else c for c in columns or df.columns))


def query(sql: str | None = None, name: str | None = None) -> Callable[[Made], Made]:
    def put(f: Made) -> Made:
        _made[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Made]:
    return dict(_made)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# Tables as text, in SQL: numbers with decimals have two of them.
CUSTOMER = "(SELECT c_custkey k, c_custkey::varchar c_custkey, c_name, c_nationkey::varchar c_nationkey, c_acctbal::decimal(18,2)::varchar c_acctbal, c_mktsegment FROM customer)"
PART = "(SELECT p_partkey k, p_partkey::varchar p_partkey, p_name, p_brand, p_type, p_size::varchar p_size, p_retailprice::decimal(18,2)::varchar p_retailprice FROM part)"
SUPPLIER = "(SELECT s_suppkey k, s_suppkey::varchar s_suppkey, s_name, s_nationkey::varchar s_nationkey, s_acctbal::decimal(18,2)::varchar s_acctbal FROM supplier)"
NATION = "(SELECT n_nationkey k, n_nationkey::varchar n_nationkey, n_name, n_regionkey::varchar n_regionkey FROM nation)"
ORDERS = "(SELECT o_orderkey k, o_orderkey::varchar o_orderkey, o_custkey::varchar o_custkey, o_orderstatus, o_totalprice::decimal(18,2)::varchar o_totalprice, o_orderpriority FROM orders)"
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def searched(name: str, table: str, source: str, condition: str, terms: list[Term], any: bool = False, columns: list[str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = text(spark, sf_dir, table, columns)
        return Filters(query=Query(tuple(terms), any)).apply(t).wide()

    shown = {"customer": CUSTOMER, "part": PART, "supplier": SUPPLIER, "nation": NATION, "orders": ORDERS}[source]
    query(f"SELECT k AS row_idx, * EXCLUDE (k) FROM {shown} t WHERE {condition}", name)(run)


searched("search_any_contains", "customer", "customer", "contains(lower(c_custkey), 'furn') OR contains(lower(c_name), 'furn') OR contains(lower(c_nationkey), 'furn') OR contains(c_acctbal, 'furn') OR contains(lower(c_mktsegment), 'furn')", [Term("furn")])
searched("search_col_contains", "part", "part", "contains(lower(p_name), 'red')", [Term("RED", column="p_name")])
searched("search_col_notcontains", "part", "part", "NOT contains(lower(p_name), 'red')", [Term("red", P.NOT_CONTAINS, "p_name")])
searched("search_col_equals", "customer", "customer", "lower(c_mktsegment) = 'building'", [Term("building", P.EQUALS, "c_mktsegment")])
searched("search_col_notequals", "customer", "customer", "lower(c_mktsegment) <> 'building'", [Term("building", P.NOT_EQUALS, "c_mktsegment")])
searched("search_col_startswith", "part", "part", "starts_with(lower(p_brand), 'brand#1')", [Term("brand#1", P.STARTS, "p_brand")])
searched("search_col_endswith", "part", "part", "suffix(lower(p_name), 'ring')", [Term("RING", P.ENDS, "p_name")])
searched("search_not_contains_any", "nation", "nation", "NOT (contains(n_nationkey, '1') OR contains(lower(n_name), '1') OR contains(n_regionkey, '1'))", [Term("1", P.NOT_CONTAINS)])
searched("search_regex", "supplier", "supplier", "regexp_matches(s_name, 'r#0+[1-3]', 'i') ", [Term("R#0+[1-3]", P.REGEX, "s_name")])
searched("search_regex_invalid", "supplier", "supplier", "false", [Term("[a", P.REGEX, "s_name")])
searched("search_case_sensitive", "part", "part", "contains(p_type, 'ECO') OR contains(p_name, 'RED') OR contains(p_name, 'blue')", [Term("ECO", column="p_type", case=True), Term("RED", column="p_name", case=True), Term("blue", column="p_name", case=True)], True)
searched("search_all_terms", "orders", "orders", "o_orderstatus = 'F' AND starts_with(o_totalprice, '1')", [Term("f", P.EQUALS, "o_orderstatus"), Term("1", P.STARTS, "o_totalprice")], columns=ORDER_COLUMNS)
searched("search_any_terms", "orders", "orders", "o_orderstatus = 'F' OR starts_with(o_totalprice, '1')", [Term("f", P.EQUALS, "o_orderstatus"), Term("1", P.STARTS, "o_totalprice")], True, ORDER_COLUMNS)
searched("search_missing_col_pos", "nation", "nation", "false", [Term("a", column="nothing")])
searched("search_missing_col_neg", "nation", "nation", "true", [Term("a", P.NOT_CONTAINS, "nothing")])
searched("search_empty_terms", "nation", "nation", "true", [Term(""), Term("", column="n_name")])


@query("SELECT event_id row_idx, event_type, user_id::varchar user_id FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2)")
def value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text(spark, sf_dir, "events", ["event_id", "event_type", "user_id"])
    first = distinct_values(t, "event_type", F.col(ORDER))[0]
    chosen = {r["value"] for r in first.orderBy("value").limit(2).collect()}
    return Filters().with_values("event_type", chosen).apply(t).wide(["event_type", "user_id"])


@query("SELECT o_orderkey row_idx, o_orderstatus FROM orders WHERE o_custkey % 3 = 0 AND o_custkey < 9000")
def value_filter_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More values than fit a condition: a semi join."""
    t = text(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    return Filters().with_values("o_custkey", {str(i) for i in range(0, 9000, 3)}).apply(t).wide(["o_orderstatus"])


#: Doubles as they stand: an eighth of an amount, whose digits both engines print alike.
EIGHTHS = "(SELECT o_orderkey k, (o_totalprice / 8)::varchar x, o_totalprice / 8 d FROM orders)"


def eighths(spark: SparkSession, sf_dir: str) -> TextTable:
    return TextTable.from_dataframe(read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 8).alias("x")), "o_orderkey")


@query(f"SELECT k row_idx, x FROM {EIGHTHS} WHERE suffix(x, '75')")
def double_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Filters(query=Query((Term("75", P.ENDS, "x"),))).apply(eighths(spark, sf_dir)).wide(["x"])


@query(f"SELECT k row_idx, row_number() OVER (ORDER BY d DESC, k) - 1 pos FROM {EIGHTHS}")
def double_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, by = Sorted().by("x", True).prepared(eighths(spark, sf_dir))
    return positions(t.df, by, "pos", ORDER)


@query(f"SELECT count(*) row_count, count(DISTINCT x)::bigint distinct_count, arg_min(x, (d, k)) min_text, arg_max(x, (d, -k)) max_text, count(*) numeric_count, min(d) numeric_min, max(d) numeric_max, round(avg(d), 4) numeric_mean FROM {EIGHTHS}")
def double_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = column_statistics(eighths(spark, sf_dir), "x").withColumn("numeric_mean", _round("numeric_mean", 4))
    return found.select("row_count", "distinct_count", "min_text", "max_text", "numeric_count", "numeric_min", "numeric_max", "numeric_mean")


@query("SELECT event_id row_idx, event_type FROM events WHERE false")
def value_filter_empty_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Filters().with_values("event_type", set()).apply(text(spark, sf_dir, "events", ["event_id", "event_type"])).wide(["event_type"])


@query(f"SELECT k row_idx, p_name FROM {PART} WHERE contains(lower(p_type), 'ta')")
def pattern_filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Filters().with_pattern("p_type", "TA").apply(text(spark, sf_dir, "part")).wide(["p_name"])


@query(f"SELECT k row_idx, p_name FROM {PART} WHERE regexp_matches(p_brand, '#[12][0-9]*$', 'i')")
def pattern_filter_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Filters().with_pattern("p_brand", "#[12][0-9]*$", True).apply(text(spark, sf_dir, "part")).wide(["p_name"])


@query("SELECT l_orderkey::varchar l_orderkey, l_linenumber::varchar l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'N') AND contains(l_quantity::decimal(18,2)::varchar, '5') AND starts_with(l_orderkey::varchar, '1')")
def predicate_set_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TextTable.from_dataframe(money(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]), "l_orderkey")
    f = Filters(query=Query((Term("1", P.STARTS, "l_orderkey"),))).with_values("l_returnflag", {"A", "N"}).with_pattern("l_quantity", "5")
    return f.apply(t).wide(["l_orderkey", "l_linenumber", "l_returnflag"]).drop(ORDER)


@query(f"SELECT k row_idx, (contains(c_custkey, '7') OR contains(lower(c_name), '7') OR contains(c_nationkey, '7') OR contains(c_acctbal, '7') OR contains(c_mktsegment, '7')) is_match FROM {CUSTOMER}")
def highlight_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.highlighted(text(spark, sf_dir, "customer"), Query.of("7")).select(ORDER, "is_match")


@query(f"SELECT k row_idx, concat_ws(',', contains(c_custkey, '7')::int, contains(c_name, '7')::int, contains(c_nationkey, '7')::int, contains(c_acctbal, '7')::int, (contains(c_mktsegment, '7') OR lower(c_mktsegment) = 'building')::int) marks FROM {CUSTOMER}")
def highlight_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text(spark, sf_dir, "customer")
    q = Query((Term("7"), Term("building", P.EQUALS, "c_mktsegment"), Term("x", P.NOT_CONTAINS)))
    return t.df.select(ORDER, F.array_join(F.transform(P.cell_marks(t, q), lambda x: x.cast("int").cast("string")), ",").alias("marks"))


@query(f"WITH m AS (SELECT * FROM {PART} WHERE contains(p_partkey || ' ' || lower(p_name) || ' ' || lower(p_brand) || ' ' || lower(p_type) || ' ' || p_size || ' ' || p_retailprice, '9') ORDER BY k LIMIT 250) SELECT DISTINCT c AS \"column\" FROM (SELECT 'p_type' c FROM m WHERE contains(p_type, '9') UNION ALL SELECT 'p_size' FROM m WHERE contains(p_size, '9') UNION ALL SELECT 'p_retailprice' FROM m WHERE contains(p_retailprice, '9'))")
def hidden_match_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hidden_matches(text(spark, sf_dir, "part"), Query.of("9"), ["p_partkey", "p_name", "p_brand"], [F.col(ORDER)])


def sorted_positions(name: str, table: str, column: str, down: bool, order: str, columns: list[str]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, by = Sorted().by(column, down).prepared(text(spark, sf_dir, table, columns))
        return positions(t.df, by, "pos", ORDER)

    query(f"SELECT {KEYS[table]} row_idx, row_number() OVER (ORDER BY {order}) - 1 pos FROM {table}", name)(run)


sorted_positions("sort_numeric_asc", "orders", "o_totalprice", False, "o_totalprice::decimal(18,2), o_orderkey", ["o_orderkey", "o_totalprice"])
sorted_positions("sort_numeric_desc", "orders", "o_totalprice", True, "o_totalprice::decimal(18,2) DESC, o_orderkey", ["o_orderkey", "o_totalprice"])
sorted_positions("sort_text_stable_desc", "customer", "c_mktsegment", True, "c_mktsegment DESC, c_custkey", ["c_custkey", "c_mktsegment"])


@query("SELECT o_orderkey row_idx, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderpriority, o_orderkey) - 1 pos FROM orders")
def sort_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort by one column, then by another: ties keep the first sort's order."""
    t, by = Sorted().by("o_orderpriority").by("o_orderstatus", True).prepared(text(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"]))
    return positions(t.df, by, "pos", ORDER)


@query("SELECT doc_id row_idx, row_number() OVER (ORDER BY substring(hex(encode(text)), 1, 64), doc_id) - 1 pos FROM documents")
def sort_id_prefix32(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_ID"))
    t, by = Sorted().by("_ID").prepared(TextTable.from_dataframe(df, "doc_id"))
    return positions(t.df, by, "pos", ORDER)


def _page(number: int, columns: list[str]) -> Made:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = View(text(spark, sf_dir, "orders", columns), sort=Sorted().by("o_totalprice", True), page_size=100, page=number)
        return v.current().select(ORDER)

    return run


_made["page_n"] = lambda spark, sf_dir: page(t := text(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), Sorted().by("o_totalprice", True), 100, 3).select(ORDER)
_sql["page_n"] = "SELECT o_orderkey row_idx FROM orders ORDER BY o_totalprice::decimal(18,2) DESC, o_orderkey LIMIT 100 OFFSET 300"
query("SELECT o_orderkey row_idx FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice::decimal(18,2) DESC, o_orderkey) - 1 p, count(*) OVER () n FROM orders) WHERE p // 100 = (n - 1) // 100", "page_last_clamped")(_page(10**9, ["o_orderkey", "o_totalprice"]))


@query("SELECT DISTINCT event_type AS value, (SELECT count(DISTINCT event_type) FROM events) >= 10000 AS truncated FROM events")
def distinct_of_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, cut = distinct_values(text(spark, sf_dir, "events", ["event_id", "event_type"]), "event_type", F.col(ORDER))
    return values.join(F.broadcast(cut))


@query("SELECT v AS value, (SELECT count(DISTINCT o_custkey) FROM orders) >= 50 AS truncated FROM (SELECT o_custkey::varchar v, min(o_orderkey) k FROM orders GROUP BY 1 ORDER BY k LIMIT 50)")
def distinct_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, cut = distinct_values(text(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), "o_custkey", F.col(ORDER), 50)
    return values.join(F.broadcast(cut))


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus = 'F'")
def distinct_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    f = Filters().with_values("o_orderstatus", {"F"}).with_values("o_orderpriority", {"1-URGENT"})
    return distinct_excluding_own(t, f, "o_orderpriority", F.col(ORDER))[0]


NUMBERS = """SELECT count(*) row_count, 0::bigint blank_count, count(DISTINCT x)::bigint distinct_count, (count(DISTINCT x) >= 100000) distinct_truncated,
  arg_min(x, (d, k)) min_text, (SELECT x FROM t ORDER BY d DESC, k LIMIT 1) max_text, count(*) numeric_count, round(min(d)::double, 4) numeric_min, round(max(d)::double, 4) numeric_max,
  round(sum(d)::double, 2) numeric_sum, round(avg(d)::double, 4) numeric_mean FROM t"""


def _round(name: str, places: int) -> Column:
    """As the SQL rounds doubles: times a power of ten, to a whole number and back, so the product decides ties. Huge ones stay."""
    x, scale = F.col(name), float(10**places)
    return F.when(F.abs(x) < 1e300, F.round(x * scale) / scale).otherwise(x)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: _round(n, 2 if n == "numeric_sum" else 4) for n in ("numeric_min", "numeric_max", "numeric_sum", "numeric_mean")})


@query("WITH t AS (SELECT o_totalprice::decimal(18,2)::varchar x, o_totalprice::decimal(18,2) d, o_orderkey k FROM orders) " + NUMBERS)
def column_stats_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(column_statistics(text(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"]), "o_totalprice"))


TEXTS = """SELECT count(*) row_count, count(*) FILTER (x = '')::bigint blank_count, count(DISTINCT x) FILTER (x <> '')::bigint distinct_count, false distinct_truncated,
  min(x) FILTER (x <> '') min_text, max(x) FILTER (x <> '') max_text, 0::bigint numeric_count, NULL::double numeric_min, NULL::double numeric_max, NULL::double numeric_sum, NULL::double numeric_mean FROM t"""


@query("WITH t AS (SELECT p_type x FROM part) " + TEXTS)
def column_stats_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_statistics(text(spark, sf_dir, "part", ["p_partkey", "p_type"]), "p_type")


@query("WITH t AS (SELECT CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END x FROM part) " + TEXTS)
def column_stats_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("x"))
    return column_statistics(TextTable.from_dataframe(df, "p_partkey"), "x")


@query("SELECT p_partkey row_idx, x, try_cast(trim(x) AS double) AS num FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN ' 12.5 ' WHEN 1 THEN '1,000' WHEN 2 THEN '-3e2' WHEN 3 THEN '' WHEN 4 THEN '.5' WHEN 5 THEN 'abc' WHEN 6 THEN '+7.' ELSE p_retailprice::decimal(18,2)::varchar END x FROM part) WHERE true".replace("try_cast(trim(x) AS double)", "CASE WHEN x IN ('1,000', '', 'abc') THEN NULL ELSE cast(trim(x) AS double) END"))
def numeric_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 8
    x = F.when(k == 0, " 12.5 ").when(k == 1, "1,000").when(k == 2, "-3e2").when(k == 3, "").when(k == 4, ".5").when(k == 5, "abc").when(k == 6, "+7.").otherwise(F.col("p_retailprice").cast("decimal(18,2)").cast("string"))
    t = TextTable.from_dataframe(read(spark, sf_dir, "part").select("p_partkey", x.alias("x")), "p_partkey")
    return t.df.select(ORDER, t.value("x").alias("x"), number_of(t.value("x")).alias("num"))


def _mutated(spark: SparkSession, sf_dir: str) -> tuple[TextTable, TextTable]:
    """Orders against themselves without every 10th, with a status changed in every 7th and new keys for every 25th."""
    left = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    kept = left.where(k % 10 != 0).withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    more = left.where(k % 25 == 0).withColumn("o_orderkey", k + 1_000_000_000)
    return TextTable.from_dataframe(left, "o_orderkey"), TextTable.from_dataframe(kept.unionByName(more), "o_orderkey")


DIFF = """WITH l AS (SELECT o_orderkey k, o_orderstatus s, o_orderpriority p FROM orders),
r AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'X' ELSE s END s, p FROM l WHERE k % 10 <> 0 UNION ALL SELECT k + 1000000000, s, p FROM l WHERE k % 25 = 0),
d AS (SELECT coalesce(l.k, r.k) k, CASE WHEN l.k IS NULL THEN 'added' WHEN r.k IS NULL THEN 'removed' WHEN l.s <> r.s OR l.p <> r.p THEN 'changed' ELSE 'unchanged' END kind, l.s ls, r.s rs FROM l FULL JOIN r ON l.k = r.k)
"""


@query(DIFF + "SELECT kind, k::varchar AS key FROM d")
def diff_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*_mutated(spark, sf_dir), "o_orderkey").entries.select("kind", "key")


@query(DIFF + "SELECT k::varchar AS key, 'o_orderstatus' AS \"column\", ls AS \"left\", rs AS \"right\" FROM d WHERE kind = 'changed'")
def diff_column_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_cells(compared(*_mutated(spark, sf_dir), "o_orderkey")).drop("left_row")


@query(DIFF + "SELECT count(*) FILTER (kind = 'added')::bigint added, count(*) FILTER (kind = 'removed')::bigint removed, count(*) FILTER (kind = 'changed')::bigint changed, count(*) FILTER (kind = 'unchanged')::bigint unchanged FROM d")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(*_mutated(spark, sf_dir), "o_orderkey").summary()


@query("WITH r AS (SELECT c_nationkey::varchar k, arg_max(c_mktsegment, c_custkey) s FROM customer GROUP BY 1) SELECT CASE WHEN n.n_nationkey IS NULL THEN 'added' WHEN r.k IS NULL THEN 'removed' WHEN n.n_name <> r.s THEN 'changed' ELSE 'unchanged' END kind, coalesce(n.n_nationkey::varchar, r.k) AS key, (SELECT count(*) > 0 FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS dup_right FROM nation n FULL JOIN r ON n.n_nationkey::varchar = r.k")
def diff_dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys on the right: the last row counts."""
    left = TextTable.from_dataframe(read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), "n_nationkey")
    right = TextTable.from_dataframe(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("name")), "c_custkey")
    found = compared(left, right, "key")
    return found.entries.select("kind", "key").join(F.broadcast(found.duplicates.select(F.col("right").alias("dup_right"))))


def _edited(spark: SparkSession, sf_dir: str) -> tuple[TextTable, Overlay]:
    t, o = text(spark, sf_dir, "nation"), Overlay()
    o.edit(1, 1, "EDITED")
    o.edit(1, 1, "TWICE")
    o.edit(3, 2, "9")
    o.delete(2, 3)
    new = o.add(3)
    o.edit(new, 1, "NEW")
    o.duplicate(["5", "COPY", "0"])
    return t, o


OVERLAY = "SELECT k row_idx, concat_ws('|', n_nationkey, {name}, n_regionkey) AS line, CASE WHEN k = 1 THEN 'Edited' ELSE 'Normal' END render_state FROM " + NATION + " WHERE k NOT IN ({gone})"


@query(OVERLAY.format(name="CASE WHEN k = 1 THEN 'TWICE' ELSE n_name END", gone="2, 3") + " UNION ALL SELECT -1, '|NEW|', 'Added' UNION ALL SELECT -2, '5|COPY|0', 'Duplicated'")
def overlay_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, o = _edited(spark, sf_dir)
    return o.resolve(t).df.select(ORDER, F.concat_ws("|", "fields").alias("line"), "render_state")


@query("SELECT -1::bigint row_idx, '|NEW|' AS line UNION ALL SELECT -2, '5|COPY|0'")
def overlay_added_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, o = _edited(spark, sf_dir)
    return o.resolve(t).df.where(F.col(ORDER) < 0).select(ORDER, F.concat_ws("|", "fields").alias("line"))


@query(OVERLAY.format(name="CASE WHEN k = 1 THEN 'TWICE' ELSE n_name END", gone="2").replace("n_regionkey) AS", "CASE WHEN k = 3 THEN '9' ELSE n_regionkey END) AS").replace("WHEN k = 1 THEN 'Edited'", "WHEN k IN (1, 3) THEN 'Edited'"))
def overlay_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undone: the copy, the new row's edit, the new row, the second deletion."""
    t, o = _edited(spark, sf_dir)
    for _ in range(4):
        o.undo()
    return o.resolve(t).df.select(ORDER, F.concat_ws("|", "fields").alias("line"), "render_state")


@query(f"SELECT k row_idx, c_name FROM {CUSTOMER} WHERE c_mktsegment = 'BUILDING' AND k NOT IN (1, 2, 3, 10)")
def selection_all_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text(spark, sf_dir, "customer")
    v = View(t, filters=Filters().with_values("c_mktsegment", {"BUILDING"}), selection=Selection(frozenset({1, 2, 3, 10}), True))
    return v.selected().wide(["c_name"])


@query(f"SELECT k row_idx, c_name FROM {CUSTOMER} WHERE k % 5 = 0 AND contains(lower(c_mktsegment), 'build')")
def extract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text(spark, sf_dir, "customer")
    v = View(t, sort=Sorted().by("c_name", True)).extracted(t.df.where(F.col(ORDER) % 5 == 0))
    return v.filtered(Filters().with_pattern("c_mktsegment", "build")).rows().wide(["c_name"])


@query(f"SELECT * FROM (SELECT 0 pos, 's_suppkey' AS \"column\", s_suppkey AS value FROM {SUPPLIER} WHERE k = 1 UNION ALL SELECT 1, 's_name', s_name FROM {SUPPLIER} WHERE k = 1 UNION ALL SELECT 2, 's_nationkey', s_nationkey FROM {SUPPLIER} WHERE k = 1 UNION ALL SELECT 3, 's_acctbal', s_acctbal FROM {SUPPLIER} WHERE k = 1)")
def record_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text(spark, sf_dir, "supplier").detail(1)


def _file(spark: SparkSession, sf_dir: str) -> str:
    """nation and region as two sections of a file that the driver writes; two tables of fixed size."""
    lines = ["START-OF-FILE", "DELIMITER=|"]
    for name in ("nation", "region"):
        df = read(spark, sf_dir, name)
        lines += [f"DATA={name.upper()}", "START-OF-FIELDS", "_ID", *df.columns, "END-OF-FIELDS", "START-OF-DATA"]
        lines += ["|".join(map(str, (r[0], *r))) for r in sorted(df.collect())]
        lines += ["END-OF-DATA", f"DATARECORDS={df.count()}"]
    return written_text(spark, "tables_bulk.dif", "\n".join([*lines, "END-OF-FILE", ""]))


@query("SELECT n_nationkey::bigint AS row_idx, concat_ws('|', n_nationkey, n_nationkey, n_name, n_regionkey) AS line FROM nation")
def dif_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TextTable.open(spark, _file(spark, sf_dir), 0, 64)
    return t.df.select(ORDER, X.dif_line(t.fields, "|").alias("line"))


@query("SELECT r_regionkey::bigint AS row_idx, r_name FROM region WHERE contains(lower(r_name), 'a')")
def dif_bulk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TextTable.of_section(spark, read_layout(_file(spark, sf_dir)), 1)
    return Filters(query=Query((Term("a", column="r_name"),))).apply(t).wide(["r_name"])


QUOTED = "CASE WHEN regexp_matches({0}, '[,\"\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@query(f"SELECT page_id row_idx, {QUOTED.format('page_id::varchar')} || ',' || {QUOTED.format('url')} || ',' || {QUOTED.format('html')} AS line FROM pages")
def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text(spark, sf_dir, "pages")
    return t.df.select(ORDER, X.csv_line(t.fields).alias("line"))


@query("SELECT doc_id row_idx, doc_id::varchar || chr(9) || translate(text, chr(9) || chr(13) || chr(10), '   ') AS line FROM documents")
def export_tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text(spark, sf_dir, "documents", ["doc_id", "text"])
    return t.df.select(ORDER, X.tsv_line(t.fields).alias("line"))


@query("SELECT n_nationkey::bigint row_idx, '{\"n_nationkey\":\"' || n_nationkey || '\",\"n_name\":\"' || n_name || '\",\"n_regionkey\":\"' || n_regionkey || '\"}' AS line FROM nation")
def export_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text(spark, sf_dir, "nation")
    return t.df.select(ORDER, X.json_line(t.fields, t.names).alias("line"))


@query("SELECT r_regionkey::bigint row_idx, r_name FROM region ORDER BY 1 LIMIT 2")
def preview_two_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, by = Sorted().prepared(text(spark, sf_dir, "region"))
    lines = X.preview(t, by, X.format_of("csv", t)).decode().splitlines()[1:]
    return spark.createDataFrame([(int(key), name) for key, name in (x.split(",") for x in lines)], "row_idx long, r_name string")


@query("SELECT o_orderkey row_idx, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS third, (o_orderkey % 3 = 2) AS extra_found FROM orders")
def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two, three or four fields under three names: a missing one is blank, an extra one found by a search of all fields only."""
    df = read(spark, sf_dir, "orders")
    k, three = F.col("o_orderkey"), F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    fields = F.when(k % 3 == 0, F.slice(three, 1, 2)).when(k % 3 == 2, F.concat(three, F.array(F.lit("extra")))).otherwise(three)
    t = TextTable(df.select(k.alias(ORDER), fields.alias("fields")), ("key", "status", "priority"))
    return t.df.select(ORDER, t.value("priority").alias("third"), P.term_holds(t, Term("extra")).alias("extra_found"))


@query("SELECT o_orderpriority AS value, count(*)::bigint AS n FROM orders GROUP BY 1")
def sort_key_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values with equal sort keys, counted."""
    t = text(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    v = t.value("o_orderpriority")
    return t.df.groupBy(sort_key(v).alias("key")).agg(F.first(v).alias("value"), F.count("*").alias("n")).select("value", "n")
