"""Queries over readings, filters, sorts, views and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deklara.functions import readings as R
from deklara.layout import DATE, NUMBER, TEXT, TIME, Column, Layout
from deklara.operators import conformance as N
from deklara.operators import figures as G
from deklara.operators import views as V
from deklara.operators.views import Filter, Sort
from deklara.plans import fixtures as X
from deklara.plans.registry import QUERIES, query

SF = tuple[SparkSession, str]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.query_view(X.orders_text(spark, sf_dir), X.ORDERS)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.query_view(X.part_text(spark, sf_dir), X.PARTS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.query_view(X.documents_text(spark, sf_dir), X.DOCUMENTS)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.query_view(X.events_time(spark, sf_dir), X.TIMES)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Typed columns as text, so that both engines show them alike."""
    return df.select("_ordinal", *(F.col(c).cast("string").alias(c) for c in columns))


# Readings


@query("read_number", f"with {X.ORDERS_TYPED_SQL} select _ordinal, q2::varchar as q2 from v")
def read_number(spark, sf_dir):
    return shown(orders(spark, sf_dir), "q2")


@query(
    "read_number_digits",
    f"with {X.DEFECTIVE_SQL} select _ordinal, case when is_number then replace(replace(trim(c2, '+-'), '.', ''), ',', '.') end as digits from n",
)
def read_number_digits(spark, sf_dir):
    c, column = F.col("c2"), X.ORDERS.columns[2]
    digits = F.when(c.rlike(R.number_pattern(X.ORDERS)), R.number_digits(c, X.ORDERS, column))
    return X.orders_defective(spark, sf_dir).select("_ordinal", digits.alias("digits"))


@query(
    "read_number_normalised",
    f"with {X.DEFECTIVE_SQL} select _ordinal, case when is_number then case when c2 like '%-' then '-' else '' end || replace(replace(trim(c2, '+-'), '.', ''), ',', '.') end as number from n",
)
def read_number_normalised(spark, sf_dir):
    return X.orders_defective(spark, sf_dir).select("_ordinal", R.normalised_number(F.col("c2"), X.ORDERS, X.ORDERS.columns[2]).alias("number"))


@query(
    "read_trailing_sign",
    f"with {X.DEFECTIVE_SQL} select count(*) filter (q < 0) as negative, sum(q)::varchar as total from (select (case when c2 like '%-' then -1 else 1 end * replace(replace(trim(c2, '-'), '.', ''), ',', '.')::decimal(18,3))::decimal(38,3) as q from n where is_number)",
)
def read_trailing_sign(spark, sf_dir):
    q = R.read_number(F.col("c2"), X.ORDERS, X.ORDERS.columns[2], 3)
    rows = X.orders_defective(spark, sf_dir).select(q.alias("q"))
    return rows.agg(F.count_if(F.col("q") < 0).alias("negative"), F.try_sum("q").cast("string").alias("total"))


@query(
    "read_implied_decimals",
    "select o_orderkey + 1 as _ordinal, (case when o_orderkey % 7 = 0 then -1 else 1 end * format('{:.2f}', o_totalprice::double)::decimal(18,2))::decimal(38,2)::varchar as q1 from orders",
)
def read_implied_decimals(spark, sf_dir):
    return shown(V.query_view(X.orders_implied(spark, sf_dir), X.IMPLIED), "q1")


@query("read_date", f"with {X.ORDERS_TYPED_SQL} select _ordinal, q3::varchar as q3 from v")
def read_date(spark, sf_dir):
    return shown(orders(spark, sf_dir), "q3")


@query(
    "read_date_short_year",
    "select o_orderkey + 1 as _ordinal, try_strptime(strftime(o_orderdate, '%d.%m.') || case when year(o_orderdate) % 100 < 98 then '20' else '19' end || strftime(o_orderdate, '%y'), '%d.%m.%Y')::date::varchar as q1 from orders",
)
def read_date_short_year(spark, sf_dir):
    """Years of two digits, leap days included: 29 February stays one in 2096, and is none in 2095 (no such value)."""
    return shown(V.query_view(X.orders_short_year(spark, sf_dir), X.SHORT_YEAR), "q1")


@query(
    "read_time",
    f"with {X.EVENTS_SQL} select _ordinal, strftime(try_strptime(c1, '%H%M%S'), '%H:%M:%S') as q1 from e",
)
def read_time(spark, sf_dir):
    return events(spark, sf_dir).select("_ordinal", F.when(F.col("q1").isNotNull(), R.time_text(F.col("q1"))).alias("q1"))


@query("read_mapped_text", f"with {X.PARTS_SQL} select _ordinal, q2 from p")
def read_mapped_text(spark, sf_dir):
    return parts(spark, sf_dir).select("_ordinal", "q2")


@query("read_absent", f"with {X.PARTS_SQL} select _ordinal, case when c3 <> '' then c3 end as q3, c3 as stored from p")
def read_absent(spark, sf_dir):
    return parts(spark, sf_dir).select("_ordinal", F.col("q3").cast("string").alias("q3"), F.col("c3").alias("stored"))


@query("query_view", f"with {X.ORDERS_TYPED_SQL} select _ordinal, c0, c1, c2, c3, c4, c5, c0 as q0, c1 as q1, q2::varchar as q2, q3::varchar as q3, c4 as q4, c5 as q5 from v")
def query_view(spark, sf_dir):
    return shown(orders(spark, sf_dir), *(f"{k}{i}" for k in "cq" for i in range(6)))


@query("column_capability", "select * from (values ('Order','text',NULL,0,NULL),('Customer','text',NULL,0,NULL),('Amount','number',3,0,NULL),('Day','date',NULL,0,NULL),('Status','text',NULL,0,NULL),('Priority','text',NULL,0,NULL)) t(\"column\", kind, scale, unreadable, limitation)")
def column_capability(spark, sf_dir):
    return G.capabilities(V.query_view(X.orders_defective(spark, sf_dir), X.ORDERS), X.ORDERS)


@query("limit_notices", f"with {X.EVENTS_SQL} select 'Time' as \"column\", 'unreadable values' as limitation, count(*) as unreadable from e where c1 = 'keine Zeit'")
def limit_notices(spark, sf_dir):
    return G.limit_notices(G.capabilities(events(spark, sf_dir), X.TIMES))


@query(
    "agg_measure",
    f"with {X.DEFECTIVE_SQL}, m as (select trim(replace(c2, '.', ''), '+-') as d from n where is_number), {X.EVENTS_SQL} select 'Amount' as \"column\", max(length(split_part(d, ',', 1))) as digits, max(length(split_part(d, ',', 2))) as decimals, 0 as unreadable from m"
    " union all select 'Time', 0, 0, count(*) from e where c1 = 'keine Zeit'",
)
def agg_measure(spark, sf_dir):
    """All number and time columns of each table in one pass."""
    amounts = G.measure(V.query_view(X.orders_defective(spark, sf_dir), X.ORDERS), X.ORDERS)
    return amounts.unionAll(G.measure(events(spark, sf_dir), X.TIMES))


_CLOCK = Layout("Clock", (Column("Event"), Column("Time", maps=(("HH:MM:SS TT", "HH:MM:SS TT"),))))


@query(
    "write_declared",
    f"with {X.ORDERS_SQL} select 'order' as kind, _ordinal, c2 as amount, c3 as at from orders_text"
    " union all select 'event', event_id + 1, NULL, strftime(ts, '%I:%M:%S %p') from events",
)
def write_declared(spark, sf_dir):
    """Amounts and days of orders, and the clock times of events in twelve hours, written as declared."""
    amount, day = X.ORDERS.columns[2:4]
    done = orders(spark, sf_dir).select(F.lit("order").alias("kind"), "_ordinal", R.write_declared(F.col("q2"), amount, X.ORDERS, 2).alias("amount"), R.write_declared(F.col("q3"), day, X.ORDERS).alias("at"))
    ts = X.load(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("_ordinal"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("q1"))
    clock = ts.select(F.lit("event").alias("kind"), "_ordinal", F.lit(None).cast("string").alias("amount"), R.write_declared(F.col("q1"), _CLOCK.columns[1], _CLOCK).alias("at"))
    return done.unionAll(clock)


@query(
    "read_bound",
    f"with {X.DEFECTIVE_SQL} select 'date' as kind, c3 as typed, coalesce((case when is_day then strptime(c3, '%d.%m.%Y')::date end)::varchar, '') as bound, c3 <> '' and not is_day as refused, 'DD.MM.YYYY' as expected from n"
    " union all select 'number', c2, case when is_number then case when c2 like '%-' or c2 like '-%' then '-' else '' end || replace(replace(trim(c2, '+-'), '.', ''), ',', '.') else '' end, c2 <> '' and not is_number, 'number decimal=, grouping=.' from n"
    " union all select 'text', c5, c5, false, 'text' from n"
    " union all select 'time', t, case when t in ('', 'keine Zeit') then '' else substr(t, 1, 2) || ':' || substr(t, 3, 2) || ':' || substr(t, 5, 2) end, t = 'keine Zeit', 'HHMMSS' from (select case when event_id % 53 = 0 then 'keine Zeit' when event_id % 59 = 0 then '' else strftime(ts, '%H%M%S') end as t from events)",
)
def read_bound(spark, sf_dir):
    """Each stored value taken as what a user typed for its column."""
    rows, times = X.orders_defective(spark, sf_dir), X.events_time(spark, sf_dir)
    found = []
    for table, layout, i, kind in ((rows, X.ORDERS, 3, "date"), (rows, X.ORDERS, 2, "number"), (rows, X.ORDERS, 5, "text"), (times, X.TIMES, 1, "time")):
        bound = R.read_bound(F.col(f"c{i}"), layout.columns[i], layout)
        found.append(table.select(F.lit(kind).alias("kind"), F.col(f"c{i}").alias("typed"), bound.alias("b")).select("kind", "typed", "b.*"))
    return N.union(found)


@query("page_columns", f"with {X.ORDERS_SQL} select c0, c2 from orders_text where _ordinal = 42")
def page_columns(spark, sf_dir):
    return X.orders_text(spark, sf_dir).where("_ordinal = 42").select("c0", "c2")


# Filters: (name, view, columns, filter, SQL view and condition)

_O, _P, _D, _E = (f"with {s} select _ordinal from {t} where " for s, t in ((X.ORDERS_TYPED_SQL, "v"), (X.PARTS_SQL, "p"), (X.DOCUMENTS_SQL, "t"), (X.EVENTS_SQL, "e")))
_FILTERS = [
    ("filter_eq", orders, X.ORDERS, [Filter(4, "eq", ("F",))], _O + "c4 = 'F'"),
    ("filter_ne", parts, X.PARTS, [Filter(3, "ne", ("7",))], _P + "c3 <> '' and c3::int <> 7"),
    ("filter_lt", orders, X.ORDERS, [Filter(2, "lt", ("1234.5",))], _O + "q2 < 1234.5"),
    ("filter_le", orders, X.ORDERS, [Filter(3, "le", ("1996-03-01",))], _O + "q3 <= date '1996-03-01'"),
    ("filter_gt", orders, X.ORDERS, [Filter(2, "gt", ("150000",))], _O + "q2 > 150000"),
    ("filter_ge", events, X.TIMES, [Filter(1, "ge", ("14:30:00",))], _E + "try_strptime(c1, '%H%M%S')::time >= time '14:30:00'"),
    ("filter_between", orders, X.ORDERS, [Filter(2, "between", ("1000", "50000")), Filter(3, "between", ("1997-01-01", None))], _O + "q2 between 1000 and 50000 and q3 >= date '1997-01-01'"),
    ("filter_contains", documents, X.DOCUMENTS, [Filter(1, "contains", ("tion",))], _D + "contains(c1, 'tion')"),
    ("filter_starts_with", parts, X.PARTS, [Filter(2, "starts_with", ("S",))], _P + "starts_with(q2, 'S')"),
    ("filter_ends_with", documents, X.DOCUMENTS, [Filter(1, "ends_with", (".",))], _D + "c1 like '%.'"),
    ("filter_matches", documents, X.DOCUMENTS, [Filter(1, "matches", ("T?e*.",))], _D + "regexp_full_match(c1, '(?s)T.e.*\\.')"),
    ("filter_one_of", orders, X.ORDERS, [Filter(4, "one_of", ("O", "P"))], _O + "c4 in ('O', 'P')"),
    ("filter_empty", parts, X.PARTS, [Filter(3, "empty")], _P + "c3 = ''"),
    ("filter_not_empty", events, X.TIMES, [Filter(1, "not_empty")], _E + "try_strptime(c1, '%H%M%S') is not null"),
    ("filter_ignore_case", documents, X.DOCUMENTS, [Filter(1, "contains", ("ÜBER",), True)], _D + "contains(lower(c1), lower('ÜBER'))"),
    ("filter_and", orders, X.ORDERS, [Filter(4, "eq", ("F",)), Filter(2, "gt", ("100000",)), Filter(5, "starts_with", ("1",))], _O + "c4 = 'F' and q2 > 100000 and c5 like '1%'"),
]


def _filter_query(name, view, layout, filters, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        return V.filtered(view(spark, sf_dir), layout, filters).select("_ordinal")


for _f in _FILTERS:
    _filter_query(*_f)


@query("filter_key_equals", f"with {X.ORDERS_SQL} select _ordinal, c0 from orders_text where c1 = '7' and c4 = 'F' order by _ordinal limit 5")
def filter_key_equals(spark, sf_dir):
    return V.key_equals(X.orders_text(spark, sf_dir), [1, 4], ["7", "F"], 5).select("_ordinal", "c0")


@query("filter_span", f"with {X.ORDERS_SQL} select _ordinal, c0 from orders_text where _ordinal between 101 and 900")
def filter_span(spark, sf_dir):
    return X.orders_text(spark, sf_dir).where(F.col("_ordinal").between(101, 900)).select("_ordinal", "c0")


@query("filter_ordinals", f"with {X.ORDERS_SQL} select _ordinal, c2 from orders_text where _ordinal in (select p_partkey + 1 from part where p_size = 7)")
def filter_ordinals(spark, sf_dir):
    wanted = X.load(spark, sf_dir, "part").where("p_size = 7").select((F.col("p_partkey") + 1).alias("_ordinal"))
    return X.orders_text(spark, sf_dir).join(wanted, "_ordinal", "left_semi").select("_ordinal", "c2")


# Sorts, views, pages


def _sorted_sql(cte: str, table: str, keys: str, where: str = "true", first: int = 0) -> str:
    return f"with {cte} select _ordinal, row_number() over (order by {keys}, _ordinal) - 1 + {first} as pos from {table} where {where}"


@query("sort_typed", _sorted_sql(X.PARTS_SQL, "p", "case when c3 <> '' then c3::int end desc nulls last"))
def sort_typed(spark, sf_dir):
    return V.view(parts(spark, sf_dir), X.PARTS, sorts=[Sort(3, True)]).select("_ordinal", "pos")


@query("sort_text_de", _sorted_sql(X.DOCUMENTS_SQL, "t", "c2 = '', c2 collate de desc, c1 collate de"))
def sort_text_de(spark, sf_dir):
    """By the whole text."""
    return V.view(V.query_view(X.documents_text(spark, sf_dir), X.DOCUMENTS), X.DOCUMENTS, sorts=[Sort(2, True), Sort(1)]).select("_ordinal", "pos")


@query("sort_multi", _sorted_sql(X.ORDERS_TYPED_SQL, "v", "c4 = '', c4 collate de, q3 desc, q2"))
def sort_multi(spark, sf_dir):
    return V.view(orders(spark, sf_dir), X.ORDERS, sorts=[Sort(4), Sort(3, True), Sort(2)]).select("_ordinal", "pos")


@query("sort_stable", _sorted_sql(X.ORDERS_TYPED_SQL, "v", "c4 collate de"))
def sort_stable(spark, sf_dir):
    return V.view(orders(spark, sf_dir), X.ORDERS, sorts=[Sort(4)]).select("_ordinal", "pos")


_RANGE = [Filter(3, "between", ("1996-01-01", "1998-12-31"))]
_RANGE_SQL = "q3 between date '1996-01-01' and date '1998-12-31'"


def _range_stored(spark, sf_dir):
    """Orders staged with their typed columns; those of three years sorted by amount."""
    return V.stored_view(V.stage(X.orders_text(spark, sf_dir), X.ORDERS), X.ORDERS, _RANGE, [Sort(2, True)])


def _range_view(spark, sf_dir):
    return _range_stored(spark, sf_dir).rows


@query("view_create", f"with {X.ORDERS_TYPED_SQL} select _ordinal, c0, c2, c3, row_number() over (order by q2 desc, _ordinal) - 1 as pos from v where {_RANGE_SQL}")
def view_create(spark, sf_dir):
    return _range_view(spark, sf_dir).select("_ordinal", "c0", "c2", "c3", "pos")


@query("view_position", _sorted_sql(X.ORDERS_TYPED_SQL, "v", "q2 desc", _RANGE_SQL))
def view_position(spark, sf_dir):
    return _range_view(spark, sf_dir).select("_ordinal", "pos")


@query("positions", f"with {X.ORDERS_TYPED_SQL} select row_number() over (order by q2 desc, _ordinal) as position, _ordinal as record from v where {_RANGE_SQL}")
def positions(spark, sf_dir):
    return _range_view(spark, sf_dir).select((F.col("pos") + 1).alias("position"), F.col("_ordinal").alias("record"))


@query("page_file_order", f"with {X.ORDERS_SQL} select _ordinal, c0, c1, c2 from orders_text where _ordinal between 513 and 1024")
def page_file_order(spark, sf_dir):
    """A page of the staged table: ordinals reach the scan, which skips files and row groups."""
    return V.page(V.stage(X.orders_text(spark, sf_dir), X.ORDERS), 513, 512, "_ordinal").select("_ordinal", "c0", "c1", "c2")


@query("page_view", f"select * from ({_sorted_sql(X.ORDERS_TYPED_SQL, 'v', 'q2 desc', _RANGE_SQL)}) where pos between 512 and 1023")
def page_view(spark, sf_dir):
    """A page of the stored view, from the files that its index names."""
    return _range_stored(spark, sf_dir).page(512, 512).select("_ordinal", "pos")


@query("position_in_view", f"with s as ({_sorted_sql(X.ORDERS_TYPED_SQL, 'v', 'q2 desc', _RANGE_SQL)}) select o_orderkey + 1 as _ordinal, coalesce(pos, -1) as pos from orders left join s on s._ordinal = o_orderkey + 1")
def position_in_view(spark, sf_dir):
    return V.position_in_view(_range_view(spark, sf_dir), X.orders_text(spark, sf_dir).select("_ordinal"))


@query(
    "query_lift_filter",
    f"with s as ({_sorted_sql(X.ORDERS_TYPED_SQL, 'v', 'q2 desc')}), h as ({_sorted_sql(X.ORDERS_TYPED_SQL, 'v', 'q2 desc', _RANGE_SQL)}) select _ordinal, pos from s where _ordinal not in (select _ordinal from h)",
)
def query_lift_filter(spark, sf_dir):
    table = orders(spark, sf_dir)
    seen = V.position_in_view(_range_view(spark, sf_dir), table.select("_ordinal"))
    return V.lifted(table, X.ORDERS, [Sort(2, True)], seen.where("pos = -1").select("_ordinal"))


@query("table_extent", "select min(o_orderkey) + 1 as first, count(*) as records, max(o_orderkey) - min(o_orderkey) + 1 = count(*) as contiguous from orders where o_orderstatus = 'F'")
def table_extent(spark, sf_dir):
    return V.extent(X.orders_partial(spark, sf_dir))


@query("agg_position_counts", "select count(*) filter (o_orderkey + 1 < 5000) as before, count(*) filter (o_orderkey + 1 = 5000) as there from orders where o_orderstatus = 'F'")
def agg_position_counts(spark, sf_dir):
    return V.position_counts(X.orders_partial(spark, sf_dir), 5000)


@query("agg_record_count", "select count(*) as records from lineitem")
def agg_record_count(spark, sf_dir):
    return X.lineitem_keys(spark, sf_dir).agg(F.count("*").alias("records"))


@query("agg_view_count", f"with {X.ORDERS_TYPED_SQL} select count(*) as records from v where {_RANGE_SQL}")
def agg_view_count(spark, sf_dir):
    return V.filtered(orders(spark, sf_dir), X.ORDERS, _RANGE).agg(F.count("*").alias("records"))


# Figures


def _figure_sql(rows: list[str], cte: str = X.ORDERS_TYPED_SQL) -> str:
    return f"with {cte} " + " union all ".join(rows)


def _row(column: int, figure: str, value: str, there: str = "true", table: str = "v") -> str:
    return f"select {column} as \"column\", '{figure}' as figure, ({value})::varchar as value, count(*) filter (not ({there})) as missing, count(*) filter ({there}) as counted, true as exact from {table}"


_SIZE = "case when c3 <> '' then c3::decimal(38,0) end"
_FIGURES = {
    "fig_count": (parts, X.PARTS, [(3, "count")], 0, _figure_sql([_row(3, "count", "count(*) filter (c3 <> '')", "c3 <> ''", "p")], X.PARTS_SQL)),
    "fig_missing": (parts, X.PARTS, [(3, "missing")], 0, _figure_sql([_row(3, "missing", "count(*) filter (c3 = '')", "c3 <> ''", "p")], X.PARTS_SQL)),
    "fig_distinct": (orders, X.ORDERS, [(2, "distinct")], 2, _figure_sql([_row(2, "distinct", "count(distinct q2)")])),
    "fig_sum": (orders, X.ORDERS, [(2, "sum")], 2, _figure_sql([_row(2, "sum", "sum(q2)")])),
    "fig_min": (orders, X.ORDERS, [(2, "min"), (3, "min")], 2, _figure_sql([_row(2, "min", "min(q2)"), _row(3, "min", "min(q3)")])),
    "fig_max": (orders, X.ORDERS, [(2, "max"), (3, "max")], 2, _figure_sql([_row(2, "max", "max(q2)"), _row(3, "max", "max(q3)")])),
    "fig_avg": (orders, X.ORDERS, [(2, "avg")], 2, _figure_sql([_row(2, "avg", "((2 * (sum(q2) * 100)::hugeint + count(*)) // (2 * count(*)))::decimal(38,2) / 100")]).replace("::varchar as value", "::decimal(38,2)::varchar as value")),
    "fig_multi": (
        parts, X.PARTS, [(3, f) for f in ("count", "distinct", "sum", "min", "max", "missing")] + [(2, "distinct")], 0,
        _figure_sql([*(_row(3, f, v, "c3 <> ''", "p") for f, v in (("count", "count(*) filter (c3 <> '')"), ("distinct", f"count(distinct {_SIZE})"), ("sum", f"sum({_SIZE})"), ("min", f"min({_SIZE})"), ("max", f"max({_SIZE})"), ("missing", "count(*) filter (c3 = '')"))), _row(2, "distinct", "count(distinct q2)", "true", "p")], X.PARTS_SQL),
    ),
}


def _figure_query(name, view, layout, wanted, scale, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        return G.figures(view(spark, sf_dir), layout, wanted, scale)


for _name, _f in _FIGURES.items():
    _figure_query(_name, *_f)


@query("fig_isolated", f"with {X.ORDERS_TYPED_SQL} select 'sum' as figure, NULL::varchar as value, false as exact union all select 'max', max(q2)::varchar, true from v")
def fig_isolated(spark, sf_dir):
    """A sum beyond 38 digits beside a figure that can be computed."""
    wide = orders(spark, sf_dir).withColumn("q2", F.lit("9" * 36 + ".99").cast("decimal(38,2)"))
    both = G.figures(wide, X.ORDERS, [(2, "sum")]).unionAll(G.figures(orders(spark, sf_dir), X.ORDERS, [(2, "max")]))
    return both.select("figure", "value", "exact")


# Functions that the readings use, on whole columns

_FUNCTIONS = {
    "fn_trim_chars": (lambda: F.btrim(F.concat(F.lit(" \t-"), F.col("c2"), F.lit("+\r\n ")), F.lit(" \t\r\n\f\v+-")), "c2"),
    "fn_replace": (lambda: F.replace(F.col("c2"), F.lit("."), F.lit("")), "replace(c2, '.', '')"),
    "fn_position": (lambda: F.instr("c2", ","), "position(',' in c2)::int"),
    "fn_length": (lambda: F.length("c5"), "length(c5)::int"),
    "fn_left_right_lpad": (lambda: F.concat(F.left("c0", F.lit(2)), F.lit("|"), F.right("c0", F.lit(2)), F.lit("|"), F.lpad("c0", 8, "0")), "left(c0, 2) || '|' || right(c0, 2) || '|' || lpad(c0, 8, '0')"),
    "fn_substr": (lambda: F.substring("c3", 4, 2), "substr(c3, 4, 2)"),
    "fn_split_part": (lambda: F.split_part(F.col("c2"), F.lit(","), F.lit(2)), "split_part(c2, ',', 2)"),
    "fn_regexp_full_match": (lambda: F.col("c2").rlike(R.whole(r"[0-9]{2}\.[0-9]{3},[0-9]{2}")), r"regexp_full_match(c2, '[0-9]{2}\.[0-9]{3},[0-9]{2}')"),
    "fn_make_date": (lambda: F.try_to_date(F.concat_ws("-", F.substring("c3", 7, 4), F.substring("c3", 4, 2), F.substring("c3", 1, 2)), "yyyy-MM-dd").cast("string"), "make_date(substr(c3, 7, 4)::int, substr(c3, 4, 2)::int, substr(c3, 1, 2)::int)::varchar"),
    "fn_try_strptime": (lambda: F.try_to_date(F.concat(F.lit("31"), F.substring("c3", 3, 8)), "dd.MM.yyyy").cast("string"), "try_strptime('31' || substr(c3, 3, 8), '%d.%m.%Y')::date::varchar"),
    "fn_cast": (lambda: F.col("c0").cast("int").cast("decimal(38,2)").cast("string"), "c0::int::decimal(38,2)::varchar"),
    "fn_case_coalesce": (lambda: F.coalesce(F.when(F.col("c4") == "F", F.col("c5")), F.col("c4")), "coalesce(case when c4 = 'F' then c5 end, c4)"),
    "fn_lower": (lambda: F.lower("c5"), "lower(c5)"),
    "fn_concat_ws": (lambda: F.concat_ws("|", "c0", "c1"), "concat_ws('|', c0, c1)"),
}


def _function_query(name, column, sql):
    @query(name, f"with {X.ORDERS_SQL} select _ordinal, {sql} as value from orders_text")
    def run(spark, sf_dir):
        return X.orders_text(spark, sf_dir).select("_ordinal", column().alias("value"))


for _name, (_column, _sql) in _FUNCTIONS.items():
    _function_query(_name, _column, _sql)


@query("fn_row_tuple", f"with {X.LINES_SQL} select count(*) as keys from (select distinct c0, c1 from l)")
def fn_row_tuple(spark, sf_dir):
    return X.lineitem_keys(spark, sf_dir).agg(F.count_distinct(F.struct("c0", "c1")).alias("keys"))


@query("fn_collate_de", "select doc_id, row_number() over (order by text collate de, doc_id) as place from documents")
def fn_collate_de(spark, sf_dir):
    """By the whole text."""
    from deklara.tables import numbered

    rows = X.load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    return numbered(rows, [F.collate("t", "de").asc(), F.col("doc_id").asc()], "place", 1).select("doc_id", "place")
