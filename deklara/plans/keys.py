"""Queries over keys, conformance and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from deklara.functions import checks as K
from deklara.layout import Column, Layout
from deklara.operators import conformance as N
from deklara.operators import keys as J
from deklara.plans import fixtures as X
from deklara.plans.registry import query
from deklara.tables import written

# Keys


@query("agg_pk_duplicates", f"with {X.LINES_SQL} select c0 || '|' || c1 as key, count(*) as n, min(_ordinal) as first, string_agg(_ordinal::varchar, ', ' order by _ordinal) as records from l where c1 <> '' group by c0, c1 having count(*) > 1")
def agg_pk_duplicates(spark, sf_dir):
    return J.duplicates(X.lineitem_keys(spark, sf_dir), ["c0", "c1"])


@query(
    "agg_pk_duplicates_first",
    f"with {X.LINES_SQL} select row_number() over (order by first, c0, c1) as place, c0 || '|' || c1 as key, n, first, records from (select c0, c1, count(*) as n, min(_ordinal) as first, string_agg(_ordinal::varchar, ', ' order by _ordinal) as records from l where c1 <> '' group by c0, c1 having count(*) > 1) order by first, c0, c1 limit 50",
)
def agg_pk_duplicates_first(spark, sf_dir):
    """The bounded report: keys in order of their first records."""
    return J.first_duplicates(X.lineitem_keys(spark, sf_dir), ["c0", "c1"], 50)


LINES = Layout("Lines", (Column("Order", primary_key=True), Column("Line", primary_key=True)))
_KEY_CELLS = ("code", "severity", "table", "_ordinal", "value", "expected")


@query("check_pk_duplicate", f"with {X.LINES_SQL} select '5001' as code, 'error' as severity, 'Lines' as \"table\", min(_ordinal) as _ordinal, c0 || '|' || c1 as value, string_agg(_ordinal::varchar, ', ' order by _ordinal) as expected from l where c1 <> '' group by c0, c1 having count(*) > 1")
def check_pk_duplicate(spark, sf_dir):
    return N.duplicate_key_findings(X.lineitem_keys(spark, sf_dir), ["c0", "c1"], LINES).select(*_KEY_CELLS)


@query("check_pk_incomplete", f"with {X.LINES_SQL} select '5002' as code, 'error' as severity, 'Lines' as \"table\", _ordinal, c0 || '|' || c1 as value, '' as expected from l where c0 = '' or c1 = ''")
def check_pk_incomplete(spark, sf_dir):
    return N.incomplete_key_findings(X.lineitem_keys(spark, sf_dir), ["c0", "c1"], LINES).select(*_KEY_CELLS)


_LINES_FK = "select l_orderkey::varchar as c0, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by 1"


@query("check_fk_unresolved", f"with {X.LINES_SQL} select '5003' as code, 'error' as severity, 'Lines' as \"table\", _ordinal, c0 as value, 'Orders' as expected from l where c0 <> '' and c0 not in (select o_orderkey::varchar from orders where o_orderstatus = 'F')")
def check_fk_unresolved(spark, sf_dir):
    child = X.lineitem_keys(spark, sf_dir).select("c0", "_ordinal")
    return N.reference_findings(child, ["c0"], X.orders_partial(spark, sf_dir), ["c0"], LINES, "Orders").select(*_KEY_CELLS)


@query("join_fk_unresolved", _LINES_FK)
def join_fk_unresolved(spark, sf_dir):
    child = X.lineitem_keys(spark, sf_dir).select("c0", "_ordinal")
    return J.unresolved(child, ["c0"], X.orders_partial(spark, sf_dir), ["c0"]).groupBy("c0").agg(F.count("*").alias("n"))


_ABSENT = f"with {X.FK_SQL}, u as (select _ordinal, c1 from o where c1 <> '' and c1 not in (select c0 from k)) select _ordinal, c1 from u"


@query("join_fk_unresolved_span", _ABSENT + " where _ordinal between 1000 and 2000")
def join_fk_unresolved_span(spark, sf_dir):
    return J.unresolved_between(X.orders_fk(spark, sf_dir), ["c1"], X.customer_text(spark, sf_dir), ["c0"], 1000, 2000).select("_ordinal", "c1")


@query("join_fk_unresolved_among", _ABSENT + " where _ordinal in (select p_partkey + 1 from part where p_size < 10)")
def join_fk_unresolved_among(spark, sf_dir):
    among = X.load(spark, sf_dir, "part").where("p_size < 10").select((F.col("p_partkey") + 1).alias("_ordinal"))
    return J.unresolved_among(X.orders_fk(spark, sf_dir), ["c1"], X.customer_text(spark, sf_dir), ["c0"], among).select("_ordinal", "c1")


@query(
    "join_fk_composite",
    f"with {X.LINES_SQL}, r as (select distinct l_orderkey::varchar as a, l_linenumber::varchar as b from lineitem where l_returnflag = 'N') select c0, c1, count(*) as n from l where not exists (select 1 from r where r.a = l.c0 and r.b = l.c1) group by 1, 2",
)
def join_fk_composite(spark, sf_dir):
    """Partly empty keys are looked up and not found."""
    parent = X.load(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").cast("string").alias("a"), F.col("l_linenumber").cast("string").alias("b"))
    return J.unresolved(X.lineitem_keys(spark, sf_dir), ["c0", "c1"], parent, ["a", "b"]).groupBy("c0", "c1").agg(F.count("*").alias("n"))


@query("join_fk_alias", "select n_name as name, count(*) as n from nation join customer on c_nationkey = n_nationkey where n_regionkey not in (select r_regionkey from region where r_name like 'A%') group by 1")
def join_fk_alias(spark, sf_dir):
    """The child's column is named otherwise than the parent's: an alias tells which is meant."""
    from deklara.layout import ForeignKey

    link = ForeignKey(("home",), "Regions", (("home", "code"),))
    nation = X.load(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("home"), F.col("n_nationkey").alias("at"), F.col("n_name").alias("name"))
    region = X.load(spark, sf_dir, "region").where("r_name like 'A%'").select(F.col("r_regionkey").cast("string").alias("code"))
    lost = J.unresolved(nation, list(link.columns), region, list(link.parent_columns(("code",))))
    return lost.join(X.load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("at")), "at").groupBy("name").agg(F.count("*").alias("n"))


@query(
    "join_follow",
    f"with {X.FK_SQL} select o._ordinal, min(k._ordinal) as target, count(k._ordinal) as matches, case when c1 = '' then 'no reference' when count(k._ordinal) = 0 then 'unresolved' else 'positioned' end as kind from o left join k on k.c0 = o.c1 group by o._ordinal, c1",
)
def join_follow(spark, sf_dir):
    return J.follow(X.orders_fk(spark, sf_dir), ["c1"], X.customer_text(spark, sf_dir), ["c0"])


@query(
    "join_follow_back",
    f"with {X.FK_SQL}, g as (select c1, count(*) as matches, list(_ordinal order by _ordinal) as r from o where c1 <> '' group by 1) select k._ordinal, coalesce(matches, 0) as matches, r[least(3, matches)] as target from k left join g on g.c1 = k.c0",
)
def join_follow_back(spark, sf_dir):
    return J.follow_back(X.customer_text(spark, sf_dir), ["c0"], X.orders_fk(spark, sf_dir), ["c1"], 3)


@query("join_count_matching", f"with {X.FK_SQL} select k.c0, count(o._ordinal) as n from k left join o on o.c1 = k.c0 group by 1")
def join_count_matching(spark, sf_dir):
    wanted = X.customer_text(spark, sf_dir).select("c0")
    return J.count_matching(X.orders_fk(spark, sf_dir).withColumn("c0", F.col("c1")), ["c0"], wanted)


@query(
    "join_mark_cells",
    f"with {X.FK_SQL}, a as (select _ordinal, 'c1' as c from o where c1 <> '' and c1 not in (select c0 from k) union all select _ordinal, 'c4' from o where c4 not in ('O', 'F')) select _ordinal, string_agg(c, ',' order by c) as columns from a group by 1",
)
def join_mark_cells(spark, sf_dir):
    child = X.orders_fk(spark, sf_dir)
    states = X.orders_text(spark, sf_dir).where("c4 in ('O', 'F')").select(F.col("c4").alias("state"))
    return J.marks(child, [(["c1"], X.customer_text(spark, sf_dir), ["c0"]), (["c4"], states, ["state"])])


_CATALOG = (
    "<Table><URL>l</URL><Name>Lines</Name><VariableLength><VariablePrimaryKey><Name>Order</Name><AlphaNumeric/></VariablePrimaryKey><VariablePrimaryKey><Name>Line</Name><AlphaNumeric/></VariablePrimaryKey>"
    "<VariableColumn><Name>Part</Name><AlphaNumeric/></VariableColumn><VariableColumn><Name>Supplier</Name><AlphaNumeric/></VariableColumn>"
    "<ForeignKey><Name>Order</Name><References>Orders</References></ForeignKey><ForeignKey><Name>Part</Name><References>Parts</References><Alias><From>Part</From><To>Code</To></Alias></ForeignKey>"
    "<ForeignKey><Name>Supplier</Name><References>Suppliers</References></ForeignKey></VariableLength></Table>"
    + "".join(f"<Table><URL>{n}</URL><Name>{n}</Name><VariableLength><VariablePrimaryKey><Name>Code</Name><AlphaNumeric/></VariablePrimaryKey></VariableLength></Table>" for n in ("Orders", "Parts", "Suppliers"))
)


@query(
    "check_keys_together",
    "with l as (select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as _ordinal, l_orderkey::varchar as o, case when l_orderkey % 17 = 0 then '' else l_linenumber::varchar end as n,"
    " l_partkey::varchar as p, case when l_linenumber % 5 = 0 then '' else l_suppkey::varchar end as s from lineitem)"
    " select '5001' as code, o || '|' || n as value, 'Lines' as \"table\", '' as target, count(*) as n from l where n <> '' group by o, n having count(*) > 1"
    " union all select '5002', o || '|' || n, 'Lines', '', count(*) from l where n = '' group by o, n"
    " union all select '5003', o, 'Lines', 'Orders', count(*) from l where o not in (select o_orderkey::varchar from orders where o_orderstatus = 'F') group by o"
    " union all select '5003', p, 'Lines', 'Parts', count(*) from l where p not in (select p_partkey::varchar from part where p_size < 25) group by p"
    " union all select '5003', s, 'Lines', 'Suppliers', count(*) from l where s <> '' and s not in (select s_suppkey::varchar from supplier where s_suppkey % 3 <> 0) group by s",
)
def check_keys_together(spark, sf_dir):
    """A table with a primary key and three foreign keys, read once: all key values go through one aggregation."""
    from deklara.sources.catalog import catalog

    text = spark.createDataFrame([("d", f"<DataSet><Media><Name>M</Name>{_CATALOG}</Media></DataSet>")], "delivery string, value string")
    links = written(J.links(catalog(text)), "links")
    line = F.when(F.col("l_orderkey") % 17 == 0, "").otherwise(F.col("l_linenumber").cast("string"))
    supplier = F.when(F.col("l_linenumber") % 5 == 0, "").otherwise(F.col("l_suppkey").cast("string"))
    tables = {0: ("Lines", X.load(spark, sf_dir, "lineitem"), [F.col("l_orderkey").cast("string"), line, F.col("l_partkey").cast("string"), supplier])}
    for i, (name, rows, key) in enumerate((("Orders", X.load(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), "o_orderkey"), ("Parts", X.load(spark, sf_dir, "part").where("p_size < 25"), "p_partkey"), ("Suppliers", X.load(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0"), "s_suppkey")), 1):
        tables[i] = (name, rows, [F.col(key).cast("string")])
    values = []
    for i, (name, rows, own) in tables.items():
        records = rows.select(F.lit("d").alias("delivery"), F.lit(i).cast("bigint").alias("table_id"), F.lit(name).alias("table"), F.monotonically_increasing_id().alias("_ordinal"), *(c.alias(f"c{n}") for n, c in enumerate(own)))
        values.append(J.key_values(records, links, len(own)))
    found = N.key_value_findings(written(N.union(values), "keys"))
    repeated = F.when(F.col("code") == str(K.KEY_DUPLICATE), F.size(F.split("expected", ", "))).otherwise(1)
    target = F.when(F.col("code") == str(K.KEY_UNRESOLVED), F.col("expected")).otherwise("")
    return N.union(found).groupBy("code", "value", "table", target.alias("target")).agg(F.sum(repeated).alias("n"))


# Conformance

_COLS = 'code, severity, _ordinal, column_index, "column", value, expected'


def _findings(spark, sf_dir):
    return N.value_findings(X.orders_defective(spark, sf_dir), X.ORDERS)


def _shown(df, *more):
    return df.select("code", "severity", "_ordinal", "column_index", "column", "value", "expected", *more)


def _check(name, code, column):
    @query(name, f"with {X.DEFECTIVE_SQL} select {_COLS} from f where code = '{code}' and \"column\" = '{column}'")
    def run(spark, sf_dir):
        return _shown(_findings(spark, sf_dir).where((F.col("code") == str(code)) & (F.col("column") == column)))


_check("check_number", 4001, "Amount")
_check("check_date", 4001, "Day")
_check("check_accuracy", 4002, "Amount")


@query("check_max_length", f"with {X.DOCUMENTS_SQL} select _ordinal, length(c1) as length from t where length(c1) > 2000")
def check_max_length(spark, sf_dir):
    found = N.value_findings(X.documents_text(spark, sf_dir), X.DOCUMENTS).where(F.col("code") == str(K.TOO_LONG))
    return found.select("_ordinal", F.length("value").cast("bigint").alias("length"))


@query("check_minimal_quote", f"with {X.DEFECTIVE_SQL} select code, _ordinal, column_index, value, true as only from f")
def check_minimal_quote(spark, sf_dir):
    """Every finding's value against the record it was found in."""
    found = N.minimal_quotes(_findings(spark, sf_dir), X.orders_defective(spark, sf_dir), X.ORDERS)
    return found.select("code", "_ordinal", "column_index", "value", "only")


@query("check_order", f"with {X.DEFECTIVE_SQL} select code, _ordinal, column_index, row_number() over (order by _ordinal, column_index, code) as place from f")
def check_order(spark, sf_dir):
    from deklara.tables import numbered

    order = [F.col(c).asc() for c in N.ORDER]
    return numbered(_findings(spark, sf_dir), order, "place", 1).select("code", "_ordinal", "column_index", "place")


_BOUND = f"with {X.DEFECTIVE_SQL}, r as (select *, row_number() over (order by _ordinal, column_index, code) as place, count(*) over () as total from f) "
_NOTICE = "select '4008' as code, NULL as _ordinal, place from r where place = 51"


@query("finding_budget", _BOUND + "select code, _ordinal, place from r where place <= 50 union all " + _NOTICE)
def finding_budget(spark, sf_dir):
    return N.bounded(_findings(spark, sf_dir), 50).select("code", "_ordinal", "place")


@query("check_bound_notice", _BOUND + _NOTICE.replace("NULL as _ordinal, place", "'50' as expected"))
def check_bound_notice(spark, sf_dir):
    return N.bounded(_findings(spark, sf_dir), 50).where(F.col("code") == str(K.STOPPED)).select("code", "expected")


@query("topn_defects", _BOUND + "select code, _ordinal, column_index from r where place <= 51")
def topn_defects(spark, sf_dir):
    return N.first_defects(_findings(spark, sf_dir), 50).select("code", "_ordinal", "column_index")


_KEYS = ", u as (select '5003' as code, 'error' as severity, _ordinal, c1 as value from o2 where c1 <> '' and c1 not in (select c_custkey::varchar from customer))"
_O2 = ", o2 as (select o_orderkey + 1 as _ordinal, case when o_orderkey % 13 = 0 then '' when o_orderkey % 19 = 0 then 'X' || o_custkey::varchar else o_custkey::varchar end as c1 from orders)"
_UNION = f"with {X.DEFECTIVE_SQL}{_O2}{_KEYS}, a as (select code, severity, _ordinal, value, 'Orders' as \"table\" from f union all select code, severity, _ordinal, value, 'Orders' from u union all select '5004', 'warning', NULL, 'Archive', 'Orders') "


def _all_findings(spark, sf_dir):
    lost = J.unresolved(X.orders_fk(spark, sf_dir), ["c1"], X.customer_text(spark, sf_dir), ["c0"])
    keys = N.key_findings(lost, K.KEY_UNRESOLVED, X.ORDERS, "_ordinal", F.col("c1"))
    unchecked = spark.range(1).select(*N.finding(K.KEY_UNCHECKED, "Orders", 2, F.lit(None), value=F.lit("Archive")))
    return N.union([_findings(spark, sf_dir), keys, unchecked])


@query("union_findings", _UNION + "select code, severity, _ordinal, value from a")
def union_findings(spark, sf_dir):
    return _all_findings(spark, sf_dir).select("code", "severity", "_ordinal", "value")


@query("agg_report_counts", _UNION + "select count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, 0 as notes, 'not conformant' as verdict, false as clean from a")
def agg_report_counts(spark, sf_dir):
    return N.counts(_all_findings(spark, sf_dir))


@query("agg_exit_class", _UNION + "select case when count(*) filter (severity = 'error') > 0 then 2 else 0 end as exit_class from a")
def agg_exit_class(spark, sf_dir):
    return N.exit_class(_all_findings(spark, sf_dir))


_STATE = _UNION + ", s as (select 'Orders' as \"table\", (select count(*) from orders) as records, (select count(*) from a) as findings union all select 'Customers', (select count(*) from customer), 0) "


def _state(spark, sf_dir):
    sizes = X.orders_text(spark, sf_dir).agg(F.lit("Orders").alias("table"), F.count("*").alias("records")).unionAll(
        X.customer_text(spark, sf_dir).agg(F.lit("Customers").alias("table"), F.count("*").alias("records"))
    )
    return N.table_state(_all_findings(spark, sf_dir), sizes)


@query("agg_table_state", _STATE + "select *, findings = 0 as conforms, findings > 50 as truncated from s")
def agg_table_state(spark, sf_dir):
    return _state(spark, sf_dir)


@query("check_gate", _STATE + "select \"table\", records from s where findings = 0")
def check_gate(spark, sf_dir):
    """Tables without an import finding may be queried."""
    return _state(spark, sf_dir).where("conforms").select("table", "records")


def _links(spark, sf_dir):
    """Each part is a delivery whose one key refers to its brand's table; tables of a size over 40 are not ready,
    and those of a size that 7 divides have no key."""
    p = X.load(spark, sf_dir, "part")
    fks = p.select(F.col("p_partkey").alias("delivery"), F.lit(0).alias("table_id"), F.lit("Parts").alias("table"), F.lit("f").alias("fk"), F.col("p_brand").alias("parent"))
    tables = p.select(F.col("p_partkey").alias("delivery"), F.lit(1).alias("table_id"), F.col("p_brand").alias("table"), F.when(F.col("p_size") % 7 == 0, 0).otherwise(1).alias("pk_count"), (F.col("p_size") <= 40).alias("ready"))
    return fks, tables


@query("check_fk_unchecked", "select p_partkey as delivery, '5004' as code, 'warning' as severity, 'Parts' as \"table\", p_brand as value from part where p_size > 40 and p_size % 7 <> 0")
def check_fk_unchecked(spark, sf_dir):
    return N.unchecked_findings(*_links(spark, sf_dir)).select("delivery", "code", "severity", "table", "value")


@query("join_reference_unchecked", "select p_partkey as delivery, p_brand as parent, 'Parts' as \"table\", 'f' as fk from part where p_size > 40 and p_size % 7 <> 0")
def join_reference_unchecked(spark, sf_dir):
    """References into tables that could not be read."""
    return J.unchecked(*_links(spark, sf_dir)).select("delivery", "parent", "table", "fk")


@query("findings_by_table", _UNION + "select code, count(*) as n from a where \"table\" = 'Orders' group by 1")
def findings_by_table(spark, sf_dir):
    return _all_findings(spark, sf_dir).where("table = 'Orders'").groupBy("code").agg(F.count("*").alias("n"))


@query("findings_by_severity", _UNION + "select code, _ordinal from a where severity = 'error'")
def findings_by_severity(spark, sf_dir):
    return _all_findings(spark, sf_dir).where("severity = 'error'").select("code", "_ordinal")


_SORTED = _UNION + ", p as (select *, row_number() over (order by case severity when 'error' then 3 when 'warning' then 2 else 1 end desc, code, _ordinal nulls first, case code when '4001' then (select min(column_index) from f where f._ordinal = a._ordinal and f.value = a.value and f.code = a.code) else -1 end) as place from a) "


@query("sort_report", _SORTED + "select place, code, severity, _ordinal from p")
def sort_report(spark, sf_dir):
    return N.report_order(_all_findings(spark, sf_dir)).select("place", "code", "severity", "_ordinal")
