"""Declared text tables derived from the given tables, in Spark and as SQL for the other engine.

Both sides render the same rows: what a delivery would hold as text, with a numbered record each.
"""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deklara.layout import DATE, NUMBER, Column, ForeignKey, Layout

ORDERS = Layout(
    "Orders",
    (
        Column("Order", primary_key=True),
        Column("Customer"),
        Column("Amount", NUMBER, accuracy=2),
        Column("Day", DATE),
        Column("Status"),
        Column("Priority", max_length=10),
    ),
    foreign_keys=(ForeignKey(("Customer",), "Customers"),),
)
SHORT_YEAR = Layout("OrdersShort", (Column("Order"), Column("Day", DATE, mask="DD.MM.YY")), epoch=98)
IMPLIED = Layout("OrdersImplied", (Column("Order"), Column("Amount", NUMBER, implied=2)))
TIMES = Layout("Events", (Column("Event"), Column("Time", maps=(("HHMMSS", "HHMMSS"),))))
# How the part table's six type words are presented.
WORDS = (("STANDARD", "Standard"), ("SMALL", "Klein"), ("MEDIUM", "Mittel"), ("LARGE", "Groß"), ("ECONOMY", "Sparsam"), ("PROMO", "Aktion"))
PARTS = Layout("Parts", (Column("Part"), Column("Name"), Column("Type", maps=WORDS), Column("Size", NUMBER, accuracy=0)))
DOCUMENTS = Layout("Documents", (Column("Document"), Column("Text", max_length=2000), Column("Language"), Column("Source")))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _amount(c: C) -> C:
    return F.translate(F.format_number(c.cast("decimal(18,2)"), 2), ",.", ".,")


def orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_orderkey") + 1).alias("_ordinal"),
        F.col("o_orderkey").cast("string").alias("c0"),
        F.col("o_custkey").cast("string").alias("c1"),
        _amount(F.col("o_totalprice")).alias("c2"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("c3"),
        F.col("o_orderstatus").alias("c4"),
        F.col("o_orderpriority").alias("c5"),
    )


ORDERS_SQL = r"""
orders_text as (
  select o_orderkey + 1 as _ordinal, o_orderkey::varchar as c0, o_custkey::varchar as c1,
    translate(format('{:,.2f}', o_totalprice::double), ',.', '.,') as c2,
    strftime(o_orderdate, '%d.%m.%Y') as c3, o_orderstatus as c4, o_orderpriority as c5
  from orders)"""

#: Typed columns of conforming orders: the amount, the day.
ORDERS_TYPED_SQL = (
    ORDERS_SQL
    + r""",
v as (
  select *, replace(replace(c2, '.', ''), ',', '.')::decimal(38, 2) as q2, strptime(c3, '%d.%m.%Y')::date as q3
  from orders_text)"""
)


def orders_defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c0").cast("bigint")
    amount = (
        F.when(k % 89 == 0, "").when(k % 97 == 0, "1.2.3").when(k % 101 == 0, F.concat("c2", F.lit("-")))
        .when(k % 103 == 0, F.concat("c2", F.lit("5"))).otherwise(F.col("c2"))
    )
    iso = F.concat_ws("-", F.substring("c3", 7, 4), F.substring("c3", 4, 2), F.substring("c3", 1, 2))
    day = F.when(k % 79 == 0, iso).when(k % 83 == 0, "31.02.1998").when(k % 61 == 0, "").otherwise(F.col("c3"))
    return orders_text(spark, sf_dir).withColumn("c2", amount).withColumn("c3", day)


DEFECTIVE_SQL = (
    ORDERS_SQL
    + r""",
d as (
  select _ordinal, c0, c1,
    case when c0::bigint % 89 = 0 then '' when c0::bigint % 97 = 0 then '1.2.3' when c0::bigint % 101 = 0 then c2 || '-'
      when c0::bigint % 103 = 0 then c2 || '5' else c2 end as c2,
    case when c0::bigint % 79 = 0 then substr(c3, 7, 4) || '-' || substr(c3, 4, 2) || '-' || substr(c3, 1, 2)
      when c0::bigint % 83 = 0 then '31.02.1998' when c0::bigint % 61 = 0 then '' else c3 end as c3,
    c4, c5
  from orders_text),
n as (
  select *, regexp_full_match(c2, '[+-]?([0-9]+|[0-9]{1,3}(\.[0-9]{3})+)(,[0-9]+)?|([0-9]+|[0-9]{1,3}(\.[0-9]{3})+)(,[0-9]+)?[+-]') as is_number,
    regexp_full_match(c3, '[0-9]{2}\.[0-9]{2}\.[0-9]{4}') and try_strptime(c3, '%d.%m.%Y') is not null as is_day
  from d),
f as (
  select '4001' as code, 'error' as severity, _ordinal, 2 as column_index, 'Amount' as "column", c2 as value, 'number' as expected from n where c2 <> '' and not is_number
  union all
  select '4002', 'error', _ordinal, 2, 'Amount', c2, '2' from n where is_number and regexp_full_match(c2, '.*,[0-9]{3,}[+-]?')
  union all
  select '4001', 'error', _ordinal, 3, 'Day', c3, 'DD.MM.YYYY' from n where c3 <> '' and not is_day
  union all
  select '4003', 'error', _ordinal, 5, 'Priority', c5, '10' from n where length(c5) > 10)"""
)


def orders_short_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_text(spark, sf_dir).select("_ordinal", "c0", F.concat(F.substring("c3", 1, 6), F.substring("c3", 9, 2)).alias("c1"))


def orders_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace("c2", "[.,]", "")
    sign = F.when(F.col("c0").cast("bigint") % 7 == 0, "-").otherwise("")
    return orders_text(spark, sf_dir).select("_ordinal", "c0", F.concat(bare, sign).alias("c1"))


def events_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 53 == 0, "keine Zeit").when(k % 59 == 0, "").otherwise(F.date_format("ts", "HHmmss"))
    return load(spark, sf_dir, "events").select((k + 1).alias("_ordinal"), k.cast("string").alias("c0"), text.alias("c1"))


EVENTS_SQL = r"""
e as (
  select event_id + 1 as _ordinal, event_id::varchar as c0,
    case when event_id % 53 = 0 then 'keine Zeit' when event_id % 59 = 0 then '' else strftime(ts, '%H%M%S') end as c1
  from events)"""


def part_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    size = F.when(k % 11 == 0, "").otherwise(F.col("p_size").cast("string"))
    return load(spark, sf_dir, "part").select((k + 1).alias("_ordinal"), k.cast("string").alias("c0"), F.col("p_name").alias("c1"), F.col("p_type").alias("c2"), size.alias("c3"))


PARTS_SQL = r"""
p as (
  select p_partkey + 1 as _ordinal, p_partkey::varchar as c0, p_name as c1, p_type as c2,
    case when p_partkey % 11 = 0 then '' else p_size::varchar end as c3,
    case p_type when 'STANDARD' then 'Standard' when 'SMALL' then 'Klein' when 'MEDIUM' then 'Mittel' when 'LARGE' then 'Groß'
      when 'ECONOMY' then 'Sparsam' when 'PROMO' then 'Aktion' else p_type end as q2
  from part)"""


def documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select((F.col("doc_id") + 1).alias("_ordinal"), F.col("doc_id").cast("string").alias("c0"), *(F.coalesce(c, F.lit("")).alias(f"c{i}") for i, c in ((1, "text"), (2, "lang"), (3, "source"))))


DOCUMENTS_SQL = r"""
t as (
  select doc_id + 1 as _ordinal, doc_id::varchar as c0, coalesce(text, '') as c1, coalesce(lang, '') as c2, coalesce(source, '') as c3
  from documents)"""


def customer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return c.select((F.col("c_custkey") + 1).alias("_ordinal"), F.col("c_custkey").cast("string").alias("c0"), F.col("c_name").alias("c1"))


def orders_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_text(spark, sf_dir).where("c4 = 'F'")


def lineitem_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers are empty where the order key divides by 17; records have no natural number, so they
    are known by the part they name, which repeats."""
    line = F.when(F.col("l_orderkey") % 17 == 0, "").otherwise(F.col("l_linenumber").cast("string"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("c0"), line.alias("c1"), (F.col("l_partkey") + 1).alias("_ordinal"))


LINES_SQL = r"""
l as (
  select l_orderkey::varchar as c0, case when l_orderkey % 17 = 0 then '' else l_linenumber::varchar end as c1, l_partkey + 1 as _ordinal
  from lineitem)"""


def orders_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c0").cast("bigint")
    customer = F.when(k % 13 == 0, "").when(k % 19 == 0, F.concat(F.lit("X"), F.col("c1"))).otherwise(F.col("c1"))
    return orders_text(spark, sf_dir).withColumn("c1", customer)


FK_SQL = (
    ORDERS_SQL
    + r""",
o as (
  select _ordinal, c0, case when c0::bigint % 13 = 0 then '' when c0::bigint % 19 = 0 then 'X' || c1 else c1 end as c1, c4
  from orders_text),
k as (select c_custkey + 1 as _ordinal, c_custkey::varchar as c0 from customer)"""
)
