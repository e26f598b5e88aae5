"""Queries over catalogs: each customer is taken as a delivery whose declarations its key decides."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deklara.layout import Column, Layout
from deklara.operators import lint as L
from deklara.plans import fixtures as X
from deklara.plans.registry import query
from deklara.sources import scan as S

# One SQL text for each catalog table; Spark and the other engine read the same one, so that what is
# compared is the checks.  Two tables, 0 and 1: of some deliveries they are called the same, or one has no name.
_TABLES = """
select *, coalesce(name, url) as "table" from (
select k as delivery, 0 as table_id, case when k % 53 <> 0 then 'Kun' || case when k % 51 = 0 then '&' else 'd' end || 'en' end as name, case when k % 20 = 0 then repeat('y', 256 - k % 2) end as description,
  case k % 14 when 0 then 'data/../kunden.csv' when 1 then '/kunden.csv' when 2 then '../kunden.csv' when 3 then 'KUNDEN.csv' when 4 then 'fehlt.csv' when 5 then 'data/./up/../kunden.csv' when 6 then './kunden.csv' when 7 then 'C:kunden.csv'
    when 8 then 'a//../../b.csv' when 9 then 'file:kunden.csv' when 10 then '.' else 'kunden.csv' end as url,
  case when k % 13 = 0 then 0 else 1 end as pk_count, ',' as "decimal", case when k % 17 = 0 then ',' else '.' end as grouping, case when k % 34 = 0 then '' else ';' end as column_delimiter,
  case when k % 19 = 0 then ';' else 'CRLF' end as record_delimiter, case when k % 18 = 0 then ';' when k % 34 = 0 then '' else 'Q' end as encapsulator, case when k % 11 = 0 then '-3' when k % 11 = 1 then 'x' else '30' end as epoch,
  case when k % 23 = 0 then '0' else '1' end as range_from, 0 as medium_id, 'M1' as medium, false as fixed, case when k % 7 = 0 then 'DD.YY' when k % 7 = 1 then 'MM/DD/YYYY' end as validity_mask,
  case when k % 37 = 0 then '-1' end as skip_bytes, case when k % 41 = 0 then '+5' end as range_to, case when k % 43 = 0 then '' end as range_length, case when k % 47 = 0 then '0' when k % 35 = 0 then '18' else '20' end as record_length from d
union all select k, 1, case when k % 29 = 0 then 'Kunden' else 'Bestellungen' end, null, case when k % 31 = 0 then 'kunden.csv' else 'b.csv' end, 0, ',', '.', ';', 'CRLF', 'Q', '30', '1', 0, 'M1', false, null, null, null, null, null from d)"""


def _of_tables(rows: str) -> str:
    return f'select r.*, t."table" from ({rows}) r join tables t on t.delivery = r.delivery and t.table_id = r.table_id'


_SQL = {
    "columns": _of_tables("""
select k as delivery, 0 as table_id, 0 as pos, 'Code' as name, case when k % 5 = 0 then 'number' else 'text' end as kind, k % 13 <> 0 as is_pk, cast(null as varchar(99)) as mask, '1' as span_from, case when k % 9 = 0 then 'x' when k % 9 = 1 then '+8' else '8' end as span_to,
  case when k % 6 = 0 then 'HHMMSS' end as map_from, case when k % 6 = 0 then case when k % 12 = 0 then 'HHMM' else 'HHMMSS' end end as map_to, 'key' as description,
  case when k % 36 = 0 then 'two' else '2' end as accuracy, case when k % 38 = 0 then '-1' end as implied, case when k % 39 = 0 then '0' else '8' end as max_length from d
union all select k, 0, 1, case when k % 8 = 0 then 'Code' when k % 8 = 1 then 'Na<me' else 'Name' end, 'text', false, null, case when k % 4 = 0 then '7' when k % 4 = 1 then '12' else '9' end, '20', null, null, case when k % 10 = 0 then repeat('x', 256) else 'name' end, null, null, null from d
union all select k, 1, 0, 'Kunde', 'text', false, null, null, null, null, null, '', null, null, null from d
union all select k, 1, 1, 'Tag', 'date', false, case k % 6 when 0 then 'DD.MM.YYYY' when 1 then 'DD.MM' when 2 then 'YYYYMMDD' when 3 then 'DD.MM.YY' when 4 then 'DD.MM.YYYY YY' else 'DD MM YYYYx' end, null, null, null, null, '', null, null, null from d"""),
    "fks": _of_tables("select k as delivery, 1 as table_id, 0 as fk, case when k % 14 = 0 then 'Nirgends' when k % 14 = 11 then 'kunden.csv' else 'Kunden' end as parent from d"),
    "fk_columns": _of_tables("""
select k as delivery, 1 as table_id, 0 as fk, 1 as pos, case when k % 15 = 0 then 'Fremd' else 'Kunde' end as name from d
union all select k, 1, 0, 2, 'Tag' from d where k % 16 = 0"""),
    "aliases": _of_tables("""
select k as delivery, 1 as table_id, 0 as fk, 0 as pos, case when k % 21 = 0 then 'Niemand' else 'Kunde' end as source, case when k % 22 = 0 then 'Name' else 'Code' end as target from d where k % 2 = 0
union all select k, 1, 0, 1, 'Tag', 'Code' from d where k % 24 = 0 union all select k, 1, 0, 2, 'Tag', 'Code' from d where k % 48 = 0"""),
    "media": "select k as delivery, 0 as medium_id, 'M1' as medium, false as accepted from d union all select k, 1, case when k % 2 = 0 then 'M1' else 'M2' end, k % 4 < 2 from d where k % 25 < 2",
    "entries": """
select k as delivery, 'kunden.csv' as name from d union all select k, 'b.csv' from d
union all select k, case when k % 26 = 0 then 'deep/index.xml' else 'index.xml' end from d where k % 27 <> 0
union all select k, case when k % 3 = 0 then '/kunden.csv' else 'B.csv' end from d where k % 28 = 0 union all select k, 'plan.bin' from d where k % 3 = 0""",
    "extensions": "select k as delivery, 'Plan' || k % 3 as name, case when k % 4 = 0 then '../plan.bin' else 'x/../plan.bin' end as url from d where k % 5 = 1",
    "commands": "select k as delivery, 'format c' as name from d where k % 33 = 0",
}


def catalog(spark, sf_dir) -> dict[str, DataFrame]:
    d = X.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    spoken = lambda sql: sql.replace('"table"', "`table`").replace('"decimal"', "`decimal`")
    head = f"with d as (select * from {{d}}), tables as ({spoken(_TABLES)}) "
    return {n: spark.sql(head + spoken(sql), d=d) for n, sql in {"tables": "select * from tables", **_SQL}.items()}


_T = '"table"'
# What the checks share: what a reference names, columns of keys, what a key's columns map to, locations without dots.
_CTE = (
    "with d as (select c_custkey as k from customer), tables as (" + _TABLES + "), " + ", ".join(f"{n} as ({s})" for n, s in _SQL.items())
    + f""",
found as (select f.*, (select count(*) from tables t where t.delivery = f.delivery and t.{_T} = f.parent) as matches from fks f),
one as (select f.*, t.table_id as parent_id, t.pk_count as parent_keys from found f join tables t on t.delivery = f.delivery and t.{_T} = f.parent where matches = 1),
width as (select delivery, table_id, fk, count(*) as width from fk_columns group by 1, 2, 3),
pk as (select delivery, table_id, name, row_number() over (partition by delivery, table_id order by pos) as at from columns where is_pk),
al as (select delivery, table_id, fk, source, arg_min(target, pos) as target from aliases group by 1, 2, 3, 4),
mapped as (
  select f.delivery, f.{_T}, f.table_id, f.name, o.parent_id, coalesce(al.target, pk.name) as target from fk_columns f join one o using (delivery, table_id, fk)
  left join al on al.delivery = f.delivery and al.table_id = f.table_id and al.fk = f.fk and al.source = f.name
  left join pk on pk.delivery = f.delivery and pk.table_id = o.parent_id and pk.at = f.pos),
kinds as (select delivery, table_id, name, arg_min(kind, pos) as kind from columns group by 1, 2, 3),
located as (
  select *, regexp_matches(url, '^(/|\\\\|[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]+:)') as absolute,
    list_reduce(list_prepend('', string_split(replace(url, '\\', '/'), '/')), lambda a, s: case when a = '!' then '!' when s in ('', '.') then a when s = '..' then case when a = '' then '!' else regexp_replace(a, '/?[^/]*$', '') end when a = '' then s else a || '/' || s end) as path
  from (select delivery, {_T}, url, 'table' as of, '' as name from tables union all select delivery, '', url, 'extension', name from extensions)),
named as (select distinct delivery, ltrim(replace(name, '\\', '/'), '/') as path from entries),
missing as (select * from located l where of = 'table' and not absolute and path not in ('', '!') and not exists (select 1 from named n where n.delivery = l.delivery and n.path = l.path)),
s as (
  select delivery, table_id, {_T}, name, span_from::int as a, span_to::int as b, lag(span_to::int) over (partition by delivery, table_id order by span_from::int, span_to::int) as before
  from columns where regexp_full_match(span_from, '[0-9]+') and regexp_full_match(span_to, '[0-9]+'))
"""
)


def _out(code, severity, subject, rest, table=_T):
    severity = severity if severity.startswith("case") else f"'{severity}'"
    return f"select delivery, {table} as {_T}, '{code}' as code, {severity} as severity, {subject} as subject from {rest}"


def _mask(c):
    count = lambda p: f"len(regexp_extract_all({c}, '{p}'))"
    return f"({count('YYYY|YY')} = 1 and {count('MM')} = 1 and {count('DD')} = 1 and not regexp_matches(regexp_replace({c}, 'YYYY|YY|MM|DD', '', 'g'), '[A-Za-z0-9]'))"


def _bad(c, least):
    return f"{c} is not null and not coalesce(regexp_full_match({c}, '[0-9]+') and try_cast({c} as int) >= {least}, false)"


_TIMES = "'^HH[^A-Za-z0-9]?MM([^A-Za-z0-9]?SS)?([^A-Za-z0-9]?TT)?$'"
_LINTS = {
    "lint_fk_column": (lambda c: L.fk_column(c["fk_columns"], c["columns"]), [_out(3001, "error", "name", "fk_columns f where not exists (select 1 from columns c where c.delivery = f.delivery and c.table_id = f.table_id and c.name = f.name)")]),
    "lint_reference": (lambda c: L.references(c["fks"], c["tables"]), [_out(3002, "error", "parent", "found where matches = 0"), _out(3003, "error", "parent", "found where matches > 1")]),
    "lint_parent_pk": (lambda c: L.parent_key(c["fks"], c["tables"]), [_out(3004, "error", "parent", "one where parent_keys = 0")]),
    "lint_fk_arity": (lambda c: L.arity(c["fks"], c["fk_columns"], c["tables"]), [_out(3005, "error", "fk::varchar", "one join width using (delivery, table_id, fk) where parent_keys > 0 and width <> parent_keys")]),
    "lint_fk_datatype": (
        lambda c: L.datatype(c["fks"], c["fk_columns"], c["aliases"], c["columns"], c["tables"]),
        [_out(3006, "error", "name", f"(select m.delivery, m.{_T}, m.name from mapped m join kinds a on a.delivery = m.delivery and a.table_id = m.table_id and a.name = m.name join kinds b on b.delivery = m.delivery and b.table_id = m.parent_id and b.name = m.target where a.kind <> b.kind)")],
    ),
    "lint_alias": (
        lambda c: L.alias(c["aliases"], c["fks"], c["fk_columns"], c["columns"], c["tables"]),
        [
            _out(3007, "error", "source", "aliases a where not exists (select 1 from fk_columns f where f.delivery = a.delivery and f.table_id = a.table_id and f.fk = a.fk and f.name = a.source)"),
            _out(3008, "error", "target", f"(select a.* from aliases a join one o using (delivery, table_id, fk) where not exists (select 1 from pk where pk.delivery = a.delivery and pk.table_id = o.parent_id and pk.name = a.target))"),
            _out(3009, "error", "target", "aliases a where exists (select 1 from aliases b where b.delivery = a.delivery and b.table_id = a.table_id and b.fk = a.fk and b.target = a.target and b.pos < a.pos)"),
            _out(3010, "warning", "fk::varchar", f"(select a.delivery, a.{_T}, a.table_id, a.fk, count(distinct a.source) as n from aliases a join fk_columns f on f.delivery = a.delivery and f.table_id = a.table_id and f.fk = a.fk and f.name = a.source group by all) join width using (delivery, table_id, fk) where width > 1 and n < width"),
        ],
    ),
    "lint_map": (
        lambda c: L.maps(c["columns"]),
        [_out(3011, "warning", "name", f"columns where kind = 'text' and map_from <> map_to and regexp_matches(map_from, {_TIMES}) and regexp_matches(map_to, {_TIMES})"), _out(3012, "error", "name", "columns where map_from is not null and kind <> 'text'")],
    ),
    "lint_media": (
        lambda c: L.empty_media(c["media"], c["tables"]),
        [_out(code, level, "medium", f"media m where {mark} accepted and not exists (select 1 from tables t where t.delivery = m.delivery and t.medium_id = m.medium_id)", "''") for code, level, mark in ((3013, "warning", "not"), (3014, "info", ""))],
    ),
    "lint_span": (
        lambda c: L.spans(c["columns"], c["tables"]),
        [
            _out(3015, "error", "name", "columns where span_from is not null and not coalesce(regexp_full_match(span_from, '[0-9]+') and regexp_full_match(span_to, '[0-9]+') and try_cast(span_from as int) between 1 and try_cast(span_to as int), false)"),
            _out(3016, "warning", "name", "s where a <= before"), _out(3017, "info", "name", "s where a > before + 1"),
            _out(3018, "error", "name", f"(select s.*, t.record_length from s join tables t using (delivery, table_id)) where record_length::int > 0 and b > record_length::int"),
        ],
    ),
    "lint_span_neighbours": (lambda c: L.spans(c["columns"], c["tables"]).where("code in ('3016', '3017')"), [_out(3016, "warning", "name", "s where a <= before"), _out(3017, "info", "name", "s where a > before + 1")]),
    "lint_scalar": (
        lambda c: L.scalars(c["tables"], c["columns"]),
        [
            *(_out(3019, "error", f"'{element}'", f"tables where {_bad(c, least)}") for element, c, least in (("SkipNumBytes", "skip_bytes", 0), ("Epoch", "epoch", 0), ("Range/To", "range_to", 0), ("Range/Length", "range_length", 0), ("Length", "record_length", 1))),
            *(_out(3019, "error", f"name || '/{element}'", f"columns where {_bad(c, least)}") for element, c, least in (("Accuracy", "accuracy", 0), ("ImpliedAccuracy", "implied", 0), ("MaxLength", "max_length", 1))),
            _out(3023, "error", _T, f"tables where {_bad('range_from', 1)}"),
        ],
    ),
    "lint_symbols": (
        lambda c: L.symbols(c["tables"]),
        [_out(3020, "error", _T, "tables where \"decimal\" = grouping"), *(_out(3021, "error", _T, f"tables where column_delimiter <> '' and column_delimiter = {other}") for other in ("record_delimiter", "encapsulator"))],
    ),
    "lint_date_mask": (
        lambda c: L.date_masks(c["columns"], c["tables"]),
        [_out(3022, "error", "name", f"columns where kind = 'date' and not {_mask('mask')}"), _out(3022, "error", "'Validity'", f"tables where validity_mask is not null and not {_mask('validity_mask')}")],
    ),
    "lint_identity": (
        lambda c: L.identity(c["tables"], c["columns"], c["fks"]),
        [
            _out(3024, "case when exists (select 1 from fks f where f.delivery = t.delivery and f.parent = t.name) then 'error' else 'warning' end", "name", "(select delivery, name from tables where name is not null group by 1, 2 having count(*) > 1) t", "''"),
            _out(3025, "warning", "url", "(select delivery, url from tables group by 1, 2 having count(*) > 1)", "''"),
            _out(3026, "error", "name", f"(select delivery, {_T}, table_id, name from columns group by all having count(*) > 1)"),
        ],
    ),
    "lint_naming": (
        lambda c: L.naming(c["columns"], c["tables"]),
        [out for rows, of in (("columns", "name"), ("tables", _T)) for out in (_out(3027, "warning", "name", f"{rows} where regexp_matches(name, '[\"&<>]')"), _out(3028, "info", of, f"{rows} where length(description) > 255"))],
    ),
    "lint_command": (lambda c: L.commands(c["commands"]), [_out(3029, "warning", "name", "commands", "''")]),
    "lint_extension": (
        lambda c: L.extensions(c["extensions"], c["entries"]),
        [_out(3030, "info", "name", "extensions", "''"), _out(3031, "error", "name", "located l where of = 'extension' and (absolute or not exists (select 1 from named n where n.delivery = l.delivery and n.path = l.path))", "''")],
    ),
    "lint_file_presence": (
        lambda c: L.file_presence(c["tables"], c["entries"]),
        [
            _out(1003, "error", "url", "missing m where not exists (select 1 from named n where n.delivery = m.delivery and lower(n.path) = lower(m.path))"),
            _out(1004, "error", "url", "located where of = 'table' and absolute"), _out(1005, "error", "url", "located where of = 'table' and not absolute and path in ('', '!')"),
            _out(1006, "warning", "url", "missing m where exists (select 1 from named n where n.delivery = m.delivery and lower(n.path) = lower(m.path))"),
        ],
    ),
    "lint_entry_collision": (lambda c: L.entry_collision(c["entries"]), [_out(1007, "error", "path", "(select delivery, ltrim(replace(name, '\\', '/'), '/') as path from entries group by 1, 2 having count(*) > 1)", "''")]),
    "lint_index_presence": (
        lambda c: L.index_presence(c["entries"]),
        [_out(code, "error", "'index.xml'", f"(select delivery from entries group by 1 having count(*) filter (name = 'index.xml') = 0 and count(*) filter (ends_with(name, '/index.xml')) {test})", "''") for code, test in ((1001, "= 0"), (1002, "> 0"))],
    ),
}
def _lint(name, check, parts):
    @query(name, _CTE + " union all ".join(parts))
    def run(spark, sf_dir):
        return check(catalog(spark, sf_dir))


for _name, (_check, _parts) in _LINTS.items():
    _lint(_name, _check, _parts)


@query(
    "join_relationships",
    _CTE + f" select delivery, {_T}, table_id, coalesce((select string_agg(distinct parent, ',' order by parent) from fks f where f.delivery = n.delivery and f.table_id = n.table_id), '') as refers_to,"
    f" coalesce((select string_agg(distinct o.{_T}, ',' order by o.{_T}) from one o where o.delivery = n.delivery and o.parent_id = n.table_id), '') as referred_by from tables n",
)
def join_relationships(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return L.relationships(c["tables"], c["fks"])


@query("catalog_tree", _CTE + f" select delivery, medium_id, medium, string_agg({_T}, ',' order by table_id) as tables from tables group by 1, 2, 3")
def catalog_tree(spark, sf_dir):
    return L.tree(catalog(spark, sf_dir)["tables"])


_LAYOUTS = {
    "no format": replace(X.ORDERS, columns=()),
    "codepage": replace(X.ORDERS, codepage="UTF7"),
    "empty delimiter": replace(X.ORDERS, column_delimiter=""),
    "zero length": replace(X.ORDERS, record_length=0, record_delimiter=""),
    "bad span": Layout("Fixed", (Column("A", start=3, end=1),), record_length=9),
}


@query("layout_usable", "select p_type as kind, case p_size % 6 when 0 then 'no format' when 1 then 'codepage' when 2 then 'empty delimiter' when 3 then 'zero length' when 4 then 'bad span' end as reason, count(*) as n from part group by 1, 2")
def layout_usable(spark, sf_dir):
    """Parts stand for tables; their size decides which declaration they have."""
    reasons = [S.unusable(layout) for layout in (*_LAYOUTS.values(), X.ORDERS)]
    named = F.element_at(F.array(*map(F.lit, reasons)), (F.col("p_size") % 6 + 1).cast("int"))
    return X.load(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind"), named.alias("reason")).agg(F.count("*").alias("n"))


def _tag(name, *inner):
    return F.concat(F.lit(f"<{name}>"), *(i if not isinstance(i, str) else F.lit(i) for i in inner), F.lit(f"</{name}>"))


@query(
    "load_catalog",
    "select c_custkey as delivery, 'M' as medium, n.table_id, case when n.table_id = 0 or c_custkey % 4 = 0 then 'T' || c_custkey else 'more/' || c_custkey || '.txt' end as \"table\", case when n.table_id = 0 then 'data/' || c_custkey || '.csv' else 'more/' || c_custkey || '.txt' end as url,"
    " n.table_id = 1 as fixed, 1 - n.table_id as pk_count, case when n.table_id = 0 and c_custkey % 2 = 0 then 'UTF8' end as codepage,"
    " case when n.table_id = 0 and c_custkey % 3 = 0 then '.' end as \"decimal\", case when n.table_id = 0 then c_nationkey::varchar end as skip_bytes, case when n.table_id = 0 then '2' end as range_from, case when n.table_id = 1 then 'YY' end as validity_mask, n.\"column\","
    " n.name, n.kind, n.is_pk, n.setting, n.span_to, case when n.pos = 1 then 'B:K' end as map, case when n.pos = 0 then case when c_custkey % 3 = 0 then 'P' || c_nationkey else 'T' || c_custkey end end as parent, case when n.pos = 0 then 'Home' end as target,"
    " case when n.pos = 0 then case when c_custkey % 3 = 0 then 0 when c_custkey % 4 = 0 then 2 else 1 end end as matches, case when n.pos = 0 and c_custkey % 3 <> 0 and c_custkey % 4 <> 0 then 0 end as parent_id, case when c_custkey % 5 = 0 then 'X:plan.bin' end as extension"
    " from customer, lateral (select 0 as pos, 0 as table_id, 'c0' as \"column\", 'Code' as name, 'text' as kind, true as is_pk, '8' as setting, NULL as span_to union all select 1, 0, 'c1', c_mktsegment, 'text', false, NULL, NULL"
    " union all select 2, 0, 'c2', 'Amount', 'number', false, (c_custkey % 5)::varchar, NULL union all select 3, 0, 'c3', 'Day', 'date', false, case when c_custkey % 7 = 0 then 'YYYYMMDD' else 'DD.MM.YYYY' end, NULL"
    " union all select 4, 1, 'c0', 'Code', 'number', false, '0', case when c_custkey % 6 = 0 then '9' else '4' end) n",
)
def load_catalog(spark, sf_dir):
    """Descriptions as XML, one for each customer, written, read back, and joined into one row for each column.  Every
    description has two tables; in a quarter of them both have one name, and each keeps its own columns."""
    from deklara.sources.catalog import catalog as read
    from deklara.tables import scratch

    c = X.load(spark, sf_dir, "customer")
    number = F.col("c_custkey")
    key, nation = number.cast("string"), F.col("c_nationkey").cast("string")
    mask = F.when(number % 7 == 0, "<Date><Format>YYYYMMDD</Format></Date>").otherwise("<Date/>")
    columns = [
        _tag("VariablePrimaryKey", "<Name>Code</Name><AlphaNumeric/><MaxLength>8</MaxLength>"),
        _tag("VariableColumn", _tag("Name", F.col("c_mktsegment")), "<AlphaNumeric/><Map><From>B</From><To>K</To></Map>"),
        _tag("VariableColumn", "<Name>Amount</Name>", _tag("Numeric", _tag("Accuracy", (number % 5).cast("string")))),
        _tag("VariableColumn", "<Name>Day</Name>", mask),
        _tag("ForeignKey", "<Name>Code</Name>", _tag("References", F.when(number % 3 == 0, F.concat(F.lit("P"), nation)).otherwise(F.concat(F.lit("T"), key))), "<Alias><From>Code</From><To>Home</To></Alias>"),
    ]
    first = [
        _tag("URL", "data/", key, ".csv"), _tag("Name", "T", key), F.when(number % 2 == 0, "<UTF8/>").otherwise(""),
        F.when(number % 3 == 0, "<DecimalSymbol>.</DecimalSymbol>").otherwise(""), _tag("SkipNumBytes", nation), "<Range><From>2</From></Range>", _tag("VariableLength", *columns),
    ]
    span = F.when(number % 6 == 0, "<From>1</From><To>9</To>").otherwise("<From>1</From><Length>4</Length>")
    second = [
        _tag("URL", "more/", key, ".txt"), F.when(number % 4 == 0, _tag("Name", "T", key)).otherwise(""), "<Validity><Range><From>1</From></Range><Format>YY</Format></Validity>",
        _tag("FixedLength", "<Length>9</Length>", _tag("FixedColumn", "<Name>Code</Name><Numeric><Accuracy>0</Accuracy></Numeric>", _tag("FixedRange", span))),
    ]
    more = F.when(number % 5 == 0, "<Extension><Name>X</Name><URL>plan.bin</URL></Extension>").otherwise("")
    xml = _tag("DataSet", more, "<Version>1</Version>", _tag("Media", "<Name>M</Name>", _tag("Table", *first), _tag("Table", *second)))
    path = scratch(spark, "catalog")
    c.select(number.alias("delivery"), xml.alias("value")).write.parquet(path)
    found = read(spark.read.parquet(path))
    at = ["delivery", "table_id"]
    tables = found["tables"].select(*at, "table", "medium", "url", "fixed", "pk_count", "codepage", "decimal", "skip_bytes", "range_from", "validity_mask")
    maps = found["maps"].select(*at, "name", F.concat_ws(":", "map_from", "map_to").alias("map"))
    links = found["fk_columns"].join(L.resolved(found["fks"], found["tables"]).drop("table"), [*at, "fk"]).join(found["aliases"].select(*at, "fk", F.col("source").alias("name"), "target"), [*at, "fk", "name"])
    setting = F.coalesce("max_length", "accuracy", "mask")
    rows = found["columns"].select(*at, F.concat(F.lit("c"), F.col("pos").cast("string")).alias("column"), "name", "kind", "is_pk", setting.alias("setting"), "span_to")
    rows = rows.join(tables, at).join(maps, [*at, "name"], "left").join(links.select(*at, "name", "parent", "target", "matches", "parent_id"), [*at, "name"], "left")
    named = found["extensions"].select("delivery", F.concat_ws(":", "name", "url").alias("extension"))
    return rows.join(named, "delivery", "left")


@query("check_table_unreadable", "select '4011' as code, 'error' as severity, p_partkey::varchar as \"table\", p_name as value, case p_size % 6 when 0 then 'no format' when 1 then 'codepage' when 2 then 'empty delimiter' when 3 then 'zero length' else 'bad span' end as expected from part where p_size % 6 <> 5")
def check_table_unreadable(spark, sf_dir):
    """Each part is a table; its size decides which declaration it has."""
    from deklara.operators import conformance as N

    reasons = [S.unusable(layout) for layout in (*_LAYOUTS.values(), X.ORDERS)]
    named = F.element_at(F.array(*map(F.lit, reasons)), (F.col("p_size") % 6 + 1).cast("int"))
    tables = X.load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("table"), F.col("p_name").alias("url"), named.alias("reason"))
    return N.unreadable_findings(tables).select("code", "severity", "table", "value", "expected")


_DELIVERY = """<?xml version="1.0" encoding="utf-8"?>
<DataSet><Version>1.0</Version><Media><Name>M1</Name>
<Table><URL>customers.csv</URL><Name>Customers</Name><UTF8/><VariableLength>
<VariablePrimaryKey><Name>Code</Name><AlphaNumeric/></VariablePrimaryKey><VariableColumn><Name>Name</Name><AlphaNumeric/></VariableColumn></VariableLength></Table>
<Table><URL>orders.csv</URL><Name>Orders</Name><UTF8/><VariableLength>
<VariablePrimaryKey><Name>Order</Name><AlphaNumeric/></VariablePrimaryKey><VariableColumn><Name>Customer</Name><AlphaNumeric/></VariableColumn>
<VariableColumn><Name>Amount</Name><Numeric><Accuracy>2</Accuracy></Numeric></VariableColumn><VariableColumn><Name>Day</Name><Date/></VariableColumn>
<VariableColumn><Name>Status</Name><AlphaNumeric/></VariableColumn><VariableColumn><Name>Priority</Name><AlphaNumeric/><MaxLength>10</MaxLength></VariableColumn>
<ForeignKey><Name>Customer</Name><References>Customers</References></ForeignKey></VariableLength></Table>
<Table><URL>regions-old.csv</URL><Name>Regions</Name><UTF8/><VariableLength>
<VariablePrimaryKey><Name>Code</Name><Numeric/></VariablePrimaryKey><VariableColumn><Name>Name</Name><AlphaNumeric/></VariableColumn></VariableLength></Table>
<Table><URL>regions.csv</URL><Name>Regions</Name><UTF8/><VariableLength>
<VariablePrimaryKey><Name>Code</Name><AlphaNumeric/></VariablePrimaryKey><VariableColumn><Name>Name</Name><AlphaNumeric/><MaxLength>6</MaxLength></VariableColumn></VariableLength></Table>
<Table><URL>archive.csv</URL><Name>Archive</Name><UTF7/><VariableLength><VariableColumn><Name>Code</Name><AlphaNumeric/></VariableColumn></VariableLength></Table>
</Media></DataSet>"""


@query(
    "validate_delivery",
    f"with {X.DEFECTIVE_SQL} select code, \"column\", _ordinal, value, 'Orders' as \"table\" from f"
    " union all select '5003', '', _ordinal, c1, 'Orders' from n where c1::bigint % 10 = 0 union all select '1003', '', NULL, 'archive.csv', 'Archive' from (select count(*) as n from orders) where n > 0"
    " union all select '3024', '', NULL, 'Regions', '' from (select count(*) as n from orders) where n > 0"
    " union all select '4001', 'Code', r_regionkey + 1, 'R' || r_regionkey, 'Regions' from region union all select '4003', 'Name', r_regionkey + 1, r_name, 'Regions' from region where length(r_name) > 6"
    " union all select '4011', '', NULL, 'archive.csv', 'Archive' from (select count(*) as n from orders) where n > 0",
)
def validate_delivery(spark, sf_dir):
    """Orders, customers and regions written as a delivery with its description, and validated: every tenth customer is
    left out, two tables are called the same, and one is absent and of a codepage that gives no reading."""
    from deklara.delivery import validate
    from deklara.tables import scratch

    root = scratch(spark, "delivery")
    spark.createDataFrame([(_DELIVERY,)], "value string").coalesce(1).write.text(f"{root}/index.xml")
    r = X.load(spark, sf_dir, "region")
    regions = lambda key: r.select((F.col("r_regionkey") + 1).alias("_ordinal"), F.concat(F.lit(key), F.col("r_regionkey").cast("string")).alias("c0"), F.col("r_name").alias("c1"))
    written = [("orders", X.orders_defective(spark, sf_dir), 6), ("customers", X.customer_text(spark, sf_dir).where("c0 % 10 <> 0"), 2), ("regions-old", regions("R"), 2), ("regions", regions(""), 2)]
    for name, rows, n in written:
        parts = rows.repartitionByRange("_ordinal").sortWithinPartitions("_ordinal")
        parts.select(F.concat_ws(";", *(f"c{i}" for i in range(n))).alias("value")).write.option("lineSep", "\r\n").text(f"{root}/{name}.csv")
    return validate(spark, root).select("code", "column", "_ordinal", "value", "table")


def _files(spark, rows, root):
    """Rows (delivery, name, _ordinal, value) as files of their deliveries' folders."""
    parts = rows.repartition("delivery", "name").sortWithinPartitions("delivery", "name", "_ordinal")
    parts.select("delivery", "name", "value").write.partitionBy("delivery", "name").option("lineSep", "\r\n").text(root)


_SMALL = """<DataSet><Version>1.0</Version><Media><Name>M1</Name>
<Table><URL>name=orders</URL><Name>Orders</Name><UTF8/><VariableLength><VariablePrimaryKey><Name>Order</Name><AlphaNumeric/></VariablePrimaryKey>
<VariableColumn><Name>Customer</Name><AlphaNumeric/></VariableColumn><VariableColumn><Name>Amount</Name><Numeric/></VariableColumn>
<ForeignKey><Name>Customer</Name><References>Customers</References></ForeignKey></VariableLength></Table>
<Table><URL>name=customers</URL><Name>Customers</Name><UTF8/><VariableLength><VariablePrimaryKey><Name>Code</Name><AlphaNumeric/></VariablePrimaryKey></VariableLength></Table>
</Media></DataSet>"""


@query(
    "validate_deliveries",
    "with o as (select c_nationkey as n, row_number() over (partition by c_nationkey order by o_orderkey) as _ordinal, o_orderkey, o_custkey, o_orderkey % 50 = 0 as bad from orders join customer on c_custkey = o_custkey),"
    " c as (select c_nationkey as n, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as _ordinal from customer where c_custkey % 10 <> 0)"
    " select 'delivery=' || n as delivery, '4001' as code, 'Orders' as \"table\", _ordinal, 'x' || o_orderkey as value, 'number' as expected from o where bad"
    " union all select 'delivery=' || n, '5003', 'Orders', _ordinal, o_custkey::varchar, 'Customers' from o where o_custkey % 10 = 0"
    " union all select 'delivery=' || n, '5001', 'Customers', 1, 'first', '1, 2' from (select distinct c_nationkey as n from customer)",
)
def validate_deliveries(spark, sf_dir):
    """Each nation's orders and customers as a delivery of its own, validated together: amounts that are none, every
    tenth customer left out, and a key that is there twice."""
    from deklara.delivery import validate
    from deklara.tables import scratch

    root = scratch(spark, "deliveries")
    customers = X.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("delivery"))
    orders = X.load(spark, sf_dir, "orders").join(customers, "o_custkey")
    amount = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).otherwise("1,5")
    one = orders.select("delivery", F.lit("orders").alias("name"), F.col("o_orderkey").alias("_ordinal"), F.concat_ws(";", F.col("o_orderkey"), F.col("o_custkey"), amount).alias("value"))
    two = customers.where("o_custkey % 10 <> 0").select("delivery", F.lit("customers").alias("name"), F.col("o_custkey").alias("_ordinal"), F.col("o_custkey").cast("string").alias("value"))
    nations = customers.select("delivery").distinct()
    twice = nations.select("delivery", F.lit("customers").alias("name"), F.lit(-1).cast("bigint").alias("_ordinal"), F.lit("first\r\nfirst").alias("value"))
    index = nations.select("delivery", F.lit("index.xml").alias("name"), F.lit(0).cast("bigint").alias("_ordinal"), F.lit(_SMALL).alias("value"))
    _files(spark, one.unionByName(two).unionByName(twice), root)
    for r in index.collect():  # one description for each nation
        spark.createDataFrame([(r["value"],)], "value string").coalesce(1).write.text(f"{root}/delivery={r['delivery']}/index.xml")
    return validate(spark, root, many=True).select("delivery", "code", "table", "_ordinal", "value", "expected")
