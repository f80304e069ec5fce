"""Untidy views of the standard tables, as text: what the queries clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableproof.plans.cells import ROW
from tableproof.plans.rows import number_by
from tableproof.session import table


def _cents(column: str) -> str:
    return f"cast(cast({column} as decimal(12,2)) as string)"


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "o_orderkey"
    return table(spark, sf_dir, "orders").selectExpr(
        f"{k} as {ROW}",
        f"case {k} % 5 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'dd/MM/yyyy') when 2 then date_format(o_orderdate, 'd MMM yyyy') when 3 then date_format(o_orderdate, 'yyyy/MM/dd') else 'N/A' end as order_date",
        "date_format(o_orderdate, 'MM/dd/yyyy') as us_date",
        f"case {k} % 6 when 0 then upper(o_orderpriority) when 1 then lower(o_orderpriority) when 2 then concat('  ', replace(o_orderpriority, ' ', '   ')) else o_orderpriority end as priority",
        f"replace({_cents('o_totalprice')}, '.', ',') as price",
        f"case when {k} % 11 = 0 then '--' when {k} % 13 = 0 then ' null ' else o_orderstatus end as status",
        f"lpad(cast({k} as string), 8, '0') as code",
    )


def orders_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "o_orderkey"
    return table(spark, sf_dir, "orders").selectExpr(
        f"{k} as {ROW}",
        "cast(datediff(o_orderdate, date'1899-12-30') as string) as excel_serial",
        _cents("o_totalprice - 100000") + " as amount",
        f"concat(cast({k} as string), '.234') as thousandish",
        f"concat('$', cast({k} % 9 + 1 as string), ',', lpad(cast({k} % 1000 as string), 3, '0'), '.50') as dollars",
        f"concat(cast({k} % 9 + 1 as string), '.', lpad(cast({k} % 1000 as string), 3, '0'), ',5') as euros",
        f"case when {k} % 2 = 0 then '1,5' else '1.5' end as mixed",
    )


def date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of dates with month names first, two-digit years about the pivot, clocks, and times that don't exist."""
    k = "o_orderkey"
    year = f"lpad(cast({k} % 100 as string), 2, '0')"
    clock = f"lpad(cast({k} % 24 as string), 2, '0')"
    return table(spark, sf_dir, "orders").selectExpr(
        f"{k} as {ROW}",
        "date_format(o_orderdate, 'MMM d, yyyy') as month_first",
        f"concat('5-May-', {year}) as short_year",
        f"case {k} % 4 when 0 then concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' ', {clock}, ':07') when 1 then concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T', {clock}, ':07:09') when 2 then concat(date_format(o_orderdate, 'yyyy/MM/dd'), ' 00:00:00') else concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 12:00:60') end as clocked",
    )


#: Raw text, its surface and its surface in title case: compatibility forms, accents, capitals beyond ASCII.
WIDE = (("\uff21\uff22\uff23 \uff11", "ABC 1", "Abc 1"), ("o\ufb03ce\u00a0 x", "office x", "Office X"), ("  \u00e9cole d'\u00e9t\u00e9 ", "\u00e9cole d'\u00e9t\u00e9", "\u00c9cole D'\u00c9t\u00e9"), ("cafe\u0301", "caf\u00e9", "Caf\u00e9"), ("\u041c\u041e\u0421\u041a\u0412\u0410\u2003\u2003\u2460", "\u041c\u041e\u0421\u041a\u0412\u0410 1", "\u041c\u043e\u0441\u043a\u0432\u0430 1"))


def wide_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with text beyond ASCII."""
    pick = "element_at(array(" + ", ".join("'" + raw.replace("'", "\\'") + "'" for raw, _, _ in WIDE) + f"), cast(o_orderkey % {len(WIDE)} as int) + 1)"
    return table(spark, sf_dir, "orders").selectExpr(f"o_orderkey as {ROW}", f"{pick} as word")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "event_id"
    return table(spark, sf_dir, "events").selectExpr(
        f"{k} as {ROW}",
        "cast(unix_timestamp(ts) as string) as epoch_s",
        f"case {k} % 4 when 0 then upper(event_type) when 1 then concat(event_type, '  ') else event_type end as event_type",
        f"case when {k} % 3 = 0 then {_cents('value')} else 'n/a' end as sparse_value",
        f"case when {k} % 2 = 0 then 'Yes' else 'no' end as flag",
    )


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    return table(spark, sf_dir, "customer").selectExpr(
        f"{k} as {ROW}",
        "c_name as name",
        f"case when {k} % 20 = 0 then concat('user', cast({k} as string), '-at-example.com') else concat('user', cast({k} as string), '@example.com') end as email",
        "c_mktsegment as segment",
        "c_mktsegment as segment_copy",
    )


def dirty_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "p_partkey"
    return table(spark, sf_dir, "part").selectExpr(
        f"{k} as {ROW}",
        f"case {k} % 4 when 0 then upper(p_name) when 1 then concat(p_name, '!') when 2 then replace(p_name, ' ', '-') else p_name end as name",
        "p_brand as brand",
        f"case when {k} % 5 = 0 then '--' else p_type end as ptype",
    )


def text_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(cast(l_quantity as int) as string) as quantity", f"{_cents('l_extendedprice')} as extended", "l_returnflag as returnflag", "date_format(l_shipdate, 'yyyy-MM-dd') as shipdate")
    numbered = number_by(lines, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "extended", "returnflag", "shipdate")
    return numbered.select(ROW, "quantity", "extended", "returnflag", "shipdate")
