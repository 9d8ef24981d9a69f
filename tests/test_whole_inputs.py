"""Queries read all rows: keys far above those of the small test sets count too."""

import datetime

import pytest
from pyspark.sql import functions as F

from tamis import catalog

ORDERS = {7: (1, 120.75), 2999: (2, 10.0), 3000: (3, 55.5), 149_999: (4, 1000.0)}
LINES = [(key, n) for key in ORDERS for n in range(1, 4)]
AMOUNT = {(key, n): key % 100 + 10 * n for key, n in LINES}


@pytest.fixture(scope="module")
def invoices(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("invoices"))
    day = datetime.datetime(2024, 1, 2)
    orders = [(k, c, "O", t, day, "1-URGENT") for k, (c, t) in ORDERS.items()]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    lines = [(k, 100 + n, n, float(n), float(AMOUNT[k, n]), "AR"[n % 2], "F") for k, n in LINES]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{d}/lineitem.parquet")
    return d


@pytest.mark.parametrize(
    "name,cols,expected",
    [
        ("invoice_line_items", ["table_id", "row_idx", "description", "quantity", "total"], {(f"L{k}", n - 1, f"part {100 + n}", float(n), AMOUNT[k, n] + 0.5) for k, n in LINES}),
        ("invoice_table_roles", ["table_id", "role"], {(f"{t}{k}", r) for k in ORDERS for t, r in (("L", "line_items"), ("H", "header"), ("S", "totals"))}),
        ("invoice_totals", ["table_id", "label", "amount"], {(f"S{k}", lab, v) for k, (_, t) in ORDERS.items() for lab, v in (("total_ht", float(int(t))), ("tax", float(int(t) // 5)), ("total_ttc", int(t) * 6 // 5 + 0.25))}),
        ("invoice_header_fields", ["table_id", "field", "value"], {(f"H{k}", f, v) for k, (c, _) in ORDERS.items() for f, v in (("invoice_number", f"FA-{k}"), ("invoice_date", "2024-01-02"), ("client_name", f"C{c}"))}),
        ("invoice_assembly", ["doc_id", "item_count", "total_amount", "invoice_number"], {(f"F{k}", 3, sum(AMOUNT[k, n] + 0.5 for n in (1, 2, 3)), f"FA-{k}") for k in ORDERS}),
        ("invoice_reference", ["doc_id", "reference"], {(f"F{k}", f"FA-{k}") for k in ORDERS if k >= 10}),
        ("dup_rows", ["table_id", "row_idx"], {(f"D{k % 50}", k // 50 * 10 + n) for k, n in LINES if k != 149_999}),
    ],
)
def test_late_orders(spark, invoices, name, cols, expected):
    rows = catalog.queries()[name](spark, invoices).select(*cols).collect()
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected


def test_late_orders_near_duplicate_columns(spark, invoices):
    got = catalog.queries()["near_duplicate_columns"](spark, invoices)
    assert {r["table_id"] for r in got.select("table_id").distinct().collect()} == {f"D{k % 50}" for k in ORDERS}
    assert got.filter(F.col("share").isNull()).count() == 0
