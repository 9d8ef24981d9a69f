"""Joins whose sides follow the corpus stay out of the driver, however small Spark thinks they are, and keep their results."""

import duckdb

from tamis import catalog
from tests.conftest import SF


def run(spark, name):
    """Rows of a query, and its plan as it was in the end; at the default threshold, which small tables are far below."""
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 * 2**20
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def tables_of_part(d):
    """Table number -> rows."""
    return dict(duckdb.sql(f"SELECT p_partkey // 20, count(*) FROM '{d}/part.parquet' GROUP BY 1").fetchall())


def alike(d):
    """Pairs of tables that are similar enough, by the SQL of table_similarity."""
    sql = catalog.oracle_sql()["table_similarity"]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
    return {frozenset((int(a[1:]), int(b[1:]))) for a, b, s in db.sql(sql).fetchall() if s > 0.08}


def greedy(d, confidence, near, most=None):
    """A plain loop over each page's four tables."""
    rows, like, pages = tables_of_part(d), alike(d), {}
    for k in rows:
        pages.setdefault(k // 4, []).append(k)
    out = set()
    for page in pages.values():
        kept = []
        for k in sorted(page, key=lambda k: (-confidence(k, rows[k]), f"T{k}")):
            if not any(frozenset((k, o)) in like and near(k, o, rows) for o in kept):
                kept.append(k)
        out |= {f"T{k}" for k in kept[:most]}
    return out


def test_greedy_table_merge(spark):
    rows, plan = run(spark, "greedy_table_merge")
    assert "Broadcast" not in plan
    expected = greedy(SF, lambda k, n: 6 * n / 130, lambda a, b, rows: rows[a] == rows[b])
    assert len(rows) == len(expected) and {r["table_id"] for r in rows} == expected


def regions_overlap(a, b, rows):
    shared = (20 - 4 * abs(a % 4 - b % 4)) * 10
    return shared / (400 - shared) > 0.6


def test_region_merge(spark):
    rows, plan = run(spark, "region_merge")
    assert "Broadcast" not in plan
    expected = greedy(SF, lambda k, n: 6 * n / 130 + k % 3, regions_overlap, 5)
    assert len(rows) == len(expected) and {r["table_id"] for r in rows} == expected


def against_sql(spark, name):
    """A similarity query takes no broadcast and returns its SQL's rows."""
    rows, plan = run(spark, name)
    assert "Broadcast" not in plan
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    assert sorted(tuple(r[c] for c in ("left_id", "right_id", "similarity")) for r in rows) == sorted(db.sql(catalog.oracle_sql()[name]).fetchall())


def test_fuzzy_table_similarity(spark):
    against_sql(spark, "fuzzy_table_similarity")


def test_table_similarity(spark):
    against_sql(spark, "table_similarity")


def processed(d):
    """What the table pipeline makes of part's tables: errors, words among numbers and outliers are gone, then a plain loop joins columns that complement each other."""
    rows = duckdb.sql(f"""SELECT p_partkey // 20, CAST(p_partkey % 20 AS INTEGER), [CASE WHEN p_partkey % 11 <> 0 THEN p_name END,
        CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 17 <> 0 THEN p_brand END, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_size AS VARCHAR) END,
        CASE WHEN p_partkey % 19 <> 0 THEN CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR) END,
        CASE WHEN p_partkey % 3 = 0 THEN p_type END, CASE WHEN p_partkey % 3 <> 0 THEN p_type END] FROM '{d}/part.parquet'""").fetchall()
    found, names, out = {}, ["Name", "Brand", "Size", "Prix cents", "Note", "Note_1"], []
    for k, i, values in rows:
        found.setdefault(k, []).append((i, values))
    for k, table in found.items():
        to = list(range(6))
        for a in range(6):
            for b in range(a + 1, 6):
                both = sum(v[a] is None and v[b] is None for _, v in table) / len(table)
                one = sum((v[a] is None) != (v[b] is None) for _, v in table) / len(table)
                if both <= 0.5 and one > 0.7 and a not in gone(to) and b not in gone(to):
                    to[b] = a
        for i, values in table:
            for c in set(to):
                best = max((v for v, t in zip(values, to) if t == c and v is not None), key=len, default=None)
                out.append((f"T{k}", 1 + k % 3, i, c, names[c], best))
    return out


def gone(to):
    return {c for c, t in enumerate(to) if c != t}


def test_table_pipeline(spark):
    rows, plan = run(spark, "table_pipeline")
    assert "Broadcast" not in plan
    got = [tuple(r[c] for c in ("table_id", "page", "row_idx", "col_idx", "col_name", "value")) for r in rows]
    assert sorted(got, key=str) == sorted(processed(SF), key=str)
