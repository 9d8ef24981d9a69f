"""Pairs of overlapping boxes: each once, whatever the grid and its blocks, and no shuffle of pairs."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tamis import catalog
from tamis.operators import geometry

BOXES = "doc_id string, page int, box_id int, x double, y double, width double, height double"


def pairs(spark, rows, *args):
    """Pairs of ids and their IoU, with their number."""
    got = geometry.overlapping(spark.createDataFrame(rows, BOXES), *args).collect()
    return Counter((r["doc_id"], r["page"], r["left_id"], r["right_id"], round(r["iou"], 9)) for r in got)


def loop(rows):
    named = [dict(zip(("doc_id", "page", "box_id", *geometry.BOX), r)) for r in rows]
    return Counter(
        (*a[:3], b[2], round(v, 9)) for a, x in zip(rows, named) for b, y in zip(rows, named) if a[:2] == b[:2] and a[2] < b[2] and (v := geometry.iou_py(x, y)) > 0
    )


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_pairs_pass_no_shuffle(spark):
    """A thousand boxes on one spot make half a million pairs, which must not be written to disk."""
    df = spark.createDataFrame([("d", 1, k, 60.0, 60.0, 20.0, 20.0) for k in range(1000)], BOXES)
    before = shuffled(spark)
    assert geometry.overlapping(df).count() == 1000 * 999 // 2
    assert shuffled(spark) - before < 1_000_000


def test_repeated_rows_pair_like_others(spark):
    rows = [("d", 1, 1, 0.0, 0.0, 10.0, 10.0)] * 2 + [("d", 1, 2, 1.0, 1.0, 10.0, 10.0)] * 3
    assert pairs(spark, rows) == loop(rows) and sum(loop(rows).values()) == 6


def test_fractions_at_a_cell_edge(spark):
    rows = [("d", 1, 1, 63.5, 5.0, 1.0, 1.0), ("d", 1, 2, 64.2, 5.0, 1.0, 1.0), ("d", 1, 3, 5.0, -0.5, 1.0, 1.0), ("d", 1, 4, 5.0, 0.25, 1.0, 1.0)]
    assert pairs(spark, rows) == loop(rows) and len(loop(rows)) == 2


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_blocks_against_loop(spark, block):
    """Boxes without area, negative places, ids that repeat across blocks, boxes over many cells."""
    rng = random.Random(block)
    rows = [(rng.choice("de"), rng.randrange(2), rng.randrange(60), rng.randrange(-80, 80) / 4, rng.randrange(-80, 80) / 4, rng.randrange(-2, 60) / 4, rng.randrange(-2, 60) / 4) for _ in range(160)]
    assert pairs(spark, rows, 4, block) == loop(rows)


def test_query_on_crowded_pages(spark, tmp_path):
    """Keys of part at sf0.1, where several boxes share a place, and one of them twice: the rows of the SQL."""
    keys = [*range(20_000), 7]
    pq.write_table(pa.table({"p_partkey": pa.array(keys, pa.int64())}), tmp_path / "part.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    expected = Counter(db.sql(catalog.oracle_sql()["iou_pairs"]).fetchall())
    got = Counter(tuple(r) for r in catalog.queries()["iou_pairs"](spark, str(tmp_path)).collect())
    assert got == expected and len(expected) > 40_000
