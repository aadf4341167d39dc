import json

import pytest
from pyspark.sql import functions as F

from catalume.sources import catalog
from catalume.sources.catalog import load_nodes, load_recipes, write_result


def test_bad_records_are_told_apart(spark, tmp_path):
    fine = {"node_id": "a", "parent_id": None, "name": "A", "kind": "Liquor", "ord": 1, "unit_volume": {"amount": 1.0, "unit": "mL"}}
    lines = [json.dumps(fine), '{"node_id": "b", "name": ', json.dumps({**fine, "node_id": None}), json.dumps({**fine, "node_id": "c", "ord": "many"}), json.dumps({"node_id": "d"})]
    (tmp_path / "nodes.jsonl").write_text("\n".join(lines))
    got = load_nodes(spark, str(tmp_path / "nodes.jsonl"), bad_to=str(tmp_path / "bad"))
    assert {r.node_id for r in got.collect()} == {"a", "d"} and got.where("node_id = 'a'").first().unit_volume.amount == 1.0 and "_bad" not in got.columns
    bad = {(r.reason, r.record[:14]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert {x for x, _ in bad} == {"malformed", "no node_id"} and len(bad) == 3
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        load_nodes(spark, str(tmp_path / "nodes.jsonl")).collect()


def test_bad_recipes_and_parquet(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"recipe_id": "1", "ingredients": [{"node": "a", "amount_unit": {"amount": 1.0, "unit": "oz"}}]}\nnot a record\n')
    got = load_recipes(spark, str(tmp_path / "r.json"), bad_to=str(tmp_path / "bad"))
    assert catalog.explode_lines(got).first().node_id == "a" and got.count() == 1
    assert [r.record for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["not a record"]
    load_recipes(spark, str(tmp_path / "r.json"), bad_to=str(tmp_path / "bad")).write.parquet(str(tmp_path / "p"))
    again = load_recipes(spark, str(tmp_path / "p"), bad_to=str(tmp_path / "bad"))
    assert again.count() == 1 and spark.read.parquet(str(tmp_path / "bad")).count() == 0


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "out")
    write_result(spark.range(3), path)
    with pytest.raises(Exception, match="no more"):
        write_result(spark.range(100).select(F.when(F.col("id") < 60, F.col("id")).otherwise(F.raise_error(F.lit("no more"))).alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    write_result(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [f.name for f in tmp_path.iterdir()] == ["out"]


def test_single_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame(x, "a string, b long, v long")
    write_result(rows(("x", 1, 1), ("x", 2, 2), ("y z", 1, 3), (None, 1, 4)), path, ["a", "b"], partitions_only=True)
    write_result(rows(("x", 2, 20), ("w", 7, 70), ("y z", 1, 30)), path, ["a", "b"], partitions_only=True)
    assert {tuple(r) for r in spark.read.parquet(path).select("a", "b", "v").collect()} == {("x", 1, 1), ("x", 2, 20), ("y z", 1, 30), (None, 1, 4), ("w", 7, 70)}
    assert [f.name for f in tmp_path.iterdir()] == ["out"]
    with pytest.raises(ValueError, match="partition"):
        write_result(rows(("x", 1, 1)), path, partitions_only=True)
