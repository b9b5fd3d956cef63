"""Third review, driver's memory: what a query's plans and their metrics take on the driver."""

from __future__ import annotations

import re

from rdspark.llm import components, jaccard, mixing


def _plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def _docs(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{text} x{k % 3}", "ab"[k % 2]) for k in range(12)] + [(12, None, None), (13, "", "a"), (13, "", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_rows_and_roots_are_read_once_for_the_documents_kept(spark, capsys):
    kept = jaccard.kept_documents(_docs(spark))
    assert len(re.findall(r"FileScan parquet", _plan(kept, capsys))) == 2
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 12, 13]


def test_targets_are_not_part_of_the_mix(spark, capsys):
    mixed = mixing.mixed_documents(_docs(spark))
    assert len(re.findall(r"(?m)^.*[- ]Window \[", _plan(mixed, capsys))) <= 1


def test_forest_of_stars(spark):
    for edges, stars in (([(3, 1), (2, 1), (5, 4)], True), ([(3, 1), (3, 2)], False), ([(3, 2), (2, 1)], False), ([], True)):
        assert components._is_forest_of_stars(spark.createDataFrame(edges, "u long, v long")) is stars
