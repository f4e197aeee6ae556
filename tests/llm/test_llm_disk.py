"""What the text operators leave on disk while they run."""

from __future__ import annotations

import pathlib

import corpus_pipeline
from pyspark.sql import functions as F

from terrascope.llm import common, jaccard, regions
from terrascope.session import SHUFFLE_CLEANUP, fresh_path


def prose(first: int, n: int = 40) -> str:
    return " ".join(f"w{first + k}" for k in range(n))


def documents(spark):
    """Twenty texts of their own, five copies of each, and a near copy of the first."""
    rows = [(100 * k + c, prose(1000 * k)) for k in range(20) for c in range(5)]
    return spark.createDataFrame([*rows, (9999, prose(0) + " more")], "doc_id long, text string")


def shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f.name for at in folders for f in pathlib.Path(at.getPath()).rglob("shuffle_*.data")}


def folders(spark) -> list[str]:
    return [p.name for p in pathlib.Path(fresh_path(spark, "x").removeprefix("file:")).parent.glob("*")]


def test_staging_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = common.staged(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert rows.count() == 10 and spark.conf.get(SHUFFLE_CLEANUP, None) != "true"
    assert not {f for f in shuffle_files(spark) - before if int(f.split("_")[1]) <= max(
        (int(b.split("_")[1]) for b in before), default=-1) + 1}


def test_slices_are_the_whole(spark):
    rows = common.staged_in_slices(lambda inside: spark.range(1000).filter(inside("id")), "slices", 3)
    assert sorted(r["id"] for r in rows.collect()) == list(range(1000))


def test_the_wide_tables_of_the_join_are_removed(spark):
    before = {n for n in folders(spark)}
    got = {r["id"]: r["component_id"] for r in jaccard.similar_classes(documents(spark)).collect()}
    assert len(got) == 101 and len(set(got.values())) == 20 and got[9999] == got[4] == 0
    left = {n[:-33] for n in folders(spark) if n not in before}
    assert "jaccard-labels" in left
    assert not left & {"jaccard-prefixes", "jaccard-shared", "jaccard-met", "jaccard-rows"}


def test_shingles_of_equal_sets_alone_are_not_listed(spark, monkeypatch):
    listed = []
    whole = jaccard.staged_in_slices

    def kept(make, name, slices):
        out = whole(make, name, slices)
        listed.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "staged_in_slices", kept)
    keyed = regions.keyed(documents(spark).filter("doc_id < 9999"), "doc_id", "text")
    prefixed = common.staged(jaccard.prefixes(keyed, 5, 80, []), "jaccard-prefixes")
    assert jaccard.candidate_links(prefixed, 80).count() == 0 and listed == [0]


def test_the_pipeline_keeps_one_stage(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{k}", lambda s, docs, d: docs) for k in range(4)])
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: spark.range(5))
    before = set(folders(spark))
    assert corpus_pipeline.run(spark, "").count() == 5
    assert [n[:-33] for n in folders(spark) if n not in before] == ["pipeline-s2"]
