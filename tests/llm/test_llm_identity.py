"""Documents whose 64-bit keys agree, and records that are there very often."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from terrascope.llm import jaccard, regions, sharding, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def passages(spark):
    """Texts with own words and shared passages, near copies, blank texts and a null."""
    pick = random.Random(5)

    def prose(n: int) -> str:
        return " ".join(f"w{pick.randrange(10_000)}" for _ in range(n))

    shared = [prose(60) for _ in range(3)]
    texts: list[str | None] = []
    for k in range(40):
        texts.append(f"{prose(30)} {shared[k % 3]} {prose(20)}" if k % 2 else prose(70))
    texts += [texts[0] + " " + prose(2), texts[1], "", " ", None]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()


def rows(df) -> list:
    return sorted(map(tuple, df.collect()), key=str)


def results(docs) -> list[list]:
    return [
        rows(suffix_dedup.remove_repeats(docs).withColumn("spans", F.sort_array("spans"))),
        rows(substring_dedup.remove_repeats(docs)),
        rows(jaccard.similar_classes(docs).select("id", "n_shingles", "component_id")),
        rows(jaccard.distinct_documents(docs)),
    ]


def test_equal_keys_of_different_documents(passages, monkeypatch):
    before = results(passages)
    assert any(r[2] for r in before[0]) and any(r[2] for r in before[1]) and len(before[3]) == 43
    monkeypatch.setattr(regions, "row_key", lambda *columns: F.lit(1).cast("long"))
    assert results(passages) == before


def test_split_signs_with_equal_keys(passages, monkeypatch):
    before = rows(suffix_dedup.remove_repeats(passages))
    monkeypatch.setattr(suffix_dedup, "RIVALS", 2)
    assert rows(suffix_dedup.remove_repeats(passages)) == before
    monkeypatch.setattr(regions, "row_key", lambda *columns: F.lit(1).cast("long"))
    assert rows(suffix_dedup.remove_repeats(passages)) == before


def test_distinct_documents_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7), (2, "a b c d e f", 8), (3, "", 9)], "doc_id long, text string, _jaccard_key long")
    assert rows(jaccard.distinct_documents(docs)) == [(1, "a b c d e f", 7), (3, "", 9)]


@pytest.mark.parametrize("hot", [7, None])
def test_shards_of_a_record_that_is_a_third_of_all(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "RUN", 64)
    own = spark.range(2000).select("id", F.col("id").cast("string").alias("text"))
    same = spark.range(1000).select(F.lit(hot).cast("long").alias("id"), F.lit("x" if hot else None).cast("string").alias("text"))
    placed = sharding.shard_records(own.unionByName(same), doc_id="id").toPandas()
    assert len(placed) == 3000
    for _, shard in placed.groupby("shard"):
        assert sorted(shard["place"]) == list(range(len(shard)))
    crowd = placed[placed["doc_id"].isna()] if hot is None else placed[(placed["doc_id"] == hot)]
    assert len(crowd) in (1000, 1001) and crowd["virtual_slot"].nunique() == len(crowd) - 999
