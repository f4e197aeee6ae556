"""The pipeline against its stages by brute force, and each stage on odd rows."""

from collections import Counter

import corpus_pipeline as P
import duckdb
import pytest
from pyspark.sql import functions as F

from terrascope.llm import decontaminate, mixing, toxicity
from terrascope.llm.common import staged, table
from terrascope.llm.queries import toxicity_model

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in P.STAGES:
        docs = staged(stage(spark, docs, SF), "stage")
        out.append(docs)
    return out


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_every_stage_by_brute_force(spark, stages):
    docs = table(spark, SF, "documents")
    toxic, near, clean, mix, shards = stages
    assert all(s.columns == COLUMNS for s in stages[:-1])
    model = toxicity_model(docs, table(spark, SF, "labels"))
    automaton = model.automaton()

    def bad(text):
        plain = toxicity.folded(text)
        return model.score(sum(f[2] for f in toxicity.finds(automaton, plain)), len(plain.split())) >= 0.5

    first = Counter({k: n for k, n in rows(docs).items() if not bad(k[1])})
    assert rows(toxic) == first

    texts = sorted(first)
    sets = [shingles(t) for _, t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    second = Counter({texts[i]: 1 for i in range(len(texts)) if up[i] == i})
    assert rows(near) == second

    items = duckdb.connect().execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    windows = set()
    for (text,) in items:
        words = decontaminate.words(text)
        windows |= {tuple(words[i:i + 10]) for i in range(max(1, len(words) - 9))} if words else set()
    sizes = {len(w) for w in windows}

    def leaked(text):
        words = decontaminate.words(text)
        return any(tuple(words[i:i + n]) in windows for n in sizes for i in range(len(words) - n + 1))

    third = Counter({k: n for k, n in second.items() if not leaked(k[1])})
    assert rows(clean) == third
    copies = {r.doc_id: r.copies for r in mixing.mixed(clean).collect()}
    assert rows(mix) == Counter({k: copies[k[0]] for k in third if copies[k[0]]})
    assert rows(shards) == rows(mix)
    load = Counter()
    for r in shards.collect():
        load[r.shard] += len((r.text or "").encode()) + 1
    largest = max(len((t or "").encode()) + 1 for _, t in third)
    assert set(load) <= set(range(8)) and max(load.values()) - min(load.values()) <= 2 * largest


def test_run_gives_the_last_stage(spark, stages):
    assert rows(P.run(spark, SF)) == rows(stages[-1])


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, id string"
    odd = spark.createDataFrame([
        (1, None, None, None, None, None, None), (None, "no id at all", "en", "a", 1, "", ""), (2, "", "en", "a", 0, "", ""),
        (2, "", "en", "a", 0, "", ""), (3, "word " * 50_000, "en", "b", 1, "", ""), (4, " x", "en", "b", 1, "", "")], schema)
    for name, stage in P.STAGES:
        got = stage(spark, odd, SF)
        assert set(odd.columns) <= set(got.columns), name
        assert got.count() > 0, name
        assert stage(spark, odd.limit(0), SF).count() == 0, name


def test_clean_documents_stay(spark, stages):
    """No stage but the mix drops a text that is neither toxic, nor a copy, nor leaked."""
    words = [f"entirely{i}fresh" for i in range(80)]
    docs = table(spark, SF, "documents").filter("doc_id < 40")
    own = docs.limit(1).select(
        F.lit(10**6).cast("long").alias("doc_id"), F.lit(" ".join(words)).alias("text"), "lang", "source", "n_chars")
    kept = docs.unionByName(own)
    for _, stage in P.STAGES[:3]:
        kept = staged(stage(spark, kept, SF), "stage")
    assert kept.filter("doc_id = 1000000").count() == 1
