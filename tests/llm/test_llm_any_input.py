"""Inputs made to break hashes, budgets, memory and names."""

import resource
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrascope.llm import chat, common, decontaminate, jaccard, mixing, simhash, substring_dedup, suffix_dedup, toxicity


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


A, B = thue_morse(2048), thue_morse(2048, "ba")


@pytest.fixture(scope="module")
def twisted(spark):
    """Different words whose polynomials modulo 2^64 agree."""
    rest = " ".join(f"x{i}" for i in range(19))
    rows = [(1, A), (2, B), (3, f"{A} {rest}"), (4, f"{B} {rest}"), (5, f"{A} {rest}")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_words_that_share_a_polynomial_are_different(spark, twisted):
    data = np.frombuffer(f"{A} {B} short".encode(), np.uint8)
    starts, ends = np.array([0, 2049, 4098]), np.array([2048, 4097, 4103])
    plain = common.RangeHash(data).of(starts, ends)
    assert plain[0] == plain[1]  # what is guarded against
    assert len(set(common.word_hashes(data, starts, ends).tolist())) == 3
    classes = {r.id: r.component_id for r in jaccard.similar_classes(twisted).collect()}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}  # 3 and 4 share 15 of 17 shingles
    removed = {r.id: r.n_removed for r in substring_dedup.remove_repeats(twisted).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 0, 5: 20}
    prints = {r.id: r.fingerprint for r in simhash.fingerprint_documents(twisted).collect()}
    assert prints[1] != prints[2] and prints[3] == prints[5]


def test_bytes_that_share_a_polynomial_by_brute_force(spark, twisted):
    texts = {r.doc_id: r.text.encode() for r in twisted.collect()}
    seen = {}
    for b in texts.values():
        for i in range(len(b) - 199):
            seen[b[i:i + 200]] = seen.get(b[i:i + 200], 0) + 1
    for row in suffix_dedup.remove_repeats(twisted).collect():
        b = texts[row.id]
        gone = set()
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone.update(range(i, i + 200))
        assert row.n_removed == len(gone)


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.frombuffer(b" ".join(bytes(rng.integers(97, 123, rng.integers(1, 300), np.uint8)) for _ in range(900)), np.uint8)
    starts, ends, _ = common.words(common.space_separated(data), np.array([0, len(data)]))
    whole = common.word_hashes(data, starts, ends)
    monkeypatch.setattr(common, "CHUNK_BYTES", 200)
    assert (common.word_hashes(data, starts, ends) == whole).all()


def test_votes_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, n)) for n in (0, 1, 50, 3000, 700)]
    whole = simhash.fingerprints(pa.array(texts, pa.string()))
    monkeypatch.setattr(simhash, "VOTE_TERMS", 37)
    assert (simhash.fingerprints(pa.array(texts, pa.string())) == whole).all()


def test_a_text_of_many_megabytes_is_voted_in_bounded_memory():
    code = """
import resource, pyarrow as pa
from terrascope.llm import simhash
text = " ".join(f"word{i}x{i % 97}" for i in range(2_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
simhash.fingerprints(pa.array([text], pa.string()))
print(len(text), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
"""
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0
    root = str(common.Path(common.__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=300, check=True).stdout
    size, peak = map(int, out.split())
    assert size > 25_000_000 and peak < 60 * size


def test_blank_documents_of_a_capped_source(spark):
    rows = [(i, "one two three" if i else "", "small") for i in range(40)] + [(i, "", "small") for i in range(40, 80)]
    rows += [(i, "a b c d e f g h " * 5, "big") for i in range(100, 200)] + [(i, None, "none") for i in range(300, 310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixed(docs).collect()
    small = [r for r in found if r.source == "small"]
    assert small[0].target == 2 * small[0].source_size and {r.copies for r in small} == {2}
    assert all(r.copies <= 2 for r in found)
    assert {r["count"] for r in mixing.mix(docs).filter("source = 'small'").groupBy("doc_id").count().collect()} == {2}


def test_a_message_without_an_id_is_an_error(spark):
    rows = [(1, 1, None, "user", "hello", 0.0), (1, None, 1, "assistant", "lost", 0.0)]
    schema = "conv long, msg long, parent long, role string, text string, score double"
    with pytest.raises(ValueError, match="no id"):
        chat.format_trees(spark.createDataFrame(rows, schema)).count()
    more = spark.createDataFrame(rows[:1], schema).withColumns({"leaf": F.lit("x"), "rank": F.lit(9), "depth": F.lit(None)})
    assert chat.format_trees(more).first().formatted == "### user: hello</turn>\n"


def test_results_find_free_names(spark):
    docs = spark.createDataFrame([(1, "kind words"), (2, "one two")], "doc_id long, text string").withColumns(
        {"_toxicity": F.lit("t"), "_contamination": F.lit("c"), "_toxicity_": F.lit(1)})
    kept = toxicity.remove_toxic(docs, toxicity.Model({}, (), (0.0, 0.0, 0.0)))
    assert kept.columns == docs.columns and {r._toxicity for r in kept.collect()} == {"t"}
    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns and [(r.doc_id, r._contamination) for r in kept.collect()] == [(1, "c")]


def test_stems_of_one_group_of_copies_are_no_lexicon(spark):
    base = " ".join(f"neutral{chr(97 + i)}" for i in range(26))
    near = [f"{base} extra{i}" for i in range(9)]
    rows = [(i, t, 1) for i, t in enumerate([base] * 9 + near)]
    rows += [(100 + i, f"you vile{'abcdefgh'[i]} snarlface number{i} {' '.join(f'pad{i}{j}' for j in range(9))}", 1) for i in range(8)]
    rows += [(200 + i, " ".join(f"good{i}{j}" for j in range(20)), 0) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    stems = toxicity.fit(docs, labels).stems
    assert any("snarlface".startswith(s) for s in stems) and not any(s.startswith("neutral") for s in stems)


def test_the_automaton_finds_what_a_plain_search_finds():
    model = toxicity.Model({"vile": 3.0, "snarl": 2.0, "bad": 1.0, "badger": 0.5}, ("bad luck", "snarl up"), (0.0, 1.0, 1.0))
    texts = ["Vile snarling b@dgers, bad luck!", "bad bad luck; BADLY evil V1LE", "snarl up the snarl", "", "аbаd 8ad vi1e", "bad  luck bad"]
    for text in texts:
        plain = toxicity.folded(text)
        excused = [(i, i + len(p)) for p in model.exceptions for i in range(len(plain)) if plain.startswith(f" {p} ", i)]
        expected = sorted(
            (i + 1, s) for s in model.stems for i in range(len(plain)) if plain.startswith(f" {s}", i)
            and not any(a + 1 <= i + 1 < b + 1 for a, b in excused))
        assert sorted((start, stem) for start, stem, _ in toxicity.finds(model.automaton(), plain)) == expected
