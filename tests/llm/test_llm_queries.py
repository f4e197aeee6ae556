"""Every query of the text operators against its SQL check or a brute-force version, on the smallest data set."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from compare import connect, difference

from terrascope.llm.queries import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.connect().execute(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY 1")
    return dict(rows.fetchall())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_against_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, CHECKS[name]) is None


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = dict(duckdb.connect().execute(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    rows = QUERIES["op4_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    seen = Counter((labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels)
    assert seen[1, 1] >= 0.85 * (seen[1, 0] + seen[1, 1])
    assert seen[0, 1] <= 0.01 * (seen[0, 0] + seen[0, 1])


def test_suffix_dedup_by_brute_force(spark, texts):
    data = {d: t.encode() for d, t in texts.items()}
    seen = Counter(b[i:i + 200] for b in data.values() for i in range(len(b) - 199))
    for row in QUERIES["op5_suffix_array_dedup"](spark, SF).collect():
        b = data[row.doc_id]
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (
            len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_fingerprints_by_brute_force(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op7_document_fingerprints"](spark, SF).collect()}
    ids = sorted(texts)
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    by_text = {}
    for i, d in enumerate(ids):
        row, following = rows[d], rows[ids[(i + 1) % len(ids)]]
        half = len(texts[d]) // 2
        edited = texts[d][:len(texts[d]) - half] + texts[following.doc_id][:half]
        assert row.n_chars == len(texts[d])
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.near_edited == 1 - apart(row.fingerprint, row.edited_fingerprint) / 64
        assert row.near_next == 1 - apart(row.fingerprint, following.fingerprint) / 64
        assert by_text.setdefault(texts[d], row.fingerprint) == row.fingerprint
        near = sum(apart(row.fingerprint, o.fingerprint) <= 3 for o in rows.values())
        assert row.n_near == (near if d % 100 == 0 else None)


def test_licenses_by_wording(spark, texts):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for row in QUERIES["op9_license_scans"](spark, SF).collect():
        expected = sorted({name for line, name in lines.items() if line in texts[row.doc_id]})
        assert row.licenses == ",".join(expected)


def test_shards(spark, texts):
    rows = QUERIES["op10_sharding"](spark, SF).collect()
    load, places = Counter(), {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) < 0.02 * max(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_near_counts_of_an_id_with_several_texts(spark, tmp_path):
    said = [(100, f"t{i} u{i} v{i} w{i} x{i} y{i}") for i in range(6)] + [(100, "t0 u0 v0 w0 x0 y0")] + [
        (i, "t1 u1 v1 w1 x1 y1") for i in (7, 200, None)] + [(None, "more"), (300, "t0 u0 v0 w0 x0 y0")]
    spark.createDataFrame(said, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op7_document_fingerprints"](spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in said)
    prints = [int(r.fingerprint, 16) for r in rows]
    for r, p in zip(rows, prints, strict=True):
        near = sum((p ^ q).bit_count() <= 3 for q in prints) if r.doc_id in (100, 200, 300) else None
        assert r.n_near == near
    assert len({r.n_near for r in rows if r.doc_id == 100}) > 1
