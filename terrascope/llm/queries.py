"""The registered queries of the text operators and their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascope.session import fresh_path

from . import (
    chat, decontaminate, jaccard, licenses, merkle, mixing, secrets, sharding, simhash, substring_dedup, suffix_dedup,
    toxicity, vector_codes,
)
from .common import ascii_lower, shipped, staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            shipped(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DECONTAMINATE_SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM item_windows),
doc_windows AS (
  SELECT r, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM doc_windows JOIN item_windows USING (win)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""


@query("op1_benchmark_decontamination", DECONTAMINATE_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


CHAT_EXTRA = r"\### Assistant: </turn> ok"

CHAT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{CHAT_EXTRA}'), (-7, 1, 'assistant', '{CHAT_EXTRA}')),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\0'), '###', '\1\1\1'), '</turn>', '\2/turn>') AS body,
         replace(replace(replace(replace(role, '\', '\0'), '###', '\1\1\1'), '</turn>', '\2/turn>'), ':', '\3') AS head
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(head) + length(body) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op2_chat_formatting", CHAT_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", CHAT_EXTRA), (-7, 1, "assistant", CHAT_EXTRA)], "conv_id long, turn int, role string, text string")
    formatted = chat.format_trees(chat.chained(rows.unionByName(extra)))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        F.col("conv").alias("conv_id"), "formatted", turns.alias("turns"), loss.alias("loss"),
    ).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS point
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM d GROUP BY source),
-- the sources that reach their limit first are the first by limit / weight
o AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k,
         sum(source_size) OVER ()::DOUBLE * 1.5 AS total, sum(w) OVER () AS weight FROM s),
l AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_total,
         weight - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM o),
free AS (SELECT left_total, left_weight FROM l WHERE w * left_total / left_weight <= cap ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size, least(w * (SELECT left_total FROM free) / (SELECT left_weight FROM free), cap) AS target FROM o),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
u AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY point RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, point) AS here
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= budget OR (upto - here <= budget AND (budget - upto + here) * 2 >= here)
                             THEN 1 ELSE 0 END))::BIGINT AS taken
FROM u
"""


@query("op3_source_mixing", MIX_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    map_path = fresh_path(spark, "shard-versions")
    return sharding.shard_records(table(spark, sf_dir, "documents"), map_path=map_path).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op5_suffix_array_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
windows AS (
  SELECT r, i, list_slice(w, i, i + 19) AS win
  FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT r, i FROM windows QUALIFY row_number() OVER (PARTITION BY win ORDER BY r, i) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS p FROM later),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p)
  GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


@query("op6_substring_dedup", SUBSTRING_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


JACCARD_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (
  SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
two_way AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT reach.doc_id, y FROM reach JOIN two_way ON x = other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""


@query("op8_ngram_jaccard_join", JACCARD_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """The model of the labels outside the held-out fold."""
    return toxicity.fit(docs, labels, ~toxicity.held_out(F.col("id")))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("toxicity.score").alias("score"), F.col("toxicity.predicted").alias("predicted"))


@query("op7_document_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`n_near`: for ids divisible by 100, the documents within three bits, the document itself among them."""
    found = staged(simhash.fingerprint_documents(table(spark, sf_dir, "documents")), "fingerprints")
    asked = found.filter("id % 100 = 0")
    counted = asked.join(simhash.near_counts(found, asked), "fingerprint", "left")
    others = found.filter("coalesce(id % 100, 1) <> 0").withColumn("n_near", F.lit(None).cast("bigint"))
    return counted.unionByName(others).select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
        "near_next", "n_near")


@query("op9_license_scans")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = licenses.license_names()
    return found.select(
        "doc_id", F.col("licenses.blocks").alias("n_blocks"), F.size("licenses.found").cast("bigint").alias("n_licensed"),
        F.array_join(names, ",").alias("licenses"),
        F.array_join(F.transform("licenses.found", lambda x: x["start"].cast("string")), ",").alias("starts"))


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"


_FIELDS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_FOLDED = f"translate(text, '{UPPER}', '{LOWER}')"
MERKLE_SQL = rf"""
WITH RECURSIVE crc_table AS (
  SELECT n, list_reduce(list_prepend(n, range(0, 8)),
                        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t
  FROM (SELECT unnest(range(0, 256)) AS n)),
crc_list AS (SELECT list(t ORDER BY n) AS ts FROM crc_table),
d AS (
  SELECT doc_id, lang, sha256({_FIELDS} || {_field('text')}) AS leaf,
         sha256({_FIELDS} || {_field(_FOLDED)}) AS lowered,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda c, x: xor(c >> 8, ts[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM documents, crc_list),
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS folded,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM d),
nodes AS (
  SELECT 0 AS level, lang, idx, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, lang, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY level, lang, idx // 8, n),
sides AS (
  SELECT level, lang, idx, n, digest,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, lang, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, lang, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM nodes),
walk AS (
  SELECT r, 0 AS level, lang, idx, n, '' AS proof, folded FROM leaves
  UNION ALL
  SELECT r, w.level + 1, w.lang, w.idx // 8, (w.n + 7) // 8, proof || lft || rgt, sha256(lft || folded || rgt)
  FROM walk w JOIN sides s ON s.level = w.level AND s.lang IS NOT DISTINCT FROM w.lang AND s.idx = w.idx WHERE w.n > 1),
up AS (SELECT r, lang, proof, folded FROM walk WHERE n = 1),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees
  FROM nodes WHERE n = 1),
over_nodes AS (
  SELECT 0 AS level, tree AS idx, trees AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx))
  FROM over_nodes WHERE n > 1 GROUP BY level, idx // 8, n),
over_sides AS (
  SELECT level, idx,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(digest, '') OVER (PARTITION BY level, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM over_nodes),
over_walk AS (
  SELECT r, subroot, 0 AS level, tree AS idx, trees AS n, proof, folded
  FROM up JOIN subroots s ON s.lang IS NOT DISTINCT FROM up.lang
  UNION ALL
  SELECT r, subroot, w.level + 1, w.idx // 8, (w.n + 7) // 8, proof || lft || rgt, sha256(lft || folded || rgt)
  FROM over_walk w JOIN over_sides s ON s.level = w.level AND s.idx = w.idx WHERE w.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, w.folded AS folded_root, w.folded = root AS verified
FROM over_walk w JOIN leaves USING (r), (SELECT digest AS root FROM over_nodes WHERE n = 1) WHERE w.n = 1
"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS])
    lowered = merkle.leaf_digest(*[F.col(c) for c in merkle.FIELDS[:-1]], ascii_lower(F.col("text")))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proved = merkle.manifest(docs, carry=["doc_id", F.when(tampered, lowered).otherwise(leaf).alias("folded")])
    m = F.col("merkle")
    return proved.select(
        "doc_id", m["leaf"].alias("leaf"), m["subroot"].alias("subroot"), m["root"].alias("root"),
        F.sha2(merkle.proof_text(m["proof"]), 256).alias("proof_sha256"),
        merkle.replayed(F.col("folded"), m["proof"]).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _codes_round(k: int) -> str:
    """Assignment of all parts to the codebooks b{k}, and the next codebooks b{k + 1}."""
    return f"""
a{k} AS (
  SELECT r, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist
  FROM (SELECT v.r, v.p, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS dist
        FROM v JOIN b{k} b USING (p)) GROUP BY r, p),
s{k} AS (
  SELECT p, e, i, sum(y)::BIGINT AS t, count(*) AS n
  FROM (SELECT p, e, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM a{k} JOIN v USING (r, p)) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list((t - ((t % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (p, e)),"""


CODES_SQL = rf"""
WITH k AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS whole
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS (
  SELECT r, p, whole[p * (len(whole) // 16) + 1 : (p + 1) * (len(whole) // 16)] AS x
  FROM (SELECT r, whole, unnest(range(0, 16)) AS p FROM k)),
b0 AS (SELECT p, r AS e, x FROM v WHERE r < 64),
{_codes_round(0)}{_codes_round(1)}{_codes_round(2)}
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY p, e, i)) AS books
      FROM (SELECT p, e, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM b2))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, books AS codebooks_sha256
FROM k JOIN c USING (r), h
"""


@query("op12_vector_code_compression", CODES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors)
    coded = staged(vector_codes.encode(vectors, books), "vector-codes")
    return vector_codes.label_errors(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


_ANY_CASE = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_SQL_HEAD = rf"{_ANY_CASE}[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
_SQL_KINDS = {  # kind: (pattern, value, condition)
    "assign": (_SQL_HEAD + "[A-Za-z0-9+/_.=-]+", f"regexp_extract(m, '{_SQL_HEAD}([A-Za-z0-9+/_.=-]+)', 1)", "length(value) >= 6"),
    "access": ("AKIA[A-Z0-9]+", "m", "length(m) >= 20"),
    "hex": ("[0-9a-f]+", "m", "length(m) >= 24"),
    "issued": (secrets.ISSUED.replace(r"\.", "[.]"), "m", "true"),
    "mixed": (secrets.MIXED, "m", "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9].*[0-9]')"),
}


def _secrets_of(i: int, kind: str, pattern: str, value: str, condition: str) -> str:
    return f"""
  SELECT r, {i} AS k, '{kind}' AS kind, m, start, start + length(m) AS stop, value FROM (
    SELECT r, m, (sum(length(piece) + before) OVER (PARTITION BY r ORDER BY i))::BIGINT AS start, {value} AS value FROM (
      SELECT r, i, m, piece, coalesce(lag(length(m)) OVER (PARTITION BY r ORDER BY i), 0) AS before FROM (
        SELECT r, unnest(ms) AS m, unnest(pieces[:len(ms)]) AS piece, unnest(range(len(ms))) AS i FROM (
          SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS pieces FROM d)))) WHERE {condition}"""


SECRETS_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_secrets_of(i, k, *v) for i, (k, v) in enumerate(_SQL_KINDS.items()))}),
owned AS (
  SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners FROM found JOIN d USING (r) GROUP BY value),
judged AS (
  SELECT r, k, kind, start, stop, CASE
    WHEN len(list_distinct(string_split(lower(value), ''))) < {secrets.LEAST_DIFFERENT}
      OR regexp_matches(lower(value), '{"|".join(secrets.DULL)}') THEN 'dull'
    WHEN owners >= {secrets.SHARED_OWNERS} THEN 'shared' ELSE 'live' END AS standing
  FROM found JOIN owned USING (value)),
rows AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (k < 3 AND standing = 'live') AS n_live,
         count(*) FILTER (k < 3 AND standing = 'shared') AS n_shared,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3 OR standing = 'live') AS spans
  FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
       coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN rows USING (r)
"""


@query("op13_secret_scans", SECRETS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`n_live` and `n_shared`: base spans whose value stays with few owners and looks random, or is widely copied."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    spans = F.col("secrets")
    base = secrets.of_kinds(spans, *secrets.BASE)

    def count(of):
        return F.size(of).cast("bigint")

    return secrets.scan_secrets(docs).select(
        "doc_id", *[count(secrets.of_kinds(spans, k)).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(spans).alias("spans"),
        *[count(secrets.of_standing(base, k)).alias(f"n_{k}") for k in ("live", "shared")])
