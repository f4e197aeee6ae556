"""Secret scans with corpus-wide ownership of every candidate.

A scan of each text gives candidates: assignments to a name such as `token`, access keys, long hex runs, and further
tokens that look like credentials (known prefixes, or long tokens of mixed characters). Each candidate's value is hashed,
and the hashes are counted over the whole corpus: in how many places (repositories: here documents) and with how many
owners (here sources) a value stands. A value that many owners have was copied from an example or a manual; a value
that stays with one owner and looks random is taken for a live credential.

Ownership decides two things. Every span says whether its value is `live`, `shared` or `dull` (a placeholder, or too few
different characters). And of the further tokens, which alone say little, only those that are live become spans; the
base kinds are spans in any case.

Counting: (hash, owner, place) are made distinct first, then counted by hash, so that a value which a third of all
documents have is spread over all tasks. Going back to the spans, values that make up 1/1000 of all candidates or more
(1000 at most, which bounds what is sent to all tasks) are looked up in every task; the others, none of them crowded,
are joined by hash. Texts are read once and never shuffled.

Defined results: a null text has no candidates; null owners are one owner, null ids one place; repeated rows are rows of
their own but one place; positions are code points, ends exclusive; spans of different kinds may overlap; those of one
start go by kind; a long text is scanned whole in one task; an empty table has no rows; columns named `secrets` are
replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

# fixed values: the patterns of the base kinds
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
#: what further tokens look like: issued prefixes, and long tokens (checked for mixed characters)
ISSUED = r"(?:ghp_|gho_|glpat-|xox[abp]-|sk_live_|sk-|AIza|SG\.)[A-Za-z0-9_.-]{16,}"
MIXED = r"[A-Za-z0-9+/_-]{24,}"
KINDS = ("assign", "access", "hex", "issued", "mixed")
BASE = KINDS[:3]
#: words that examples are made of
DULL = ("example", "sample", "placeholder", "changeme", "your", "dummy", "xxxx", "1234", "abcd", "test")
LEAST_DIFFERENT = 8
SHARED_OWNERS = 3
CROWDED = 1000

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_RUNS = [("access", re.compile(ACCESS)), ("hex", re.compile(HEX)), ("issued", re.compile(ISSUED)), ("mixed", re.compile(MIXED))]


def looks_random(value: str) -> bool:
    """Not made of an example's words, and of enough different characters."""
    low = value.lower()
    return len(set(low)) >= LEAST_DIFFERENT and not any(w in low for w in DULL)


def is_mixed(value: str) -> bool:
    """Capital and small letters and digits, as issued keys have them."""
    return (any("a" <= c <= "z" for c in value) and any("A" <= c <= "Z" for c in value)
            and sum("0" <= c <= "9" for c in value) >= 2)


def candidates(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, value), leftmost and not overlapping inside a kind. A base kind's match that is too short is
    dropped with all it covers."""
    for m in _ASSIGN.finditer(text):
        if len(m.group(2)) >= LEAST_ASSIGNED:
            yield "assign", m.start(), m.end(), m.group(2)
    for kind, pattern in _RUNS:
        for m in pattern.finditer(text):
            if kind != "mixed" or is_mixed(m.group()):
                yield kind, m.start(), m.end(), m.group()


SPAN = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("value", T.StringType()), T.StructField("random", T.BooleanType())])
_ARROW_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
                         ("random", pa.bool_())])


def _scanned(docs: DataFrame) -> DataFrame:
    """row, place, owner, carried and `spans`: start, kind number, end, SHA-256 of the value, whether it looks random."""
    schema = T.StructType([
        *[docs.schema[c] for c in ("place", "owner", "carried")], T.StructField("spans", T.ArrayType(SPAN))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            found = []
            for text in batch.column(3).to_pylist():
                spans = [
                    (start, number[kind], end, hashlib.sha256(value.encode()).hexdigest(), looks_random(value))
                    for kind, start, end, value in candidates(text or "")]
                found.append([dict(zip(SPAN.names, s, strict=True)) for s in sorted(spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(3)] + [pa.array(found, pa.list_(_ARROW_SPAN))], schema.names)

    return docs.mapInArrow(scan, schema).withColumn("row", F.monotonically_increasing_id())


def ownership(spans: DataFrame) -> DataFrame:
    """value, `uses` (spans), `places` and `owners` (different ones) of every candidate value."""
    per_place = spans.groupBy("value", "owner", "place").agg(F.count(F.lit(1)).alias("uses"))
    per_owner = per_place.groupBy("value", "owner").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("places"))
    return per_owner.groupBy("value").agg(
        F.sum("uses").alias("uses"), F.sum("places").alias("places"), F.count(F.lit(1)).alias("owners"))


def standing(owners: Column, random: Column) -> Column:
    return F.when(~random, "dull").when(owners >= SHARED_OWNERS, "shared").otherwise("live")


def scan_secrets(
    docs: DataFrame, doc_id: str = "doc_id", owner: str = "source", text: str = "text", place: str | None = None,
) -> DataFrame:
    """The documents' other columns, without the text, and `secrets`: an array of start, kind, end, value (its SHA-256),
    standing, places and owners, in the order of start and kind. `place` is the repository's column, or else the id's."""
    own = [c for c in docs.columns if c not in (text, "secrets")]
    scanned = staged(_scanned(docs.select(
        F.col(place or doc_id).alias("place"), F.col(owner).alias("owner"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("carried"),
        F.col(text).alias("text"))), "secret-spans")
    spans = scanned.filter(F.size("spans") > 0).select("row", "place", "owner", F.explode("spans").alias("span")).select(
        "row", "place", "owner", "span.*")
    owned = staged(ownership(spans), "secret-owners")
    total = owned.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    crowded = F.col("uses") * CROWDED >= total
    few = staged(owned.filter(crowded), "secret-crowded")  # CROWDED rows at most
    known = spans.join(F.broadcast(few), "value", "left")
    told = known.filter(F.col("uses").isNotNull()).unionByName(
        known.filter(F.col("uses").isNull()).drop("uses", "places", "owners").join(owned.filter(~crowded), "value"))
    names = F.array(*[F.lit(k) for k in KINDS])
    judged = told.withColumn("standing", standing(F.col("owners"), F.col("random"))).filter(
        (F.col("kind") < len(BASE)) | (F.col("standing") == "live"))
    per_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", "kind", "end", "value", "standing", "places", "owners"))).alias("found"))
    named = F.transform("found", lambda s: F.struct(
        s["start"].alias("start"), F.element_at(names, s["kind"] + 1).alias("kind"), s["end"].alias("end"),
        s["value"].alias("value"), s["standing"].alias("standing"), s["places"].alias("places"), s["owners"].alias("owners")))
    kept = scanned.select("row", "carried").join(per_row, "row", "left")
    return kept.select("carried.*", F.coalesce(named, F.array().cast(SECRETS)).alias("secrets"))


SECRETS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType()),
    T.StructField("value", T.StringType()), T.StructField("standing", T.StringType()),
    T.StructField("places", T.LongType()), T.StructField("owners", T.LongType())]))


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def of_standing(spans: Column, name: str) -> Column:
    return F.filter(spans, lambda s: s["standing"] == name)
