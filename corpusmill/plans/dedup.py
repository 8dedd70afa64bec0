"""Duplicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup as D
from ..operators.signatures import grown
from ..session import settled, shared_folder, table

_NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"
_TOKENS = "regexp_extract_all(replace(lower(coalesce(text, '')), chr(775), ''), '[a-zа-яё0-9ßà-öø-ÿā-žșț]+')"
_SHINGLES = """CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE []::VARCHAR[] END"""


def _sig(slots: int) -> str:
    return f"""tok AS (SELECT doc_id, {_TOKENS} AS t, sha256({_NORM}) AS content_hash FROM documents),
base AS (SELECT DISTINCT doc_id, ('0x' || substr(md5(s), 1, 7))::BIGINT AS x FROM (SELECT doc_id, unnest({_SHINGLES}) AS s FROM tok)),
par AS (SELECT i, 1 + i * 2654435761 % 2147483646 AS a, (i * 40503 * 65537 + 12345) % 2147483647 AS b FROM (SELECT unnest(range(0, {slots}))::BIGINT AS i)),
slots AS (SELECT doc_id, i, min((x * a + b) % 2147483647) AS m FROM base, par GROUP BY doc_id, i),
sig AS (SELECT doc_id, list(m ORDER BY i) AS sig FROM slots GROUP BY doc_id)"""


_PAIRS = f"""{_sig(128)},
cls AS (SELECT sig, min(doc_id) AS class_id, count(*) AS members FROM sig GROUP BY sig),
bk AS (SELECT class_id, 'strict' AS variant, k AS band, array_to_string(sig[k * 16 + 1:k * 16 + 16], ',') AS bucket FROM cls, (SELECT unnest(range(0, 8)) AS k)
  UNION ALL SELECT class_id, 'loose', k, array_to_string(sig[k * 8 + 1:k * 8 + 8], ',') FROM cls, (SELECT unnest(range(0, 16)) AS k)),
cand AS (SELECT x.class_id AS a, y.class_id AS b, count(*) FILTER (variant = 'strict') AS strict, count(*) FILTER (variant = 'loose') AS loose
  FROM bk x JOIN bk y USING (variant, band, bucket) WHERE x.class_id < y.class_id GROUP BY ALL),
near AS (SELECT a, b, list_sum(list_transform(range(1, 129), lambda i: (p.sig[i] = q.sig[i])::INT))::DOUBLE / 128 AS jaccard
  FROM cand JOIN cls p ON p.class_id = a JOIN cls q ON q.class_id = b)"""


def _signed(spark: SparkSession, d: str) -> DataFrame:
    """Signatures, worked out once for all that follows."""
    return settled(D.signatures(table(spark, d, "documents")))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_groups(table(spark, d, "documents"))


def exact_classes(spark: SparkSession, d: str) -> DataFrame:
    return D.exact_members(table(spark, d, "documents"))


def normalise_text_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length(T.normalise(F.col("text"))).cast("long").alias("size"), T.content_hash(F.col("text")).alias("content_hash"))


def shingles(spark: SparkSession, d: str) -> DataFrame:
    s = D.shingles(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.size(F.array_distinct("s")).cast("long").alias("n_distinct"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    return D.signatures(table(spark, d, "documents")).where(F.size("sig") > 0).select("doc_id", F.array_join("sig", ",").alias("sig"))


def grown_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of a table that came in two deliveries, the second with all of the first in it."""
    docs, folder = table(spark, d, "documents"), shared_folder(spark)
    grown(docs.where("lang = 'en'"), folder)
    return grown(docs, folder)[0].where(F.size("sig") > 0).select("doc_id", F.array_join("sig", ",").alias("sig"))


def lsh_candidates(spark: SparkSession, d: str) -> DataFrame:
    return D.candidates(D.classes(_signed(spark, d)))


def near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return D.near_pairs(D.classes(_signed(spark, d))).select("a", "b", F.round("jaccard", 6).alias("jaccard"), "level")


def duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    """The members of the classes that lsh_candidates and near_duplicates pair."""
    signed = _signed(spark, d)
    return D.members(signed, D.classes(signed))


def duplicate_flags(spark: SparkSession, d: str) -> DataFrame:
    signed = _signed(spark, d)
    reps = D.classes(signed)
    return D.flags(signed, reps, D.near_pairs(reps))


QUERIES = {
    f.__name__: f
    for f in (
        exact_duplicates, exact_classes, normalise_text_hash, shingles, minhash_signature, grown_signatures, lsh_candidates, near_duplicates, duplicate_classes,
        duplicate_flags,
    )
}

ORACLES = {
    "exact_duplicates": f"SELECT sha256({_NORM}) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "exact_classes": f"SELECT doc_id, sha256({_NORM}) AS content_hash, min(doc_id) OVER (PARTITION BY sha256({_NORM})) AS class_id FROM documents",
    "duplicate_classes": f"WITH {_sig(128)} SELECT documents.doc_id, CASE WHEN sig IS NOT NULL THEN min(documents.doc_id) OVER (PARTITION BY sig) END AS class_id FROM documents LEFT JOIN sig USING (doc_id)",
    "normalise_text_hash": f"SELECT doc_id, length({_NORM}) AS size, sha256({_NORM}) AS content_hash FROM documents",
    "shingles": f"""WITH tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents), s AS (SELECT doc_id, {_SHINGLES} AS s FROM tok)
SELECT doc_id, len(s) AS n, len(list_distinct(s)) AS n_distinct, md5(array_to_string(s, '|')) AS digest FROM s""",
    "minhash_signature": f"WITH {_sig(128)} SELECT doc_id, array_to_string(sig, ',') AS sig FROM sig",
    "grown_signatures": f"WITH {_sig(128)} SELECT doc_id, array_to_string(sig, ',') AS sig FROM sig",
    "lsh_candidates": f"WITH {_PAIRS} SELECT a, b, strict, loose FROM cand",
    "near_duplicates": f"WITH {_PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard, CASE WHEN jaccard >= 0.88 THEN 2 ELSE 3 END AS level FROM near WHERE jaccard >= 0.71",
    "duplicate_flags": f"""WITH {_PAIRS}, hits AS (SELECT * FROM near WHERE jaccard >= 0.71),
bycls AS (SELECT sig, members > 1 OR class_id IN (SELECT a FROM hits) OR class_id IN (SELECT b FROM hits) AS f FROM cls),
bycon AS (SELECT content_hash, count(*) > 1 AS f FROM tok JOIN sig USING (doc_id) GROUP BY content_hash)
SELECT tok.doc_id, coalesce(bycls.f, false) OR coalesce(bycon.f, false) AS has_duplicates
FROM tok LEFT JOIN sig USING (doc_id) LEFT JOIN bycls ON bycls.sig = sig.sig LEFT JOIN bycon ON bycon.content_hash = tok.content_hash""",
}
