"""The opN_ queries: thin uses of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm.block_dedup import block_dedup
from framelake.llm import chat
from framelake.llm.decontaminate import contamination
from framelake.llm.fingerprint import fingerprints
from framelake.llm.language_id import language_id
from framelake.llm.licenses import TEMPLATES, license_scan
from framelake.llm.minhash_dedup import near_duplicates
from framelake.llm.sentencepiece_fst import tokenise
from framelake.llm.suffix_dedup import suffix_dedup
from framelake.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), threshold=0.8)


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op3_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "class_id")


def op4_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return block_dedup(docs, width=35, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenise(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), held_out_fold=2, folds=4)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out_fold=0, folds=5)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return suffix_dedup(docs, width=50, texts=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"), threshold=0.8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_decontamination, op2_perspectives, op3_probminhash_dedup, op4_block_dedup, op5_sentencepiece, op6_language_id, op7_fingerprints, op8_toxicity, op9_suffix_dedup, op10_license_scan)
    return {f.__name__: f for f in every}


_WORDS = """list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""


def _containment_sql(queries: str, result: str, beside: str = "", short: bool = False) -> str:
    """All pairs of document and query by a join on shingles; ``queries`` gives text and other columns.  ``short``:
    queries of one to four words are one shingle of their own length."""
    few = "UNION SELECT k, array_to_string(w, ' ') FROM qw WHERE len(w) BETWEEN 1 AND 4" if short else ""
    runs = """UNION SELECT DISTINCT r, g FROM (SELECT r, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT len(w) AS n FROM qw WHERE len(w) BETWEEN 1 AND 4)))
          WHERE g IN (SELECT g FROM qs)""" if short else ""  # fmt: skip
    return f"""
WITH q AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM ({queries})),
qw AS (SELECT k, {_WORDS} AS w FROM q),
qs AS MATERIALIZED (SELECT DISTINCT k, g FROM (SELECT k, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM qw)) {few}),
qn AS (SELECT k, count(*) AS n FROM qs GROUP BY 1),
dw AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
ds AS MATERIALIZED (SELECT DISTINCT r, g FROM (SELECT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM dw)) WHERE g IN (SELECT g FROM qs) {runs}),
c AS (SELECT r, k, count(*) AS s FROM ds JOIN qs USING (g) GROUP BY 1, 2),
m AS MATERIALIZED (SELECT r, k, s, n, s / n AS containment FROM c JOIN qn USING (k) WHERE s >= 0.8 * n - 1e-9){beside}
SELECT doc_id, {result} FROM m JOIN q USING (k) JOIN dw USING (r)"""


# Matches of which the document has more in another license's, and nothing beside it.
_BEST_SQL = """,
p AS (SELECT a.r, a.k FROM m a JOIN m b ON a.r = b.r AND b.containment > a.containment JOIN q x ON x.k = a.k JOIN q y ON y.k = b.k AND x.license IS DISTINCT FROM y.license
      JOIN qs u ON u.k = a.k JOIN ds ON ds.r = a.r AND ds.g = u.g JOIN qs v ON v.k = b.k AND v.g = u.g GROUP BY a.r, a.k, b.k, a.s HAVING count(*) = a.s)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLOCK_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT r, i, true AS hit FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
judged AS (SELECT r, i, x, coalesce(i - max(CASE WHEN hit THEN i END) OVER (PARTITION BY r ORDER BY i) < 35, false) AS gone FROM word LEFT JOIN rep USING (r, i)),
kept AS (SELECT r, count(*) FILTER (gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS k FROM judged GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

_SUFFIX_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS x FROM documents),
byte AS MATERIALIZED (SELECT r, doc_id, i, CASE WHEN i <= octet_length(x) - 49 THEN md5(x[i:i + 49]) END AS h, hex(x[i:i]) AS b FROM (SELECT *, unnest(range(1, octet_length(x) + 1)) AS i FROM d)),
first AS (SELECT h, min(doc_id) AS least FROM byte WHERE h IS NOT NULL GROUP BY h),
judged AS (SELECT r, i, b, coalesce(i - max(CASE WHEN least < doc_id THEN i END) OVER (PARTITION BY r ORDER BY i) < 50, false) AS gone FROM byte LEFT JOIN first USING (h)),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS rise FROM judged),
kept AS (SELECT r, count(*) FILTER (gone) AS n, count(*) FILTER (rise) AS s, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS k FROM edge GROUP BY r)
SELECT doc_id, octet_length(x)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    notices = ", ".join(f"({i}::BIGINT, {_quoted(k)}, {_quoted(t)})" for i, (k, t) in enumerate(TEMPLATES))
    licenses = _containment_sql(f"SELECT * FROM (VALUES {notices}) t(template_id, license, text)", "template_id, license, n AS n_template, s AS n_shared, containment", _BEST_SQL, short=True)
    return {
        "op1_decontamination": _containment_sql("SELECT item_id, text FROM benchmark", "item_id, n AS n_item, s AS n_shared, containment"),
        "op2_perspectives": chat.oracle(),
        "op4_block_dedup": _BLOCK_SQL,
        "op9_suffix_dedup": _SUFFIX_SQL,
        "op10_license_scan": f"{licenses} WHERE (r, k) NOT IN (SELECT r, k FROM p)",
    }
