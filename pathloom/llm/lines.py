"""Line dedup: lines that many documents share go, except in one document.

A line's key is the line without white space at its ends, A-Z in lower case.
Keys that are long enough are exploded as 128-bit hashes, each once a document;
hashes found in enough documents name the lines to drop, and every document is
put together again from its other lines by position. DataFrame functions only.

Only hashes travel to be counted. The counts go through partial sums, so a line
of every document is no hot key; the hashes are joined to those that are shared
by an ordinary join, whose large partitions Spark splits. The texts travel once,
to the list of the lines that their document loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flagged, fresh, stored, text_or_empty

#: Code points of a key that counts, and documents that make it shared.
LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
#: White space at a line's ends: space and 0x09-0x0D.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def hashed(line: Column, least_chars: int) -> Column:
    """MD5 of a line's key, null where the key is too short to count."""
    key = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(key) >= least_chars, F.unhex(F.md5(F.translate(key, UPPER, LOWER).cast("binary"))))


def gone_positions(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """One row per document that loses lines: line_doc, line_text (MD5 of its text), gone (numbers of the lines, from 0).

    The document with the largest identifier keeps the lines of a shared key.
    """
    body = text_or_empty(text)
    keyed = docs.select(F.col(key).alias("line_doc"), F.unhex(F.md5(body.cast("binary"))).alias("line_text"), F.posexplode(F.transform(lines_of(body), lambda x: hashed(x, least_chars))).alias("pos", "line_key"))
    found = stored(keyed.filter("line_key is not null"), "line_keys")
    # A null identifier is one document, and the smallest.
    name = F.struct(F.col("line_doc").isNotNull().alias("known"), F.col("line_doc"))
    often = found.groupBy("line_key").agg(F.count_distinct(name).alias("documents"), F.max(name).alias("last")).filter(F.col("documents") >= least_documents)
    often = stored(often.select("line_key", F.col("last.line_doc").alias("last_doc")), "shared_lines")
    # The bitmap only saves the shuffle of lines that nobody shares; the join decides.
    maybe = flagged(found, F.col("line_key"), often.select("line_key"), "maybe").filter("maybe").drop("maybe")
    lost = maybe.join(often, "line_key").filter(~F.col("line_doc").eqNullSafe(F.col("last_doc")))
    return lost.groupBy("line_doc", "line_text").agg(F.collect_set("pos").alias("gone"))


def stripped(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, dict[str, str]]:
    """docs plus n_lines (before dropping), n_dropped and kept (the text that is left); names avoid clashes.

    A null or empty text is one empty line. A document that loses all its lines
    keeps the empty text. Rows that repeat an identifier are one document in the
    counts and lose the same keys, each from its own lines; a null identifier
    counts as one more document, the smallest. All lines of a key stay in the
    document that keeps it. An empty table gives an empty result; other columns
    are carried along. Returns the frame and the added names.
    """
    count, dropped, kept, gone, of, body = fresh(docs, "n_lines", "n_dropped", "kept", "gone_lines", "gone_doc", "gone_text")
    lost = gone_positions(docs, key, text, least_chars, least_documents).select(F.col("line_doc").alias(of), F.col("line_text").alias(body), F.col("gone").alias(gone))
    same = F.col(key).eqNullSafe(F.col(of)) & (F.unhex(F.md5(text_or_empty(text).cast("binary"))) == F.col(body))
    rows = docs.join(lost, same, "left")
    lines = lines_of(text_or_empty(text))
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = F.when(F.col(gone).isNull(), text_or_empty(text)).otherwise(F.array_join(F.transform(stays, lambda i: F.get(lines, i)), "\n"))
    n = F.size(lines).cast("long")
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], n.alias(count), F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(dropped), left.alias(kept))
    return rows, {"n_lines": count, "n_dropped": dropped, "kept": kept}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = stripped(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}')"
ORACLE = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
  SELECT *, {_KEY} AS line_key FROM numbered
), often AS (
  SELECT line_key, max(doc_id) AS last FROM keyed WHERE length(line_key) >= {LEAST_CHARS}
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}
), marked AS (
  SELECT k.*, o.last IS NOT NULL AND o.last <> k.doc_id AS gone FROM keyed k LEFT JOIN often o USING (line_key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
