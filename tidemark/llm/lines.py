"""Line dedup by content-defined chunks, in DataFrame functions only.

A text's lines are hashed; a rolling hash over neighbouring line hashes chooses where chunks end, so a chunk's
boundaries depend on the lines around them alone and shift with them. Chunks of at least two lines that also
occur earlier (by document id, then place) are removed, after their bytes were compared with the earliest.

Only hashes travel at first, and are pre-aggregated, so that a chunk in a third of all documents is one row a
task. Texts then meet their documents' repeated chunk numbers; only the bodies of those chunks travel further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, named

MEAN = 4  # mean lines of a chunk
LEAST = 2  # lines that a chunk must have to be removed


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_ends(lines: Column, mean: int = MEAN) -> Column:
    """1-based numbers of the lines that end a chunk: the last, and those whose rolling hash (31 times the line's
    hash plus that of the line before it, 0 before the first) is 0 modulo ``mean``."""

    def ends(h: Column) -> Column:
        before = lambda i: F.when(i > 1, F.element_at(h, F.greatest(i - 1, F.lit(1)))).otherwise(F.lit(0).cast("long"))
        return F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: (i == F.size(h)) | (F.pmod(F.element_at(h, i) * 31 + before(i), F.lit(mean)) == 0))

    return _let(F.transform(lines, line_hash), ends)


def chunks(text: Column, mean: int = MEAN) -> Column:
    """Array of (no, lines, body) of a text, in order; null for null. Joined by newlines they give the text."""

    def bodies(ls: Column) -> Column:
        def one(ends: Column) -> Column:
            start = lambda k: F.when(k > 0, F.element_at(ends, F.greatest(k, F.lit(1)))).otherwise(F.lit(0))
            return F.transform(ends, lambda end, k: F.struct((k + 1).alias("no"), (end - start(k)).alias("lines"), F.array_join(F.slice(ls, start(k) + 1, end - start(k)), "\n").alias("body")))

        return _let(chunk_ends(ls, mean), one)

    return _let(F.split(text, "\n"), bodies)


def repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mean: int = MEAN, least: int = LEAST) -> DataFrame:
    """``(doc_id, no)`` of every chunk that is removed: equal, byte by byte, to an earlier chunk.

    Chunks are grouped by hash first and by their bodies then, so different chunks of one hash are kept apart. A
    chunk that very many texts hold is dealt by salt.
    """
    d = docs.filter(named(doc_id).isNotNull() & named(text).contains("\n")).select(named(doc_id).alias("doc_id"), named(text).alias("text"))
    hashed = d.select("doc_id", F.explode(F.transform(F.filter(chunks(F.col("text"), mean), lambda c: c["lines"] >= least), lambda c: F.struct(c["no"].alias("no"), F.xxhash64(c["body"]).alias("h")))).alias("c"))
    hashed = cut(hashed.select("doc_id", "c.no", "c.h"))
    shared = cut(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))
    marks = hot_join(hashed, shared, "h", "_n", "doc_id").groupBy("doc_id").agg(F.collect_set("no").alias("marks"))
    met = d.join(marks, "doc_id").select("doc_id", F.explode(_let(chunks(F.col("text"), mean), lambda cs: F.transform("marks", lambda m: F.struct(m.alias("no"), F.try_element_at(cs, m)["body"].alias("body"))))).alias("c"))
    bodies = cut(met.select("doc_id", "c.*"))
    first = bodies.groupBy("body").agg(F.min(F.struct("doc_id", "no")).alias("lead"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return hot_join(bodies, cut(first), "body", "_n", "doc_id").filter(F.struct("doc_id", "no") != F.col("lead")).select("doc_id", "no").distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mean: int = MEAN, least: int = LEAST) -> DataFrame:
    """``docs`` with two more columns, ``text_kept`` and ``chunks_removed``, for every row.

    Null texts stay null, empty and one-line texts stay as they are, rows without an id are never changed, and
    a text of which every chunk is removed becomes empty. Of repeated rows of one id only chunks that also
    occur under a smaller id, or earlier in the text, go; ids should be unique. An empty table gives an empty
    result; other columns are passed through, but for ones of the two new names, which are replaced.
    """
    gone = repeated_chunks(docs, doc_id, text, mean, least).groupBy("doc_id").agg(F.collect_set("no").alias("_gone")).withColumnRenamed("doc_id", "_gone_id")
    given, numbers = docs.alias("_given"), gone["_gone"]
    of = lambda c: docs["`" + c.replace("`", "``") + "`"]
    out = given.join(gone, of(doc_id) == gone["_gone_id"], "left")
    kept = F.array_join(F.transform(F.filter(chunks(of(text), mean), lambda c: ~F.array_contains(numbers, c["no"])), lambda c: c["body"]), "\n")
    new = ("text_kept", "chunks_removed")
    return out.select(*[of(c) for c in docs.columns if c not in new], F.when(numbers.isNull(), of(text)).otherwise(kept).alias(new[0]), F.when(numbers.isNull(), 0).otherwise(F.size(numbers)).alias(new[1]))


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_removed, kept_chars, kept_md5)`` of every document."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("chunks_removed").cast("long").alias("n_removed"), F.coalesce(F.length("text_kept"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("text_kept", F.lit(""))).alias("kept_md5"))


def oracle(mean: int = MEAN, least: int = LEAST) -> str:
    """The same in DuckDB SQL; chunks are compared by their text itself."""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, (h * 31 + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {mean} = 0 AS ends FROM h),
g AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS no FROM r),
c AS (SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY doc_id, no),
k AS (SELECT *, n >= {least} AND row_number() OVER (PARTITION BY body, n >= {least} ORDER BY doc_id, no) > 1 AS gone FROM c),
o AS (SELECT doc_id, sum(gone::INT)::BIGINT AS n_removed, coalesce(string_agg(body, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, length(coalesce(kept, ''))::BIGINT AS kept_chars, md5(coalesce(kept, '')) AS kept_md5 FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id"""
