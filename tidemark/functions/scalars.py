"""Scalar functions: text, ids, urls, dates, numbers. All are column expressions; one needs Unicode tables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ratings' labels and numbers, and the ports that a url need not name.
RATINGS = {"strongly_negative": -2, "negative": -1, "neutral": 0, "positive": 1, "strongly_positive": 2, "not_mentioned": None}
DEFAULT_PORTS = {"http": "80", "https": "443"}
#: Unicode's white space, and the separators that Python counts as such.
SPACE = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def optional_text(c: Column) -> Column:
    """Stripped of Unicode white space; null where nothing is left."""
    return F.nullif(F.btrim(c, F.lit(SPACE)), F.lit(""))


def lean(spark: SparkSession, mb: int = 4) -> None:
    """Let Arrow batches end at ``mb`` megabytes where the session sets no limit of its own, so that what a Python
    task holds does not follow from how long the texts of 10,000 rows are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(mb << 20))


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def normalized_body(c: Column) -> Column:
    """NFKC, case-folded, white space collapsed. Plain ASCII rows stay in the JVM."""
    lean(SparkSession.active())
    plain = F.trim(F.regexp_replace(F.lower(c), r"[\s\x1c-\x1f]+", " "))
    ascii_only = F.length(c) == F.octet_length(c)
    return F.when(ascii_only, plain).otherwise(_folded(F.when(~ascii_only, c)))


def prefixed_sha(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.sha2(c, 256))


def article_id(uri: Column, url: Column, prefix: str = "event_registry") -> Column:
    return F.coalesce(F.concat(F.lit(prefix + ":"), uri), prefixed_sha("url_sha256", url))


def json_array_id(version: int, *cols: Column) -> Column:
    """SHA-256 of the compact JSON array ``[version, "a", "b", ...]``."""
    return F.sha2(F.concat(F.lit(f"[{version},"), F.substring(F.to_json(F.array(*cols)), F.lit(2), F.lit(1 << 30))), 256)


def host_of(c: Column) -> Column:
    """Lower-cased host of an absolute url: no user, port or final dot; null if there is none."""
    host = F.rtrim(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit("."))
    return F.when((host != "") & ~host.rlike(r"\s"), host)


def homepage(c: Column) -> Column:
    """``https://host`` of a url or bare host, one ``www.`` dropped; null for other schemes."""
    s = optional_text(c)
    full = F.when(s.contains("://"), s).otherwise(F.concat(F.lit("https://"), s))
    host = F.regexp_replace(host_of(full), r"^www\.", "")
    return F.when(full.rlike(r"^(?i:https?)://") & (host != "") & host.isNotNull(), F.concat(F.lit("https://"), host))


def canonical_url(c: Column) -> Column:
    """Scheme and host lower-cased, default port and fragment dropped, empty path ``/``; null if not plain http(s)."""
    s = optional_text(c)
    pattern = r"^(?i)(https?)://(\[[^\]]*\]|[^/?#:@]*)(?::([0-9]*))?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$"
    scheme, port = F.lower(F.regexp_extract(s, pattern, 1)), F.regexp_extract(s, pattern, 3)
    host = F.rtrim(F.lower(F.regexp_extract(s, pattern, 2)), F.lit("."))
    path, query = F.regexp_extract(s, pattern, 4), F.regexp_extract(s, pattern, 5)
    default = (port == "") | ((scheme == "http") & (port == DEFAULT_PORTS["http"])) | ((scheme == "https") & (port == DEFAULT_PORTS["https"]))
    bad_port = (port != "") & (F.try_to_number(port, F.lit("99999999")) > 65535)
    out = F.concat(scheme, F.lit("://"), host, F.when(default, "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query))
    return F.when((host != "") & ~host.rlike(r"\s") & ~F.coalesce(bad_port, F.lit(False)), out)


def evidence_urls(c: Column) -> Column:
    """Distinct urls of a text in order, without the punctuation that follows them."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"https?://[^\s<>]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"""[.,);"']+$""", "")))


def iso_date(c: Column) -> Column:
    """A strict ``YYYY-MM-DD`` date, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def iso_timestamp(c: Column) -> Column:
    """An ISO timestamp with an offset or ``Z``; null for naive ones."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def local_date(ts: Column, zone: str) -> Column:
    """The date of an instant in a time zone (the session's zone being UTC)."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def day_first_date(c: Column) -> Column:
    return F.try_to_date(c, "d/M/yyyy")


def review_date(c: Column) -> Column:
    """An ISO date, or a spreadsheet's serial day (day 0 is 1899-12-30)."""
    return F.coalesce(iso_date(c), F.when(c.rlike(r"^\d+(\.0+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.expr("1") * c.cast("double").cast("int"))))


def whole_number(c: Column, positive: bool = False) -> Column:
    """A non-negative (or positive) whole number from text, else null."""
    n = F.when(c.rlike(r"^\s*\d+(\.0+)?\s*$"), F.trim(c).cast("double").cast("long"))
    return F.when(n > 0, n) if positive else n


def season_code(season: Column) -> Column:
    two = lambda x: F.lpad((x % 100).cast("string"), 2, "0")
    return F.concat(two(season), two(season + 1))


def rating_number(label: Column) -> Column:
    """The number of a rating's label; null for ``not_mentioned`` and unknown labels."""
    return F.element_at(F.create_map(*[x for k, v in RATINGS.items() for x in (F.lit(k), F.lit(v).cast("int"))]), label)


def difference_kind(a: Column, b: Column) -> Column:
    """How two ratings differ: in mention, polarity, neutrality or intensity; null if they agree."""
    return F.when(a.eqNullSafe(b), None).when(a.isNull() | b.isNull(), "mention").when(a * b < 0, "polarity").when((a == 0) | (b == 0), "neutral").otherwise("intensity")


def row_log_loss(p_true: Column) -> Column:
    return -F.ln(F.least(F.greatest(p_true, F.lit(1e-15)), F.lit(1.0)))


def argmax_label(labels: list[str], probs: list[Column]) -> Column:
    """The first label of the greatest probability."""
    arr = F.array(*probs)
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(arr, F.array_max(arr)).cast("int"))


def utf16_chunks(c: Column, limit: int = 32767) -> Column:
    """Pieces of a text of at most ``limit`` UTF-16 units; no surrogate pair is split."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            if len(x.encode("utf-16-le", "surrogatepass")) == 2 * len(x):  # no pairs
                return [x[i : i + limit] for i in range(0, len(x), limit)] or [""]
            out, now, size = [], [], 0
            for ch in x:
                w = 2 if ord(ch) > 0xFFFF else 1
                if size + w > limit:
                    out.append("".join(now))
                    now, size = [], 0
                now.append(ch)
                size += w
            return [*out, "".join(now)]

        return s.map(one)

    return F.when(F.length(c) * 2 <= limit, F.array(c)).otherwise(cut(c))
