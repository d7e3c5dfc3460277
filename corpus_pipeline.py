"""A training-data pipeline: five stages over ``documents``, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import langid, lines, minhash, mixing, unigram
from tidemark.llm.common import cut, discard, lean, named, stored, table


#: A language is found where the network gives one more than all others together.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found; ``lang`` stays as it was labelled.

    Those without a letter go, and those whose likeliest language has a probability of at most LEAST_SCORE. Where
    nothing is labelled and so nothing can be learned, all with a letter stay.
    """
    model = langid.fit(docs, langid.is_held_out())
    if not model[1]:
        return docs.filter(F.col("text").rlike(langid.LETTER))
    place = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    numbered = docs.select(*[named(c).alias(p) for c, p in place.items()])
    told = langid.predict(numbered, model, keep=tuple(place.values()), text=place["text"])
    return told.filter((F.col("lang_pred") != langid.UND) & (F.col("score") > LEAST_SCORE)).select(*[F.col(p).alias(c) for c, p in place.items()])


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that stand in an earlier document; texts that lose all of it go."""
    out = lines.dedup_lines(docs)
    whole = F.col("chunks_removed") == 0
    out = out.filter(whole | (F.col("text_kept") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text_kept")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("text_kept")).select(*map(named, docs.columns))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id. Rows without an id stay."""
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*map(named, docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or more rows each.

    Rows without an id or with a repeated one have each a share of their own in the mix; of those that agree in id
    and number of words, those of lesser source, then text, are taken less often.
    """
    times = (F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    mixed = cut(mixing.mix(docs).select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), times.alias("__times")))
    if mixed.groupBy("__id").count().filter((F.col("count") > 1) | F.col("__id").isNull()).isEmpty():
        out = docs.join(mixed.filter("__times > 0"), F.col("doc_id") == F.col("__id"))
    else:
        number = lambda of, *order: F.row_number().over(Window.partitionBy(*of).orderBy(*order))
        left = docs.withColumn("__words", mixing.n_words("text")).withColumn("__no", number(("doc_id", "__words"), "source", "text"))
        right = mixed.withColumn("__place", number(("__id", "__size"), "__times"))
        out = left.join(right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__words") == F.col("__size")) & (F.col("__no") == F.col("__place"))).filter("__times > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*map(named, docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_pieces, ids, exact)``: the pieces of every document."""
    return unigram.encode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("MinHash near-dedup", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Trained weights, shuffles by fingerprint and piece search have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's rows. A stage's table goes once the next stands."""
    lean(spark)
    docs = given = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if docs is not given:
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
