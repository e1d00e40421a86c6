"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it again. All stages but the last return the columns of documents.

Defined cases, for every stage: rows are told apart by their contents and never
by doc_id alone, so null and repeated ids lose no text; a null text is an empty
one; columns beside those of documents go through unchanged whatever their name;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import kneser_ney, minhash, mixing, packing, secrets
from brindle.llm.text import table, through_table, words_of


def as_struct(docs: DataFrame) -> Column:
    """The whole row, so that no column of it clashes with those of a stage."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    The verdict depends on language and text alone, so equal rows share it and ties need no rule. Null and empty texts
    stay; a null language is judged by the model of all languages. Texts of any length are scored whole.
    """
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary"))
    keyed = docs.select("doc_id", "lang", "text", key.alias("key"))
    rejected = kneser_ney.classify(keyed, table(spark, sf_dir, "labels"), carry=("key",)).where("NOT kept").select("key").distinct()
    rows = docs.select(as_struct(docs).alias("row"), key.alias("key"))
    return rows.join(rejected.hint("merge"), "key", "left_anti").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, one with the least doc_id.

    Repeated rows are a class; of ties (equal doc_id and text) one row stays, chosen by a hash of the row. Null ids
    count as the greatest. Rows without words all stay.
    """
    return minhash.one_of_each(docs)


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; no row goes. Null texts stay null; n_chars is that of the new text, and unchanged for a null one."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document stands as often as the mix takes it, three times at most, whole or with the runs of words that are taken.

    Documents of which no word is taken go, those without words too. A null source is the last source; repeated rows
    are documents of their own. Whole texts stay as they are; of a part, words are joined by one space.
    """
    rows = mixing.mix(docs, carry=True).select("row", "size", F.explode(F.filter("spans", lambda x: F.size(x) > 0)).alias("runs"))
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    words = words_of(F.col("row.text"))
    part = F.array_join(F.flatten(F.transform("runs", lambda x: F.slice(words, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))), " ")
    rows = rows.withColumn("part", F.when(taken < F.col("size"), part))
    row = F.col("row").withField("text", F.coalesce("part", "row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.coalesce(F.length("part").cast(docs.schema["n_chars"].dataType), "row.n_chars"))
    return rows.select(row.alias("row")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of every row; a null or empty text is its end id alone, repeated rows are packed as often as they stand."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_copies),
    ("secret scan", secret_free),
    ("source mixing", mixed),
    ("packing", packed),
]

#: No stage but mixing can be said in SQL; the tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
