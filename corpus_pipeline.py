"""A corpus pipeline: toxic documents go, one of each group of near copies stays, contaminated documents go, secrets are masked, what is left is packed.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows,
an empty table and columns of any further names, which come through as they are: inside
a stage all columns have names of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, queries, secrets, toxicity
from tidemark.llm.common import dropped, is_small, phase, stored


class Aside:
    """``docs`` with its columns named by their places, so that no operator's columns clash with them."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.docs = docs.toDF(*(f"_c{i}" for i in range(len(self.names))))

    def __call__(self, name: str) -> str:
        return f"_c{self.names.index(name)}"

    def back(self, df: DataFrame, **changed: Column) -> DataFrame:
        return df.select(*(changed.get(n, F.col(f"_c{i}")).alias(n) for i, n in enumerate(self.names)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, as they are.

    Null and empty texts get the score of a text without known terms; repeated rows
    stay repeated. Without labels every score is 0.5, and no document is left.
    """
    a = Aside(docs)
    index = toxicity.train(docs.select("doc_id", "text"), queries.table(spark, sf_dir, "labels"))
    return a.back(toxicity.score_toxicity(a.docs, index, text=a("text"), evidence=0).where("score < 0.5"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at 0.8: the one with the smallest id.

    A row is its id and text: ids may repeat or be null (nulls last, then by the text's
    MD5). Rows that repeat both are one document, of which the row with the least other
    columns (as JSON) stays; those without words (null and empty texts too) all stay.
    """
    a = Aside(docs)
    key, text = F.col(a("doc_id")), F.col(a("text"))
    with phase() as made:
        groups = jaccard.ngram_groups(a.docs, a("doc_id"), a("text"), k=5, num=80, den=100, identity=True).where("n_shingles > 0")
        groups = stored(groups.select(F.col(a("doc_id")).alias("id"), "text_hash", "label"), "groups")
    dropped(*(x for x in made if x is not groups))
    row = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    several = groups.groupBy("label").agg(F.min(row).alias("stays"), F.max(row).alias("other")).where("stays <> other").select("label", "stays")
    gone = groups.join(several, "label").where(row != F.col("stays")).select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = stored(gone, "gone")
    dropped(groups)
    left = a.docs.join(F.broadcast(gone) if is_small(gone) else gone, key.eqNullSafe(F.col("_id")) & (F.md5(F.encode(text, "UTF-8")) == F.col("_hash")), "left_anti")
    ids = stored(a.docs.groupBy(key.alias("_again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_again"), "repeated")
    if ids.isEmpty():
        return a.back(left)
    same = key.eqNullSafe(F.col("_again"))
    words = F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")  # as the shingles' words
    again = left.where(words).join(ids, same, "left_semi")
    rest = F.to_json(F.struct(*(F.col(c) for c in a.docs.columns if c not in (a("doc_id"), a("text"))), F.lit(0)))
    once = again.groupBy(key.alias("_id"), text.alias("_text")).agg(F.min_by(F.struct(*a.docs.columns), rest).alias("_row")).select("_row.*")
    return a.back(left.where(words).join(ids, same, "left_anti").unionByName(once).unionByName(left.where(~words)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth are in passages of the benchmark.

    Null and empty texts have no words and stay; repeated rows are judged alike; an empty
    benchmark removes nothing.
    """
    a = Aside(docs)
    found = decontaminate.find_passages(a.docs, queries.table(spark, sf_dir, "benchmark"), text=a("text"))
    return a.back(found.where(~decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words"))))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and ``n_chars`` (if there is such a column) of the masked text.

    Null and empty texts stay as they are; repeated rows are masked alike.
    """
    a = Aside(docs)
    found = secrets.find_secrets(a.docs, text=a("text"), redact="[secret]")
    if "n_chars" not in a.names:
        return a.back(found)
    kind = docs.schema["n_chars"].dataType
    return a.back(found, n_chars=F.when(F.size("secret_spans") > 0, F.length(a("text")).cast(kind)).otherwise(F.col(a("n_chars"))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document is packed: one row for each, null and empty texts (of one byte, the separator) and repeated rows too."""
    return queries.packed(docs)


STAGES = [("toxicity", toxicity_stage), ("ngram_jaccard_join", jaccard_stage), ("decontamination", decontamination_stage), ("secret_scans", secret_stage), ("best_fit_packing", packing_stage)]

#: Nearest neighbours and best-fit bins can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with phase() as made:
            after = stored(stage(spark, docs, sf_dir), name)
        dropped(docs, *(x for x in made if x is not after))
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
