"""A corpus, stage by stage: rules, near duplicates, personal data, mixture, sequences.

Each stage takes the documents that the one before it kept and returns
documents again; the last returns the pieces of packed sequences.  All stages
hand on the five COLUMNS of documents and leave out any other column.  Texts of
any length are taken whole, one in memory at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewatch.llm import jaccard, mixing, packing, pii, quality
from gatewatch.llm.queries import vocabulary
from gatewatch.llm.tables import sized, stash, sweep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and those that their host and their own failures make junk.

    A null or empty text goes, a null source is a host, repeated rows are judged
    each, an empty table stays empty.  A long text is counted whole, its words in
    one array; columns beside COLUMNS go.
    """
    return quality.posterior(docs.select(*COLUMNS)).where("wanted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the document of the least id stays, once.

    Columns beside COLUMNS go.  Texts without words and rows without an id are near nothing and stay.  Rows
    that share an id are one document: they stay or go together, and equal
    texts among them stay once.  Texts of any length are compared whole.
    """
    docs = docs.select(*COLUMNS)
    gone = stash(jaccard.classes(docs, k=5, percent=80).where("n_shingles > 0 and doc_id != component_id").select("doc_id").distinct(), "gone")
    shared = stash(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "shared-ids")
    stay = docs.join(sized(gone), "doc_id", "left_anti")
    if not shared.isEmpty():
        rest = F.struct("lang", "source", "n_chars")
        once = stay.join(sized(shared), "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(rest).alias("rest")).select("doc_id", "text", "rest.*")
        stay = stay.join(sized(shared), "doc_id", "left_anti").unionByName(once)
    return stay.select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in texts are replaced by their kind; n_chars follows.

    Null texts and null n_chars stay null, repeated rows are masked alike, an
    empty table stays empty.  A long text is searched whole, in time linear in
    it; columns beside COLUMNS go.
    """
    masked = pii.masked(pii.find(docs.select(*COLUMNS)))
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A text without words is there as often as its source is taken whole.  A
    null source is one of its own, repeated rows share their copies, an empty
    table stays empty.  Of a long text only the number of words counts, so it is
    a large share of its source; columns beside COLUMNS go.
    """
    mixed = mixing.mix(docs.select(*COLUMNS)).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of 4096 tokens; other columns than doc_id and text are not looked at.

    A null id is kept, a null or empty text is one token, repeated rows are
    packed each, an empty table gives no pieces.  A text of more tokens is cut
    into as many pieces as it takes.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Learned patterns, random rounding and packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
