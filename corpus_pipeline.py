"""Documents to training sequences: toxicity, line dedup, near-dedup, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
to the session's shared folder and reads it again for the next stage.
"""

from pyspark.sql import DataFrame, SparkSession

from merchframe.llm import line_dedup, packing, pii, setsketch, toxicity
from merchframe.llm.common import read
from merchframe.session import settle

#: Documents of this similarity of shingles, in hundredths, are near-duplicates.
NEAR = 80
#: Texts that a task hands to its Python worker at once.
BATCH_ROWS = 1_000
#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """Tasks and Python workers hold at most BATCH_ROWS texts at once, since a batch lies in both several times.

    Rows are handled one by one here, so results don't depend on it. A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(BATCH_ROWS if now <= 0 else min(now, BATCH_ROWS)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.5 go."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go; every document stays."""
    return line_dedup.dedup_lines(docs, least=1).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return setsketch.drop_near_duplicates(docs, NEAR)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    small_batches(spark)
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of a power of two of ids, one piece of one document each."""
    small_batches(spark)
    return packing.pack(docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-dedup", dedup_near),
          ("personal data", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
