"""The corpus pipeline: quality, recurring lines, near duplicates, source mix, packing.

Each stage is a function of (session, documents, table folder) to a DataFrame; ``run`` writes every
stage's rows as Parquet below the shared folder and reads them again for the next.

All stages take a null text as empty, treat each repeated row alike, and give an empty table for an
empty one; the stages but the last keep all columns, extra ones too. Ties go by the document's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.llm import common
from deskloom.llm.line_dedup import drop_recurring_lines
from deskloom.llm.mixing import mix
from deskloom.llm.ngram_join import representatives
from deskloom.llm.packing import pack
from deskloom.llm.quality import fit


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (operator 7), as they are."""
    common.ship(spark)
    scorer = fit(docs, common.labels(spark, sf_dir))
    return docs.where(scorer(common.text_of("text")) >= 0.5)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their recurring lines dropped (operator 10) and ``n_chars`` counted anew."""
    cleaned = drop_recurring_lines(docs)
    counted = {"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(counted).select(*[common.col(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each component of near duplicates (operator 6)."""
    common.ship(spark)
    return representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for (operator 5)."""
    return mix(docs).select(*[common.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences (operator 3)."""
    common.ship(spark)
    return pack(docs)


STAGES = [
    ("quality", good_quality),
    ("lines", without_recurring_lines),
    ("near_duplicates", one_of_each_group),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None
