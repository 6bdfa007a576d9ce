"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deskloom.llm.collocations import OP12_SQL, op12_collocations
from deskloom.llm.common import ship
from deskloom.llm.decontaminate import OP13_SQL, op13_decontamination
from deskloom.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from deskloom.llm.fingerprints import op4_fingerprints
from deskloom.llm.html_text import op2_html_text
from deskloom.llm.line_dedup import OP10_SQL, op10_line_dedup
from deskloom.llm.merkle import OP11_SQL, op11_merkle_manifest
from deskloom.llm.mixing import OP5_SQL, op5_mixing
from deskloom.llm.ngram_join import op6_ngram_join
from deskloom.llm.packing import op3_packing
from deskloom.llm.quality import op7_quality
from deskloom.llm.sharding import op9_sharding
from deskloom.llm.substring_dedup import op8_substring_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_text": _shipped(op2_html_text),
    "op3_packing": _shipped(op3_packing),
    "op4_fingerprints": op4_fingerprints,
    "op5_mixing": op5_mixing,
    "op6_ngram_join": _shipped(op6_ngram_join),
    "op7_quality": _shipped(op7_quality),
    "op8_substring_dedup": _shipped(op8_substring_dedup),
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle_manifest": _shipped(op11_merkle_manifest),
    "op12_collocations": _shipped(op12_collocations),
    "op13_decontamination": _shipped(op13_decontamination),
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op5_mixing": OP5_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_collocations": OP12_SQL,
    "op13_decontamination": OP13_SQL,
}
