"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontam import op9_decontamination
from .html_extract import op7_html
from .langid import op2_langid
from .mixing import OP1_SQL, op1_mixing
from .simhash import op6_simhash
from .suffix_dedup import op4_suffix_dedup
from .tiff import op8_tiff
from .tokencount import op3_token_counts
from .toxicity import op10_toxicity
from .warc import op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_langid": op2_langid,
    "op3_token_counts": op3_token_counts,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_html": op7_html,
    "op8_tiff": op8_tiff,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {"op1_mixing": OP1_SQL}
