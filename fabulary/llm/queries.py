"""The registered queries of this subpackage; `__spark_entry__` adds them when it can import this module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fabulary.llm.alignment import op12
from fabulary.llm.bpe import op6
from fabulary.llm.fingerprint import op10
from fabulary.llm.html_text import op4
from fabulary.llm.media import op9
from fabulary.llm.mixing import op2
from fabulary.llm.quality import op1
from fabulary.llm.secret_scan import op7
from fabulary.llm.sharding import op3
from fabulary.llm.simhash import op8
from fabulary.llm.suffix_tree import op5
from fabulary.llm.toxicity import op11
from fabulary.llm.whitening import op13

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1,
    "op2_mixing": op2,
    "op3_sharding": op3,
    "op4_html_text": op4,
    "op5_suffix_tree": op5,
    "op6_byte_bpe": op6,
    "op7_secrets": op7,
    "op8_simhash": op8,
    "op9_media_png": op9,
    "op10_fingerprint": op10,
    "op11_toxicity": op11,
    "op12_alignment": op12,
    "op13_whitening": op13,
}

#: DuckDB SQL for those that SQL can express.
ORACLE: dict[str, str] = {}
