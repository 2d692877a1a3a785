"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm.chat_format import OP9_SQL, op9_chat_format
from tidebook.llm.decontamination import op1_decontamination
from tidebook.llm.html_extraction import op13_html_extraction
from tidebook.llm.lm_scoring import op5_lm_scoring
from tidebook.llm.media import op6_media_columns
from tidebook.llm.mixing import OP8_SQL, op8_source_mix
from tidebook.llm.near_dedup import op4_near_dedup
from tidebook.llm.periodic_runs import op11_periodic_runs
from tidebook.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from tidebook.llm.quality import op2_quality
from tidebook.llm.secrets import op10_secret_scan
from tidebook.llm.substring_dedup import op7_substring_dedup
from tidebook.llm.token_output import op3_token_output


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_decontamination,
            op2_quality,
            op3_token_output,
            op4_near_dedup,
            op5_lm_scoring,
            op6_media_columns,
            op7_substring_dedup,
            op8_source_mix,
            op9_chat_format,
            op10_secret_scan,
            op11_periodic_runs,
            op12_prefix_trie,
            op13_html_extraction,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_source_mix": OP8_SQL, "op9_chat_format": OP9_SQL, "op12_prefix_trie": OP12_SQL}
