"""The training-data queries by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .imatch import op3_imatch
from .langid import op9_language_id
from .media import op6_media_columns
from .mixing import op8_mixing
from .packing import op5_packing
from .pii import op10_pii
from .quality import op4_quality
from .sharding import op1_sharding
from .simhash import op2_simhash
from .substring import ORACLE_SQL as SUBSTRING_SQL
from .substring import op7_substring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_imatch": op3_imatch,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_media_columns": op6_media_columns,
    "op7_substring": op7_substring,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {"op7_substring": SUBSTRING_SQL}
