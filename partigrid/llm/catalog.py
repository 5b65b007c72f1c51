"""Registered queries of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partigrid.llm import maxscore, urlrules
from partigrid.llm.cube import op10_mix
from partigrid.llm.langid import op6_language
from partigrid.llm.maxscore import op7_maxscore
from partigrid.llm.packing import op2_packing
from partigrid.llm.quality import op4_quality
from partigrid.llm.quartile import op5_fingerprints
from partigrid.llm.simhash import op3_simhash
from partigrid.llm.token_store import op1_token_store
from partigrid.llm.urlrules import op8_url_filters
from partigrid.llm.warc import op9_warc

ALL = (op1_token_store, op2_packing, op3_simhash, op4_quality, op5_fingerprints, op6_language, op7_maxscore, op8_url_filters, op9_warc, op10_mix)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op7_maxscore": maxscore.ORACLE_SQL, "op8_url_filters": urlrules.ORACLE_SQL}
