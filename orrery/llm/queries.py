"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontam, jaccard, ordinal, packing, pii, planes, quality, sharding, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_jaccard_join": jaccard.op2_jaccard_join,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_pii": pii.op4_pii,
        "op5_warc": warc.op5_warc,
        "op6_ordinal_quality": ordinal.op6_ordinal_quality,
        "op7_bitplanes": planes.op7_bitplanes,
        "op8_packing": packing.op8_packing,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.ORACLE_SQL, "op2_jaccard_join": jaccard.ORACLE_SQL, "op5_warc": warc.ORACLE_SQL, "op9_quality_rules": quality.ORACLE_SQL}
