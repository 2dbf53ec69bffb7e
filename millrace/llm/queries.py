"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query name -> module that holds the function of that name
NAMES = {
    "op1_shard": "sharding",
    "op2_quality": "quality",
    "op3_lines": "linededup",
    "op4_simhash": "simhash",
    "op5_decontaminate": "decontam",
    "op6_bpe": "bpe",
    "op7_licenses": "licenses",
    "op8_toxicity": "toxicity",
    "op9_urls": "urlfilter",
    "op10_language": "langid",
}


def queries() -> dict:
    return {name: getattr(import_module(f"millrace.llm.{module}"), name) for name, module in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in NAMES.items():
        sql = getattr(import_module(f"millrace.llm.{module}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
