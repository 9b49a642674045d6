"""Registered queries of the training-data operators and their DuckDB SQL.

Where SQL cannot express a query (SimHash hashing, trained models, LPT, approximate search, spans by
position) there is none; ``tests/llm`` holds it against a brute-force version.
"""

from __future__ import annotations

from narrascope.llm import oracle
from narrascope.llm.ann import op2_rabit
from narrascope.llm.collocations import op12_collocations
from narrascope.llm.common import read_table
from narrascope.llm.conversations import op11_conversation_repair
from narrascope.llm.decontam import op9_decontaminate
from narrascope.llm.line_runs import op10_line_dedup
from narrascope.llm.mixing import mix
from narrascope.llm.packing import op13_packing
from narrascope.llm.pii import op7_pii
from narrascope.llm.sharding import op6_lpt_sharding
from narrascope.llm.simhash import op5_simhash
from narrascope.llm.toxicity import op3_toxicity
from narrascope.llm.url_tree import op1_url_tree
from narrascope.llm.warc import op8_warc


def _over(op, *tables: str):
    return lambda spark, sf_dir: op(*[read_table(spark, sf_dir, t) for t in tables])


def op4_mix(docs):
    """The mixture of the whole table: up to two epochs, 90 % of all tokens."""
    return mix(docs, budget_permille=900, max_epochs=2).select("doc_id", "lang", "source", "mix_domain", "mix_tokens", "mix_epoch")


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_url_tree": _over(op1_url_tree, "pages"),
        "op2_rabit": _over(op2_rabit, "embeddings"),
        "op3_toxicity": _over(op3_toxicity, "documents", "labels"),
        "op4_mix": _over(op4_mix, "documents"),
        "op5_simhash": _over(op5_simhash, "documents"),
        "op6_lpt_sharding": _over(op6_lpt_sharding, "documents"),
        "op7_pii": _over(op7_pii, "documents"),
        "op8_warc": _over(op8_warc, "pages"),
        "op9_decontaminate": _over(op9_decontaminate, "documents", "benchmark"),
        "op10_line_dedup": _over(op10_line_dedup, "documents"),
        "op11_conversation_repair": _over(op11_conversation_repair, "conversations"),
        "op12_collocations": _over(op12_collocations, "documents"),
        "op13_packing": _over(op13_packing, "documents"),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
