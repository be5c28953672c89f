"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .q_bpe import op9_bpe_encode_decode
from .q_passages import op3_repeated_passages
from .q_compression import op4_compression_quality
from .q_hamming import OP1_SQL, op1_hamming_top_k
from .q_minhash import op6_minhash_near_dedup
from .q_mixing import OP2_SQL, op2_mix_curriculum
from .q_phrases import OP11_SQL, op11_phrase_collocations
from .q_quality import op8_robust_quality_rules
from .q_repair import OP12_SQL, op12_conversation_repair
from .q_secrets import op10_secret_scan
from .q_sharding import OP13_SQL, op13_rendezvous_shards
from .q_tokenfiles import op5_token_counts
from .sql import OP3_SQL, OP6_SQL, OP7_SQL
from .q_suffixes import op7_repeated_bytes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hamming_top_k": op1_hamming_top_k,
        "op2_mix_curriculum": op2_mix_curriculum,
        "op3_repeated_passages": op3_repeated_passages,
        "op4_compression_quality": op4_compression_quality,
        "op5_token_counts": op5_token_counts,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_repeated_bytes": op7_repeated_bytes,
        "op8_robust_quality_rules": op8_robust_quality_rules,
        "op9_bpe_encode_decode": op9_bpe_encode_decode,
        "op10_secret_scan": op10_secret_scan,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_rendezvous_shards": op13_rendezvous_shards,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_hamming_top_k": OP1_SQL,
        "op2_mix_curriculum": OP2_SQL,
        "op3_repeated_passages": OP3_SQL,
        "op6_minhash_near_dedup": OP6_SQL,
        "op7_repeated_bytes": OP7_SQL,
        "op11_phrase_collocations": OP11_SQL,
        "op12_conversation_repair": OP12_SQL,
        "op13_rendezvous_shards": OP13_SQL,
    }
