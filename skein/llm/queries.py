"""The queries of this subpackage and the SQL that checks them, by name."""

from __future__ import annotations

from skein.llm import mixing, topk, vector_dedup
from skein.llm.minhash import op4_near_duplicates
from skein.llm.packing import op6_packing
from skein.llm.pii import op10_pii
from skein.llm.quality import op5_quality
from skein.llm.secrets import op9_secrets
from skein.llm.shards import op3_sharding
from skein.llm.token_counts import op2_token_counts


def queries() -> dict:
    return {
        "op1_topk": topk.op1_topk, "op2_token_counts": op2_token_counts, "op3_sharding": op3_sharding, "op4_near_duplicates": op4_near_duplicates, "op5_quality": op5_quality,
        "op6_packing": op6_packing, "op7_mixing": mixing.op7_mixing, "op8_vector_dedup": vector_dedup.op8_vector_dedup, "op9_secrets": op9_secrets, "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.ORACLE_SQL, "op7_mixing": mixing.ORACLE_SQL, "op8_vector_dedup": vector_dedup.ORACLE_SQL}
