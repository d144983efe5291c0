"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op7_bpe_roundtrip
from .chunks import op9_substring_dedup
from .huffman import op6_huffman_tokens
from .langid import op3_language_id
from .lines import OP5_SQL, op5_line_dedup
from .mixing import op4_mixing
from .ogg import op8_ogg_media
from .simhash import op2_simhash_near_dedup
from .topk import op10_exact_topk
from .urls import op1_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_simhash_near_dedup,
        op3_language_id,
        op4_mixing,
        op5_line_dedup,
        op6_huffman_tokens,
        op7_bpe_roundtrip,
        op8_ogg_media,
        op9_substring_dedup,
        op10_exact_topk,
    )
}

OP10_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
  where embedding is not null and vec_id is not null and not list_bool_or(list_transform(embedding, lambda x: x is null or not isfinite(x)))
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op10_exact_topk": OP10_SQL}
