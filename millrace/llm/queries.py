"""The queries that apply the corpus operators to whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from millrace.llm.alignment import op13
from millrace.llm.clustering import ORACLE as CLUSTER_SQL
from millrace.llm.clustering import op12
from millrace.llm.dedup import op9
from millrace.llm.langid import op4
from millrace.llm.media import op8
from millrace.llm.mixing import ORACLE as MIX_SQL
from millrace.llm.mixing import op6
from millrace.llm.ngram_join import op5
from millrace.llm.packing import op7
from millrace.llm.pii import op2
from millrace.llm.secrets import op1
from millrace.llm.sharding import op10
from millrace.llm.toxicity import op3
from millrace.llm.url_filter import ORACLE as URL_SQL
from millrace.llm.url_filter import op11

QUERIES = {
    "op1_secret_scan": op1,
    "op2_personal_data": op2,
    "op3_toxicity": op3,
    "op4_language_id": op4,
    "op5_ngram_jaccard_join": op5,
    "op6_hierarchical_mix": op6,
    "op7_best_fit_packing": op7,
    "op8_telephony_media": op8,
    "op9_exact_dedup": op9,
    "op10_sharding": op10,
    "op11_url_filter": op11,
    "op12_centroid_clustering": op12,
    "op13_token_alignment": op13,
}

ORACLES = {
    "op6_hierarchical_mix": MIX_SQL,
    "op11_url_filter": URL_SQL,
    "op12_centroid_clustering": CLUSTER_SQL,
    "op9_exact_dedup": r"""
with n as (select doc_id, text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as t from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by t) as group_size,
  first_value(doc_id) over w = doc_id as kept, sha256(t) as text_sha256
from n window w as (partition by t order by length(coalesce(text, '')) desc, doc_id)""",
}
