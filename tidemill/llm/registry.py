"""Queries of the training-data operators, by name, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .ann import op6_ann
from .flac import op8_flac
from .hard_negatives import op12_hard_negatives
from .mixing import op7_mixing
from .packing import op4_packing
from .pivot_search import op11_exact_search
from .prefix_trie import op13_prefix_trie
from .quality import op9_quality
from .secrets import op10_secrets
from .simhash import op5_simhash
from .substring_dedup import op1_substring_dedup
from .toxicity import op3_toxicity
from .warc import op2_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_warc": op2_warc,
        "op3_toxicity": op3_toxicity,
        "op4_packing": op4_packing,
        "op5_simhash": op5_simhash,
        "op6_ann": op6_ann,
        "op7_mixing": op7_mixing,
        "op8_flac": op8_flac,
        "op9_quality": op9_quality,
        "op10_secrets": op10_secrets,
        "op11_exact_search": op11_exact_search,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_prefix_trie": op13_prefix_trie,
        "pipeline": corpus_pipeline.run,
    }


#: Late windows by their words themselves; a document keeps the words that none covers.
REPEATS_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as t from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from d)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by t order by doc_id, i) as n from windows) where n > 1),
gone as (select doc_id, list(distinct i + k) as places from late, generate_series(0, 19) g(k) group by doc_id),
kept as (select doc_id, w, places, case when places is null then w else [w[j] for j in generate_series(1, len(w)) if not list_contains(places, j)] end as k from d left join gone using (doc_id))
select doc_id, len(w)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""

ARCHIVES_SQL = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
q as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as kept from p)
select page_id, payload_bytes, payload_digest, case when page_id = kept then 'response' else 'revisit' end as record_type, case when page_id <> kept then kept end as refers_to from q
"""

#: Vectors as whole numbers; every query against every row.
WHOLE_VECTORS = "select *, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

SEARCH_SQL = f"""
with v as ({WHOLE_VECTORS}),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select * from (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s) where rank <= 5
"""

NEGATIVES_SQL = f"""
with v as (select vec_id, e, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as l from ({WHOLE_VECTORS}) where label is not null),
s as (select a.vec_id as anchor_id, a.l as own, c.vec_id, c.l, list_inner_product(a.e, c.e)::bigint as score from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where l = own qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select * from (select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank, vec_id as negative_id, positive_score, score as negative_score from p join s using (anchor_id) where l <> own and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score) where rank <= 10
"""

#: Heads by a CRC-32 bit by bit; nodes by their turns' digests in a row; every node's figures go to all it begins with.
TRIE_SQL = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) - 1 as p, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as m, length(coalesce(text, '')) as chars from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, xor(4294967295, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint), lambda a, x: list_reduce(range(8), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, x)), 4294967295)) % 6 as h from (select distinct conv_id from t)),
r as (select c.conv_id, p, m, chars from c join t on t.conv_id = c.base and p < h union all select c.conv_id, p + 1000000, m, chars from c join t on t.conv_id = c.conv_id and p >= h),
q as (select conv_id, m, chars, row_number() over (partition by conv_id order by p) as depth, string_agg(m, '/') over (partition by conv_id order by p) as key from r),
k as (select conv_id, 0 as depth, '' as key, 0 as chars from c union all select conv_id, depth, key, chars from q),
len as (select conv_id, max(depth) as n from k group by 1),
n as (select key, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars, coalesce(string_agg(case when len.n = depth then conv_id end, ',' order by conv_id), '') as ends, bool_and(len.n = depth) as leaf from k join len using (conv_id) group by key),
up as (select k.key, sum(n.leaf::int) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved from n join k on k.conv_id = n.conv_id and k.depth <= n.depth group by 1),
pa as (select n.key, p.key as parent_key, p.conv_id as parent from n join k on k.conv_id = n.conv_id and k.depth = n.depth - 1 join n p on p.key = k.key),
kids as (select parent_key as key, count(*) as n from pa group by 1)
select n.conv_id, n.depth::bigint as depth, pa.parent as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children, up.n_leaves::bigint as n_leaves, up.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from n join up using (key) left join pa using (key) left join kids using (key)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": REPEATS_SQL, "op2_warc": ARCHIVES_SQL, "op11_exact_search": SEARCH_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_prefix_trie": TRIE_SQL}
