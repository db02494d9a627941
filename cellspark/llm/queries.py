"""The queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from . import alignment, byte_bpe, chat_trees, collocations, decontamination, language_id, ngram_join, quality, sharding, spotsigs, suffix_dedup, token_counts, url_filter
from .shared import bounded_batches

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_quality": quality.op3_quality,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_sharding": sharding.op8_sharding,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_spotsigs": spotsigs.op10_spotsigs,
    "op11_collocations": collocations.op11_collocations,
    "op12_alignment": alignment.op12_alignment,
    "op13_chat_trees": chat_trees.op13_chat_trees,
}

#: Every 100-byte string by its hexadecimal digits; those that start earlier too mark what goes.
_REPEATS = r"""WITH d AS (SELECT doc_id, encode(coalesce(text,'')) AS b, octet_length(encode(coalesce(text,''))) AS n FROM documents),
h AS (SELECT doc_id, n, hex(b) AS x FROM d),
p AS (SELECT doc_id, i, md5(substring(x, 2*i+1, 200)) AS k FROM (SELECT doc_id, x, unnest(range(0, greatest(0, n-99))) AS i FROM h)),
f AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
r AS (SELECT doc_id, i, i > coalesce(lag(i) OVER w, -1000) + 100 AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT doc_id, min(i) AS a, max(i)+100 AS z FROM (SELECT doc_id, i, sum(new::int) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r) GROUP BY doc_id, run),
t AS (SELECT doc_id, sum(z-a)::bigint AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM q GROUP BY doc_id)
SELECT h.doc_id, n::bigint AS n_bytes, coalesce(n_removed,0) AS n_removed, coalesce(n_spans,0) AS n_spans,
sha256(unhex(CASE WHEN t.a IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(t.a)+1), lambda j: substring(x, 2*(CASE WHEN j=0 THEN 0 ELSE t.z[j] END)+1, 2*((CASE WHEN j=len(t.a) THEN n ELSE t.a[j+1] END)-(CASE WHEN j=0 THEN 0 ELSE t.z[j] END)))), '') END)) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id)
"""

#: Shingles as lists of words, all pairs that share one, components by reachability.
_LINKS = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<3 THEN [array_to_string(w,' ')] ELSE list_distinct(list_transform(range(1,len(w)-1), lambda i: w[i]||' '||w[i+1]||' '||w[i+2])) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
g AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x=b.x AND a.doc_id<b.doc_id AND 100*least(a.n,b.n)>=90*greatest(a.n,b.n) GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM g WHERE 100*k>=90*(na+nb-k)),
u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT u.b, c.r FROM c JOIN u ON c.doc_id=u.a)
SELECT s.doc_id, len(s)::bigint AS n_shingles, m AS component_id FROM s JOIN (SELECT doc_id, min(r) AS m FROM c GROUP BY doc_id) USING (doc_id)
"""

#: All runs of one to four words; scores by 128-bit numbers.
_COLLOCATIONS = r"""WITH p AS (SELECT coalesce(lang,'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w)-m+2), lambda i: array_to_string(w[i:i+m-1],' '))) AS s FROM w, (SELECT unnest([1,2,3,4]) AS m) WHERE len(w)>=m),
f AS MATERIALIZED (SELECT lang, m, s, string_split(s,' ') AS g, count(*) AS f FROM g GROUP BY ALL HAVING count(*)>=30),
n AS (SELECT lang, sum(len(w))::bigint AS n FROM w GROUP BY lang),
c AS (SELECT lang, s, f AS a, k, array_to_string(g[1:k],' ') AS x, array_to_string(g[k+1:],' ') AS y FROM f JOIN (SELECT unnest([1,2,3]) AS k) ON k<m),
b AS (SELECT c.lang, c.s, a, k, l.f AS l, r.f AS r, (2000000::hugeint*a)//(l.f+r.f) AS score FROM c JOIN f l ON l.lang=c.lang AND l.s=x JOIN f r ON r.lang=c.lang AND r.s=y QUALIFY row_number() OVER (PARTITION BY c.lang, c.s ORDER BY score, k)=1),
o AS (SELECT lang, s, max(f) AS f FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m-s+2), lambda i: array_to_string(g[i:i+s-1],' '))))) AS s FROM f WHERE m>2) GROUP BY ALL),
z AS (SELECT b.lang, b.s AS phrase, a, l, r, n, score::bigint AS score FROM b JOIN n USING (lang) LEFT JOIN o ON o.lang=b.lang AND o.s=b.s WHERE o.f IS NULL OR 100*o.f<80*a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank<=2000
"""

#: Turns in their order; a formatted turn has 17 characters and a line break besides role and text as escaped.
_CHATS = r"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations
UNION ALL SELECT -7, unnest([0,1]), unnest(['user','assistant']), '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(replace(replace(replace(replace(role||chr(0)||text,'\','\\'),'[INST]','[\INST]'),'[/INST]','[\/INST]'),'</s>','<\/s>'))-1 AS k FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role='assistant'),0)::bigint AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role='assistant'),'')) AS loss_sha256,
sum(k+18)::bigint AS formatted_chars FROM e GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op4_suffix_dedup": _REPEATS, "op6_ngram_join": _LINKS, "op11_collocations": _COLLOCATIONS, "op13_chat_trees": _CHATS}


def _bounded(f):
    def run(spark, sf_dir):
        bounded_batches(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    """Query name to function of (spark, sf_dir)."""
    return {name: _bounded(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict:
    """Query name to DuckDB SQL, where SQL can express the operator."""
    return dict(ORACLES)
