"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from .blake import tokens_sql

_F = """f AS (SELECT event_id+1 AS seq, 'f'||event_id AS fact_id, 'e'||event_id AS episode_id, 'u'||user_id AS subject, event_type AS predicate,
  'k'||json_extract_string(props,'$.k') AS object, ts AS valid_from, ts AS recorded_at, event_type IN ('click','view','purchase') AS multi, props AS payload FROM events)"""
_E = (
    _F
    + """, g AS (SELECT *, lag(object) OVER (PARTITION BY subject,predicate ORDER BY seq) AS p,
  row_number() OVER (PARTITION BY subject,predicate,object ORDER BY seq) AS rn FROM f),
k AS (SELECT * FROM g WHERE (multi AND rn=1) OR (NOT multi AND (p IS NULL OR p<>object))),
e AS (SELECT *, CASE WHEN NOT multi THEN lead(valid_from) OVER w END AS valid_to, CASE WHEN NOT multi THEN lead(recorded_at) OVER w END AS tx_to,
  CASE WHEN NOT multi THEN lead(seq) OVER w END AS next_seq FROM k WINDOW w AS (PARTITION BY subject,predicate ORDER BY seq))"""
)
_T = "t AS (SELECT DISTINCT 'u'||user_id AS subject_id FROM events WHERE user_id % 17 = 0)"
_KEYS = "keys AS (SELECT DISTINCT 'u'||user_id AS subject_id FROM events WHERE user_id % 17 <> 0 OR user_id % 34 = 0)"
_LOG = """lg AS (SELECT seq*2+1 AS seq, 'asserted' AS op, fact_id, subject, predicate, object, valid_from, NULL::TIMESTAMP AS valid_to, recorded_at, episode_id FROM e
  UNION ALL SELECT next_seq*2, 'invalidated', fact_id, NULL, NULL, NULL, NULL, valid_to, tx_to, NULL FROM e WHERE next_seq IS NOT NULL)"""
_RULES = """r(predicate, rx) AS (VALUES ('name_is','(?i:\\b(?:my name is|i am|i''m))\\s+([A-Z]\\w+)'), ('lives_in','(?i:\\b(?:i live in|i now live in|i moved to|i relocated to))\\s+([A-Z]\\w+)'),
  ('works_at','(?i:\\b(?:i work at|i work for|i joined|i now work at))\\s+([A-Z]\\w+)'), ('uses','(?i:\\b(?:i use|i switched to|i now use|i prefer))\\s+([A-Z]\\w+)'))"""
_M = """n AS (SELECT 'c'||c_custkey AS episode_id, 's'||c_custkey AS subject_id, 'My name is '||replace(c_name,'#','_')||'. I live in '||n_name||' and I use '||upper(c_mktsegment[1])||lower(c_mktsegment[2:])||'.' AS text
  FROM customer JOIN nation ON c_nationkey=n_nationkey UNION ALL SELECT 'o'||o_orderkey, 's'||o_custkey, 'I now work at Status_'||o_orderstatus||'.' FROM orders),
r(predicate, rx) AS (VALUES ('name_is','(?i:\\b(?:my name is|i am|i''m))\\s+([A-Z]\\w+)'), ('lives_in','(?i:\\b(?:i live in|i now live in|i moved to|i relocated to))\\s+([A-Z]\\w+)'),
  ('works_at','(?i:\\b(?:i work at|i work for|i joined|i now work at))\\s+([A-Z]\\w+)'), ('uses','(?i:\\b(?:i use|i switched to|i now use|i prefer))\\s+([A-Z]\\w+)')),
h AS (SELECT n.*, predicate, unnest(regexp_extract_all(text, rx, 0)) AS m, unnest(regexp_extract_all(text, rx, 1)) AS object FROM n, r),
x AS (SELECT *, subject_id AS subject, strpos(text, m)-1+length(m) AS span_hi, strpos(text, m)-1+length(m)-length(object) AS span_lo FROM h)"""
_TOK = "list_distinct(list_transform(regexp_extract_all(lower({0}),'[a-z0-9]+'), lambda w: CASE WHEN length(w)>3 AND w[-1]='s' THEN w[:-2] ELSE w END))"
_MERGES = """mg AS (SELECT c_custkey*2 AS seq, 'entity_merged' AS op, 'n'||c_custkey AS alias_id, 'n'||(CASE WHEN c_custkey%10=9 THEN c_custkey-9 ELSE c_custkey+1 END) AS canonical_id FROM customer WHERE c_custkey%4<>3 OR c_custkey%20>9
  UNION ALL SELECT c_custkey*2+1, 'entity_unmerged', 'n'||c_custkey, 'n'||(CASE WHEN c_custkey%12=0 THEN c_custkey+1 ELSE c_custkey+2 END) FROM customer WHERE c_custkey%6=0)"""
_ALIAS = (
    _MERGES
    + """, ml AS (SELECT *, row_number() OVER (PARTITION BY alias_id ORDER BY seq) AS i FROM mg),
st AS (SELECT alias_id, canonical_id, i FROM ml WHERE i=1 AND op='entity_merged'
  UNION ALL SELECT s.alias_id, CASE WHEN m.op='entity_merged' THEN m.canonical_id WHEN m.canonical_id=s.canonical_id THEN NULL ELSE s.canonical_id END, m.i FROM st s JOIN ml m ON m.alias_id=s.alias_id AND m.i=s.i+1),
al AS (SELECT alias_id, arg_max({'c': canonical_id}, i).c AS canonical_id FROM st GROUP BY alias_id HAVING arg_max({'c': canonical_id}, i).c IS NOT NULL)"""
)
_NUM = _F + ", d AS (SELECT seq, fact_id AS ref, sha256(fact_id||'|'||subject||'|'||predicate||'|'||object) AS ph FROM f)"
_G = "'" + "0" * 64 + "'"
_CHAIN = _NUM + f", c AS (SELECT list_reduce(list_prepend({_G}, list(ph ORDER BY seq)), lambda a, b: a || sha256(right(a,64)||b)) AS s, count(*) AS n FROM d)"
_CHECKED = ", i AS (SELECT unnest(range(1, n+1)) AS seq, s FROM c), l AS (SELECT seq, substr(s,64*(seq-1)+1,64) AS prev, substr(s,64*seq+1,64) AS entry FROM i)"
_DIGEST = "sha256('asserted|'||fact_id||'|'||subject||'|'||predicate||'|'||sha256({0})||'|'||epoch_us(valid_from)||'||1.000000||'||episode_id||'|'||subject||'||||'||epoch_us(recorded_at))"


def _deep(forged: str = "false", skipped: str = "false") -> str:
    """ok, entries, broken_at: the first entry that does not follow, or whose event, unless it is skipped, derives another hash.

    Payload hashes are taken as they were chained (ph) and as the log gives them now, in which objects are forged where that holds.
    """
    now = _DIGEST.format(f"CASE WHEN {forged} THEN 'forged' ELSE object END")
    return f"""WITH {_F}, d AS (SELECT seq, subject, {_DIGEST.format('object')} AS ph, {now} AS now FROM f),
c AS (SELECT list_reduce(list_prepend({_G}, list(ph ORDER BY seq)), lambda a, b: a || sha256(right(a,64)||b)) AS s, count(*) AS n FROM d){_CHECKED},
bad AS (SELECT min(seq) AS first_bad FROM l JOIN d USING (seq) WHERE sha256(prev||ph)<>entry OR (NOT ({skipped}) AND now<>ph))
SELECT first_bad IS NULL AS ok, (SELECT n FROM c) AS entries, first_bad AS broken_at FROM bad"""



def _vectors(**sources: tuple[str, str, str]) -> str:
    """For each name (source, key, text): name(key, bucket, s) and name_n(key, sq), by one table of hashed tokens."""
    parts = [f"{n}_t AS (SELECT {k}, unnest(regexp_extract_all(lower({t}),'[a-z0-9]+')) AS tok FROM {src})" for n, (src, k, t) in sources.items()]
    parts.append(tokens_sql("hashed", " UNION ALL ".join(f"SELECT tok FROM {n}_t" for n in sources)))
    for n, (_, k, _) in sources.items():
        parts.append(f"{n} AS (SELECT {k}, bucket, sum(sign)::BIGINT AS s FROM {n}_t JOIN hashed USING (tok) GROUP BY ALL HAVING sum(sign) <> 0)")
        parts.append(f"{n}_n AS (SELECT {k}, sum(s*s)::DOUBLE AS sq FROM {n} GROUP BY ALL)")
    return ",\n".join(parts)


_Q = "q(query_id, query, subject) AS (VALUES (1::BIGINT,'what did u12 purchase','u12'),(2,'u7 click k3','u7'),(3,'signup of u40 k9','u40'),(4,'errors','u3'))"


def _rank(where: str, sem: float, kw: float, by_subject: bool, out: str) -> str:
    return f"""WITH {_E}, {_Q}, c AS (SELECT fact_id, subject, predicate, object, recorded_at AS tx_from, subject||' '||predicate||' '||object AS text FROM e WHERE {where}),
{_vectors(tv=('(SELECT DISTINCT text FROM c)', 'text', 'text'), qv=('q', 'query_id', 'query'))},
sims AS (SELECT query_id, text, sum(tv.s*qv.s)::DOUBLE / sqrt(any_value(tv_n.sq) * any_value(qv_n.sq)) AS sim FROM tv JOIN qv USING (bucket) JOIN tv_n USING (text) JOIN qv_n USING (query_id) GROUP BY ALL),
p AS (SELECT q.query_id, c.*, {_TOK.format('q.query')} AS qt, {_TOK.format('c.text')} AS ct FROM q JOIN c ON {'c.subject=q.subject' if by_subject else 'true'}),
sc AS (SELECT p.*, {sem}::DOUBLE*coalesce(sim,0) + {kw}::DOUBLE*CASE WHEN len(qt)=0 THEN 0 ELSE len(list_intersect(qt,ct))/len(qt) END AS score FROM p LEFT JOIN sims s ON s.query_id=p.query_id AND s.text=p.text),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tx_from, fact_id) AS rank FROM sc)
{out}"""


_TOP = "SELECT query_id, rank, fact_id, object, round(score,6) AS score FROM rk WHERE rank<=5"
_AT = "valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' < valid_to)"
_LEX = """list_distinct(regexp_extract_all(lower({0}),'[a-z0-9]+'))"""
def similar_sql(names: str) -> str:
    """CTEs that end in ps(a, b, score): all pairs of the names that a query yields."""
    return f"""nm AS (SELECT DISTINCT name FROM ({names})),
pr AS (SELECT x.name AS a, y.name AS b, {_LEX.format('x.name')} AS s, {_LEX.format('y.name')} AS t FROM nm x JOIN nm y ON x.name<y.name),
{_vectors(nv=('nm', 'name', 'name'))},
cs AS (SELECT x.name AS a, y.name AS b, sum(x.s*y.s)::DOUBLE / sqrt(any_value(i.sq) * any_value(j.sq)) AS cosine FROM nv x JOIN nv y USING (bucket) JOIN nv_n i ON i.name=x.name JOIN nv_n j ON j.name=y.name WHERE x.name<y.name GROUP BY ALL),
ps AS (SELECT pr.a, pr.b, greatest(CASE WHEN len(s)>0 AND len(t)>0 AND len(list_intersect(s,t))=least(len(s),len(t)) THEN 0.9
  ELSE greatest(len(list_intersect(s,t))/greatest(len(list_distinct(list_concat(s,t))),1), CASE WHEN greatest(length(pr.a),length(pr.b))=0 THEN 1.0 ELSE 1.0-levenshtein(lower(pr.a),lower(pr.b))/greatest(length(pr.a),length(pr.b)) END) END, coalesce(cosine,0)) AS score
  FROM pr LEFT JOIN cs ON cs.a=pr.a AND cs.b=pr.b)"""


_ER = similar_sql("SELECT p_name AS name FROM part WHERE p_name IS NOT NULL")
_BANDS = "SELECT CASE WHEN length(a)>=length(b) THEN a ELSE b END AS canonical_id, CASE WHEN length(a)>=length(b) THEN b ELSE a END AS alias_id, round(score,3) AS score, CASE WHEN round(score,9)>=0.85 THEN 'auto' ELSE 'review' END AS band FROM ps WHERE round(score,9)>=0.5"
_LEFT = f"{_E}, {_T}, lf AS (SELECT * FROM e WHERE subject NOT IN (SELECT subject_id FROM t WHERE subject_id<>'u34'))"
_REG = """rq AS (SELECT 'u'||user_id AS subject_id, 'op'||(event_id%3) AS requested_by, ts AS recorded_at, event_id AS seq FROM events WHERE user_id%17=0 AND event_type='error'),
ls AS (SELECT subject_id, arg_max(requested_by, seq) AS requested_by, arg_max(recorded_at, seq) AS recorded_at FROM rq GROUP BY 1),
nl AS (SELECT subject, count(*) AS n FROM lf GROUP BY 1),
reg AS (SELECT subject_id, requested_by, recorded_at, coalesce(n,0) AS facts_left, n IS NULL AS erased FROM ls LEFT JOIN nl ON subject=subject_id)"""
_OVER = f"""b AS (SELECT item_id, {_TOK.format('text')} AS ts FROM benchmark), d AS (SELECT doc_id, unnest({_TOK.format('text')}) AS token FROM documents),
bt AS (SELECT item_id, len(ts) AS n, unnest(ts) AS token FROM b),
hits AS (SELECT item_id, doc_id, n, count(*) AS h FROM d JOIN bt USING (token) GROUP BY ALL),
best AS (SELECT *, round(h/n,6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(h/n,6) DESC, doc_id) AS r FROM hits)"""
_SINGLE = f"""WITH {_F}, g AS (SELECT *, lag(object) OVER (PARTITION BY subject,predicate ORDER BY seq) AS p FROM f WHERE NOT multi), k AS (SELECT * FROM g WHERE p IS NULL OR p<>object)"""

ORACLE: dict[str, str] = {
    "log_union_scan": f"WITH {_F} SELECT seq*2-1 AS seq, 'episode' AS op, episode_id, NULL::VARCHAR AS fact_id, NULL::VARCHAR AS object, payload, subject AS subject_id FROM f UNION ALL SELECT seq*2, 'asserted', episode_id, fact_id, object, NULL, subject FROM f",
    "log_json_roundtrip": f"WITH {_E}, {_LOG} SELECT seq, op, fact_id, subject, predicate, object, epoch_us(valid_from) AS valid_from_us, epoch_us(valid_to) AS valid_to_us, epoch_us(recorded_at) AS recorded_us FROM lg",
    "log_digest": f"""WITH {_E}, {_LOG} SELECT seq, op AS kind, fact_id AS ref, sha256(CASE WHEN op='asserted' THEN 'asserted|'||fact_id||'|'||subject||'|'||predicate||'|'||sha256(object)||'|'||epoch_us(valid_from)||'||1.000000||'||episode_id||'|'||subject||'||||'||epoch_us(recorded_at)
  ELSE 'invalidated|'||fact_id||'|superseded|'||epoch_us(valid_to)||'||'||epoch_us(recorded_at) END) AS payload_hash FROM lg""",
    "extract_facts": f"WITH {_M} SELECT predicate, object, count(*) AS n, count(DISTINCT subject) AS subjects FROM x GROUP BY ALL",
    "extract_spans": f"WITH {_M} SELECT episode_id, subject, predicate, object, span_lo, span_hi, substr(text, span_lo+1, span_hi-span_lo)=object AS exact FROM x",
    "dedup_multi": f"WITH {_E} SELECT seq, fact_id, subject, predicate, object FROM e WHERE multi",
    "supersede_single": f"WITH {_E} SELECT seq, fact_id, subject, predicate, object, valid_from, valid_to FROM e WHERE NOT multi",
    "ingest_exact": """WITH RECURSIVE o AS (SELECT 'c'||o_custkey AS subject, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), o_orderkey) AS seq, o_orderpriority AS object, o_orderdate AS valid_from FROM orders),
u AS (SELECT *, row_number() OVER (PARTITION BY subject, y, object ORDER BY seq) AS rn FROM o),
l AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seq) AS i FROM u WHERE rn=1),
w AS (SELECT subject, i, seq, object, valid_from, y, NULL::VARCHAR AS at_start, object AS now, true AS made FROM l WHERE i=1
  UNION ALL SELECT l.subject, l.i, l.seq, l.object, l.valid_from, l.y, CASE WHEN l.y=w.y THEN w.at_start ELSE w.now END,
    CASE WHEN l.object IS NOT DISTINCT FROM (CASE WHEN l.y=w.y THEN w.at_start ELSE w.now END) OR l.object=w.now THEN w.now ELSE l.object END,
    NOT (l.object IS NOT DISTINCT FROM (CASE WHEN l.y=w.y THEN w.at_start ELSE w.now END) OR l.object=w.now) FROM w JOIN l ON l.subject=w.subject AND l.i=w.i+1)
SELECT subject, seq, object, valid_from FROM w WHERE made""",
    "edges_all": f"WITH {_E} SELECT fact_id, subject, predicate, object, epoch_us(valid_from) AS valid_from_us, epoch_us(valid_to) AS valid_to_us, epoch_us(tx_to) AS tx_to_us, valid_to IS NULL AS alive FROM e",
    "edges_live": f"WITH {_E} SELECT fact_id, subject, predicate, object, valid_from FROM e WHERE valid_to IS NULL",
    "edges_asof": f"WITH {_E} SELECT subject, predicate, object, valid_from, valid_to FROM e WHERE {_AT}",
    "asof_join": f"WITH {_E}, p AS (SELECT DISTINCT 'u'||user_id AS subject, t FROM events, (VALUES (TIMESTAMP '2024-01-05'),(TIMESTAMP '2024-01-15'),(TIMESTAMP '2024-01-25')) v(t)) SELECT p.subject, t, count(*) AS n_facts, min(object) AS least_object FROM p JOIN e ON e.subject=p.subject AND valid_from<=t AND (valid_to IS NULL OR t<valid_to) GROUP BY ALL",
    "entities": f"WITH {_E}, {_MERGES} SELECT subject AS entity_id FROM e UNION SELECT canonical_id FROM mg WHERE op='entity_merged'",
    "alias_state": f"WITH RECURSIVE {_ALIAS} SELECT alias_id, canonical_id FROM al",
    "alias_sets": f"WITH {_MERGES}, l AS (SELECT canonical_id, alias_id, arg_max(op, seq) AS op FROM mg GROUP BY ALL) SELECT canonical_id, string_agg(alias_id, ',' ORDER BY alias_id) AS aliases FROM l WHERE op='entity_merged' GROUP BY 1",
    "alias_resolve": f"""WITH RECURSIVE {_ALIAS}, wk AS (SELECT alias_id, canonical_id AS cur, [alias_id] AS seen, canonical_id=alias_id AS ended FROM al
  UNION ALL SELECT w.alias_id, a.canonical_id, list_append(w.seen, w.cur), list_contains(w.seen, a.canonical_id) OR a.canonical_id=w.cur FROM wk w JOIN al a ON a.alias_id=w.cur WHERE NOT w.ended)
SELECT alias_id, arg_max(cur, len(seen)) AS resolved FROM wk GROUP BY 1""",
    "forgotten_filter": f"WITH {_E}, {_T} SELECT fact_id, subject, predicate, object FROM e WHERE subject NOT IN (SELECT subject_id FROM t)",
    "key_intact": f"WITH {_E}, {_KEYS} SELECT fact_id, subject FROM e WHERE subject IN (SELECT subject_id FROM keys)",
    "timeline": f"WITH {_E} SELECT subject, fact_id, valid_from, valid_to IS NULL AS alive, row_number() OVER (PARTITION BY subject ORDER BY valid_from, seq) AS place FROM e",
    "provenance": f"WITH {_M} SELECT episode_id, subject, predicate, object, substr(text, span_lo+1, span_hi-span_lo) AS snippet FROM x",
    "conflicts": f"WITH {_E} SELECT subject, predicate, count(DISTINCT object) AS n_values, string_agg(object, ',' ORDER BY valid_from, seq) AS value_list, 'recency' AS resolution, min(seq) AS first_seq FROM e WHERE NOT multi GROUP BY ALL HAVING count(DISTINCT object)>=2",
    "graph_nodes": f"WITH {_E}, n AS (SELECT subject AS id, 'entity' AS kind, valid_from, seq, 0 AS z FROM e UNION ALL SELECT object, 'value', valid_from, seq, 1 FROM e) SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY valid_from, seq, z) AS r FROM n) WHERE r=1",
    "graph_edges": f"WITH {_E} SELECT fact_id AS edge_id, subject AS source, predicate AS label, object AS target, valid_to IS NULL AS alive FROM e",
    "erased_refs": f"WITH {_F}, {_T}, {_KEYS}, z AS (SELECT subject_id FROM t WHERE subject_id NOT IN (SELECT subject_id FROM keys)) SELECT episode_id AS ref FROM f WHERE subject IN (SELECT subject_id FROM z) UNION SELECT fact_id FROM f WHERE subject IN (SELECT subject_id FROM z)",
    "tokens": f"SELECT token, count(*) AS docs FROM (SELECT unnest({_TOK.format('text')}) AS token FROM documents) GROUP BY 1",
    "keyword_overlap": f"WITH {_OVER} SELECT item_id, doc_id, score FROM best WHERE r=1",
    "hash_embed": f"WITH {_vectors(v=('benchmark', 'item_id', 'text'))} SELECT item_id, bucket::INT AS bucket, round(s / sqrt(sq),6) AS w FROM v JOIN v_n USING (item_id)",
    "vector_topk": """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON e.label=q.label AND e.vec_id<>q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id, round(score,6) AS score FROM r WHERE rank<=5""",
    "hybrid_topk": _rank("valid_to IS NULL", 0.4, 0.6, False, _TOP),
    "hybrid_topk_asof": _rank(_AT, 0.4, 0.6, True, _TOP),
    "weights_semantic": _rank("valid_to IS NULL", 0.7, 0.3, False, _TOP),
    "answer": _rank("valid_to IS NULL", 0.4, 0.6, False, "SELECT query_id, object AS answer FROM rk WHERE rank=1"),
    "er_names": f"WITH {_E} SELECT subject AS name FROM e UNION SELECT object FROM e",
    "er_pairs": f"WITH {_ER} SELECT a, b, round(score,6) AS score FROM ps",
    "er_bands": f"WITH {_ER} {_BANDS}",
    "chain_head": f"WITH {_CHAIN} SELECT right(s,64) AS head, n AS entries FROM c",
    "chain_links": f"WITH {_CHAIN}, i AS (SELECT s, unnest(range(1, n+1)) AS seq FROM c) SELECT seq, substr(s,64*(seq-1)+1,64) AS prev_hash, substr(s,64*seq+1,64) AS entry_hash FROM i",
    "chain_blocks": f"WITH {_NUM} SELECT (seq-1)//1000 AS block, list_reduce(list_prepend({_G}, list(ph ORDER BY seq)), lambda a, b: sha256(a||b)) AS head, count(*) AS n FROM d GROUP BY 1",
    "chain_verify": f"WITH {_CHAIN} SELECT true AS ok, n AS entries, NULL::BIGINT AS broken_at, right(s,64) AS head FROM c",
    "chain_verify_tampered": f"WITH {_CHAIN}{_CHECKED}, b AS (SELECT min(seq) AS broken_at FROM l JOIN d USING (seq) WHERE sha256(prev||CASE WHEN seq=777 THEN sha256('x') ELSE ph END)<>entry) SELECT broken_at IS NULL AS ok, (SELECT n FROM c) AS entries, broken_at FROM b",
    "deep_verify": _deep(),
    "deep_verify_tampered": _deep("seq=500"),
    "deep_verify_shred": _deep("subject IN (SELECT subject_id FROM t)", "subject IN (SELECT subject_id FROM t)").replace("WITH ", f"WITH {_T}, ", 1),
    "forget_preview": f"WITH {_E}, {_T} SELECT subject_id, (SELECT count(*) FROM f WHERE subject=subject_id) AS episodes_deleted, (SELECT count(*) FROM e WHERE subject=subject_id) AS facts_deleted FROM t",
    "manifest_hash": f"WITH {_E}, {_T}, i AS (SELECT subject, episode_id AS id FROM f UNION ALL SELECT subject, fact_id FROM e) SELECT subject_id, sha256(string_agg(id, chr(10) ORDER BY id)) AS manifest_hash FROM t JOIN i ON subject=subject_id GROUP BY 1",
    "erasure_register": f"WITH {_LEFT}, {_REG} SELECT * FROM reg",
    "subject_check": f"WITH {_LEFT}, nl AS (SELECT subject, count(*) AS n FROM lf GROUP BY 1), a AS (SELECT DISTINCT subject AS subject_id FROM f) SELECT a.subject_id, CASE WHEN t.subject_id IS NULL THEN 'not erased' WHEN n IS NULL THEN 'erased' ELSE 'incomplete' END AS status, coalesce(n,0) AS facts_left FROM a LEFT JOIN t ON t.subject_id=a.subject_id LEFT JOIN nl ON nl.subject=a.subject_id",
    "evidence_summary": f"WITH {_LEFT}, {_REG}, d AS (SELECT seq, sha256(fact_id||'|'||subject||'|'||predicate||'|'||object) AS ph FROM f), c AS (SELECT list_reduce(list_prepend({_G}, list(ph ORDER BY seq)), lambda a, b: sha256(a||b)) AS head, count(*) AS entries FROM d) SELECT (SELECT bool_and(erased) FROM reg) AS ok, true AS chain_ok, entries, head, (SELECT count(*) FROM reg) AS erasures, (SELECT count(*) FROM (SELECT DISTINCT subject_id, requested_by FROM rq)) AS certificates FROM c",
    "crypto_roundtrip": f"WITH {_F}, {_T} SELECT seq, subject AS subject_id, object, payload FROM f WHERE subject NOT IN (SELECT subject_id FROM t)",
    "reconcile_downstream": f"WITH {_F}, {_T}, s AS (SELECT subject, count(*) AS n FROM f WHERE seq%5=0 AND substr(subject,2)::BIGINT%34=0 GROUP BY 1) SELECT subject_id, coalesce(n,0) AS rows_left, n IS NULL AS verified FROM t LEFT JOIN s ON subject=subject_id",
    "accuracy": """WITH w AS (SELECT c_custkey, n_name AS full_name, split_part(n_name,' ',1) AS got, CASE WHEN c_custkey%7=0 THEN 'nowhere' ELSE lower(n_name) END AS expected FROM customer JOIN nation ON c_nationkey=n_nationkey)
SELECT count(*) FILTER (contains(lower(got), expected)) AS hits, count(*) AS n, round(avg(contains(lower(got), expected)::INT),6) AS accuracy FROM w""",
    "recall_at_k": f"WITH {_OVER}, ev AS (SELECT item_id, list(doc_id) AS docs FROM hits WHERE h=n GROUP BY 1) SELECT count(*) FILTER (list_contains(docs, doc_id)) AS hits, count(*) AS n, round(avg(list_contains(docs, doc_id)::INT),6) AS recall FROM best JOIN ev USING (item_id) WHERE r=1",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i=greatest(1,least(n,round_even(0.5*n,0)::INT))) AS p50, max(value) FILTER (i=greatest(1,least(n,round_even(0.95*n,0)::INT))) AS p95 FROM r GROUP BY 1""",
    "human_turns": "SELECT conv_id, count(*) AS turns, max(turn) AS last_turn FROM conversations WHERE role='user' GROUP BY 1",
    "open_facts": f"WITH {_E} SELECT fact_id, replace(subject||' '||predicate||' '||object,'_',' ') AS shown FROM e WHERE valid_to IS NULL",
    "generated_bench": f"""WITH n AS (SELECT 'u'||i AS subject_id, 'My name is User'||i||'. I live in City'||i||' and I work at Org'||i||'.' AS text FROM range(200) t(i)),
{_RULES}, h AS (SELECT predicate, unnest(regexp_extract_all(text, rx, 1)) AS object FROM n, r) SELECT predicate, count(*) AS n, min(object) AS least FROM h GROUP BY 1""",
    "stream_supersede": f"{_SINGLE} SELECT seq, fact_id, subject, predicate, object FROM k",
    "stream_edges": f"{_SINGLE} SELECT fact_id, subject, predicate, object, epoch_us(valid_from) AS valid_from_us, epoch_us(lead(valid_from) OVER (PARTITION BY subject,predicate ORDER BY seq)) AS valid_to_us FROM k",
    "stream_window_counts": "WITH w AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS ws, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT epoch_us(ws) AS window_us, event_type, n FROM w WHERE ws + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
}
