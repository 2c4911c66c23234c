"""DuckDB's SQL of the queries in `stores`."""

from __future__ import annotations

from . import oracle as O

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f')||'+00:00'"
_GONE = "('u17'),('u34'),('u51')"
_ALL_KINDS = """k AS (SELECT *, event_id+1 AS seq, event_id%4=1 AS odd, 'u'||user_id AS who, 'k'||json_extract_string(props,'$.k') AS val,
  CASE WHEN event_id%4=1 THEN 'agent' ELSE '' END AS agent, epoch_us(ts) AS us FROM events),
s AS (SELECT *, who||'|'||agent||'||org' AS scope, CASE WHEN odd THEN us::VARCHAR ELSE '' END AS until_us FROM k)"""

ORACLE: dict[str, str] = {
    "store_log": f"WITH {O._F} SELECT seq, 'asserted' AS op, fact_id, object, epoch_us(recorded_at) AS recorded_us FROM f",
    "store_audit": f"""WITH {O._F}, d AS (SELECT seq, fact_id AS ref, {O._DIGEST.format('object')} AS ph FROM f),
c AS (SELECT list_reduce(list_prepend({O._G}, list(ph ORDER BY seq)), lambda a, b: a || sha256(right(a,64)||b)) AS s, count(*) AS n FROM d), i AS (SELECT s, unnest(range(1, n+1)) AS seq FROM c)
SELECT seq, 'asserted' AS kind, ref, ph AS payload_hash, substr(s,64*(seq-1)+1,64) AS prev_hash, substr(s,64*seq+1,64) AS entry_hash FROM i JOIN d USING (seq)""",
    "store_compacted": "SELECT count(*) AS events, max(event_id)+1 AS last_seq, count(*) AS stored, true AS ok FROM events",
    "facade_shred": f"WITH {O._F} SELECT seq, fact_id, subject AS subject_id, object FROM f WHERE subject NOT IN (VALUES {_GONE})",
    "facade_shred_check": f"WITH g(s) AS (VALUES {_GONE}) SELECT true AS deep_ok, (SELECT count(*) FROM events)+count(*) AS entries, count(*) AS erasures, count(*) AS certificates, true AS ok FROM g",
    "certificates": f"""WITH {O._F}, g(subject_id) AS (VALUES {_GONE})
SELECT subject_id, 'dpo' AS requested_by, 0::BIGINT AS episodes_deleted, count(fact_id) AS facts_deleted, sha256(coalesce(string_agg(fact_id, chr(10) ORDER BY fact_id), '')) AS manifest_hash, 'HMAC-SHA256' AS algorithm, false AS dry_run
FROM g LEFT JOIN f ON subject=subject_id GROUP BY 1""",
    "is_forgotten": f"WITH g(s) AS (VALUES {_GONE}), a(s) AS (VALUES {_GONE},('u1'),('u2')) SELECT s AS subject_id, s IN (SELECT s FROM g) AS forgotten FROM a",
    "kept_fold": O.ORACLE["edges_all"],
    "edges_upto": f"WITH {O._E} SELECT fact_id, object, NOT coalesce(next_seq*2<=5000, false) AS alive, seq*2+1 AS seq FROM e WHERE seq*2+1<=5000",
    "subject_filter": f"WITH {O._E} SELECT fact_id, 'name' AS by FROM e WHERE subject='u12' UNION ALL SELECT fact_id, 'scope' FROM e WHERE valid_to IS NULL AND seq%3=1",
    "late_validity": f"WITH {O._F}, b AS (SELECT * REPLACE (TIMESTAMP '2030-01-01' - to_seconds(seq) AS valid_from) FROM f WHERE NOT multi), g AS (SELECT *, lag(object) OVER w AS p FROM b WINDOW w AS (PARTITION BY subject, predicate ORDER BY seq)) SELECT fact_id, valid_from, lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY seq) AS valid_to FROM g WHERE p IS NULL OR p<>object",
    "cardinality": """WITH m(predicate) AS (VALUES ('uses'),('speaks_language'),('likes'),('knows'),('owns'),('visited'),('interested_in'),('member_of'))
SELECT predicate, predicate='click' OR (predicate<>'likes' AND predicate IN (SELECT predicate FROM m)) AS multi FROM (SELECT DISTINCT event_type AS predicate FROM events UNION ALL SELECT predicate FROM m UNION ALL SELECT 'lives_in')""",
    "checked_times": "SELECT o_orderkey, CASE WHEN o_orderkey%5<>0 THEN epoch_us(o_orderdate::DATE::TIMESTAMP) END AS us FROM orders",
    "iso_text": f"SELECT event_id, {_ISO.format('ts')} AS iso FROM events",
    "session_dates": "SELECT c_custkey, CASE WHEN c_custkey%4 IN (0,1) THEN DATE '2023-01-01' + (c_custkey%400)::INT ELSE DATE '2022-01-01' + (30*(c_custkey%20))::INT END AS day FROM customer",
    "redacted_dsn": r"SELECT c_custkey, regexp_replace('postgresql://user'||c_custkey||CASE WHEN c_custkey%3=0 THEN '' ELSE ':pa$s'||c_custkey END||'@db.example.org:5432/x', '(://[^:/@]+:)[^@]+@', '\1***@') AS shown FROM customer",
    "unit_vectors": "WITH v AS (SELECT vec_id, vec_id%5 AS k, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, CASE WHEN k=0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS square, round(CASE WHEN k=0 THEN 0::DOUBLE ELSE e[1]/sqrt(list_sum(list_transform(e, lambda x: x*x))) END, 6) AS first FROM v",
    "digests_of_all_kinds": f"""WITH {_ALL_KINDS} SELECT seq,
CASE event_id%6 WHEN 0 THEN 'episode' WHEN 1 THEN 'asserted' WHEN 2 THEN 'invalidated' WHEN 3 THEN 'entity_merged' WHEN 4 THEN 'entity_unmerged' ELSE 'subject_forgotten' END AS kind,
CASE event_id%6 WHEN 0 THEN 'e'||event_id WHEN 1 THEN 'f'||event_id WHEN 2 THEN 'f'||event_id WHEN 3 THEN 'c'||event_id WHEN 4 THEN 'c'||event_id ELSE who END AS ref,
sha256(CASE event_id%6
  WHEN 0 THEN 'episode|e'||event_id||'|'||sha256(props)||'|'||sha256(CASE WHEN odd THEN 'src|'||event_id ELSE '' END)||'|'||scope||'|'||us
  WHEN 1 THEN 'asserted|f'||event_id||'|'||event_type||'|p|q|'||sha256(val)||'|'||us||'|'||until_us||'|'||printf('%.6f', round((event_id%7)/7, 6))||'|'||CASE WHEN odd THEN (event_id%9)||',12' ELSE '' END||'|e'||event_id||'|'||scope||'|'||us
  WHEN 2 THEN 'invalidated|f'||event_id||'|superseded|'||until_us||'|'||CASE WHEN odd THEN 'f'||event_id ELSE '' END||'|'||us
  WHEN 3 THEN 'entity_merged|c'||event_id||'|'||val||'|'||sha256(CASE WHEN odd THEN 'é|x' ELSE '' END)||'|'||us
  WHEN 4 THEN 'entity_unmerged|c'||event_id||'|'||val||'|'||us
  ELSE 'subject_forgotten|'||who||'|dpo|'||us END) AS payload_hash FROM s""",
    "edge_rows": f"""WITH {O._E} SELECT fact_id, '{{"fact_id":"'||fact_id||'","subject":"'||subject||'","predicate":"'||predicate||'","object":"'||object||'","valid_from":"'||{_ISO.format('valid_from')}||'","valid_to":'||coalesce('"'||{_ISO.format('valid_to')}||'"','null')
||',"alive":'||(valid_to IS NULL)||',"confidence":0.5,"subject_id":null,"source_episode_id":"'||episode_id||'"}}' AS row FROM e""",
    "whole_spans": "SELECT event_id, CASE WHEN event_id%3<>0 AND event_id%4<>0 THEN event_id END AS lo, CASE WHEN event_id%3<>0 AND event_id%4<>0 THEN event_id+5 END AS hi FROM events",
    "replayed_facts": f"WITH {O._M} SELECT episode_id, subject, predicate, object, strpos(text, object)-1 AS span_lo, strpos(text, object)-1+length(object) AS span_hi FROM x WHERE predicate<>'uses'",
    "evaluation_file": "SELECT 's'||n_nationkey AS subject_id, 'where' AS query, n_name AS expected, CASE WHEN n_nationkey%2=0 THEN '2021-01-01' END AS as_of, 'I live in '||n_name||'.' AS text, '2020-01-01' AS valid_from FROM nation",
    "conversation_turns": """WITH a AS (SELECT *, turn%11+1 AS s FROM conversations), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY turn, role, text)-1 AS place, dense_rank() OVER (PARTITION BY conv_id ORDER BY s)-1 AS i FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, place) AS n FROM b WHERE i<3)
SELECT conv_id, s::BIGINT AS session, DATE '2022-01-01' + (30*i)::INT AS date, place, role AS speaker, 'D:'||conv_id||':'||turn AS dia_id FROM k WHERE n<=4""",
    "scorable_questions": """WITH d AS (SELECT DISTINCT doc_id FROM documents), q AS (SELECT doc_id, doc_id%5+1 AS category FROM d WHERE doc_id%6<>0 AND doc_id%5+1<>5)
SELECT * FROM q WHERE doc_id%10<>1 AND (doc_id%4<>0 OR (doc_id+1 IN (SELECT doc_id FROM d) AND (doc_id+1)%10<>1))""",
    "keyword_ranks": """WITH w AS (SELECT item_id, list_transform(regexp_extract_all(lower(text),'[a-z0-9]+'), lambda w: CASE WHEN length(w)>3 AND w[-1]='s' THEN w[:-2] ELSE w END) AS ws FROM benchmark)
SELECT item_id, round(CASE WHEN len(ws)=0 THEN 0 ELSE least(10.0::DOUBLE*len(list_filter(ws, lambda w: w IN ('answer','question','model')))/len(ws), 1.0::DOUBLE) END, 6) AS rank FROM w""",
    "merge_events": O.ORACLE["alias_resolve"],
    "resolved_names": f"WITH {O._ER} SELECT 'entity_merged' AS op, CASE WHEN length(a)>=length(b) THEN a ELSE b END AS canonical_id, CASE WHEN length(a)>=length(b) THEN b ELSE a END AS alias_id, round(score,3) AS score FROM ps WHERE round(score,9)>=0.85",
    "first_places": f"WITH {O._E}, n AS (SELECT subject AS id, 'entity' AS kind, valid_from, seq, 0 AS z FROM e UNION ALL SELECT object, 'value', valid_from, seq, 1 FROM e) SELECT id, kind, row_number() OVER (ORDER BY valid_from, seq, z) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY valid_from, seq, z) AS r FROM n) WHERE r=1",
    "name_bands": f"WITH {O.similar_sql('SELECT n_name AS name FROM nation UNION SELECT r_name FROM region')} {O._BANDS}",
}
