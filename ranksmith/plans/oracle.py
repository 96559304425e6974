"""Independent DuckDB SQL for the registered queries (the correctness gate).

These strings are written from the operator definitions, not generated from
the Spark plans: they use a plain cross product for top-k, window functions
for ranks and ordinary GROUP BY for the metrics.
"""

from __future__ import annotations

from ..functions.det import u01_sql

TASK_LIST = "['FactCheck','NLI','QA','QAdoc','STS','Twitter']"

V1 = f"""q_vec AS (
  SELECT vec_id AS qid, embedding, label,
         ({TASK_LIST})[(label % 6) + 1] AS task,
         'ev' || CAST((vec_id // 10) % 3 AS VARCHAR) AS event
  FROM embeddings WHERE vec_id % 10 = 0)"""

V2 = """c_vec AS (SELECT vec_id AS did, embedding, label FROM embeddings WHERE vec_id % 10 <> 0)"""

V3 = """qrels_pairs AS (
  SELECT qkey AS qid, dkey AS did FROM run_vec
  UNION
  SELECT q.qid, q.qid + t.o FROM q_vec q, unnest(range(1, 21)) t(o)),
qrels_vec AS (
  SELECT q.task, q.event, q.qid AS qkey, c.did AS dkey,
         CAST(greatest(0, 2 - abs(q.label - c.label)) AS DOUBLE) AS score
  FROM qrels_pairs p JOIN q_vec q ON q.qid = p.qid JOIN c_vec c ON c.did = p.did
  WHERE (q.qid // 10) % 7 <> 0 AND (q.qid * 31 + c.did) % 5 <> 0)"""


def topk_cte(name: str, q: str, c: str, k: int = 10) -> str:
    return f"""{name} AS (
  SELECT qid, did, score, rank FROM (
    SELECT q.qid, c.did,
           round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score,
           row_number() OVER (PARTITION BY q.qid ORDER BY
             round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC,
             c.did ASC) AS rank
    FROM {q} q CROSS JOIN {c} c) WHERE rank <= {k})"""


V4 = topk_cte("topk_vec", "q_vec", "c_vec") + """,
run_vec AS (
  SELECT 'base' AS model, q.task, q.event, q.qid AS qrow, q.qid AS qkey,
         CAST(t.rank AS BIGINT) AS rank, t.did AS dkey, t.score
  FROM topk_vec t JOIN q_vec q USING (qid))"""

V5 = f"""ckpt(model, n, w) AS (VALUES ('checkpoint-10', 0, 0.0::DOUBLE), ('checkpoint-20', 1, 0.1::DOUBLE), ('checkpoint-30', 2, 0.2::DOUBLE)),
mq_vec AS (
  SELECT k.model, q.task, q.event, q.qid AS own, q.qid * 3 + k.n AS qid,
         list_transform(q.embedding, lambda x, i: (1 - k.w) * CAST(x AS DOUBLE) + k.w * ({u01_sql('k.model', 'q.qid', 'i - 1')} - 0.5)) AS embedding
  FROM q_vec q CROSS JOIN ckpt k),
""" + topk_cte("topk_models", "mq_vec", "c_vec") + """,
models_run AS (
  SELECT q.model, q.task, q.event, q.own AS qrow, q.own AS qkey, t.did AS dkey, t.score, CAST(t.rank AS BIGINT) AS rank
  FROM topk_models t JOIN mq_vec q USING (qid))"""

VEC_VIEWS = ",\n".join([V1, V2, V4, V3])


def metrics_ctes(run: str, qrels: str, k: int = 10, cut_before_filter: bool = True,
                 stats_uncut: bool = False) -> str:
    """CTE text ending in ``perq`` (one row per query row of the run)."""
    cut = f"WHERE r.rank <= {k}" if (cut_before_filter and not stats_uncut) else ""
    ign_filter = f"score IS NOT NULL AND rank <= {k}" if cut_before_filter else "score IS NOT NULL"
    pair_ok = "TRUE" if stats_uncut else f"rank <= {k}"
    return f"""graded AS (
  SELECT r.model, r.task, r.event, r.qrow, r.qkey, r.rank, r.dkey, j.score
  FROM {run} r LEFT JOIN {qrels} j
    ON r.task = j.task AND r.event = j.event AND r.qkey = j.qkey AND r.dkey = j.dkey
  {cut}),
ign AS (
  SELECT *, row_number() OVER (PARTITION BY model, task, event, qrow ORDER BY rank) AS irank
  FROM graded WHERE {ign_filter}),
ideal AS (
  SELECT task, event, qkey,
         sum(CASE WHEN irank <= {k} THEN (pow(2, score) - 1) / log2(irank + 1) ELSE 0 END) AS idcg,
         count(*) FILTER (WHERE score > 0) AS rel_total
  FROM (SELECT *, row_number() OVER (PARTITION BY task, event, qkey ORDER BY score DESC) AS irank
        FROM {qrels}) GROUP BY task, event, qkey),
pz AS (
  SELECT model, task, event, qrow, qkey,
         count(*) FILTER (WHERE {pair_ok}) AS n_pairs,
         count(*) FILTER (WHERE {pair_ok} AND score IS NULL) AS n_unjudged,
         sum(CASE WHEN rank <= {k} THEN (pow(2, coalesce(score, 0)) - 1) / log2(rank + 1) ELSE 0 END) AS dcg_z,
         min(rank) FILTER (WHERE rank <= {k} AND coalesce(score, 0) > 0) AS first_z,
         count(*) FILTER (WHERE rank <= {k} AND coalesce(score, 0) > 0) AS hit_z
  FROM graded GROUP BY model, task, event, qrow, qkey),
pi AS (
  SELECT model, task, event, qrow,
         sum(CASE WHEN irank <= {k} THEN (pow(2, score) - 1) / log2(irank + 1) ELSE 0 END) AS dcg_i,
         min(irank) FILTER (WHERE irank <= {k} AND score > 0) AS first_i,
         count(*) FILTER (WHERE irank <= {k} AND score > 0) AS hit_i
  FROM ign GROUP BY model, task, event, qrow),
perq AS (
  SELECT pz.model, pz.task, pz.event, pz.qrow, pz.qkey, pz.n_pairs, pz.n_unjudged,
         ideal.idcg IS NOT NULL AS judged, f.task IS NOT NULL AS file_judged,
         CASE WHEN ideal.idcg > 0 THEN dcg_z / ideal.idcg ELSE 0 END AS ndcg_z,
         coalesce(1.0 / first_z, 0) AS rr_z,
         CASE WHEN ideal.rel_total > 0 THEN hit_z / ideal.rel_total ELSE 0 END AS rec_z,
         CASE WHEN ideal.idcg > 0 THEN coalesce(pi.dcg_i, 0) / ideal.idcg ELSE 0 END AS ndcg_i,
         coalesce(1.0 / pi.first_i, 0) AS rr_i,
         CASE WHEN ideal.rel_total > 0 THEN coalesce(pi.hit_i, 0) / ideal.rel_total ELSE 0 END AS rec_i
  FROM pz LEFT JOIN pi USING (model, task, event, qrow)
          LEFT JOIN ideal USING (task, event, qkey)
          LEFT JOIN (SELECT DISTINCT task, event FROM {qrels}) f ON f.task = pz.task AND f.event = pz.event)"""


PER_EVENT_SELECT = """SELECT model, task AS search_task, event AS event_type, 'zero' AS variant,
       CAST(count(*) AS BIGINT) AS num_queries, round(avg(ndcg_z), 6) AS "NDCG@10",
       round(avg(rr_z), 6) AS "RR@10", round(avg(rec_z), 6) AS "REC@10"
FROM perq WHERE judged GROUP BY model, task, event
UNION ALL
SELECT model, task, event, 'ignore', CAST(count(*) AS BIGINT), round(avg(ndcg_i), 6),
       round(avg(rr_i), 6), round(avg(rec_i), 6)
FROM perq WHERE judged GROUP BY model, task, event"""

PER_TASK_SELECT = """SELECT model, task AS search_task, round(avg(ndcg), 6) AS "NDCG@10"
FROM (SELECT model, task, event, avg(ndcg_z) AS ndcg FROM perq WHERE judged GROUP BY ALL)
GROUP BY model, task"""

OVERALL_SELECT = """SELECT model, round(avg(ndcg), 6) AS overall_ndcg,
       printf('Overall mean NDCG@10: %.4f', avg(ndcg)) AS overall_text
FROM (SELECT model, task, avg(ndcg) AS ndcg FROM
        (SELECT model, task, event, avg(ndcg_z) AS ndcg FROM perq WHERE judged GROUP BY ALL)
      GROUP BY ALL)
GROUP BY model"""

STATS_SELECT = """SELECT model, CAST(sum(n_pairs) AS BIGINT) AS total_retrieved_pairs,
       CAST(sum(CASE WHEN judged THEN n_unjudged ELSE 0 END) AS BIGINT) AS unannotated_pairs,
       round(CASE WHEN sum(n_pairs) > 0
                  THEN sum(CASE WHEN judged THEN n_unjudged ELSE 0 END) / sum(n_pairs) ELSE 0 END, 6)
         AS unannotated_ratio
FROM perq WHERE file_judged GROUP BY model"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- text path ----------------------------------------------------------------

STRIP_RE = r"^[\s\p{Z}\x0B\x1C-\x1F\x85]+|[\s\p{Z}\x0B\x1C-\x1F\x85]+$"


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '{STRIP_RE}', '', 'g')"


CORPUS_TXT = f"""corpus_txt AS (
  SELECT CAST(row_number() OVER (ORDER BY title, _id) - 1 AS BIGINT) AS idx,
         CAST(_id AS VARCHAR) AS did, passage
  FROM (SELECT doc_id AS _id, source AS title,
               {strip_sql(f"concat_ws(chr(10), nullif({strip_sql('source')}, ''), nullif({strip_sql('text')}, ''))")} AS passage
        FROM documents)
  WHERE length(passage) > 0)"""

Q_TXT = f"""q_txt AS (
  SELECT item_id AS qid, 'QA' AS task,
         'Given the question, retrieve most relevant passage that best answers the question: '
           || {strip_sql('text')} AS query
  FROM benchmark)"""


def hash_feat_cte(name: str, src: str, id_col: str, text_col: str, dim: int = 64) -> str:
    return f"""{name} AS (
  SELECT id, bucket, sum(sgn) AS value FROM (
    SELECT id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % {dim} AS bucket,
           CAST(CASE WHEN CAST(('0x' || substr(md5(tok), 9, 1)) AS INTEGER) < 8 THEN 1 ELSE -1 END AS DOUBLE) AS sgn
    FROM (SELECT {id_col} AS id, unnest(string_split_regex(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+')) AS tok
          FROM {src})
    WHERE length(tok) > 0)
  GROUP BY id, bucket)"""


TEXT_TOPK = ",\n".join([
    CORPUS_TXT, Q_TXT,
    hash_feat_cte("dfeat", "corpus_txt", "idx", "passage"),
    hash_feat_cte("qfeat", "q_txt", "qid", "query"),
    """dnorm AS (SELECT id, sqrt(sum(value * value)) AS norm FROM dfeat GROUP BY id)""",
    """qnorm AS (SELECT id, sqrt(sum(value * value)) AS norm FROM qfeat GROUP BY id)""",
    """tscore AS (
  SELECT q.id AS qid, d.id AS idx, round(sum(q.value * d.value) / (qn.norm * dn.norm), 6) AS score
  FROM qfeat q JOIN dfeat d ON q.bucket = d.bucket
       JOIN qnorm qn ON qn.id = q.id JOIN dnorm dn ON dn.id = d.id
  WHERE qn.norm > 0 AND dn.norm > 0
  GROUP BY q.id, d.id, qn.norm, dn.norm)""",
    """text_topk AS (
  SELECT t.qid, CAST(row_number() OVER (PARTITION BY t.qid ORDER BY t.score DESC, t.idx ASC) AS BIGINT) AS rank,
         t.idx, c.did, t.score
  FROM tscore t JOIN corpus_txt c ON c.idx = t.idx
  QUALIFY rank <= 10)""",
])

QRELS_TXT = """qrels_txt AS (
  SELECT 'QA' AS task, 'txt' AS event, CAST(b.item_id AS VARCHAR) AS qkey, CAST(d.doc_id AS VARCHAR) AS dkey,
         CAST(1 + coalesce(l.quality, 0) AS DOUBLE) AS score
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""

RUN_TXT = """run_txt AS (
  SELECT 'hash64' AS model, 'QA' AS task, 'txt' AS event, qid AS qrow, CAST(qid AS VARCHAR) AS qkey,
         rank, did AS dkey, score
  FROM text_topk)"""


# ---- training pairs, groups and batch plan ----------------------------------------


def _u(*a):
    return u01_sql(*a)


TRAIN_PAIRS = f"""u_ AS (SELECT * FROM conversations WHERE role = 'user'),
a_ AS (SELECT * FROM conversations WHERE role = 'assistant'),
qs AS (SELECT u.conv_id, u.turn, u.text AS query, a.text AS pos_text
       FROM u_ u JOIN a_ a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
cand AS (SELECT conv_id AS c_conv, turn AS c_turn, text AS c_text, {_u("'cand'", 'conv_id', 'turn')} AS h FROM a_),
ring AS (SELECT *, row_number() OVER (ORDER BY h, c_conv, c_turn) - 1 AS cpos FROM cand),
sz AS (SELECT count(*) AS n FROM cand),
probes AS (
  SELECT q.*, 1 + q.conv_id % 12 AS n_neg, o,
         (CAST(floor({_u("'start'", 'q.conv_id', 'q.turn')} * sz.n) AS BIGINT) + o) % sz.n AS cpos
  FROM qs q CROSS JOIN sz, unnest(range(0, sz.n)) t(o)),
hit AS (SELECT p.*, r.c_conv, r.c_turn, r.c_text FROM probes p JOIN ring r ON r.cpos = p.cpos
        WHERE r.c_conv <> p.conv_id),
hit1 AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY conv_id, turn, cpos ORDER BY o) = 1),
hit2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY o) AS k FROM hit1 QUALIFY k <= n_neg),
pairs_long AS (
  SELECT conv_id * 1000 + turn AS row_id, conv_id % 5 AS dataset_id, query, 'pos' AS kind,
         CAST(0 AS BIGINT) AS j, pos_text AS text, {_u("'pos'", 'conv_id', 'turn')} AS score FROM qs
  UNION ALL
  SELECT conv_id * 1000 + turn, conv_id % 5, query, 'neg', CAST(k - 1 AS BIGINT), c_text,
         {_u("'neg'", 'conv_id', 'turn', 'c_conv', 'c_turn')} FROM hit2)"""

SEED, EPOCH, GROUP, RATIO = 7, 0, 8, 0.3
QA_INS = "Given the question, retrieve most relevant passage that best answers the question"

TRAIN_GROUPS = TRAIN_PAIRS + f""",
rows_ AS (SELECT row_id, dataset_id, any_value(query) AS query,
                 list(text ORDER BY j) FILTER (WHERE kind = 'pos') AS pos,
                 list(text ORDER BY j) FILTER (WHERE kind = 'neg') AS neg,
                 list(score ORDER BY j) FILTER (WHERE kind = 'pos') AS pos_scores,
                 list(score ORDER BY j) FILTER (WHERE kind = 'neg') AS neg_scores
          FROM pairs_long GROUP BY row_id, dataset_id),
negpick AS (
  SELECT row_id, jj, k AS slot FROM (
    SELECT row_id, jj, row_number() OVER (PARTITION BY row_id ORDER BY u, jj) AS k FROM (
      SELECT r.row_id, t.jj % len(r.neg) AS jj, {_u(str(SEED), str(EPOCH), 'r.row_id', "'neg'", 't.jj')} AS u
      FROM rows_ r, unnest(range(0, CAST(ceil({GROUP - 1} / len(r.neg)) AS BIGINT) * len(r.neg))) t(jj)
      WHERE len(r.neg) > 0))
  WHERE k <= {GROUP - 1}),
posp AS (
  SELECT r.*, CAST(floor({_u(str(SEED), str(EPOCH), 'r.row_id', "'pos'")} * len(r.pos)) AS BIGINT) AS pi FROM rows_ r),
pos_txt AS (
  SELECT p.row_id, p.pi, p.pos[p.pi + 1] AS t, length(p.pos[p.pi + 1]) AS n,
         CAST(floor(length(p.pos[p.pi + 1]) / 3) AS BIGINT) + 1 AS sz FROM posp p),
pos_shuf AS (
  SELECT row_id, CASE WHEN n > 100 AND {_u(str(SEED), str(EPOCH), 'row_id', "'shuffle'")} < {RATIO}
         THEN array_to_string(list_transform(list_sort(list_transform(range(0, CAST(ceil(n / sz) AS BIGINT)),
                lambda i: struct_pack(u := {_u(str(SEED), str(EPOCH), 'row_id', "'chunk'", 'i')}, i := i,
                                      s := substring(t, CAST(i * sz + 1 AS BIGINT), sz)))), lambda x: x.s), ' ')
         ELSE t END AS text FROM pos_txt),
groups_long AS (
  SELECT p.row_id, p.dataset_id, '{QA_INS}' || ': ' || p.query AS query, CAST(0 AS BIGINT) AS j,
         s.text, p.pos_scores[p.pi + 1] AS teacher
  FROM posp p JOIN pos_shuf s USING (row_id)
  UNION ALL
  SELECT r.row_id, r.dataset_id, '{QA_INS}' || ': ' || r.query, CAST(n.slot AS BIGINT), r.neg[n.jj + 1],
         r.neg_scores[n.jj + 1]
  FROM rows_ r JOIN negpick n USING (row_id))"""

BATCH_PLAN = TRAIN_PAIRS + f""",
rows_ AS (SELECT DISTINCT row_id, dataset_id FROM pairs_long),
ranked AS (SELECT row_id, dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY
             {_u(str(SEED), str(EPOCH), "'row'", 'row_id')}, row_id) - 1 AS rnk,
             count(*) OVER (PARTITION BY dataset_id) AS n FROM rows_),
plan AS (
  SELECT CAST({EPOCH} AS INTEGER) AS epoch, dataset_id, CAST(rnk // (16 * 2) AS BIGINT) AS batch_no,
         CAST((rnk % (16 * 2)) // 16 AS INTEGER) AS rank, CAST(rnk % 16 AS INTEGER) AS slot, row_id
  FROM ranked WHERE rnk // (16 * 2) < n // (16 * 2))"""

TEMP = 0.05

LOSS_AUDIT = TRAIN_GROUPS + ",\n" + f"""texts AS (
  SELECT row_id * 100 + j + 1 AS tid, text FROM groups_long
  UNION ALL SELECT DISTINCT row_id * 100 AS tid, query FROM groups_long),
""" + hash_feat_cte("tfeat", "texts", "tid", "text") + f""",
tnorm AS (SELECT id, sqrt(sum(value * value)) AS norm FROM tfeat GROUP BY id),
dots AS (SELECT q.id AS qid, d.id AS pid, sum(q.value * d.value) AS dot
         FROM tfeat q JOIN tfeat d ON q.bucket = d.bucket AND d.id // 100 = q.id // 100
         WHERE q.id % 100 = 0 AND d.id % 100 <> 0 GROUP BY q.id, d.id),
sc AS (
  SELECT g.row_id, g.j, g.teacher,
         CASE WHEN qn.norm > 0 AND dn.norm > 0 THEN coalesce(dots.dot, 0) / (qn.norm * dn.norm) ELSE 0 END
           / {TEMP} AS score
  FROM groups_long g
  LEFT JOIN tnorm qn ON qn.id = g.row_id * 100
  LEFT JOIN tnorm dn ON dn.id = g.row_id * 100 + g.j + 1
  LEFT JOIN dots ON dots.qid = g.row_id * 100 AND dots.pid = g.row_id * 100 + g.j + 1),
agg AS (
  SELECT row_id, max(score) AS m, max(teacher) AS mt FROM sc GROUP BY row_id),
lse AS (
  SELECT s.row_id, a.m + ln(sum(exp(s.score - a.m))) AS lse, sum(exp(s.teacher - a.mt)) AS tz
  FROM sc s JOIN agg a USING (row_id) GROUP BY s.row_id, a.m),
audit AS (
  SELECT s.row_id,
         round(any_value(l.lse) - max(CASE WHEN s.j = 0 THEN s.score END), 6) AS loss_group,
         round(-sum(exp(s.teacher - a.mt) / l.tz * (s.score - l.lse)), 6) AS kd_kl
  FROM sc s JOIN lse l USING (row_id) JOIN agg a USING (row_id) GROUP BY s.row_id)"""


# ---- pre-training text ----------------------------------------------------------

WS_RE = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"
PACK_L = 64

LINES = f"""lines AS (
  SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines_ix AS (SELECT *, CAST(row_number() OVER (ORDER BY doc_id, line_no) - 1 AS BIGINT) AS idx FROM lines)"""

LINES_SPLIT = LINES + """,
split_ AS (SELECT doc_id, line_no, idx,
  CASE WHEN idx < floor((SELECT count(*) FROM lines_ix) * 2.0 / 100 + 0.5) THEN 'validation' ELSE 'train' END AS split
  FROM lines_ix)"""

PACKED = LINES + f""",
toks AS (
  SELECT idx, list_transform(list_filter(string_split_regex(line, '{WS_RE}'), lambda t: length(t) > 0),
           lambda t: CAST((CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 30000) + 10 AS INTEGER)) AS ids
  FROM lines_ix),
rows_ AS (
  SELECT idx, ids, idx // 1000 AS batch_no, len(ids) AS n,
         coalesce(sum(len(ids)) OVER (PARTITION BY idx // 1000 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
         sum(len(ids)) OVER (PARTITION BY idx // 1000) AS total
  FROM toks),
tok AS (
  SELECT batch_no, total, off + generate_subscripts(ids, 1) - 1 AS p, unnest(ids) AS id FROM rows_ WHERE n > 0),
blocks AS (
  SELECT CAST(batch_no AS BIGINT) AS batch_no, CAST(p // {PACK_L} AS BIGINT) AS block_no, list(id ORDER BY p) AS ids
  FROM tok WHERE p // {PACK_L} < total // {PACK_L} GROUP BY batch_no, p // {PACK_L})"""


# ---- sweep reports --------------------------------------------------------------

TASKS_SQL = ["FactCheck", "NLI", "QA", "QAdoc", "STS", "Twitter"]

SWEEP_TASK = """sweep_task AS (
  SELECT model, task AS search_task, round(avg(ndcg), 6) AS "NDCG@10"
  FROM (SELECT model, task, event, avg(ndcg_z) AS ndcg FROM perq WHERE judged GROUP BY ALL)
  GROUP BY model, task)"""

SWEEP_TASK_LIGHT = """sweep_light AS (
  SELECT model, task AS search_task, round(avg(ndcg_z), 6) AS "NDCG@10"
  FROM perq WHERE judged AND event = 'ev0' GROUP BY model, task)"""
