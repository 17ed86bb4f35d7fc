"""The registered queries restated in SQL for an independent engine."""

from __future__ import annotations

from tessella import schemas
from tessella.functions import lexicon as lx
from tessella.functions import words as W

BLANK = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORD = r"[\p{L}\p{M}\p{N}_]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {quote(BLANK + '+')}), lambda w: w <> '')"


def word_set(x: str) -> str:
    return f"list_distinct({words(f'lower({x})')})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {quote('^' + BLANK + '+|' + BLANK + '+$')}, '', 'g')"


def tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {quote(W.TOKEN)}), lambda t: lower(t))"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def caps(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all({x}, {quote(WORD + '+')}), "
        "lambda w: regexp_full_match(w, '[A-Z][a-z]+'))"
    )


def frag_id(n: str) -> str:
    return f"(CASE WHEN ({n}) % 10 = 0 THEN printf('F-%04d', {n}) ELSE printf('D-%06d', {n}) END)"


def origin(n: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(schemas.QUALITY_SOURCES))
    return f"(CASE ({n}) % 9 {cases} END)"


THRESHOLD = (
    "(CASE final_source WHEN 'user_claimed' THEN 0.95::DOUBLE WHEN 'llm_self_reported' THEN 0.85 "
    "WHEN 'heuristic_boosted' THEN 0.85 WHEN 'independently_verified' THEN 0.70 "
    "WHEN 'majority_vote' THEN 0.75 WHEN 'rastrello_discovered' THEN 0.80 "
    "WHEN 'evaluator_computed' THEN 0.75 WHEN 'inherited' THEN 0.85 ELSE 0.80 END)"
)

PARENTS = (
    "(CASE WHEN doc_id = 0 THEN []::BIGINT[] WHEN doc_id % 5 = 0 AND (doc_id - 1) // 2 <> doc_id - 1 "
    "THEN [(doc_id - 1) // 2, doc_id - 1] ELSE [(doc_id - 1) // 2] END)"
)

FRAG = f"""frag AS (
  SELECT {frag_id('doc_id')} AS id, doc_id AS seq, source AS shelf, text AS content, lang AS topic,
         (doc_id * 37 % 101)::DOUBLE / 100 AS quality, {origin('doc_id')} AS final_source,
         CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'author-' || (doc_id % 7) END AS author,
         [lang, source, CASE WHEN doc_id % 2 = 0 THEN 'Even' ELSE 'odd' END] AS tags,
         CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at,
         {words('lower(text)')}[1:2] AS keywords
  FROM documents),
frag2 AS (SELECT *, {THRESHOLD} AS threshold, quality >= {THRESHOLD} AS sure,
  substring(sha256(id || '::' || content || '::' || strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00')), 1, 16) AS checksum
  FROM frag)"""

QUERIES = f"""q AS (SELECT item_id AS qid, text || CASE WHEN item_id % 4 = 0 THEN ' ' || {words('text')}[1] ELSE '' END AS text FROM benchmark)"""

VECTORS = f"""nv AS (SELECT count(*) AS n FROM embeddings),
vec AS (SELECT {frag_id('d.doc_id')} AS id, d.doc_id AS seq, e.embedding::DOUBLE[] AS vec
        FROM documents d, nv, embeddings e WHERE e.vec_id = d.doc_id % nv.n),
qvec AS (SELECT b.item_id AS qid, e.embedding::DOUBLE[] AS vec
         FROM benchmark b, nv, embeddings e WHERE e.vec_id = (b.item_id * 11 + 3) % nv.n)"""

_ops = listed(schemas.OPERATION_TYPES)
_statuses = listed(schemas.APPEAL_STATUSES)
APPEALS = f"""nd AS (SELECT count(*) AS n FROM documents),
app0 AS (SELECT c.*, (conv_id * 7 + turn) % n AS s1, (conv_id * 13) % n AS s2 FROM conversations c, nd),
app AS (SELECT 'A-' || conv_id || '-' || turn AS id, conv_id * 1000 + turn AS seq, conv_id, turn,
  list_concat([{frag_id('s1')}, {frag_id('s2')}], CASE WHEN conv_id % 17 = 0 THEN ['D-missing'] ELSE []::VARCHAR[] END) AS sources,
  list_transform(range(1, 1 + CASE WHEN conv_id % 23 = 0 THEN 11 ELSE turn % 3 END), lambda i: {_ops}[(conv_id + i) % 7 + 1]) AS ops,
  {_statuses}[(conv_id + turn) % 5 + 1] AS status,
  d.text
    || CASE WHEN turn % 3 = 0 THEN ' perhaps maybe' ELSE '' END
    || CASE WHEN turn % 4 = 0 THEN ' not never' ELSE '' END
    || ' ' || a.text AS proposed_content,
  'explanation ' || conv_id AS explanation,
  TIMESTAMP '2024-01-01' + to_hours(conv_id) AS created_at,
  CASE WHEN (conv_id + turn) % 5 IN (2, 3) THEN TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_seconds(turn * 977) END AS resolved_at
  FROM app0 a JOIN documents d ON d.doc_id = a.s1)"""

LINKS = """links AS (SELECT id, u.pos - 1 AS pos, u.source_id FROM (SELECT id, unnest(list_transform(sources, lambda s, i: {'pos': i, 'source_id': s})) AS u FROM app)),
cited AS (SELECT l.id, l.pos, l.source_id, f.* EXCLUDE (id) FROM links l JOIN frag2 f ON f.id = l.source_id)"""

MEASURED = f"""srcw AS (SELECT id, flatten(list({words('content')} ORDER BY pos)) AS sw, count(*) AS n_cited FROM cited GROUP BY id),
m0 AS (SELECT a.*, {words('a.proposed_content')} AS pw, coalesce(s.sw, []) AS sw, coalesce(s.n_cited, 0) AS n_cited
       FROM app a LEFT JOIN srcw s ON s.id = a.id),
m1 AS (SELECT *, list_distinct(pw) AS pset, list_distinct(sw) AS sset, len(pw) AS np, len(sw) AS ns,
         {word_set('proposed_content')} AS lset FROM m0),
m2 AS (SELECT *, len(list_intersect(pset, sset)) AS shared, np::DOUBLE / greatest(ns, 1) AS ratio,
         CASE WHEN len(lset) = 0 THEN 0.0 ELSE least(len(list_intersect(lset, {listed(lx.HEDGES)}))::DOUBLE / len(lset) * 5.0, 1.0) END AS vague
       FROM m1),
m3 AS (SELECT *, np - ns AS delta_token,
  CASE WHEN len(sset) = 0 THEN (CASE WHEN len(pset) = 0 THEN 1.0 ELSE 0.0 END) ELSE shared::DOUBLE / len(sset) END AS coverage,
  least(CASE WHEN ns = 0 THEN (CASE WHEN np > 0 THEN 0.5 ELSE 0.0 END) ELSE least(
     (CASE WHEN ratio > 2.0 THEN least((ratio - 2.0) / 2.0 * 0.5, 0.5) ELSE 0.0 END)
   + (CASE WHEN len(pset) > 0 AND len(sset) > 0 THEN (len(pset) - shared)::DOUBLE / len(pset) * 0.3 ELSE 0.0 END)
   + (CASE WHEN ratio < 0.5 AND ns > 5 THEN 0.2 ELSE 0.0 END), 1.0) END + vague * 0.15, 1.0)::DOUBLE AS risk
  FROM m2),
measured AS (SELECT *, 0.3 * tanh(delta_token::DOUBLE / greatest(ns, 1)) + 0.4 * coverage - 0.3 * risk AS agg FROM m3)"""


def bm25_ctes(shelf: str) -> str:
    """Scored keyword hits ``bm(qid, shelf, id, seq, score)``; ``shelf`` is a SQL expression."""
    return f"""tok AS (SELECT id, seq, {shelf} AS shelf, {tokens('content')} AS toks FROM frag),
post AS (SELECT id, seq, shelf, term, count(*) AS tf FROM (SELECT id, seq, shelf, unnest(toks) AS term FROM tok) GROUP BY ALL),
dl AS (SELECT id, shelf, len(toks) AS dl FROM tok WHERE len(toks) > 0),
st AS (SELECT shelf, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY shelf),
df AS (SELECT shelf, term, count(*) AS df FROM post GROUP BY ALL),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens('text')}) AS term FROM q) GROUP BY ALL),
bm AS (SELECT qt.qid, post.shelf, post.id, post.seq,
  sum(qt.qtf * ln((st.n - df.df + 0.5) / (df.df + 0.5) + 1) * post.tf * 2.5
      / (post.tf + 1.5 * (1 - 0.75 + 0.75 * dl.dl / st.avgdl))) AS score
  FROM qt JOIN post ON post.term = qt.term JOIN df ON df.term = post.term AND df.shelf = post.shelf
  JOIN st ON st.shelf = post.shelf JOIN dl ON dl.id = post.id GROUP BY ALL)"""


def top(source: str, keys: str, k: int, value: str = "score") -> str:
    return (
        f"(SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round({value}, 9) DESC, seq) AS rank "
        f"FROM {source} QUALIFY rank <= {k})"
    )


NORM = "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


def hybrid_ctes(k: int = 5) -> str:
    depth = max(2 * k, 10)
    return f"""{FRAG}, {QUERIES}, {VECTORS}, {bm25_ctes("'x'")},
vs AS (SELECT v.id, v.seq, qv.qid, list_dot_product(v.vec, qv.vec) AS score FROM vec v, qvec qv),
kn AS (SELECT qid, id, seq, {NORM} AS kw FROM {top('bm', 'qid', depth)} WINDOW w AS (PARTITION BY qid)),
en AS (SELECT qid, id, seq, {NORM} AS emb FROM {top('vs', 'qid', depth)} WINDOW w AS (PARTITION BY qid)),
fused AS (SELECT qid, id, seq, 0.4 * coalesce(kw, 0) + 0.6 * coalesce(emb, 0) AS score, coalesce(emb, 0) AS emb
          FROM kn FULL JOIN en USING (qid, id, seq)),
hy AS {top('(SELECT * FROM fused WHERE emb >= 0.72 OR score > 0)', 'qid', k)}"""


def entry_ctes(probes: str, exclude: str = "") -> str:
    """Listed conflicts ``ent`` of ``probes`` (id, content, vec) with the stored rows."""
    return f"""pw AS (SELECT id, {words('content')} AS w, {word_set('content')} AS ws FROM {probes}),
ps AS (SELECT id, w, {sides('ws', 0)} AS l, {sides('ws', 1)} AS r FROM pw),
ow AS (SELECT id, seq, {words('content')} AS w, {word_set('content')} AS ws FROM frag),
os AS (SELECT id, seq, w, {sides('ws', 0)} AS l, {sides('ws', 1)} AS r FROM ow),
pr AS (SELECT p.id, v.id AS other_id, list_dot_product(p.vec, v.vec) AS s FROM {probes} p JOIN vec v ON p.id <> v.id),
hit AS (SELECT pr.*, x.w AS pw, y.w AS ow, y.seq AS other_seq, {opposed('x', 'y')} AS contra
  FROM pr JOIN ps x ON x.id = pr.id JOIN os y ON y.id = pr.other_id WHERE pr.s >= 0.85{exclude}),
ent AS (SELECT id, other_id, other_seq, s, contra, CASE WHEN contra > 0.5 THEN 'nli_contradiction' ELSE 'embedding_similarity' END AS method,
  array_to_string(list_filter(pw, lambda w: list_contains(ow, w)), ' ') AS t FROM hit),
entries AS (SELECT id, other_id, method, CASE WHEN length(t) > 10 THEN t ELSE '' END AS excerpt,
  round(s, 4) AS similarity, round(contra, 4) AS contradiction FROM ent)"""


HIT_PROBES = "hp AS (SELECT DISTINCT f.id, f.content, v.vec FROM hy JOIN frag f ON f.id = hy.id JOIN vec v ON v.id = hy.id)"

_toks = "toks"
_bigrams = "list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])"
_singles = "list_filter(toks, lambda t: length(t) > 2)"
_half = "length(text) // 2"
_long = (
    "list_concat(list_concat(regexp_extract_all(text, '\"([^\"]+)\"', 1), " + caps("text") + "), "
    "list_filter(toks, lambda t: length(t) > 2 AND NOT list_contains("
    + listed(lx.ASPECT_STOPWORDS)
    + ", t))[1:6])"
)
ASPECTS = f"""asp0 AS (SELECT qid, text, {words('lower(text)')} AS toks FROM q),
asp1 AS (SELECT *, list_concat({_singles}, {_bigrams}) AS base, {_long} AS long FROM asp0),
asp2 AS (SELECT *, CASE WHEN len(base) < 2 AND length(text) > 2
   THEN list_concat(base, [substring(text, 1, {_half}), substring(text, {_half} + 1)]) ELSE base END AS short FROM asp1),
asp AS (SELECT qid, text,
   CASE WHEN len(toks) < 5 THEN {ordered_distinct('short')}[1:5] ELSE {ordered_distinct('long')}[1:10] END AS aspects,
   CASE WHEN len(toks) < 5 THEN {ordered_distinct('base')}[1:5] ELSE {ordered_distinct('long')}[1:10] END AS caspects FROM asp2)"""


def intake_ctes(k: int) -> str:
    return f"""{FRAG}, {QUERIES}, {ASPECTS},
qw AS (SELECT qid, {word_set('text')} AS ws FROM q),
fw AS (SELECT id, seq, {word_set('content')} AS ws FROM frag),
sim AS (SELECT a.qid, b.id, b.seq, count(*)::DOUBLE / least(a.n, b.m) AS sim
  FROM (SELECT qid, len(ws) AS n, unnest(ws) AS w FROM qw) a JOIN (SELECT id, seq, len(ws) AS m, unnest(ws) AS w FROM fw) b ON a.w = b.w
  GROUP BY a.qid, b.id, b.seq, a.n, b.m),
cand AS {top('(SELECT * FROM sim WHERE sim >= 0.35)', 'qid', k, 'sim')},
cert AS (SELECT c.qid, c.rank, c.sim, f.* FROM cand c JOIN frag2 f ON f.id = c.id WHERE f.sure),
ua AS (SELECT qid, unnest(list_transform(aspects, lambda a, i: {{'i': i, 'a': a}})) AS u FROM asp),
hit AS (SELECT qid, u.i AS i, u.a AS a, EXISTS (SELECT 1 FROM cert c WHERE c.qid = ua.qid AND (
   contains(lower(c.content), lower(u.a)) OR contains(lower(c.topic), lower(u.a))
   OR len(list_filter(c.tags, lambda t: contains(lower(t), lower(u.a)))) > 0)) AS hit FROM ua),
hits AS (SELECT qid, coalesce(list(a ORDER BY i) FILTER (hit), []) AS matched,
   coalesce(list(a ORDER BY i) FILTER (NOT hit), []) AS missing FROM hit GROUP BY qid),
certs AS (SELECT qid, list(id ORDER BY rank) AS ids, max(sim) AS max_sim, count(*) AS n_cert,
   sum(len({words('content')})) AS words FROM cert GROUP BY qid),
scanned AS (SELECT q.qid, q.text, a.aspects, a.caspects, coalesce(h.matched, []) AS matched, coalesce(h.missing, []) AS missing,
   coalesce(c.ids, []) AS ids, coalesce(c.max_sim, 0.0) AS max_sim, coalesce(c.n_cert, 0) AS n_cert, coalesce(c.words, 0) AS words,
   coalesce(c.n_cert, 0) > 0 AND len(coalesce(h.matched, [])) >= len(a.aspects) * 0.4 AS proceed
   FROM q JOIN asp a ON a.qid = q.qid LEFT JOIN hits h ON h.qid = q.qid LEFT JOIN certs c ON c.qid = q.qid)"""


def gaps_text(x: str) -> str:
    return (
        f"CASE len({x}) WHEN 0 THEN '' WHEN 1 THEN 'Missing aspect: ' || {x}[1] "
        f"ELSE 'Missing aspects: ' || array_to_string({x}[1:len({x}) - 1], ', ') || ', and ' || {x}[len({x})] END"
    )


ROUTED = """ratioed AS (SELECT *, len(matched)::DOUBLE / greatest(len(aspects), 1) AS ratio FROM scanned),
routed AS (SELECT *, CASE WHEN proceed AND ratio >= 0.9 THEN 'compose' WHEN proceed AND ratio >= 0.4 THEN 'partial' ELSE 'generate' END AS path,
  (len(%s) + words * 1.1::DOUBLE) * 1.3::DOUBLE AS cc,
  (len(%s) + list_sum(list_concat([0], list_transform(aspects, lambda a: len(%s))))) * 3.0::DOUBLE * 1.3::DOUBLE AS gc FROM ratioed)""" % (
    words("text"), words("text"), words("a"),
)


def frequent(source: str, key: str, text: str, limit: int) -> str:
    return f"""fq0 AS (SELECT {key} AS k, unnest(list_transform({words(text)}, lambda w, i: {{'w': w, 'i': i}})) AS u FROM {source}),
fq1 AS (SELECT k, lower(u.w) AS w, count(*) AS n, min(u.i) AS f FROM fq0 WHERE length(u.w) > 3 GROUP BY ALL),
fq2 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, f) AS rn FROM fq1 QUALIFY rn <= {limit}),
fq AS (SELECT k, list(w ORDER BY rn) AS frequent FROM fq2 WHERE n >= 2 GROUP BY k)"""


DEFINITION = f"(?:is|are|was|were|means|refers to|defined as) ({WORD}+(?:{BLANK}+{WORD}+){{0,5}})"
CONNECT = f"""{frequent('frag', 'id', 'content', 8)},
con0 AS (SELECT f.id, list_concat(list_concat([f.topic], f.tags), list_concat({caps('f.content')}[1:5], coalesce(fq.frequent, []))) AS t,
  list_concat([f.topic], list_transform(regexp_extract_all(f.content, {quote(DEFINITION)}, 1)[1:3], lambda s: {strip('s')})) AS s
  FROM frag f LEFT JOIN fq ON fq.k = f.id),
con AS (SELECT id, {ordered_distinct('t')}[1:10] AS tabs, {ordered_distinct('s')}[1:10] AS slots FROM con0)"""

GAPS = f"""uca AS (SELECT qid, unnest(list_transform(caspects, lambda a, i: {{'i': i, 'a': a}})) AS u FROM scanned),
terms AS (SELECT c.qid, lower(c.content) AS lc, list_transform(list_concat(con.tabs, con.slots), lambda t: lower(t)) AS ts
          FROM cert c JOIN con ON con.id = c.id),
gap0 AS (SELECT qid, u.i AS i, u.a AS a, EXISTS (SELECT 1 FROM terms t WHERE t.qid = uca.qid AND (
   len(list_filter({words('lower(u.a)')}, lambda w: NOT contains(t.lc, w))) = 0
   OR len(list_filter(t.ts, lambda x: contains(x, lower(u.a)))) > 0)) AS covered FROM uca),
gap AS (SELECT s.qid, coalesce(list(g.a ORDER BY g.i) FILTER (NOT g.covered), []) AS gaps FROM scanned s LEFT JOIN gap0 g ON g.qid = s.qid GROUP BY s.qid)"""


def sides(ws: str, side: int) -> str:
    names = listed([p[side] for p in lx.ANTONYMS])
    return f"list_filter(range(1, {len(lx.ANTONYMS) + 1}), lambda i: list_contains({ws}, {names}[i]))"


def opposed(a: str, b: str) -> str:
    return (
        f"least(0.25 * len(list_distinct(list_concat(list_intersect({a}.l, {b}.r), list_intersect({a}.r, {b}.l)))), 0.8)::DOUBLE"
    )


PAIRS = f"""mem AS (SELECT qid, rank, id, {word_set('content')} AS ws FROM cert),
mems AS (SELECT *, {sides('ws', 0)} AS l, {sides('ws', 1)} AS r FROM mem),
pairs0 AS (SELECT a.qid, a.id AS a, b.id AS b, a.rank AS ra, len(a.ws) AS na, len(b.ws) AS nb,
   len(list_intersect(a.ws, b.ws)) AS x, {opposed('a', 'b')} AS contra
   FROM mems a JOIN mems b ON a.qid = b.qid AND a.rank < b.rank),
pairs AS (SELECT *, x::DOUBLE / (na + nb - x) AS jac FROM pairs0 WHERE na > 0 AND nb > 0)"""

_pct = "CAST(round_even({0} * 100, 0) AS BIGINT)"


def pct(x: str) -> str:
    return _pct.format(x)


EXPLANATION = (
    "'This appeal proposes to ' || CASE WHEN len(ops) = 0 THEN 'modify' ELSE array_to_string(ops, ', ') END "
    "|| ' content from ' || n_cited || ' source fragment(s). It ' || CASE WHEN delta_token < 0 THEN 'saves ' || (-delta_token) || ' tokens' "
    "WHEN delta_token > 0 THEN 'costs ' || delta_token || ' additional tokens' ELSE 'does not change the token count' END "
    f"|| ', with ' || {pct('coverage')} || '% content coverage and ' || {pct('risk')} || '% estimated risk. The aggregate quality score is ' || round(agg, 3) || '.'"
)

BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, {quote(BREAK)})"
    return (
        f"CASE WHEN {x} = '' THEN []::VARCHAR[] WHEN {parts}[len({parts})] = '' "
        f"THEN {parts}[1:len({parts}) - 1] ELSE {parts} END"
    )


DIFF = f"""srct AS (SELECT id, string_agg(content, ' ' ORDER BY pos) AS st FROM cited GROUP BY id),
d0 AS (SELECT m.*, coalesce(s.st, '') AS st FROM measured m LEFT JOIN srct s ON s.id = m.id),
d1 AS (SELECT *, list_sort(list_filter(pset, lambda w: NOT list_contains(sset, w))) AS added,
  list_sort(list_filter(sset, lambda w: NOT list_contains(pset, w))) AS removed,
  {lines('proposed_content')} AS nl, {lines('st')} AS ol FROM d0),
diffed AS (SELECT *, list_filter(list_transform(range(1, greatest(len(nl), len(ol)) + 1),
   lambda i: {{'n': i, 'o': coalesce(ol[i], ''), 'w': coalesce(nl[i], '')}}), lambda p: p.o <> p.w)[1:50] AS modified FROM d1)"""

PROS = """list_filter([
 CASE WHEN coverage >= 0.7 THEN 'High coverage (' || {cov} || '%) of source material' END,
 CASE WHEN risk < 0.1 THEN 'Low risk score (' || printf('%.2f', risk) || ')' END,
 CASE WHEN delta_token > 0 THEN 'Adds ' || delta_token || ' new tokens of information' WHEN delta_token < 0 THEN 'Reduces token count by ' || (-delta_token) || ' tokens' END,
 CASE WHEN agg >= 0.7 THEN 'Strong aggregate score (' || printf('%.2f', agg) || ')' END,
 CASE WHEN len(added) > 0 THEN 'Adds ' || len(added) || ' new passage(s)' END], lambda p: p IS NOT NULL)""".format(cov=pct("coverage"))
CONS = """list_filter([
 CASE WHEN coverage <= 0.3 THEN 'Low coverage (' || {cov} || '%) of source material' END,
 CASE WHEN risk > 0.6 THEN 'Elevated risk score (' || printf('%.2f', risk) || ')' END,
 CASE WHEN agg <= 0.3 THEN 'Low aggregate score (' || printf('%.2f', agg) || ')' END,
 CASE WHEN len(removed) > 0 THEN 'Removes ' || len(removed) || ' existing passage(s)' END], lambda p: p IS NOT NULL)""".format(cov=pct("coverage"))

JUDGED_APPEALS = f"""judged AS (SELECT *, {PROS} AS pros0, {CONS} AS cons0 FROM diffed),
pc AS (SELECT *, CASE WHEN len(pros0) = 0 THEN ['No significant advantages identified'] ELSE pros0 END AS pros,
  CASE WHEN len(cons0) = 0 THEN ['No significant concerns identified'] ELSE cons0 END AS cons FROM judged)"""

META = """meta AS (SELECT a.id, a.explanation, count(c.source_id) AS n,
  list_sort(list_distinct(coalesce(list(c.topic) FILTER (c.topic <> ''), []))) AS topics,
  list_sort(list_distinct(flatten(coalesce(list(c.tags) FILTER (c.source_id IS NOT NULL), [])))) AS tags,
  coalesce(sum(c.quality), 0) / greatest(count(c.source_id), 1) AS quality,
  list_sort(list_distinct(coalesce(list(c.author) FILTER (c.author <> ''), []))) AS authors
  FROM app a LEFT JOIN cited c ON c.id = a.id GROUP BY a.id, a.explanation),
merged AS (SELECT id, CASE WHEN len(topics) > 0 THEN array_to_string(topics, ' | ') ELSE substring(explanation, 1, 60) END AS m_topic,
  tags AS m_tags, round(quality, 4) AS m_quality,
  CASE WHEN len(authors) > 0 THEN array_to_string(authors, ', ') ELSE 'system' END AS m_author FROM meta)"""

QUALITY_TEXT = """qd AS (SELECT c.id, count(*) AS n, min(quality) AS lo, max(quality) AS hi, sum(quality) / count(*) AS mean FROM cited c GROUP BY c.id),
qh0 AS (SELECT id, coalesce(final_source, 'unknown') AS o, count(*) AS n, min(pos) AS p FROM cited GROUP BY ALL),
qh AS (SELECT id, string_agg('''' || o || ''': ' || n, ', ' ORDER BY p) AS h FROM qh0 GROUP BY id),
qtext AS (SELECT a.id, CASE WHEN qd.id IS NULL THEN 'No source fragments available.' ELSE
  'Source fragments: ' || qd.n || chr(10) || 'Quality range: ' || printf('%.2f', lo) || ' - ' || printf('%.2f', hi) || chr(10)
  || 'Mean quality: ' || printf('%.3f', mean) || chr(10) || 'Quality sources: {' || qh.h || '}' END AS summary, round(qd.mean, 4) AS mean
  FROM app a LEFT JOIN qd ON qd.id = a.id LEFT JOIN qh ON qh.id = a.id)"""

BASE_SCORE = f"""CASE WHEN len({words('content')}) < 5 THEN greatest(0.0, quality - 0.3)
  WHEN len({words('content')}) < 15 THEN quality ELSE least(1.0, quality + 0.1) END"""
_junk = " OR ".join(f"contains(lower(content), {quote(m)})" for m in lx.JUNK_MARKERS)


def scored(source: str) -> str:
    return f"""sc0 AS (SELECT *, ({BASE_SCORE})::DOUBLE AS b0, ({_junk}) AS junk FROM {source}),
sc1 AS (SELECT *, CASE WHEN junk THEN greatest(0.0, b0 - 0.4) ELSE b0 END AS base FROM sc0),
sc AS (SELECT *, [round(greatest(0.0, least(1.0, base - 0.15)), 4)::DOUBLE, round(greatest(0.0, least(1.0, base)), 4)::DOUBLE,
   round(greatest(0.0, least(1.0, base + 0.15)), 4)::DOUBLE] AS scores FROM sc1)"""


ROUTE = "CASE WHEN final_source = 'user_claimed' THEN 'vote' WHEN quality < 0.6 THEN 'reject' WHEN quality > 0.9 THEN 'accept' ELSE 'vote' END"
VOTED = f"""{scored('frag2')},
v0 AS (SELECT *, {ROUTE} AS route, len(list_filter(scores, lambda s: s >= 0.8)) AS yes FROM sc),
v AS (SELECT *, CASE route WHEN 'vote' THEN yes WHEN 'accept' THEN 1 ELSE 0 END AS votes_for,
  CASE route WHEN 'vote' THEN 3 - yes WHEN 'accept' THEN 0 ELSE 1 END AS votes_against,
  CASE route WHEN 'vote' THEN round(list_sum(scores) / 3, 4) ELSE quality END AS mean_score,
  CASE route WHEN 'vote' THEN list_min(scores) ELSE quality END AS min_score,
  CASE route WHEN 'vote' THEN list_max(scores) ELSE quality END AS max_score FROM v0),
voted AS (SELECT *, votes_for > votes_against AS accepted,
  route <> 'vote' OR votes_for = 0 OR votes_against = 0 OR votes_for >= 2 AS consensus FROM v)"""

CALIB = f"""cal AS (SELECT {frag_id('l.doc_id')} AS id, d.text AS content, d.lang AS category,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'good' WHEN l.quality = 0 AND l.toxic = 0 THEN 'borderline'
       WHEN l.quality = 0 AND l.toxic = 1 THEN 'bad' ELSE 'junk' END AS ground_truth,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 0.9::DOUBLE WHEN l.quality = 0 AND l.toxic = 0 THEN 0.7
       WHEN l.quality = 0 AND l.toxic = 1 THEN 0.3 ELSE 0.08 END AS true_quality,
  (l.doc_id * 37 % 101)::DOUBLE / 100 AS quality FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
JUDGED = f"""{CALIB}, {scored('cal')},
j0 AS (SELECT *, len(list_filter(scores, lambda s: s >= 0.8)) AS yes, list_sum(scores) / 3 AS mean,
  CASE ground_truth WHEN 'good' THEN true WHEN 'borderline' THEN NULL ELSE false END AS should FROM sc),
j AS (SELECT *, yes > 1.5 AS majority, (yes > 1.5) = should AS correct,
  (yes * (yes - 1) + (3 - yes) * (2 - yes))::DOUBLE / 6 AS agreement FROM j0)"""

EDGES = f"""edges AS (SELECT {frag_id('doc_id')} AS child, {frag_id('p')} AS parent FROM (SELECT doc_id, unnest({PARENTS}) AS p FROM documents))"""
PEDGES = f"""pedges AS (SELECT doc_id AS child_seq, {frag_id('doc_id')} AS child, {frag_id('u.p')} AS parent, u.i AS pos
 FROM (SELECT doc_id, unnest(list_transform({PARENTS}, lambda p, i: {{'p': p, 'i': i}})) AS u FROM documents))"""
NEWEST = f"(SELECT arg_max({frag_id('doc_id')}, doc_id) AS start FROM documents GROUP BY source)"
OLDEST = f"(SELECT arg_min({frag_id('doc_id')}, doc_id) AS start FROM documents GROUP BY source)"


def walk(name: str, starts: str, src: str, dst: str, cap: int | None = None) -> str:
    bound = f" WHERE w.dist < {cap}" if cap is not None else ""
    return f"""{name}_w(start, node, dist) AS (SELECT start, start, 0 FROM {starts}
 UNION SELECT w.start, e.{dst}, w.dist + 1 FROM {name}_w w JOIN edges e ON e.{src} = w.node{bound}),
{name} AS (SELECT start, node AS fragment_id, min(dist) AS distance FROM {name}_w GROUP BY ALL)"""


DEPTH = f"""dep_w(node, d) AS (SELECT {frag_id('doc_id')}, 0 FROM documents WHERE doc_id = 0
 UNION SELECT e.child, w.d + 1 FROM dep_w w JOIN edges e ON e.parent = w.node),
dep AS (SELECT node AS fragment_id, max(d) AS depth FROM dep_w GROUP BY node)"""

BEST = f"""pl AS (SELECT doc_id, unnest(list_transform({PARENTS}, lambda p, i: {{'p': p, 'i': i}})) AS u FROM documents),
bp AS (SELECT {frag_id('pl.doc_id')} AS fragment_id, arg_max(f.id, f.quality * 1000 - u.i) AS best_parent
  FROM pl JOIN frag f ON f.seq = u.p GROUP BY pl.doc_id)"""


def conflicts(threshold: float) -> str:
    return f"""WITH {FRAG}, {VECTORS},
ws AS (SELECT id, {word_set('content')} AS ws FROM frag),
sd AS (SELECT id, {sides('ws', 0)} AS l, {sides('ws', 1)} AS r FROM ws),
p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.vec, b.vec) AS s FROM vec a JOIN vec b ON a.id <> b.id),
c AS (SELECT p.a, p.s, CASE WHEN p.s >= 0.85 THEN {opposed('x', 'y')} ELSE 0.0 END AS k
  FROM p JOIN sd x ON x.id = p.a JOIN sd y ON y.id = p.b WHERE p.s >= {threshold})
SELECT a AS id, count(*) AS n_conflicts, round(max(s), 6) AS max_similarity, round(max(k), 6) AS max_contradiction,
  count(*) FILTER (k > 0.5) AS n_opposed FROM c GROUP BY a"""


_stop = listed(lx.PHRASE_STOPWORDS)
PHRASES = f"""ph0 AS (SELECT doc_id AS seq, source AS context, list_transform(regexp_split_to_array({strip(f"regexp_replace(text, {quote(BLANK + '+')}, ' ', 'g')")}, '[.!?]+'), lambda s: {strip('s')}) AS sents FROM documents),
ph1 AS (SELECT seq, context, list_filter(sents, lambda s: len({words('s')}) BETWEEN 10 AND 50
   AND len(list_filter({words('s')}, lambda x: NOT list_contains({_stop}, lower(x)))) >= 3) AS ps FROM ph0),
ph2 AS (SELECT seq, context, unnest(list_transform(ps, lambda p, i: {{'p': p, 'i': i - 1}})) AS u FROM ph1),
ph AS (SELECT seq, context, u.i AS pos, u.p AS phrase, sha256(u.p) AS hash, 'phrase:' || substring(sha256(u.p), 1, 12) AS key,
   substring(array_to_string({words('u.p')}[1:5], ' ') || CASE WHEN len({words('u.p')}) > 5 THEN '...' ELSE '' END, 1, 60) AS name FROM ph2)"""

CANDIDATES = f"""{FRAG}, {PHRASES},
oc AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, pos) AS occurrence FROM ph),
due AS (SELECT * FROM oc WHERE occurrence >= 3),
dk AS (SELECT key, any_value(phrase) AS phrase, any_value(hash) AS hash FROM due GROUP BY key),
kw AS (SELECT key, {word_set('phrase')} AS ws FROM dk),
fw AS (SELECT id, seq, sure, {word_set('content')} AS ws FROM frag2),
sm AS (SELECT k.key, f.seq, f.sure, count(*)::DOUBLE / least(k.n, f.m) AS sim
  FROM (SELECT key, len(ws) AS n, unnest(ws) AS w FROM kw) k JOIN (SELECT seq, sure, len(ws) AS m, unnest(ws) AS w FROM fw) f ON k.w = f.w
  GROUP BY k.key, f.seq, f.sure, k.n, f.m),
held AS (SELECT key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(sim, 9) DESC, seq) AS rn FROM sm WHERE sim >= 0.35 QUALIFY rn <= 3)
  WHERE sure AND sim >= 0.9 UNION SELECT dk.key FROM dk JOIN frag2 f ON contains(f.checksum, substring(dk.hash, 1, 8))),
cnd AS (SELECT * FROM due WHERE key NOT IN (SELECT key FROM held))"""

FEEDBACK = """ev AS (SELECT user_id AS key, ts, event_id AS seq,
  CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'click' THEN 'used' WHEN 'view' THEN 'ignored' END AS action FROM events),
fb AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) AS rn,
  count(*) FILTER (action = 'used') OVER w AS u, count(*) FILTER (action = 'ignored') OVER w AS g
  FROM ev WHERE action IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
st AS (SELECT user_id AS key, count(*) FILTER (event_type = 'signup') AS occ FROM events GROUP BY user_id),
run(key, rn, thr, occ) AS (SELECT key, 0::BIGINT, 12::BIGINT, occ FROM st
 UNION ALL SELECT r.key, f.rn, greatest(greatest(1, least(30, r.thr + CASE WHEN f.action = 'confirmed' THEN -1
    ELSE round_even(f.u * -0.5::DOUBLE + f.g * 0.3::DOUBLE, 0)::BIGINT END)), r.occ + 1), r.occ
 FROM run r JOIN fb f ON f.key = r.key AND f.rn = r.rn + 1)"""

QUARANTINE = """qr AS (SELECT 'E-' || event_id AS fragment_id, ts AS quarantined_at, CASE WHEN event_id % 3 = 0 THEN ts END AS notified_at,
  value > 150 AS resolved, date_diff('microsecond', ts, TIMESTAMP '2024-01-31') / 3600000000.0::DOUBLE AS age FROM events WHERE event_type = 'error'),
qp AS (SELECT *, NOT resolved AND notified_at IS NULL AND age >= 24 AS pending FROM qr),
qs AS (SELECT count(*) AS total, count(*) FILTER (NOT resolved) AS unresolved, count(*) FILTER (pending) AS pending FROM qp)"""

_markers = " + ".join(
    f"regexp_matches(content, {quote('(?m)' + m)})::INT" for m in lx.CODE_MARKERS
)

ORACLES: dict[str, str] = {
    "tokenize_stats": f"WITH {FRAG} SELECT id, len({tokens('content')}) AS n_tokens, len(list_distinct({tokens('content')})) AS n_terms, len({words('content')}) AS n_words, len({word_set('content')}) AS n_word_set FROM frag",
    "fragment_checksum": f"WITH {FRAG} SELECT id, checksum, round(quality, 4) AS quality FROM frag2",
    "point_lookup": f"""WITH {FRAG} SELECT id, true AS found, checksum, shelf FROM frag2 WHERE seq % 20 = 0
 UNION ALL SELECT 'X-' || seq, false, NULL, NULL FROM frag2 WHERE seq % 20 = 0""",
    "archive_insert": f"""WITH {FRAG}, inc AS (SELECT *, 0 AS copy FROM frag UNION ALL SELECT * REPLACE (seq + 10000000000 AS seq), 1 FROM frag),
 j AS (SELECT seq, CASE WHEN status = 'archived' THEN 'duplicate_id' WHEN copy = 1 AND length(content) <= 10000 THEN 'duplicate_id'
   WHEN length(content) > 10000 THEN 'content_too_long' ELSE 'accepted' END AS outcome FROM inc)
 SELECT outcome, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM j GROUP BY outcome""",
    "ingest_counts": f"""WITH {FRAG}, inc AS (SELECT *, 0 AS copy FROM frag UNION ALL SELECT *, 1 FROM frag),
 j AS (SELECT length(content) AS n, status <> 'archived' AND copy = 0 AND length(content) <= 10000 AS ok FROM inc)
 SELECT count(*) AS judged, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS refused, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS characters,
  coalesce(max(n) FILTER (ok), 0)::BIGINT AS longest FROM j""",
    "soft_delete": f"WITH {FRAG} SELECT shelf, CASE WHEN quality < 0.2 THEN 'archived' ELSE status END AS status, count(*) AS n FROM frag GROUP BY ALL",
    "list_filter": f"WITH {FRAG} SELECT id, topic, status FROM frag WHERE topic = 'en' AND status = 'active' AND list_has_any(list_transform(tags, lambda t: lower(t)), ['even', 'src3'])",
    "keyword_search": f"WITH {FRAG} SELECT id, shelf FROM frag WHERE len(list_filter(['inthe', 'thisand', 'que la'], lambda k: list_contains(keywords, k) OR contains(lower(content), k))) > 0",
    "quality_filter": f"WITH {FRAG} SELECT id, round(quality, 4) AS quality FROM frag WHERE quality >= 0.8",
    "next_fragment_id": f"WITH {FRAG} SELECT coalesce(max(TRY_CAST(nullif(regexp_extract(id, '^F-([0-9]+)', 1), '') AS BIGINT)), 0) + 1 AS next_id FROM frag",
    "restore_last_wins": f"WITH {FRAG} SELECT CASE WHEN quality >= 0.5 THEN 'restored' ELSE shelf END AS shelf, count(*) AS n, round(sum(quality), 4) AS quality_sum FROM frag GROUP BY 1",
    "provenance_update": f"WITH {FRAG} SELECT id, 'inherited' AS source_1, round(quality / 2, 4) AS quality_1, 'majority_vote' AS source_2, round(quality, 4) AS quality_2, round(quality / 2, 4) AS latest, 1 AS n_inherited FROM frag WHERE final_source IS NOT NULL",
    "shelf_statistics": f"""WITH {FRAG}, g AS (SELECT shelf, NOT (sure OR least(quality + 0.15, 0.95) >= 0.8) AS rejected FROM frag2)
 SELECT coalesce(shelf, 'total') AS shelf, count(*) FILTER (NOT rejected) AS fragments, count(*) FILTER (rejected) AS rejected FROM g GROUP BY ROLLUP (shelf)""",
    "bm25_topk": f"""WITH {FRAG}, {QUERIES}, {bm25_ctes("'x'")} SELECT qid, id, rank, round(score, 6) AS score FROM {top('bm', 'qid', 5)}""",
    "stored_index_topk": f"""WITH {FRAG}, kept AS (SELECT * FROM frag WHERE NOT quality < 0.2), {QUERIES},
 {bm25_ctes("'x'").replace("FROM frag", "FROM kept")} SELECT qid, id, rank, round(score, 6) AS score FROM {top('bm', 'qid', 5)}""",
    "shelf_bm25_topk": f"""WITH {FRAG}, {QUERIES}, {bm25_ctes('shelf')} SELECT qid, shelf, id, rank, round(score, 6) AS score FROM {top('bm', 'qid, shelf', 3)}""",
    "vector_topk": f"""WITH {VECTORS}, vs AS (SELECT v.id, v.seq, qv.qid, list_dot_product(v.vec, qv.vec) AS score FROM vec v, qvec qv)
 SELECT qid, id, rank, round(score, 6) AS score FROM {top('vs', 'qid', 5)}""",
    "stored_vector_topk": f"""WITH {FRAG}, {VECTORS}, vs AS (SELECT v.id, v.seq, qv.qid, list_dot_product(v.vec, qv.vec) AS score
  FROM vec v JOIN frag f ON f.id = v.id AND NOT f.quality < 0.2, qvec qv)
 SELECT qid, id, rank, round(score, 6) AS score FROM {top('vs', 'qid', 5)}""",
    "minmax_norm": f"""WITH {FRAG}, {QUERIES}, {bm25_ctes("'x'")} SELECT qid, id, round({NORM}, 6) AS norm FROM {top('bm', 'qid', 10)} WINDOW w AS (PARTITION BY qid)""",
    "hybrid_topk": f"WITH {hybrid_ctes()} SELECT qid, id, rank, round(score, 6) AS score FROM hy",
    "compose_text": f"""WITH {hybrid_ctes()},
 rows AS (SELECT h.qid, f.quality, h.rank, f.topic, f.content, row_number() OVER (PARTITION BY h.qid ORDER BY f.quality DESC, h.rank) AS i FROM hy h JOIN frag f ON f.id = h.id),
 body AS (SELECT qid, count(*) AS n, string_agg('--- Fragment ' || i || ': [' || CASE WHEN topic = '' THEN 'untitled' ELSE topic END || '] (quality: ' || round(quality, 3) || ') ---' || chr(10) || content || chr(10) || chr(10), '' ORDER BY i) AS b FROM rows GROUP BY qid),
 ans AS (SELECT q.qid, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'No relevant fragments found for query: ' || text ELSE
   {strip("'Based on ' || n || ' relevant memory fragment(s), here is a synthesized response:' || chr(10) || chr(10) || b || '--- End of response for: ' || text || ' ---'")} END AS a FROM q LEFT JOIN body ON body.qid = q.qid)
 SELECT qid, n, length(a) AS n_chars, md5(a) AS digest FROM ans""",
    "retrieve_with_conflicts": f"""WITH {hybrid_ctes()}, ws AS (SELECT id, {word_set('content')} AS ws FROM frag),
 sd AS (SELECT id, {sides('ws', 0)} AS l, {sides('ws', 1)} AS r FROM ws),
 hv AS (SELECT DISTINCT v.id, v.vec FROM vec v JOIN hy ON hy.id = v.id),
 p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.vec, b.vec) AS s FROM hv a JOIN vec b ON a.id <> b.id),
 c AS (SELECT p.a, count(*) AS n, max(p.s) AS s, max({opposed('x', 'y')}) AS k FROM p JOIN sd x ON x.id = p.a JOIN sd y ON y.id = p.b WHERE p.s >= 0.85 GROUP BY p.a)
 SELECT hy.qid, hy.id, hy.rank, c.n AS n_conflicts, round(c.s, 6) AS max_similarity, round(c.k, 6) AS max_contradiction FROM hy JOIN c ON c.a = hy.id""",
    "shelf_hybrid_topk": f"""WITH {FRAG}, {QUERIES}, {VECTORS}, {bm25_ctes('shelf')},
 vs AS (SELECT f.shelf, v.id, v.seq, qv.qid, list_dot_product(v.vec, qv.vec) AS score FROM vec v JOIN frag f ON f.id = v.id, qvec qv),
 kn AS (SELECT qid, shelf, id, seq, {NORM} AS kw FROM {top('bm', 'qid, shelf', 10)} WINDOW w AS (PARTITION BY qid, shelf)),
 en AS (SELECT qid, shelf, id, seq, {NORM} AS emb FROM {top('vs', 'qid, shelf', 10)} WINDOW w AS (PARTITION BY qid, shelf)),
 fused AS (SELECT qid, shelf, id, seq, 0.4 * coalesce(kw, 0) + 0.6 * coalesce(emb, 0) AS score, coalesce(emb, 0) AS emb FROM kn FULL JOIN en USING (qid, shelf, id, seq))
 SELECT qid, shelf, id, rank, round(score, 6) AS score FROM {top('(SELECT * FROM fused WHERE emb >= 0.72 OR score > 0)', 'qid, shelf', 3)}""",
    "hit_conflict_entries": f"WITH {hybrid_ctes()}, {HIT_PROBES}, {entry_ctes('hp')} SELECT * FROM entries",
    "proposal_conflict_entries": f"""WITH {FRAG}, {VECTORS}, {APPEALS}, pp AS (SELECT a.id, a.proposed_content AS content, a.sources, e.embedding::DOUBLE[] AS vec
  FROM app a, nv, embeddings e WHERE e.vec_id = a.seq % nv.n), {entry_ctes('pp', " AND NOT list_contains((SELECT any_value(sources) FROM pp z WHERE z.id = pr.id), pr.other_id)")}
 SELECT * FROM entries""",
    "answers_with_warnings": f"""WITH {hybrid_ctes()}, {HIT_PROBES}, {entry_ctes('hp')},
 ln AS (SELECT hy.qid, hy.rank, ent.other_seq, '⚠ Conflict detected: ' || ent.id || ' vs ' || ent.other_id || ' (similarity: ' || round_even(ent.s * 100, 0)::INT || '%, method: ' || ent.method || ')' AS line
   FROM hy JOIN ent ON ent.id = hy.id),
 w AS (SELECT qid, count(*) AS n, string_agg(line, chr(10) ORDER BY rank, other_seq) AS t FROM ln GROUP BY qid)
 SELECT q.qid, coalesce(n, 0)::INT AS n_warnings, md5(coalesce(t, '')) AS warnings_digest, coalesce(length(t) + length(chr(10) || chr(10) || '--- Conflict Warnings ---' || chr(10)), 0)::INT AS added FROM q LEFT JOIN w ON w.qid = q.qid""",
    "aspects": f"WITH {QUERIES}, {ASPECTS} SELECT qid, array_to_string(aspects, '|') AS aspects, array_to_string(caspects, '|') AS composition_aspects FROM asp",
    "intake_candidates": f"WITH {intake_ctes(10)} SELECT qid, id, rank, round(sim, 6) AS sim FROM cand",
    "intake_scan": f"WITH {intake_ctes(10)} SELECT qid, array_to_string(ids, '|') AS certified, array_to_string(matched, '|') AS matched, array_to_string(missing, '|') AS missing, round(max_sim, 6) AS max_similarity, proceed AS should_proceed FROM scanned",
    "certified_exists": f"""WITH {FRAG}, {QUERIES}, {ASPECTS}, ua AS (SELECT DISTINCT lower(unnest(aspects)) AS a FROM asp),
 hay AS (SELECT lower(content) AS c, lower(topic) AS t, list_transform(tags, lambda t: lower(t)) AS g FROM frag2 WHERE sure),
 fa AS (SELECT a FROM ua WHERE EXISTS (SELECT 1 FROM hay WHERE contains(c, ua.a) OR contains(t, ua.a) OR len(list_filter(g, lambda x: contains(x, ua.a))) > 0))
 SELECT p.qid, bool_or(fa.a IS NOT NULL) AS found FROM (SELECT qid, lower(unnest(aspects)) AS a FROM asp) p LEFT JOIN fa ON fa.a = p.a GROUP BY p.qid""",
    "certified_count": f"WITH {intake_ctes(1_000_000_000)} SELECT qid, n_cert AS n FROM scanned",
    "dispatch_route": f"""WITH {intake_ctes(20)}, {ROUTED}
 SELECT qid, path, CASE path WHEN 'generate' THEN 0.0 ELSE round(ratio, 6) END AS coverage, CASE path WHEN 'generate' THEN 0.0 ELSE round(cc, 4) END AS compose_cost,
   CASE path WHEN 'generate' THEN 0.0 ELSE round(gc, 4) END AS generate_cost, CASE path WHEN 'partial' THEN {gaps_text('missing')} ELSE '' END AS gap_description,
   CASE path WHEN 'generate' THEN '' ELSE array_to_string(matched, '|') END AS covered FROM routed""",
    "dispatch_reason": f"""WITH {intake_ctes(20)}, {ROUTED}
 SELECT qid, CASE WHEN path = 'compose' THEN 'Full composition: ' || len(matched) || '/' || len(aspects) || ' aspects covered (' || {pct('ratio')} || '%), compose cost (' || printf('%.1f', cc) || ') < generate cost (' || printf('%.1f', gc) || ')'
  WHEN path = 'partial' THEN 'Partial composition: ' || len(matched) || '/' || len(aspects) || ' aspects covered (' || {pct('ratio')} || '%). Missing: [''' || array_to_string(missing, ''', ''') || ''']. Compose cost (' || printf('%.1f', cc) || ') < generate cost (' || printf('%.1f', gc) || ')'
  WHEN NOT proceed THEN 'Full generation: No certified candidates found by Intake Verifier'
  ELSE 'Full generation: Coverage too low (' || printf('%.1f', ratio * 100) || '% < 40%)' END AS reason FROM routed""",
    "tabs_slots": f"WITH {FRAG}, {CONNECT} SELECT id, array_to_string(tabs, '|') AS tabs, array_to_string(slots, '|') AS slots FROM con",
    "text_connectors": f"""WITH {APPEALS}, {frequent('app', 'id', 'proposed_content', 5)},
 t0 AS (SELECT a.id, list_concat({caps('proposed_content')}[1:5], coalesce(fq.frequent, [])) AS t,
   list_transform(list_filter(list_transform(regexp_split_to_array(proposed_content, '[.!?]+')[1:5], lambda s: {strip('s')}), lambda s: length(s) > 10), lambda s: array_to_string({words('s')}[1:6], ' ')) AS s
   FROM app a LEFT JOIN fq ON fq.k = a.id)
 SELECT id, array_to_string({ordered_distinct('t')}[1:10], '|') AS tabs, array_to_string({ordered_distinct('s')}[1:10], '|') AS slots FROM t0""",
    "composition_gaps": f"WITH {intake_ctes(20)}, {CONNECT}, {GAPS} SELECT qid, array_to_string(gaps, '|') AS gaps FROM gap",
    "jaccard_overlaps": f"WITH {intake_ctes(20)}, {PAIRS} SELECT qid, a, b, round(jac, 6) AS score FROM pairs WHERE jac > 0.75",
    "contradiction_pairs": f"WITH {intake_ctes(20)}, {PAIRS} SELECT qid, a, b, round(contra, 6) AS score FROM pairs WHERE jac > 0.3 AND contra > 0.3",
    "composition": f"""WITH {intake_ctes(20)}, {CONNECT}, {GAPS}, {PAIRS},
 pc AS (SELECT qid, count(*) FILTER (jac > 0.75) AS n_over, count(*) FILTER (jac > 0.3 AND contra > 0.3) AS n_con, coalesce(bool_or(jac > 0.3 AND contra > 0.5), false) AS blk FROM pairs GROUP BY qid),
 body AS (SELECT qid, string_agg({strip('content')}, chr(10) || chr(10) ORDER BY quality DESC, rank) FILTER ({strip('content')} <> '') AS b FROM cert GROUP BY qid),
 z AS (SELECT s.qid, s.n_cert = 0 AS none, coalesce(pc.blk, false) AS blk, g.gaps, coalesce(n_over, 0) AS n_over, coalesce(n_con, 0) AS n_con, coalesce(body.b, '') AS b
   FROM scanned s JOIN gap g ON g.qid = s.qid LEFT JOIN pc ON pc.qid = s.qid LEFT JOIN body ON body.qid = s.qid)
 SELECT qid, NOT none AND NOT blk AS success, NOT none AND NOT blk AND len(gaps) > 0 AS partial, NOT none AND blk AS blocked,
   CASE WHEN none THEN 1 ELSE len(gaps) END AS n_gaps, n_over AS n_overlaps, n_con AS n_contradictions,
   md5(CASE WHEN none OR blk THEN '' WHEN len(gaps) > 0 THEN b || chr(10) || chr(10) || '---' || chr(10) || array_to_string(list_transform(gaps, lambda g: '[Missing: ' || g || ']'), chr(10)) ELSE b END) AS digest FROM z""",
    "appeal_insert": f"""WITH {APPEALS}, ok AS (SELECT id, seq, row_number() OVER (ORDER BY seq) AS rn FROM (SELECT id, min(seq) AS seq FROM
   (SELECT id, seq, ops FROM app UNION ALL SELECT id, seq + 1, ops FROM app) WHERE len(ops) <= 10 GROUP BY id) QUALIFY rn <= 20),
 j AS (SELECT i.seq, CASE WHEN i.seq > ok.seq THEN 'duplicate_id' WHEN (SELECT count(*) FROM ok) >= 20 AND i.seq > (SELECT max(seq) FROM ok) THEN 'too_many_active'
   WHEN len(i.ops) > 10 THEN 'too_many_ops' ELSE 'accepted' END AS outcome
   FROM (SELECT id, seq, ops FROM app UNION ALL SELECT id, seq + 1, ops FROM app) i LEFT JOIN ok ON ok.id = i.id)
 SELECT outcome, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM j GROUP BY outcome""",
    "active_appeals": f"WITH {APPEALS} SELECT status, count(*) AS n FROM app WHERE status NOT IN ('approved', 'rejected', 'expired') GROUP BY status",
    "retention_prune": f"""WITH {APPEALS}, f AS (SELECT *, coalesce(status IN ('approved', 'rejected', 'expired') AND date_diff('microsecond', resolved_at, TIMESTAMP '2024-01-31') // 86400000000 > 10, false) AS aged,
   status IN ('approved', 'rejected', 'expired') AS closed FROM app),
 r AS (SELECT *, row_number() OVER (PARTITION BY closed ORDER BY resolved_at DESC NULLS LAST, seq DESC) AS rn, bool_or(aged) OVER () AS any_aged FROM f)
 SELECT id, status, CASE WHEN any_aged THEN aged ELSE closed AND rn > 100 END AS pruned FROM r""",
    "count_prune": f"""WITH {APPEALS}, r AS (SELECT *, row_number() OVER (ORDER BY resolved_at DESC NULLS LAST, seq DESC) AS rn FROM app WHERE status IN ('approved', 'rejected', 'expired'))
 SELECT id, status FROM r WHERE rn > 40""",
    "source_resolution": f"WITH {FRAG}, {APPEALS}, {LINKS} SELECT id, pos, source_id, shelf FROM cited",
    "missing_sources": f"WITH {FRAG}, {APPEALS}, {LINKS} SELECT id, pos, source_id FROM links WHERE source_id NOT IN (SELECT id FROM frag)",
    "appeals_citing": f"WITH {APPEALS} SELECT id, status FROM app WHERE list_contains(sources, 'D-000007')",
    "appeal_metrics": f"WITH {FRAG}, {APPEALS}, {LINKS}, {MEASURED} SELECT id, delta_token, round(coverage, 6) AS coverage, round(risk, 6) AS risk, round(agg, 6) AS aggregate_score FROM measured",
    "blended_metrics": f"""WITH {FRAG}, {VECTORS}, {APPEALS}, {LINKS}, {MEASURED},
 av AS (SELECT a.id, e.embedding::DOUBLE[] AS vec FROM app a, nv, embeddings e WHERE e.vec_id = a.seq % nv.n),
 bc AS (SELECT l.id, max(list_cosine_similarity(av.vec, vec.vec)) AS c FROM links l JOIN vec ON vec.id = l.source_id JOIN av ON av.id = l.id GROUP BY l.id),
 neg AS (SELECT *, {words('lower(proposed_content)')} AS lw FROM m3),
 x AS (SELECT neg.id, neg.delta_token, neg.ns, CASE WHEN len(pw) = 0 THEN 0.0 ELSE coalesce(bc.c, 0.0) END AS c, neg.coverage, vague,
  CASE WHEN n_cited > 0 AND len(lw) > 0 THEN least(len(list_filter(lw, lambda w: list_contains({listed(lx.NEGATIONS)}, w)))::DOUBLE / len(lw) * 3.0, 1.0) ELSE 0.0 END AS nega,
  least(CASE WHEN ns = 0 THEN (CASE WHEN np > 0 THEN 0.5 ELSE 0.0 END) ELSE
     (CASE WHEN ratio > 2.0 THEN least((ratio - 2.0) / 2.0 * 0.5, 0.5) ELSE 0.0 END)
   + (CASE WHEN len(pset) > 0 AND len(sset) > 0 THEN (len(pset) - shared)::DOUBLE / len(pset) * 0.3 ELSE 0.0 END)
   + (CASE WHEN ratio < 0.5 AND ns > 5 THEN 0.2 ELSE 0.0 END) END, 1.0) AS base FROM neg LEFT JOIN bc ON bc.id = neg.id),
 y AS (SELECT *, 0.5 * coverage + 0.5 * c AS cov, least(least(base + 0.25 * nega, 1.0) + vague * 0.15, 1.0)::DOUBLE AS risk FROM x)
 SELECT id, round(c, 6) AS best_cosine, round(cov, 6) AS coverage, round(risk, 6) AS risk,
  round(0.3 * tanh(delta_token::DOUBLE / greatest(ns, 1)) + 0.4 * cov - 0.3 * risk, 6) AS aggregate_score FROM y""",
    "appeal_diff": f"""WITH {FRAG}, {APPEALS}, {LINKS}, {MEASURED}, {DIFF},
 ix AS (SELECT id, source_id, content, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS i FROM cited),
 seen AS (SELECT x.id, i, max(i) OVER (PARTITION BY x.id, x.source_id) AS place, instr(lower(a.proposed_content), lower({strip('x.content')})) AS loc, {strip('x.content')} <> '' AS real FROM ix x JOIN app a ON a.id = x.id),
 ord AS (SELECT id, place, row_number() OVER (PARTITION BY id ORDER BY loc, i) - 1 AS rk, count(*) OVER (PARTITION BY id) AS n FROM seen WHERE real AND loc > 0),
 re AS (SELECT id, string_agg(rk::VARCHAR, '|' ORDER BY rk) AS reordered FROM ord WHERE n >= 2 AND place <> rk GROUP BY id)
 SELECT d.id, len(added) AS n_added, len(removed) AS n_removed, md5(array_to_string(added, '|')) AS added, len(modified) AS n_modified,
  md5(array_to_string(list_transform(modified, lambda m: m.n || ':' || m.o || ':' || m.w), '|')) AS modified, coalesce(re.reordered, '') AS reordered FROM diffed d LEFT JOIN re ON re.id = d.id""",
    "governance_pros_cons": f"WITH {FRAG}, {APPEALS}, {LINKS}, {MEASURED}, {DIFF}, {JUDGED_APPEALS} SELECT id, len(pros) AS n_pros, len(cons) AS n_cons, pros[1] AS first_pro, array_to_string(cons, '|') AS cons FROM pc",
    "review_pros_cons": f"""WITH {FRAG}, {APPEALS}, {LINKS}, {MEASURED} SELECT id, array_to_string(list_filter([
  CASE WHEN delta_token < 0 THEN 'Token savings: ' || (-delta_token) || ' fewer tokens' WHEN delta_token = 0 THEN 'No change in token count' END,
  CASE WHEN coverage >= 0.8 THEN 'High content coverage (' || {pct('coverage')} || '%)' WHEN coverage >= 0.5 THEN 'Moderate content coverage (' || {pct('coverage')} || '%)' END,
  CASE WHEN risk < 0.2 THEN 'Low risk (' || {pct('risk')} || '%)' END, CASE WHEN agg > 0.5 THEN 'Strong aggregate quality score' END,
  CASE WHEN len(ops) > 0 THEN 'Operations proposed: ' || array_to_string(ops, ', ') END], lambda p: p IS NOT NULL), '|') AS pros,
  array_to_string(list_filter([CASE WHEN delta_token > 0 THEN 'Token increase: ' || delta_token || ' additional tokens' END,
  CASE WHEN coverage < 0.5 THEN 'Low content coverage (' || {pct('coverage')} || '%)' END,
  CASE WHEN risk >= 0.2 AND risk < 0.5 THEN 'Moderate risk (' || {pct('risk')} || '%)' WHEN risk >= 0.5 THEN 'High risk (' || {pct('risk')} || '%)' END,
  CASE WHEN agg < 0 THEN 'Negative aggregate quality score' END], lambda p: p IS NOT NULL), '|') AS cons FROM measured""",
    "appeal_explanation": f"WITH {FRAG}, {APPEALS}, {LINKS}, {MEASURED} SELECT id, {EXPLANATION} AS explanation FROM measured",
    "vagueness_negation": f"""WITH {APPEALS}, t AS (SELECT id, {words('lower(proposed_content)')} AS w, {word_set('proposed_content')} AS s FROM app)
 SELECT id, round(CASE WHEN len(s) = 0 THEN 0.0 ELSE least(len(list_intersect(s, {listed(lx.HEDGES)}))::DOUBLE / len(s) * 5.0, 1.0) END, 6) AS vagueness,
  round(CASE WHEN len(w) = 0 THEN 0.0 ELSE least(len(list_filter(w, lambda x: list_contains({listed(lx.NEGATIONS)}, x)))::DOUBLE / len(w) * 3.0, 1.0) END, 6) AS negation FROM t""",
    "antonym_score": f"""WITH {FRAG}, {APPEALS}, {LINKS}, fs AS (SELECT id, {word_set('content')} AS ws FROM frag), aps AS (SELECT id, {word_set('proposed_content')} AS ws FROM app),
 fx AS (SELECT id, {sides('ws', 0)} AS l, {sides('ws', 1)} AS r FROM fs), ax AS (SELECT id, {sides('ws', 0)} AS l, {sides('ws', 1)} AS r FROM aps)
 SELECT c.id, c.pos, round({opposed('ax', 'fx')}, 6) AS score FROM cited c JOIN ax ON ax.id = c.id JOIN fx ON fx.id = c.source_id""",
    "merge_metadata": f"WITH {FRAG}, {APPEALS}, {LINKS}, {META} SELECT id, m_topic, array_to_string(m_tags, '|') AS m_tags, m_quality, m_author FROM merged",
    "provenance_summary": f"""WITH {FRAG}, {APPEALS}, {LINKS} SELECT a.id, count(c.source_id) AS n_sources, round(min(c.quality), 4) AS min_quality, round(max(c.quality), 4) AS max_quality,
  round(sum(c.quality) / nullif(count(c.source_id), 0), 4) AS mean_quality, array_to_string(list_sort(list_distinct(coalesce(list(c.final_source) FILTER (c.final_source IS NOT NULL), []))), '|') AS quality_sources
  FROM app a LEFT JOIN cited c ON c.id = a.id GROUP BY a.id""",
    "quality_distribution": f"WITH {FRAG}, {APPEALS}, {LINKS}, {QUALITY_TEXT} SELECT id, summary FROM qtext",
    "model_provenance": f"""WITH {FRAG}, {APPEALS}, {LINKS} SELECT DISTINCT id, source_id, 'm' || (seq % 4) AS model_id, 'v' || (seq % 3) AS model_version,
  CASE WHEN seq % 3 = 0 THEN '' ELSE 'e' || (seq % 3) END AS evaluator_model_id, coalesce(final_source, '') AS quality_source FROM cited WHERE seq % 4 <> 3""",
    "approve_pending": f"""WITH {FRAG}, {APPEALS}, {LINKS}, {META},
 nx AS (SELECT coalesce(max(TRY_CAST(nullif(regexp_extract(id, '^F-([0-9]+)', 1), '') AS BIGINT)), 0) AS n FROM frag),
 pa AS (SELECT *, row_number() OVER (ORDER BY seq, id) AS rn FROM app WHERE status = 'pending_user_approval'),
 so AS (SELECT id, arg_min(final_source, pos) FILTER (final_source IS NOT NULL) AS o FROM cited GROUP BY id)
 SELECT printf('F-%04d', nx.n + pa.rn) AS id, pa.id AS appeal_id, m.m_topic AS topic, round(m.m_quality, 4) AS quality, m.m_author AS author,
  substring(sha256(printf('F-%04d', nx.n + pa.rn) || '::' || pa.proposed_content || '::2024-01-31T00:00:00+00:00'), 1, 16) AS checksum,
  coalesce(so.o, '') AS model_id, coalesce(so.o, 'governance_promotion') AS quality_source
 FROM pa CROSS JOIN nx JOIN merged m ON m.id = pa.id LEFT JOIN so ON so.id = pa.id""",
    "reject_appeals": f"""WITH {APPEALS} SELECT CASE WHEN status = 'pending_user_approval' THEN 'rejected' ELSE status END AS status,
  CASE WHEN status = 'pending_user_approval' AND seq % 2 = 0 THEN 'too long' ELSE explanation END AS explanation, count(*) AS n FROM app GROUP BY ALL""",
    "governance_stats": f"""WITH {APPEALS}, {QUARANTINE}, s AS (SELECT count(*) AS total_appeals, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected,
  count(*) FILTER (status = 'pending_user_approval') AS pending, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'expired') AS expired,
  coalesce(avg(date_diff('microsecond', created_at, resolved_at) / 1000000.0::DOUBLE) FILTER (resolved_at >= created_at), 0) AS mean FROM app)
 SELECT s.* EXCLUDE (mean), round(mean, 2) AS avg_seconds, CASE WHEN mean < 60 THEN round_even(mean, 0)::BIGINT || 's' WHEN mean < 3600 THEN (floor(mean)::BIGINT // 60) || 'm ' || (floor(mean)::BIGINT % 60) || 's'
   ELSE (floor(mean)::BIGINT // 3600) || 'h ' || (floor(mean)::BIGINT % 3600 // 60) || 'm ' || (floor(mean)::BIGINT % 60) || 's' END AS avg_text,
  qs.total AS quarantine_size, qs.unresolved, qs.pending AS pending_notifications FROM s, qs""",
    "governance_report": f"""WITH {FRAG}, {APPEALS}, {LINKS}, {MEASURED}, {DIFF}, {JUDGED_APPEALS}, {QUALITY_TEXT}
 SELECT pc.id, delta_token, round(risk, 6) AS risk, n_cited, md5({EXPLANATION}) AS explanation, array_to_string(pros, '|') AS pros, t.mean AS mean_quality, md5(t.summary) AS distribution FROM pc JOIN qtext t ON t.id = pc.id""",
    "guardian_gate": f"WITH {FRAG} SELECT id, threshold, CASE WHEN sure THEN 'accept' WHEN least(quality + 0.15, 0.95) >= 0.8 THEN 'accept_improved' ELSE 'reject' END AS decision FROM frag2",
    "heuristic_improve": f"""WITH {FRAG} SELECT CASE WHEN sure THEN id ELSE id || '_improved' END AS id, round(CASE WHEN sure THEN quality ELSE least(quality + 0.15, 0.95) END, 4) AS quality,
  array_to_string(CASE WHEN sure THEN tags ELSE list_concat(tags, ['enhanced', 'auto_improved']) END, '|') AS tags, length(content) + CASE WHEN sure THEN 0 ELSE {len(lx.IMPROVED_SUFFIX)} END AS n_chars,
  CASE WHEN sure THEN author ELSE '' END AS author, sure AND final_source IS NOT NULL AS has_provenance FROM frag2 WHERE sure OR least(quality + 0.15, 0.95) >= 0.8""",
    "circuit_route": f"WITH {FRAG} SELECT id, {ROUTE} AS route FROM frag",
    "circuit_vote": f"WITH {FRAG}, {VOTED} SELECT id, route, votes_for, votes_against, accepted, consensus, round(mean_score, 4) AS mean_score, round(min_score, 4) AS min_score, round(max_score, 4) AS max_score FROM voted",
    "vetted_fragments": f"""WITH {FRAG}, {VOTED} SELECT CASE route WHEN 'vote' THEN id || '_vetted' ELSE id END AS id, round(CASE route WHEN 'vote' THEN mean_score ELSE quality END, 4) AS quality,
  CASE WHEN route = 'vote' THEN 'majority_vote' WHEN quality > 0.9 THEN 'independently_verified' ELSE 'evaluator_computed' END AS final_source, CASE route WHEN 'vote' THEN 3 ELSE 1 END AS n_evaluations,
  CASE route WHEN 'vote' THEN 'majority_vote_3' END AS method FROM voted WHERE accepted""",
    "mock_agent_base": f"WITH {FRAG}, {scored('frag')} SELECT id, round(base, 4) AS score FROM sc",
    "calibration_summary": f"""WITH {JUDGED} SELECT count(*) AS total, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct AND majority) AS false_positives, count(*) FILTER (NOT correct AND NOT majority) AS false_negatives,
  round(avg(agreement), 6) AS mean_agreement, round(avg(abs(mean - true_quality)), 6) AS mean_score_error, round(count(*) FILTER (correct)::DOUBLE / count(*), 6) AS accuracy FROM j""",
    "scorer_summary": f"""WITH {JUDGED}, x AS (SELECT correct, should, true_quality, unnest([{{'a': 'agent-strict', 's': scores[1]}}, {{'a': 'agent-balanced', 's': scores[2]}}, {{'a': 'agent-generous', 's': scores[3]}}]) AS u FROM j)
 SELECT u.a AS agent, round(count(*) FILTER (correct)::DOUBLE / count(*), 4) AS accuracy, round(count(*) FILTER ((u.s >= 0.8) = should)::DOUBLE / count(*), 4) AS own_accuracy, round(avg(u.s) - avg(true_quality), 4) AS generosity FROM x GROUP BY u.a""",
    "agreement_rate": f"WITH {JUDGED} SELECT id, majority, round(agreement, 6) AS agreement FROM j",
    "calibration_labels": f"WITH {CALIB} SELECT l.g AS ground_truth, count(cal.id) AS n FROM (SELECT unnest({listed(schemas.CALIBRATION_LABELS)}) AS g) l LEFT JOIN cal ON cal.ground_truth = l.g GROUP BY l.g",
    "calibration_filters": f"WITH {CALIB} SELECT id, ground_truth, round(quality, 4) AS claimed_quality FROM cal WHERE quality BETWEEN 0.6 AND 0.9 AND category = 'en'",
    "stratified_sample": f"WITH {CALIB} SELECT ground_truth, row_number() OVER (PARTITION BY ground_truth ORDER BY md5('42:' || id), id) AS rank, id FROM cal QUALIFY rank <= 5",
    "dag_roots_leaves": f"WITH {EDGES} SELECT {frag_id('doc_id')} AS fragment_id, 'root' AS kind FROM documents WHERE doc_id = 0 UNION ALL SELECT {frag_id('doc_id')}, 'leaf' FROM documents WHERE {frag_id('doc_id')} NOT IN (SELECT parent FROM edges)",
    "dag_depth": f"WITH RECURSIVE {EDGES}, {DEPTH} SELECT fragment_id, depth FROM dep",
    "ancestors": f"WITH RECURSIVE {EDGES}, {walk('anc', NEWEST, 'child', 'parent')} SELECT * FROM anc",
    "descendants": f"WITH RECURSIVE {EDGES}, {walk('des', OLDEST, 'parent', 'child')} SELECT * FROM des",
    "ancestors_capped": f"WITH RECURSIVE {EDGES}, {walk('anc', NEWEST, 'child', 'parent', 2)} SELECT * FROM anc",
    "cycle_check": f"""WITH RECURSIVE {EDGES}, alle AS (SELECT parent, child FROM edges UNION SELECT child, parent FROM edges WHERE child LIKE 'F-%'),
 seed AS (SELECT child AS n FROM edges WHERE child LIKE 'F-%' UNION SELECT parent FROM edges WHERE child LIKE 'F-%'),
 fw(n) AS (SELECT n FROM seed UNION SELECT e.child FROM fw JOIN alle e ON e.parent = fw.n), bw(n) AS (SELECT n FROM seed UNION SELECT e.parent FROM bw JOIN alle e ON e.child = bw.n)
 SELECT false AS clean_has_cycle, n AS fragment_id FROM fw INTERSECT SELECT false, n FROM bw""",
    "best_parent": f"WITH {FRAG}, {BEST} SELECT * FROM bp",
    "lineage": f"""WITH RECURSIVE {PEDGES}, st AS (SELECT start FROM {NEWEST} UNION SELECT {frag_id('doc_id')} FROM documents WHERE {frag_id('doc_id')} LIKE 'F-%'),
 up(start, node, path) AS (SELECT start, start, []::BIGINT[] FROM st UNION ALL SELECT u.start, e.parent, list_append(u.path, e.pos) FROM up u JOIN pedges e ON e.child = u.node),
 one AS (SELECT start, node, min(path) AS path, min(len(path)) AS distance FROM up GROUP BY ALL)
 SELECT start, (row_number() OVER (PARTITION BY start ORDER BY path DESC))::INT AS number, node AS fragment_id, distance::INT AS distance FROM one""",
    "version_records": f"""WITH RECURSIVE {EDGES}, {PEDGES}, {DEPTH},
 up(start, node, path) AS (SELECT start, start, []::BIGINT[] FROM {NEWEST} UNION ALL SELECT u.start, e.parent, list_append(u.path, e.pos) FROM up u JOIN pedges e ON e.child = u.node),
 dn(start, node, path) AS (SELECT start, start, []::BIGINT[] FROM {NEWEST} UNION ALL SELECT u.start, e.child, list_append(u.path, e.child_seq) FROM dn u JOIN pedges e ON e.parent = u.node),
 a AS (SELECT start, string_agg(node, '|' ORDER BY path) AS t FROM (SELECT start, node, min(path) AS path FROM up GROUP BY ALL) GROUP BY start),
 d AS (SELECT start, string_agg(node, '|' ORDER BY path) AS t FROM (SELECT start, node, min(path) AS path FROM dn GROUP BY ALL) GROUP BY start),
 pa AS (SELECT child, string_agg(parent, '|' ORDER BY pos) AS t FROM pedges GROUP BY child),
 ch AS (SELECT parent, string_agg(child, '|' ORDER BY child_seq) AS t FROM pedges GROUP BY parent)
 SELECT a.start, dep.depth::INT AS depth, a.t AS ancestors, d.t AS descendants, coalesce(pa.t, '') AS parents, coalesce(ch.t, '') AS children
 FROM a JOIN d ON d.start = a.start JOIN dep ON dep.fragment_id = a.start LEFT JOIN pa ON pa.child = a.start LEFT JOIN ch ON ch.parent = a.start""",
    "version_history": f"""WITH RECURSIVE {EDGES}, {DEPTH}, {walk('anc', NEWEST, 'child', 'parent')}, {walk('des', NEWEST, 'parent', 'child')},
 ch AS (SELECT parent AS start, count(DISTINCT child) AS children FROM edges GROUP BY parent), pa AS (SELECT child AS start, count(*) AS parents FROM edges GROUP BY child)
 SELECT s.start, (SELECT count(*) FROM anc WHERE anc.start = s.start) AS ancestors, (SELECT count(*) FROM des WHERE des.start = s.start) AS descendants, dep.depth, coalesce(ch.children, 0) AS children, coalesce(pa.parents, 0) AS parents
 FROM {NEWEST} s JOIN dep ON dep.fragment_id = s.start LEFT JOIN ch ON ch.start = s.start LEFT JOIN pa ON pa.start = s.start""",
    "rollback": f"WITH {FRAG}, {BEST} SELECT s.start AS id, bp.best_parent AS previous, CASE WHEN bp.best_parent IS NULL THEN f.status ELSE 'archived' END AS status FROM {NEWEST} s LEFT JOIN bp ON bp.fragment_id = s.start JOIN frag f ON f.id = s.start",
    "node_model_stats": f"""WITH n AS (SELECT unnest([{{'field': 'model', 'value': CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'm' || (doc_id % 4) END}}, {{'field': 'evaluator', 'value': CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'e' || (doc_id % 3) END}},
  {{'field': 'quality_source', 'value': coalesce({origin('doc_id')}, '')}}, {{'field': 'total', 'value': 'all'}}]) AS u FROM documents) SELECT u.field AS field, u.value AS value, count(*) AS n FROM n WHERE u.value <> '' GROUP BY ALL""",
    "appeal_answers": f"""WITH {APPEALS} SELECT id, md5(CASE WHEN status = 'approved' AND proposed_content <> '' THEN 'An approved appeal (' || id || ') was applied to synthesise the following response for: ' || explanation || chr(10) || chr(10) || {strip('proposed_content')} ELSE 'composed' END) AS digest FROM app""",
    "remove_node": f"WITH {FRAG} SELECT CASE WHEN doc_id % 4 = 3 THEN '' ELSE 'm' || (doc_id % 4) END AS model_id, count(*) AS n, sum(len({PARENTS}))::BIGINT AS links FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1",
    "nodes_by_model": f"SELECT {frag_id('doc_id')} AS fragment_id, 'v' || (doc_id % 3) AS model_version FROM documents WHERE doc_id % 4 = 1 AND doc_id % 3 = 2",
    "submit_appeals": f"WITH {APPEALS} SELECT id, true AS found, 'pending_user_approval' AS status FROM app WHERE status <> 'draft' UNION ALL SELECT id || '-unknown', false, NULL FROM app",
    "update_proposals": f"WITH {APPEALS} SELECT id, CASE WHEN status <> 'draft' THEN explanation WHEN seq % 3 = 0 THEN 'second' ELSE 'first' END AS explanation FROM app",
    "change_status": f"""WITH {APPEALS} SELECT id, CASE WHEN status <> 'draft' THEN status WHEN seq % 2 = 0 THEN 'approved' ELSE 'pending_user_approval' END AS status,
 strftime(CASE WHEN status = 'draft' AND seq % 2 = 0 THEN TIMESTAMP '2024-01-31' ELSE resolved_at END, '%Y-%m-%d %H:%M:%S.%f') AS resolved_at FROM app""",
    "appeals_by_status": f"WITH {APPEALS} SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(resolved_at, '%Y-%m-%d %H:%M:%S.%f') AS resolved_at FROM app WHERE status = 'approved'",
    "appeal_json": f"WITH {FRAG}, {APPEALS}, {LINKS}, {MEASURED} SELECT id, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at, printf('%.4f', coverage)::DOUBLE AS coverage, printf('%.4f', risk)::DOUBLE AS risk FROM measured",
    "fragment_json": f"WITH {FRAG} SELECT id, md5(content) AS digest, topic, round(quality, 4) AS quality, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at, checksum, final_source FROM frag2",
    "open_records": "SELECT event_id, json_extract_string(props, '$.k') AS k, 'true' AS processed, len(json_keys(props)) + 1 AS n FROM events",
    "embedding_seeds": f"""WITH {FRAG} SELECT id, list_sum(list_transform(string_split(content, ''), lambda c, i: unicode(c)::BIGINT * i % 2147483647))::BIGINT % 2147483647 AS index_seed,
 ('0x' || substring(md5(content), 1, 8))::BIGINT AS conflict_seed FROM frag""",
    "quarantine_notices": f"WITH {QUARANTINE} SELECT resolved, CASE WHEN pending THEN true WHEN notified_at IS NOT NULL THEN false END AS stamped_now, notified_at IS NULL AND NOT pending AS never, count(*) AS n FROM qp GROUP BY ALL",
    "quarantine_dump": f"WITH {FRAG}, q AS (SELECT {frag_id('event_id')} AS fragment_id, 'scoring failed' AS reason, value > 150 AS resolved FROM events WHERE event_type = 'error') SELECT q.*, f.topic, round(f.quality, 4) AS quality FROM q LEFT JOIN frag f ON f.id = q.fragment_id",
    "pattern_dump": f"WITH {PHRASES} SELECT seq, pos, 'phrase' AS type, substring(phrase, 1, 100) AS preview, context, substring(hash, 1, 12) AS hash FROM ph",
    "overlap_excerpt": f"""WITH {FRAG}, {APPEALS}, {LINKS},
 aw AS (SELECT a.id, c.pos, {words('a.proposed_content')} AS pw, {words('c.content')} AS cw FROM app a JOIN cited c ON c.id = a.id),
joined AS (SELECT id, pos, array_to_string(list_filter(pw, lambda w: list_contains(cw, w)), ' ') AS t FROM aw),
cutted AS (SELECT id, pos, CASE WHEN length(t) > 100 THEN substring(t, 1, 100) || '...' ELSE t END AS t FROM joined)
 SELECT c.id, c.pos, CASE WHEN length(x.t) > 10 THEN x.t ELSE '' END AS excerpt FROM cited c LEFT JOIN cutted x ON x.id = c.id AND x.pos = c.pos""",
    "archive_conflicts": conflicts(0.85),
    "archive_conflicts_wide": conflicts(0.3),
    "phrase_patterns": f"WITH {PHRASES} SELECT seq, pos, name, substring(hash, 1, 12) AS hash FROM ph",
    "pattern_trackers": f"WITH {PHRASES} SELECT key, count(*) AS cnt, arg_min(name, seq * 100000 + pos) AS name, arg_min(context, seq * 100000 + pos) AS context, min(seq) AS first_seq, max(seq) AS last_seq, count(*) >= 12 AS ready FROM ph GROUP BY key",
    "pattern_statistics": f"WITH {PHRASES}, t AS (SELECT key, count(*) AS n FROM ph GROUP BY key) SELECT 'phrase' AS type, count(*) AS patterns, count(*) FILTER (n >= 12) AS ready FROM t",
    "pattern_candidates": f"WITH {CANDIDATES} SELECT key, seq, pos, occurrence FROM cnd",
    "pattern_certify": f"""WITH {CANDIDATES}, one AS (SELECT *, row_number() OVER (PARTITION BY substring(hash, 1, 8) ORDER BY seq, pos) AS rn FROM cnd QUALIFY rn = 1)
 SELECT 'R-' || substring(hash, 1, 8) AS id, name AS topic, seq, context || '|phrase|phrase' AS tags, 'rastrello:' || context AS source, lower(name) || '|' || context || '|phrase' AS keywords FROM one""",
    "code_detection": f"WITH {FRAG} SELECT id, ({_markers}) >= 3 AS is_code FROM frag",
    "feedback_thresholds": f"""WITH RECURSIVE {FEEDBACK}, fin AS (SELECT key, arg_max(thr, rn) AS thr, any_value(occ) AS occ FROM run GROUP BY key), t AS (SELECT key, count(*) FILTER (action = 'used') AS used, count(*) FILTER (action = 'ignored') AS ignored, count(*) FILTER (action = 'confirmed') AS confirmed FROM ev GROUP BY key)
 SELECT fin.key, occ AS occurrences, thr AS threshold, used, ignored, confirmed FROM fin JOIN t ON t.key = fin.key""",
    "quarantine_pending": f"WITH {QUARANTINE} SELECT fragment_id, round(age, 4) AS age_hours FROM qp WHERE pending",
    "quarantine_alerts": f"""WITH {QUARANTINE}, a AS (SELECT 1 AS o, CASE WHEN total >= 100 THEN 'critical' ELSE 'warning' END AS severity, 'quarantine_size' AS metric, total AS value,
   'Quarantine has ' || total || ' fragments (' || CASE WHEN total >= 100 THEN '>100x threshold)' ELSE 'exceeds threshold of 50)' END AS message FROM qs WHERE total >= 50
  UNION ALL SELECT 2, 'warning', 'pending_notifications', pending, pending || ' fragment(s) in quarantine >24h without admin review' FROM qs WHERE pending > 0)
 SELECT severity, metric, value, message FROM a UNION ALL SELECT 'ok', 'quarantine_size', total, 'Quarantine is healthy' FROM qs WHERE NOT EXISTS (SELECT 1 FROM a)""",
    "quarantine_fold": """WITH log AS (SELECT 'U-' || user_id AS fragment_id, CASE event_type WHEN 'error' THEN 'quarantine' WHEN 'view' THEN 'notify' WHEN 'click' THEN 'resolve' WHEN 'purchase' THEN (CASE WHEN value > 60 THEN 'release' END) END AS action, ts AS t, event_id AS seq, event_type AS reason FROM events),
 c AS (SELECT fragment_id, coalesce(max(seq) FILTER (action = 'release'), -1) AS cut FROM log WHERE action IS NOT NULL GROUP BY ALL),
 s AS (SELECT l.fragment_id, arg_min(t, seq) FILTER (action = 'quarantine') AS q, arg_min(t, seq) FILTER (action = 'notify') AS n, coalesce(bool_or(action = 'resolve'), false) AS resolved, coalesce(arg_max(reason, seq) FILTER (action = 'resolve'), '') AS resolution
  FROM log l JOIN c ON c.fragment_id = l.fragment_id WHERE l.action IS NOT NULL AND l.seq > c.cut GROUP BY l.fragment_id)
 SELECT fragment_id, strftime(q, '%Y-%m-%d %H:%M:%S.%f') AS quarantined_at, strftime(n, '%Y-%m-%d %H:%M:%S.%f') AS notified_at, resolved, resolution FROM s WHERE q IS NOT NULL""",
}
