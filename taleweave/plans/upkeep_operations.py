"""Further read operations: searches over edges and graphs, phases, upkeep of vectors, sessions."""

from __future__ import annotations

from taleweave.plans.dialect import Spark
from taleweave.plans.operations import FOCUS, op

_TENTH = "least(9, cast(floor((sequence - a) * 10.0 / greatest(b - a, 1)) AS BIGINT))"
_PHASES = f"ph AS (SELECT id, title, {_TENTH} AS phase, sequence FROM events_ CROSS JOIN (SELECT min(sequence) AS a, max(sequence) AS b FROM events_) m)"


@op
def phase_members(d: Spark):
    """Membership of events and scenes in phases, with centrality by distance from the phase's middle."""
    return f"""WITH {_PHASES}, mid AS (SELECT phase, avg(sequence) AS middle, max(sequence) - min(sequence) AS width FROM ph GROUP BY phase)
        SELECT ph.id, ph.phase, 'event' AS entity_type, round(1.0 / (1.0 + abs(ph.sequence - mid.middle) / greatest(mid.width, 1)), 6) AS centrality FROM ph JOIN mid ON mid.phase = ph.phase
        UNION ALL SELECT s.id, ph.phase, 'scene', round(1.0 / (1.0 + abs(ph.sequence - mid.middle) / greatest(mid.width, 1)), 6) FROM scenes_ s JOIN ph ON ph.id = s.event JOIN mid ON mid.phase = ph.phase"""


@op
def phase_pairs(d: Spark):
    """How many characters bridge each pair of phases."""
    return f"""WITH {_PHASES}, seen AS (SELECT DISTINCT i.in_id, ph.phase FROM involved_ i JOIN ph ON ph.id = i.out_id)
        SELECT x.phase AS a, y.phase AS b, count(*) AS n FROM seen x JOIN seen y ON y.in_id = x.in_id AND x.phase < y.phase GROUP BY x.phase, y.phase"""


@op
def query_around(d: Spark, anchor: str = FOCUS, limit: int = 20):
    """Characters around an anchor: by shared scenes, then by distance of the medians of what they witnessed."""
    return f"""WITH med AS (SELECT i.in_id, median(e.sequence) AS m FROM involved_ i JOIN events_ e ON e.id = i.out_id GROUP BY i.in_id),
        shared AS (SELECT p.in_id, count(*) AS n FROM participates_ p JOIN participates_ q ON q.out_id = p.out_id AND q.in_id = {anchor} WHERE p.in_id <> {anchor} GROUP BY p.in_id)
        SELECT id, shared, distance FROM (SELECT c.in_id AS id, coalesce(s.n, 0) AS shared, round(abs(c.m - a.m), 3) AS distance, row_number() OVER (ORDER BY coalesce(s.n, 0) DESC, abs(c.m - a.m), c.in_id) AS rn
        FROM med c CROSS JOIN (SELECT m FROM med WHERE in_id = {anchor}) a LEFT JOIN shared s ON s.in_id = c.in_id WHERE c.in_id <> {anchor}) z WHERE rn <= {limit}"""


def _edge_vectors(d: Spark) -> str:
    one = lambda k: f"SELECT o.vec_id AS observer, t.vec_id AS target, o.label AS kind, {d.plus('o.embedding', 't.embedding')} AS v FROM embeddings o JOIN embeddings t ON t.vec_id = o.vec_id + {k}"
    return f"{one(1)} UNION ALL {one(3)}"


@op
def similar_relationships(d: Spark, observer: int = 5, target: int = 6, limit: int = 10):
    """Edges whose vectors are most like that of one edge."""
    return f"""WITH e AS ({_edge_vectors(d)}) SELECT observer, target, score FROM (SELECT e.observer, e.target, round({d.cosine('e.v', 'q.v')}, 6) AS score,
        row_number() OVER (ORDER BY round({d.cosine('e.v', 'q.v')}, 6) DESC, e.observer, e.target) AS rn FROM e CROSS JOIN (SELECT v FROM e WHERE observer = {observer} AND target = {target}) q
        WHERE NOT (e.observer = {observer} AND e.target = {target})) z WHERE rn <= {limit}"""


@op
def perspective_search(d: Spark, query: int = 0, kind: int = 3, limit: int = 10):
    """Perceptions of observers of one kind most like a query vector."""
    return f"""SELECT observer, target, score FROM (SELECT e.observer, e.target, round({d.cosine('e.v', 'q.embedding')}, 6) AS score, row_number() OVER (ORDER BY round({d.cosine('e.v', 'q.embedding')}, 6) DESC, e.observer, e.target) AS rn
        FROM ({_edge_vectors(d)}) e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {query}) q WHERE e.kind = {kind}) z WHERE rn <= {limit}"""


@op
def perception_shift(d: Spark):
    """How the gap between neighbouring series moves: first and last gap, and the trend (0.02)."""
    return f"""WITH g AS (SELECT x.series, x.step, 1 - {d.cosine('x.v', 'y.v')} AS gap FROM arc_ x JOIN arc_ y ON y.series = x.series + 2 AND y.step = x.step)
        SELECT series, round(min_by(gap, step), 6) AS first, round(max_by(gap, step), 6) AS last, CASE WHEN max_by(gap, step) - min_by(gap, step) < -0.02 THEN 'converging' WHEN max_by(gap, step) - min_by(gap, step) > 0.02 THEN 'diverging' ELSE 'stable' END AS trend FROM g GROUP BY series"""


@op
def semantic_graph_search(d: Spark, series: int = 4, hops: int = 2, limit: int = 10):
    """Vectors reached within two hops of their labels' chain, ranked by similarity to a series' newest."""
    return f"""WITH q AS (SELECT max_by(v, step) AS v, max_by(label, step) AS label FROM arc_ WHERE series = {series}) SELECT vec_id, score FROM (SELECT e.vec_id, round({d.cosine('e.embedding', 'q.v')}, 6) AS score,
        row_number() OVER (ORDER BY round({d.cosine('e.embedding', 'q.v')}, 6) DESC, e.vec_id) AS rn FROM embeddings e CROSS JOIN q WHERE abs(e.label - q.label) BETWEEN 1 AND {hops}) z WHERE rn <= {limit}"""


@op
def rank_correlation(d: Spark):
    """Spearman's correlation of two rankings of all vectors: by similarity to vector 0 and to vector 1."""
    return f"""WITH s AS (SELECT e.vec_id, row_number() OVER (ORDER BY round({d.cosine('e.embedding', 'a.embedding')}, 9) DESC, e.vec_id) AS r1, row_number() OVER (ORDER BY round({d.cosine('e.embedding', 'b.embedding')}, 9) DESC, e.vec_id) AS r2
        FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) a CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 1) b WHERE e.vec_id > 1)
        SELECT count(*) AS n, round(1.0 - 6.0 * sum((r1 - r2) * (r1 - r2)) / (count(*) * (count(*) * count(*) - 1.0)), 9) AS rho FROM s"""


@op
def facts_in_scope(d: Spark):
    """Facts with the characters they hold for: strict ones for all, warnings for a role, the rest for nobody who is stale."""
    return """SELECT f.id, count(c.id) AS n_characters FROM facts_ f JOIN characters_ c ON f.enforcement = 'strict' OR (f.enforcement = 'warning' AND EXISTS (SELECT 1 FROM roles_ r WHERE r.id = c.id AND r.role = 'mentor'))
        OR (f.enforcement = 'informational' AND c.stale = 0) GROUP BY f.id"""


@op
def baseline_due(d: Spark):
    """Characters that have a vector but no logged search yet: those a baseline snapshot is due for."""
    return f"""SELECT DISTINCT c.id FROM characters c WHERE {d.size('c.embedding')} = 384 AND NOT EXISTS (SELECT 1 FROM search_results s WHERE s.probe_id = c.id)"""


@op
def backfill_due(d: Spark):
    """Characters whose vector is missing, unusable or stale, in chunks of fifty."""
    return f"""SELECT id, why, {d.intdiv('(row_number() OVER (ORDER BY id) - 1)', '50')} AS chunk FROM (SELECT id, max(CASE WHEN {d.size('embedding')} <> 384 THEN 'missing' ELSE 'stale' END) AS why
        FROM characters WHERE {d.size('embedding')} <> 384 OR embedding_stale GROUP BY id) z"""


@op
def session_start(d: Spark):
    """How much a returning user is told, by the length of the gap before their newest event."""
    gap = f"({d.micros('ts')} - {d.micros('before')})"
    return f"""SELECT user_id, CASE WHEN before IS NULL THEN 'new' WHEN {gap} < 86400000000 THEN 'brief' WHEN {gap} < 604800000000 THEN 'standard' ELSE 'full' END AS verbosity FROM (
        SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) z WHERE rn = 1"""


@op
def recent_activity(d: Spark):
    """Momentum: beliefs learnt in the last 30 and the 30 days before, per character."""
    return f"""SELECT in_id, sum(CASE WHEN learned_at > now_ - INTERVAL 30 DAYS THEN 1 ELSE 0 END) AS recent, sum(CASE WHEN learned_at <= now_ - INTERVAL 30 DAYS THEN 1 ELSE 0 END) AS earlier
        FROM knows_ CROSS JOIN (SELECT max(learned_at) AS now_ FROM knows_) m WHERE learned_at > now_ - INTERVAL 60 DAYS GROUP BY in_id"""


@op
def arc_trajectory(d: Spark):
    """Mean of the last three deltas of each series beside its overall mean."""
    return f"""WITH dl AS (SELECT series, step, CASE WHEN p IS NOT NULL THEN 1 - {d.cosine('v', 'p')} END AS delta FROM (SELECT series, step, v, lag(v) OVER (PARTITION BY series ORDER BY step) AS p FROM arc_) z),
        r AS (SELECT series, delta, row_number() OVER (PARTITION BY series ORDER BY step DESC) AS rn FROM dl WHERE delta IS NOT NULL)
        SELECT series, round(sum(CASE WHEN rn <= 3 THEN delta ELSE 0 END) / 3.0, 6) AS recent, round(avg(delta), 6) AS mean FROM r GROUP BY series"""


@op
def document_sources(d: Spark):
    """Notes and other documents attached to characters, by kind and language."""
    return f"""SELECT lower(trim(lang)) AS lang, count(DISTINCT doc_id) AS n, count(DISTINCT subject_id) AS n_subjects, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY lower(trim(lang))"""


@op
def notes_of_characters(d: Spark):
    """Documents per character they are about, through links in any spelling, newest first by their ids."""
    return f"""SELECT c.id, count(DISTINCT x.doc_id) AS n_documents, max(x.doc_id) AS newest FROM characters_ c JOIN (SELECT doc_id, 'character:' || {d.key('subject_id')} AS subject FROM documents WHERE subject_id IS NOT NULL) x ON x.subject = c.id GROUP BY c.id"""
