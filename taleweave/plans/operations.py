"""The engine's read operations, one function per operation: (dialect, parameters) -> SQL.

Each runs over the whole world; a limit stands only where the operation is a top-k or a page. Results
are structured columns in place of formatted text, and every order is total, so they can be compared.
"""

from __future__ import annotations

from taleweave.plans.dialect import Spark
from taleweave.plans.world import LETTERS

FOCUS, OTHER = "(SELECT id FROM focus_)", "(SELECT id FROM other_)"
OPS: dict = {}

# What clients know these grades by, each with the number it lies below.
ARC = ((0.02, "essentially unchanged"), (0.1, "minor evolution"), (0.3, "significant evolution"), (None, "dramatic transformation"))
GAP = ((0.05, "remarkably accurate"), (0.15, "fairly accurate"), (0.30, "notable blind spots"), (0.50, "significantly distorted"), (None, "dramatically wrong"))
WHAT_IF = ((0.02, "negligible"), (0.05, "minor"), (0.10, "moderate"), (0.20, "major"), (None, "transformative"))


def _graded(x: str, grades: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {below} THEN '{name}'" for below, name in grades[:-1]) + f" ELSE '{grades[-1][1]}' END"


def op(f):
    OPS[f.__name__] = f
    return f


# --- scans, filters, pages -------------------------------------------------------------------------


@op
def lookup(d: Spark, entity_id: str = FOCUS):
    """One entity of any type with the number of facts that apply to it."""
    return f"""SELECT e.id, e.entity_type, e.name, length(e.content) AS content_chars, count(a.fact_id) AS n_facts
        FROM entity_ e LEFT JOIN applies_ a ON a.entity_id = e.id WHERE e.id = {entity_id} GROUP BY e.id, e.entity_type, e.name, e.content"""


@op
def overview(d: Spark):
    """Entities of each type, with the share that has text of its own."""
    return """SELECT entity_type, count(*) AS n, sum(CASE WHEN content <> name THEN 1 ELSE 0 END) * 1.0 / count(*) AS described FROM entity_ GROUP BY entity_type"""


@op
def character_roles(d: Spark):
    return f"""SELECT c.id, c.name, {d.texts('r.role')} AS roles FROM characters_ c JOIN roles_ r ON r.id = c.id GROUP BY c.id, c.name"""


@op
def filtered_characters(d: Spark, role: str = "rival", part: str = "mira"):
    """Metadata filters: role membership and case-insensitive name part."""
    return f"""SELECT c.id, c.name FROM characters_ c WHERE lower(c.name) LIKE '%{part}%' AND EXISTS (SELECT 1 FROM roles_ r WHERE r.id = c.id AND r.role = '{role}')"""


@op
def events_between(d: Spark, low: float = 0.25, high: float = 0.5):
    """Range scan of the timeline between two shares of its length, in order."""
    return f"""SELECT e.id, e.title, e.sequence FROM events_ e, (SELECT min(sequence) AS a, max(sequence) AS b FROM events_) m
        WHERE e.sequence BETWEEN m.a + {low} * (m.b - m.a) AND m.a + {high} * (m.b - m.a)"""


@op
def next_sequence(d: Spark):
    """The sequence that an appended event gets, and the midpoint of every gap for insertion."""
    return f"""SELECT id AS after_id, sequence, {d.intdiv('(sequence + next_seq)', '2')} AS midpoint, max(sequence) OVER () + 1 AS appended
        FROM (SELECT id, sequence, lead(sequence) OVER (ORDER BY sequence, id) AS next_seq FROM events_) z WHERE next_seq IS NOT NULL"""


@op
def location_children(d: Spark):
    return "SELECT p.id, p.name, count(c.id) AS n_children FROM locations_ p JOIN locations_ c ON c.parent = p.id GROUP BY p.id, p.name"


@op
def scenes_by_secondary_location(d: Spark):
    """Set-membership scan: scenes by a location among their secondary ones."""
    inner = d.explode("scenes", "secondary_locations", "loc")
    return f"SELECT loc AS location_id, count(DISTINCT id) AS n_scenes FROM {inner} GROUP BY loc"


@op
def list_facts(d: Spark, enforcement: str = "strict", search: str = "steel", limit: int = 20, offset: int = 0):
    """Facts by conjunctive filters; the total is that before the page."""
    return f"""SELECT id, title, description, enforcement, total FROM (SELECT id, title, description, enforcement, count(*) OVER () AS total, row_number() OVER (ORDER BY id) AS rn
        FROM facts_ WHERE enforcement = '{enforcement}' AND lower(description) LIKE '%{search}%') z WHERE rn > {offset} AND rn <= {offset + limit}"""


@op
def page_with_cursor(d: Spark, limit: int = 20, offset: int = 40):
    """One page of characters by name with the cursor of the next page (base64 of its offset)."""
    cursor = d.b64(f"""'{{"offset":{offset + limit}}}'""")
    return f"""SELECT id, name, rn, CASE WHEN total > {offset + limit} THEN {cursor} END AS next_cursor FROM (SELECT id, name, row_number() OVER (ORDER BY name, id) AS rn,
        count(*) OVER () AS total FROM characters_) z WHERE rn > {offset} AND rn <= {offset + limit}"""


@op
def token_budget(d: Spark, budget: int = 2000, row_cost: int = 20, envelope: int = 50):
    """The rows, newest first, that fit a token budget; at least one."""
    cost = f"{d.intdiv('length(content)', '4')} + {row_cost}"
    return f"""SELECT id, cost, used FROM (SELECT id, {cost} AS cost, cast(sum({cost}) OVER w AS BIGINT) AS used, row_number() OVER w AS rn
        FROM (SELECT id, updated_at, composite_text AS content FROM characters_ WHERE composite_text IS NOT NULL) z
        WINDOW w AS (ORDER BY updated_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) y WHERE rn = 1 OR {envelope} + used <= {budget}"""


@op
def composite_text(d: Spark):
    """Text that describes a character: name, roles and told relations, in a fixed order."""
    return f"""SELECT c.id, c.name || CASE WHEN r.roles IS NULL THEN '' ELSE ' is ' || r.roles END || CASE WHEN x.rel IS NULL THEN '.' ELSE '. ' || x.rel || '.' END AS text
        FROM characters_ c LEFT JOIN (SELECT id, {d.texts('role', ', ')} AS roles FROM roles_ GROUP BY id) r ON r.id = c.id
        LEFT JOIN (SELECT e.in_id, {d.texts("e.rel_type || ' of ' || t.name", '; ')} AS rel FROM relates_ e JOIN characters_ t ON t.id = e.out_id GROUP BY e.in_id) x ON x.in_id = c.id"""


# --- ledger ---------------------------------------------------------------------------------------


@op
def knowledge_state(d: Spark):
    """The latest state of every pair of knower and target."""
    return f"SELECT in_id, out_id, certainty, {d.micros('learned_at')} AS learned_us FROM held_"


@op
def knowledge_inventory(d: Spark):
    cases = ", ".join(f"sum(CASE WHEN certainty = '{c}' THEN 1 ELSE 0 END) AS n_{c}" for c in ("knows", "suspects", "believes_wrongly", "uncertain"))
    return f"SELECT in_id, {cases}, sum(CASE WHEN certainty IN ('assumes', 'denies', 'forgotten') THEN 1 ELSE 0 END) AS n_other FROM held_ GROUP BY in_id"


@op
def knowledge_at_event(d: Spark):
    """As-of join: what each witness of an event held about each target at that moment."""
    if d.name == "spark":
        # A statement holds from its moment until the next of its pair; a tie leaves the earlier one no time.
        # The witnessed events, the smaller side, are copied to 64 parts, for one character holds a tenth of the ledger.
        return """SELECT i.in_id, i.out_id AS event_id, k.out_id, k.certainty FROM (SELECT w.in_id, w.out_id, e.created_at, part_ FROM involved_ w JOIN events_ e ON e.id = w.out_id LATERAL VIEW explode(sequence(0, 63)) ex AS part_) i
            JOIN (SELECT in_id, out_id, certainty, learned_at, lead(learned_at) OVER (PARTITION BY in_id, out_id ORDER BY learned_at, created_at, id) AS until, pmod(hash(out_id), 64) AS part_ FROM knows_ WHERE certainty IS NOT NULL) k
            ON k.in_id = i.in_id AND k.part_ = i.part_ AND k.learned_at <= i.created_at AND (k.until IS NULL OR k.until > i.created_at)"""
    # The same by rank: of all that a witness stated up to the event, the last about each target.
    return """SELECT in_id, event_id, out_id, certainty FROM (SELECT i.in_id, i.out_id AS event_id, k.out_id, k.certainty, row_number() OVER (PARTITION BY i.in_id, i.out_id, k.out_id
        ORDER BY k.learned_at DESC, k.created_at DESC, k.id DESC) AS rn FROM involved_ i JOIN events_ e ON e.id = i.out_id
        JOIN knows_ k ON k.in_id = i.in_id AND k.learned_at <= e.created_at WHERE k.certainty IS NOT NULL) z WHERE rn = 1"""


@op
def knowledge_history(d: Spark, character: str = FOCUS):
    """Full history of one character, with how long each statement stood."""
    return f"""SELECT id, out_id, certainty, {d.micros('learned_at')} AS learned_us, row_number() OVER (PARTITION BY out_id ORDER BY learned_at, created_at, id) AS version,
        {d.micros('lead(learned_at) OVER (PARTITION BY out_id ORDER BY learned_at, created_at, id)')} - {d.micros('learned_at')} AS stood_us
        FROM knows_ WHERE in_id = {character} AND certainty IS NOT NULL"""


@op
def knowledge_conflicts(d: Spark):
    """Targets that someone wrongly believes in, with who does and who knows better."""
    return f"""SELECT w.out_id, count(*) AS n_wrong, {d.distinct_texts('w.in_id', ' ')} AS believers, coalesce(max(k.n), 0) AS n_knowing FROM held_ w
        LEFT JOIN (SELECT out_id, count(*) AS n FROM held_ WHERE certainty = 'knows' GROUP BY out_id) k ON k.out_id = w.out_id WHERE w.certainty = 'believes_wrongly' GROUP BY w.out_id"""


@op
def knowledge_gaps(d: Spark, character: str = FOCUS):
    """What a character knows, suspects, has wrong, and has not heard of although others know it."""
    return f"""SELECT bucket, count(*) AS n FROM (
        SELECT CASE WHEN certainty = 'knows' THEN 'confident' WHEN certainty IN ('suspects', 'uncertain', 'assumes') THEN 'suspicion'
               WHEN certainty IN ('believes_wrongly', 'denies') THEN 'false' ELSE 'forgotten' END AS bucket FROM held_ WHERE in_id = {character}
        UNION ALL SELECT 'blind spot' FROM (SELECT DISTINCT out_id FROM held_ WHERE certainty = 'knows' AND in_id <> {character}) o
        WHERE NOT EXISTS (SELECT 1 FROM held_ h WHERE h.in_id = {character} AND h.out_id = o.out_id)) z GROUP BY bucket"""


@op
def secrets(d: Spark):
    """Targets that exactly one character knows."""
    return "SELECT out_id, min(in_id) AS holder FROM held_ WHERE certainty = 'knows' GROUP BY out_id HAVING count(*) = 1"


@op
def transmission_chain(d: Spark):
    """Per target the order in which it spread, with each teller's own place in it."""
    return f"""WITH first_ AS (SELECT in_id, out_id, min(learned_at) AS heard FROM knows_ GROUP BY in_id, out_id),
        ranked AS (SELECT in_id, out_id, row_number() OVER (PARTITION BY out_id ORDER BY heard, in_id) AS place FROM first_),
        told AS (SELECT DISTINCT in_id, out_id, source_id FROM knows_ WHERE source_id IS NOT NULL)
        SELECT r.out_id, r.in_id, r.place, t.source_id, s.place AS source_place FROM ranked r JOIN told t ON t.in_id = r.in_id AND t.out_id = r.out_id
        LEFT JOIN ranked s ON s.in_id = t.source_id AND s.out_id = r.out_id"""


@op
def possible_sources(d: Spark):
    """Who else witnessed the event at which something was learnt."""
    return """SELECT k.id, count(DISTINCT o.in_id) AS n_sources, min(o.in_id) AS first_source FROM knows_ k JOIN involved_ o ON o.out_id = k.event_id AND o.in_id <> k.in_id
        WHERE k.source_id IS NULL AND k.certainty = 'knows' GROUP BY k.id"""


def _scenes_since(d: Spark) -> str:
    # Counting per month first keeps the ordered running sum on a few rows; only the month itself is
    # compared row by row, in Spark by a running count over beliefs and scenes in order of time.
    within = f"""SELECT h.id, count(s.id) AS n FROM held_ h LEFT JOIN scenes_ s ON {d.month('s.created_at')} = {d.month('h.learned_at')} AND s.created_at > h.learned_at GROUP BY h.id"""
    if d.name == "spark":
        within = f"""SELECT id, sum(later) AS n FROM (SELECT id, belief, sum(scene) OVER (PARTITION BY m ORDER BY t DESC, belief DESC) AS later FROM (
            SELECT id, learned_at AS t, {d.month('learned_at')} AS m, 1 AS belief, 0 AS scene FROM held_
            UNION ALL SELECT NULL, created_at, {d.month('created_at')}, 0, CASE WHEN id IS NULL THEN 0 ELSE 1 END FROM scenes_) z) y WHERE belief = 1 GROUP BY id"""
    return f"""per AS (SELECT {d.month('created_at')} AS m, count(*) AS n FROM scenes_ GROUP BY 1), months AS (SELECT DISTINCT {d.month('learned_at')} AS m FROM held_),
        after_month AS (SELECT q.m, coalesce(sum(p.n), 0) AS after_m FROM months q LEFT JOIN per p ON p.m > q.m GROUP BY q.m),
        within AS ({within}),
        since AS (SELECT h.*, cast(w.n + a.after_m AS BIGINT) AS scenes_since FROM held_ h JOIN within w ON w.id = h.id JOIN after_month a ON a.m = {d.month('h.learned_at')})"""


@op
def scenes_since(d: Spark):
    """Range-count join: scenes that came after each held belief, counted per month before row by row."""
    return f"WITH {_scenes_since(d)} SELECT in_id, out_id, scenes_since FROM since"


def _irony(d: Spark, least: int, knower: str) -> str:
    weight = "scenes_since + CASE WHEN tension >= 7 THEN 3 WHEN tension >= 4 THEN 1.5 ELSE 0 END + CASE enforcement WHEN 'strict' THEN 3 WHEN 'warning' THEN 1 ELSE 0 END"
    return f"""WITH {_scenes_since(d)},
        pairs AS (SELECT s.in_id AS knower, p.out_id AS unknower, s.out_id AS target, s.scenes_since, p.tension FROM since s JOIN perceives_ p ON p.in_id = s.in_id
                  WHERE s.certainty = 'knows' AND s.scenes_since >= {least} AND s.out_id <> p.out_id AND {knower}),
        missing AS (SELECT p.* FROM pairs p LEFT JOIN (SELECT DISTINCT in_id, out_id FROM held_) h ON h.in_id = p.unknower AND h.out_id = p.target WHERE h.in_id IS NULL),
        law AS (SELECT entity_id, min(enforcement) AS enforcement FROM applies_ GROUP BY entity_id)
        SELECT knower, unknower, target, scenes_since, CASE WHEN scenes_since >= 5 THEN 'high' WHEN scenes_since >= 2 THEN 'medium' ELSE 'low' END AS signal,
               cast({weight} AS DOUBLE) AS weight FROM missing m LEFT JOIN law l ON l.entity_id = m.target"""


@op
def dramatic_irony(d: Spark, character: str = FOCUS, min_scenes: int = 3):
    """What a character knows and those they perceive do not, weighed by time, tension and facts."""
    return _irony(d, min_scenes, f"s.in_id = {character}")


def irony_known(d: Spark, least: int) -> str:
    """What each knows for long enough, with its weight but for tension; ``irony_totals`` reads it as known_."""
    return f"""WITH {_scenes_since(d)}, law AS (SELECT entity_id, min(enforcement) AS enforcement FROM applies_ GROUP BY entity_id)
        SELECT s.in_id AS knower, s.out_id AS target, CASE WHEN s.scenes_since >= 5 THEN 1 ELSE 0 END AS high,
               s.scenes_since + CASE l.enforcement WHEN 'strict' THEN 3 WHEN 'warning' THEN 1 ELSE 0 END AS weight
        FROM since s LEFT JOIN law l ON l.entity_id = s.out_id WHERE s.certainty = 'knows' AND s.scenes_since >= {least} AND s.out_id IS NOT NULL"""


@op
def irony_totals(d: Spark, min_scenes: int = 3):
    """The same over all characters, summed up per pair of knower and unknower."""
    if d.name == "spark":
        # All that the knower knows, less what the unknower holds or is: what one knows is never paired with all they perceive.
        return f"""WITH whole AS (SELECT knower, count(*) AS n, sum(high) AS n_high, sum(weight) AS weight FROM known_ GROUP BY knower),
            less AS (SELECT knower, unknower, count(*) AS n, sum(high) AS n_high, sum(weight) AS weight FROM (
                     SELECT k.knower, h.in_id AS unknower, k.high, k.weight FROM known_ k JOIN held_ h ON h.out_id = k.target WHERE h.in_id <> h.out_id
                     UNION ALL SELECT knower, target, high, weight FROM known_ WHERE target LIKE 'character:%') z GROUP BY knower, unknower)
            SELECT p.in_id AS knower, p.out_id AS unknower, w.n - coalesce(x.n, 0) AS n, w.n_high - coalesce(x.n_high, 0) AS n_high,
                   round(w.weight - coalesce(x.weight, 0) + (w.n - coalesce(x.n, 0)) * CASE WHEN p.tension >= 7 THEN 3 WHEN p.tension >= 4 THEN 1.5 ELSE 0 END, 3) AS weight
            FROM perceives_ p JOIN whole w ON w.knower = p.in_id LEFT JOIN less x ON x.knower = p.in_id AND x.unknower = p.out_id WHERE w.n > coalesce(x.n, 0)"""
    inner = _irony(d, min_scenes, "1 = 1")
    head, tail = inner.rsplit("SELECT knower, unknower, target", 1)
    return f"{head}, found AS (SELECT knower, unknower, target{tail}) SELECT knower, unknower, count(*) AS n, sum(CASE WHEN signal = 'high' THEN 1 ELSE 0 END) AS n_high, round(sum(weight), 3) AS weight FROM found GROUP BY knower, unknower"


@op
def knowledge_asymmetries(d: Spark, a: str = FOCUS, b: str = OTHER):
    """What each of two characters knows and the other holds nothing about."""
    return f"""SELECT k.in_id AS knower, k.out_id AS target FROM held_ k WHERE k.certainty = 'knows' AND k.in_id IN ({a}, {b})
        AND NOT EXISTS (SELECT 1 FROM held_ h WHERE h.out_id = k.out_id AND h.in_id <> k.in_id AND h.in_id IN ({a}, {b}))"""


# --- tension, roles, threads ------------------------------------------------------------------------


@op
def tension_matrix(d: Spark, min_tension: int = 1):
    return f"""SELECT in_id, out_id, tension, max(tension) OVER (PARTITION BY in_id) AS highest, round(avg(tension) OVER (PARTITION BY in_id), 6) AS mean
        FROM perceives_ WHERE tension >= {min_tension}"""


@op
def narrative_tensions(d: Spark, min_severity: float = 0.0):
    """Pairs with signals of conflict, their mean weight and the severity; no pair without a signal is looked at."""
    return f"""WITH signal AS (
        SELECT least(in_id, out_id) AS a, greatest(in_id, out_id) AS b, 'edge' AS kind, max(tension) / 10.0 AS weight FROM perceives_ WHERE tension >= 7 GROUP BY 1, 2
        UNION ALL SELECT least(k.in_id, w.in_id), greatest(k.in_id, w.in_id), CASE w.certainty WHEN 'denies' THEN 'denial' ELSE 'contradiction' END, CASE w.certainty WHEN 'denies' THEN 0.8 ELSE 0.9 END
        FROM (SELECT DISTINCT in_id, out_id FROM held_ WHERE certainty = 'knows') k JOIN held_ w ON w.out_id = k.out_id AND w.in_id <> k.in_id AND w.certainty IN ('denies', 'believes_wrongly')
        UNION ALL SELECT least(x.in_id, y.in_id), greatest(x.in_id, y.in_id), 'loyalty', 0.8 FROM relates_ x JOIN relates_ y ON y.out_id = x.out_id AND y.in_id <> x.in_id
        WHERE x.rel_type IN ('ally', 'friend') AND y.rel_type IN ('rival', 'enemy')),
        tense AS (SELECT least(in_id, out_id) AS a, greatest(in_id, out_id) AS b, max(tension) AS tension FROM perceives_ GROUP BY 1, 2),
        kinds AS (SELECT a, b, kind, count(*) AS n, sum(weight) AS w FROM signal GROUP BY a, b, kind),
        top AS (SELECT a, b, kind, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, kind) AS rn FROM kinds),
        total AS (SELECT a, b, cast(sum(n) AS BIGINT) AS n_signals, sum(w) / sum(n) AS mean FROM kinds GROUP BY a, b)
        SELECT t.a, t.b, t.n_signals, p.kind, round(least(1.0, greatest(0.0, t.mean + 0.03 * coalesce(e.tension, 0))), 6) AS severity
        FROM total t JOIN top p ON p.a = t.a AND p.b = t.b AND p.rn = 1 LEFT JOIN tense e ON e.a = t.a AND e.b = t.b
        WHERE t.mean + 0.03 * coalesce(e.tension, 0) >= {min_severity}"""


#: From so many pairs with a signal of loyalty on, those of one hearer are not listed before they are a result.
HUB_PAIRS = 100_000
#: Tasks that list them.
HUB_TASKS = 96


def tension_steps() -> dict[str, str]:
    """Tables that ``tensions`` reads, in order. A hub is a hearer whose fond and hostile tellers make many pairs; a side is
    how one teller stands to all hubs, and faces another side if some hub has a signal between the two."""
    facing = lambda x, y: f"f.side = least({x}, {y}) AND f.other = greatest({x}, {y})"
    return {
        "teller_": "SELECT out_id AS hearer, in_id AS teller, CASE WHEN rel_type IN ('ally', 'friend') THEN 1 ELSE 0 END AS fond FROM relates_ WHERE rel_type IN ('ally', 'friend', 'rival', 'enemy')",
        "hub_": f"SELECT hearer FROM teller_ GROUP BY hearer HAVING sum(fond) * sum(1 - fond) >= {HUB_PAIRS}",
        "side_": "SELECT teller, array_join(array_sort(collect_list(hearer || CASE fond WHEN 1 THEN '+' ELSE '-' END)), ' ') AS side FROM teller_ WHERE hearer IN (SELECT hearer FROM hub_) GROUP BY teller",
        "facing_": """WITH marks AS (SELECT side, mark FROM (SELECT DISTINCT side FROM side_) z LATERAL VIEW explode(split(side, ' ')) ex AS mark)
            SELECT least(x.side, y.side) AS side, greatest(x.side, y.side) AS other, count(*) AS n FROM (SELECT * FROM marks WHERE right(mark, 1) = '+') x
            JOIN (SELECT * FROM marks WHERE right(mark, 1) = '-') y ON left(x.mark, length(x.mark) - 1) = left(y.mark, length(y.mark) - 1) GROUP BY 1, 2""",
        # Every pair with a signal but for those of hubs, or with a tension, and what hubs add to it.
        "near_": f"""WITH light AS (SELECT t.* FROM teller_ t LEFT ANTI JOIN hub_ h ON h.hearer = t.hearer),
            found AS (SELECT least(in_id, out_id) AS a, greatest(in_id, out_id) AS b, tension, 0 AS denial, 0 AS contradiction, 0 AS loyalty FROM perceives_
                UNION ALL SELECT least(k.in_id, w.in_id), greatest(k.in_id, w.in_id), NULL, CASE w.certainty WHEN 'denies' THEN 1 ELSE 0 END, CASE w.certainty WHEN 'denies' THEN 0 ELSE 1 END, 0
                FROM (SELECT in_id, out_id FROM held_ WHERE certainty = 'knows') k JOIN held_ w ON w.out_id = k.out_id AND w.in_id <> k.in_id AND w.certainty IN ('denies', 'believes_wrongly')
                UNION ALL SELECT least(x.teller, y.teller), greatest(x.teller, y.teller), NULL, 0, 0, 1 FROM light x JOIN light y ON y.hearer = x.hearer WHERE x.fond = 1 AND y.fond = 0),
            pair AS (SELECT a, b, max(tension) AS tension, sum(denial) AS denial, sum(contradiction) AS contradiction, sum(loyalty) AS loyalty FROM found GROUP BY a, b)
            SELECT p.a, p.b, p.tension, CASE WHEN p.tension >= 7 THEN 1 ELSE 0 END AS edge, p.denial, p.contradiction, p.loyalty + coalesce(f.n, 0) AS loyalty, f.n AS hub,
                   CASE WHEN x.side <= y.side THEN p.a ELSE p.b END AS facer, CASE WHEN x.side <= y.side THEN p.b ELSE p.a END AS faced
            FROM pair p LEFT JOIN side_ x ON x.teller = p.a LEFT JOIN side_ y ON y.teller = p.b LEFT JOIN facing_ f ON {facing('x.side', 'y.side')}""",
        "facer_": """SELECT s.teller, f.other, f.n, e.known FROM side_ s JOIN facing_ f ON f.side = s.side
            LEFT JOIN (SELECT facer, collect_set(faced) AS known FROM near_ WHERE hub IS NOT NULL GROUP BY facer) e ON e.facer = s.teller""",
    }


def tensions(min_severity: float = 0.0) -> str:
    """As ``narrative_tensions``. Pairs that only hubs make are listed by each teller over those it faces, without a shuffle."""
    mean = "(edge * coalesce(tension, 0) / 10.0 + denial * 0.8 + contradiction * 0.9 + loyalty * 0.8) / (edge + denial + contradiction + loyalty) + 0.03 * coalesce(tension, 0)"
    return f"""SELECT a, b, cast(edge + denial + contradiction + loyalty AS BIGINT) AS n_signals, CASE WHEN contradiction >= greatest(denial, edge, loyalty) THEN 'contradiction'
        WHEN denial >= greatest(edge, loyalty) THEN 'denial' WHEN edge >= loyalty THEN 'edge' ELSE 'loyalty' END AS kind, round(least(1.0, greatest(0.0, {mean})), 6) AS severity
        FROM near_ WHERE edge + denial + contradiction + loyalty > 0 AND {mean} >= {min_severity}
        UNION ALL SELECT /*+ BROADCAST(y) */ least(x.teller, y.teller), greatest(x.teller, y.teller), x.n, 'loyalty', 0.8 FROM (SELECT /*+ REPARTITION({HUB_TASKS}) */ * FROM facer_) x
        JOIN side_ y ON y.side = x.other WHERE 0.8 >= {min_severity} AND (x.known IS NULL OR NOT array_contains(x.known, y.teller))"""


@op
def character_features(d: Spark):
    """Counts that roles are inferred from."""
    trait = lambda k: f"max({d.size(d.entry('profile', k))}) AS {k}"
    return f"""SELECT c.id, coalesce(a.n, 0) AS known_about, coalesce(a.w, 0) AS false_about, coalesce(h.n, 0) AS holds, coalesce(h.w, 0) AS holds_false, coalesce(r.mentor, 0) AS mentors,
        coalesce(r.rival, 0) AS rivals, coalesce(r.ally, 0) AS allies, coalesce(g.degree, 0) AS degree, coalesce(t.secret, 0) AS secrets, coalesce(t.contradiction, 0) AS contradictions, coalesce(t.wound, 0) AS wounds FROM characters_ c
        LEFT JOIN (SELECT id, {trait('secret')}, {trait('contradiction')}, {trait('wound')} FROM characters GROUP BY id) t ON t.id = c.id
        LEFT JOIN (SELECT out_id, count(*) AS n, sum(CASE WHEN certainty = 'believes_wrongly' THEN 1 ELSE 0 END) AS w FROM held_ GROUP BY out_id) a ON a.out_id = c.id
        LEFT JOIN (SELECT in_id, count(*) AS n, sum(CASE WHEN certainty = 'believes_wrongly' THEN 1 ELSE 0 END) AS w FROM held_ GROUP BY in_id) h ON h.in_id = c.id
        LEFT JOIN (SELECT in_id, sum(CASE WHEN rel_type = 'mentor' THEN 1 ELSE 0 END) AS mentor, sum(CASE WHEN rel_type IN ('rival', 'enemy') THEN 1 ELSE 0 END) AS rival,
                   sum(CASE WHEN rel_type IN ('ally', 'friend') THEN 1 ELSE 0 END) AS ally FROM relates_ GROUP BY in_id) r ON r.in_id = c.id
        LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT in_id AS id, out_id AS o FROM edges_ UNION ALL SELECT out_id, in_id FROM edges_) z GROUP BY id) g ON g.id = c.id"""


# A role, when it counts, and its weight. central is the number of links over all others there are.
ROLES = (
    ("social_hub", "central > 0.5", "0.6 + (central - 0.5) * 0.8"),
    ("outsider", "central = 0", "0.9"),
    ("peripheral", "central > 0 AND central < 0.2", "0.4"),
    ("person_of_interest", "known_about >= 3", "0.4 + least(known_about / 10.0, 0.5)"),
    ("enigma", "false_about >= 2", "0.5 + least(false_about / 5.0, 0.4)"),
    ("deceived", "holds_false >= 2", "0.4 + least(holds_false / 5.0, 0.4)"),
    ("information_broker", "holds >= 5", "0.3 + least(holds / 20.0, 0.4)"),
    ("mentor", "mentors >= 1", "0.5 + least(mentors / 3.0, 0.4)"),
    ("antagonist", "rivals >= 2", "0.4 + least(rivals / 5.0, 0.4)"),
    ("connector", "allies >= 3", "0.3 + least(allies / 6.0, 0.4)"),
    ("keeper_of_secrets", "secrets >= 1", "0.4 + least(secrets / 3.0, 0.4)"),
    ("complex_character", "contradictions >= 1", "0.3 + least(contradictions / 3.0, 0.4)"),
    ("tragic_figure", "wounds >= 1", "0.3 + least(wounds / 3.0, 0.3)"),
)


@op
def infer_roles(d: Spark):
    """The best narrative role of each character by scored rules over its features, and how many others (up to three)
    count besides. ``bridge``, which needs betweenness, is left out; that is an operation of its own."""
    feat = f"SELECT f.*, f.degree * 1.0 / greatest(n.n - 1, 1) AS central FROM ({character_features(d)}) f CROSS JOIN (SELECT count(*) AS n FROM characters_) n"
    if d.name == "spark":
        # One pass: a row's roles are sorted within it.
        scores = ", ".join(f"struct(CASE WHEN {when} THEN round(-cast({weight} AS DOUBLE), 9) ELSE 1.0 END AS s, '{role}' AS role)" for role, when, weight in ROLES)
        return f"""SELECT id, CASE WHEN size(r) > 0 THEN r[0].role ELSE 'undefined' END AS role, CASE WHEN size(r) > 0 THEN round(least(1.0, -r[0].s), 6) ELSE 0.0 END AS confidence,
            cast(least(3, greatest(0, size(filter(r, x -> x.s <= -0.3)) - 1)) AS BIGINT) AS n_secondary FROM (SELECT id, filter(array_sort(array({scores})), x -> x.s <= 0) AS r FROM ({feat}) f) z"""
    union = " UNION ALL ".join(f"SELECT id, '{role}' AS role, round(cast({weight} AS DOUBLE), 9) AS s FROM feat WHERE {when}" for role, when, weight in ROLES)
    return f"""WITH feat AS ({feat}), scored AS ({union}), ranked AS (SELECT id, role, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, role) AS rn, count(*) FILTER (s >= 0.3) OVER (PARTITION BY id) AS n FROM scored)
        SELECT f.id, coalesce(p.role, 'undefined') AS role, coalesce(round(least(1.0, p.s), 6), 0.0) AS confidence, coalesce(least(3, greatest(0, p.n - 1)), 0)::BIGINT AS n_secondary FROM feat f LEFT JOIN ranked p ON p.id = f.id AND p.rn = 1"""


@op
def narrative_threads(d: Spark):
    """Open threads: secrets, false beliefs, strained pairs and stale entities."""
    return f"""SELECT 'secret' AS thread, out_id AS subject, min(in_id) AS character_id FROM held_ WHERE certainty = 'knows' GROUP BY out_id HAVING count(*) = 1
        UNION ALL SELECT 'false belief', out_id, in_id FROM held_ WHERE certainty = 'believes_wrongly' UNION ALL SELECT 'tension', out_id, in_id FROM perceives_ WHERE tension >= 7
        UNION ALL SELECT 'stale', id, id FROM characters_ WHERE stale = 1"""


@op
def character_voice(d: Spark, character: str = FOCUS):
    """How a character speaks: the mix of certainties and the band of their tensions."""
    return f"""SELECT h.in_id AS id, count(*) AS n, round(avg(CASE WHEN certainty = 'knows' THEN 1.0 ELSE 0 END), 6) AS assertive, round(avg(CASE WHEN certainty IN ('uncertain', 'suspects') THEN 1.0 ELSE 0 END), 6) AS hedging,
        max(CASE WHEN p.mean >= 8 THEN 'explosive' WHEN p.mean >= 5 THEN 'strained' WHEN p.mean >= 3 THEN 'guarded' ELSE 'calm' END) AS band
        FROM held_ h LEFT JOIN (SELECT in_id, avg(tension) AS mean FROM (SELECT in_id, tension, row_number() OVER (PARTITION BY in_id ORDER BY tension DESC, out_id) AS rn FROM perceives_ WHERE tension IS NOT NULL) z
        WHERE rn <= 10 GROUP BY in_id) p ON p.in_id = h.in_id WHERE h.in_id = {character} GROUP BY h.in_id"""


@op
def world_health(d: Spark):
    """Vectors per type of entity: total, embedded, stale, coverage, with an overall row. Types whose vectors are not
    stored have null, and no part in the overall coverage."""
    return """SELECT coalesce(kind, 'OVERALL') AS kind, sum(total) AS total, sum(embedded) AS embedded, sum(stale) AS stale, round(sum(embedded) * 100.0 / sum(CASE WHEN embedded IS NOT NULL THEN total END), 6) AS coverage FROM (
        SELECT 'character' AS kind, 1 AS total, CASE WHEN id IN (SELECT id FROM characters WHERE cardinality(embedding) = 384) THEN 1 ELSE 0 END AS embedded, stale FROM characters_
        UNION ALL SELECT 'location', 1, NULL, NULL FROM locations_ UNION ALL SELECT 'event', 1, NULL, NULL FROM events_ UNION ALL SELECT 'scene', 1, NULL, NULL FROM scenes_ UNION ALL SELECT 'knowledge', 1, NULL, NULL FROM knowledge_) z
        GROUP BY ROLLUP (kind)""".replace("cardinality(embedding)", d.size("embedding"))


# --- graph ------------------------------------------------------------------------------------------


@op
def graph_traversal(d: Spark, start: str = FOCUS, depth: int = 2):
    """Breadth-first: characters within ``depth`` undirected hops, with the fewest hops."""
    return f"""{d.recursive} und AS (SELECT in_id AS a, out_id AS b FROM edges_ UNION SELECT out_id, in_id FROM edges_),
        walk AS (SELECT {start} AS id, 0 AS hops UNION SELECT u.b, w.hops + 1 FROM walk w JOIN und u ON u.a = w.id WHERE w.hops < {depth})
        SELECT id, min(hops) AS hops FROM walk GROUP BY id HAVING min(hops) > 0"""


def _depth(d: Spark) -> int:
    return 3


@op
def connection_paths(d: Spark, start: str = FOCUS, end: str = OTHER, max_hops: int | None = None, include_events: bool | None = None):
    """All simple paths between two characters of at most ``max_hops``, by perceptions either way and by events both witnessed.
    A path is its characters: one that several relations or events make is listed once."""
    max_hops = max_hops or _depth(d)
    events = include_events is None or include_events
    parts = []
    shared = " UNION SELECT x.in_id, y.in_id FROM involved_ x JOIN involved_ y ON y.out_id = x.out_id AND y.in_id <> x.in_id" if events else ""
    und = f"und AS (SELECT in_id AS a, out_id AS b FROM perceives_ UNION SELECT out_id, in_id FROM perceives_{shared})"
    for h in range(1, max_hops + 1):
        joins = " ".join(f"JOIN und e{i} ON e{i}.a = e{i - 1}.b" for i in range(2, h + 1))
        distinct = " AND ".join(f"e{i}.b <> e{j}.b AND e{i}.b <> e1.a" for i in range(1, h + 1) for j in range(i + 1, h + 1)) or "1 = 1"
        path = " || '>' || ".join(["e1.a"] + [f"e{i}.b" for i in range(1, h + 1)])
        parts.append(f"SELECT {h} AS hops, {path} AS path FROM und e1 {joins} WHERE e1.a = {start} AND e{h}.b = {end} AND {distinct}")
    return f"WITH {und} SELECT hops, path, round(1.0 / (hops + 1), 6) AS confidence FROM ({' UNION ALL '.join(parts)}) z"


@op
def influence(d: Spark, start: str = FOCUS, max_depth: int | None = None):
    """Strongest directed influence on every character reached within ``max_depth`` hops."""
    max_depth = max_depth or _depth(d)
    factor = "CASE WHEN tension >= 7 THEN 0.7 ELSE 1.0 END * CASE WHEN rel_type IN ('mentor', 'family') THEN 1.0 WHEN rel_type IN ('ally', 'friend') THEN 0.9 WHEN rel_type = 'professional' THEN 0.7 WHEN rel_type = 'rival' THEN 0.4 ELSE 0.85 END"
    base = {1: 1.0, 2: 0.6, 3: 0.3}
    ctes = [f"e AS (SELECT in_id AS a, out_id AS b, cast({factor} AS DOUBLE) AS f FROM perceives_)", f"p1 AS (SELECT b, max(f) AS f FROM e WHERE a = {start} AND b <> {start} GROUP BY b)"]
    for h in range(2, max_depth + 1):
        ctes.append(f"p{h} AS (SELECT e.b, max(p.f * e.f) AS f FROM p{h - 1} p JOIN e ON e.a = p.b WHERE e.b <> {start} GROUP BY e.b)")
    union = " UNION ALL ".join(f"SELECT b AS id, {h} AS hops, f * {base.get(h, 0.3)} AS strength FROM p{h}" for h in range(1, max_depth + 1))
    return f"""WITH {', '.join(ctes)}, allp AS ({union}), best AS (SELECT id, hops, strength, row_number() OVER (PARTITION BY id ORDER BY hops) AS rn FROM allp)
        SELECT id, hops, round(strength, 6) AS strength, CASE WHEN hops = 1 THEN 'direct' WHEN hops = 2 THEN 'likely' ELSE 'possible' END AS label FROM best WHERE rn = 1"""


@op
def degree_centrality(d: Spark):
    """In and out degree over distinct edges, normalised, with the role the degree suggests."""
    return """SELECT id, n_in, n_out, round(degree, 9) AS degree, CASE WHEN degree = 0 THEN 'isolated' WHEN degree > 0.5 THEN 'hub' WHEN degree < 0.2 THEN 'peripheral' ELSE 'connected' END AS role,
        rank() OVER (ORDER BY n_in + n_out DESC) AS place FROM (SELECT c.id, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out, (coalesce(i.n, 0) + coalesce(o.n, 0)) * 1.0 / (count(*) OVER () - 1) AS degree FROM characters_ c
        LEFT JOIN (SELECT out_id, count(*) AS n FROM edges_ GROUP BY out_id) i ON i.out_id = c.id LEFT JOIN (SELECT in_id, count(*) AS n FROM edges_ GROUP BY in_id) o ON o.in_id = c.id) z"""


@op
def reverse_query(d: Spark, character: str = FOCUS):
    """What refers to an entity: scenes, events, knowledge, other characters."""
    return f"""SELECT 'scene' AS kind, out_id AS id FROM participates_ WHERE in_id = {character} UNION ALL SELECT 'event', out_id FROM involved_ WHERE in_id = {character}
        UNION ALL SELECT 'knowledge', id FROM knowledge_ WHERE owner = {character} UNION ALL SELECT 'perceiver', in_id FROM perceives_ WHERE out_id = {character}"""


@op
def location_usage(d: Spark):
    return """SELECT l.id, l.name, coalesce(p.n, 0) AS n_primary, coalesce(c.n, 0) AS n_children FROM locations_ l LEFT JOIN (SELECT location, count(*) AS n FROM scenes_ GROUP BY location) p ON p.location = l.id
        LEFT JOIN (SELECT parent, count(*) AS n FROM locations_ GROUP BY parent) c ON c.parent = l.id WHERE p.n > 0 OR c.n > 0"""


@op
def impact(d: Spark, start: str = FOCUS, depth: int | None = None):
    """How many entities a change reaches at each distance, with the severity of that distance."""
    depth = depth or _depth(d)
    return f"""SELECT hops, count(*) AS n, CASE hops WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
        CASE WHEN sum(count(*)) OVER () > 10 THEN 'high' WHEN sum(count(*)) OVER () > 3 THEN 'medium' ELSE 'low' END AS overall FROM ({graph_traversal(d, start, depth)}) hit GROUP BY hops"""


@op
def relationship_strength(d: Spark, character: str = FOCUS):
    return f"""SELECT 'out' AS direction, r.out_id AS other, r.rel_type, p.tension, p.feelings FROM relates_ r LEFT JOIN perceives_ p ON p.in_id = r.in_id AND p.out_id = r.out_id WHERE r.in_id = {character}
        UNION ALL SELECT 'in', r.in_id, r.rel_type, p.tension, p.feelings FROM relates_ r LEFT JOIN perceives_ p ON p.in_id = r.out_id AND p.out_id = r.in_id WHERE r.out_id = {character}"""


@op
def co_occurrence(d: Spark):
    """Pairs of participants of the same scenes, with the number shared."""
    return "SELECT a.in_id AS a, b.in_id AS b, count(*) AS shared FROM participates_ a JOIN participates_ b ON b.out_id = a.out_id AND a.in_id < b.in_id GROUP BY a.in_id, b.in_id"


@op
def reciprocal_perceptions(d: Spark):
    """Reverse-edge join: pairs that perceive each other, once, with both tensions."""
    return "SELECT a.in_id AS a, a.out_id AS b, a.tension AS tension_ab, b.tension AS tension_ba FROM perceives_ a JOIN perceives_ b ON b.in_id = a.out_id AND b.out_id = a.in_id WHERE a.in_id < a.out_id"


@op
def mermaid_graph(d: Spark):
    """Lines of a diagram: one per undirected pair and kind of relation."""
    return f"""SELECT DISTINCT {d.key('least(in_id, out_id)')} || ' -- ' || rel_type || ' -- ' || {d.key('greatest(in_id, out_id)')} AS line FROM relates_"""


# --- consistency ------------------------------------------------------------------------------------


@op
def timeline_violations(d: Spark):
    """Ledger rows learnt at an event later than the event of a scene in which their character took part; gap is to the earliest such scene."""
    if d.name == "spark":
        return """SELECT k.id, k.in_id, k.event_id, CASE WHEN max(CASE WHEN a.enforcement = 'strict' THEN 1 ELSE 0 END) = 1 THEN 'critical' ELSE 'warning' END AS severity, max(e.sequence) - min(p.sequence) AS gap
            FROM knows_ k JOIN events_ e ON e.id = k.event_id JOIN (SELECT t.in_id, min(v.sequence) AS sequence FROM participates_ t JOIN scenes_ s ON s.id = t.out_id JOIN events_ v ON v.id = s.event GROUP BY t.in_id) p
            ON p.in_id = k.in_id AND p.sequence < e.sequence LEFT JOIN applies_ a ON a.entity_id = k.out_id GROUP BY k.id, k.in_id, k.event_id"""
    # The same scene by scene, without a minimum per character first.
    return """SELECT k.id, k.in_id, k.event_id, CASE WHEN bool_or(coalesce(a.enforcement, '') = 'strict') THEN 'critical' ELSE 'warning' END AS severity, max(e.sequence - v.sequence) AS gap
        FROM knows_ k JOIN events_ e ON e.id = k.event_id JOIN participates_ t ON t.in_id = k.in_id JOIN scenes_ s ON s.id = t.out_id JOIN events_ v ON v.id = s.event AND v.sequence < e.sequence
        LEFT JOIN applies_ a ON a.entity_id = k.out_id GROUP BY k.id, k.in_id, k.event_id"""


@op
def relationship_violations(d: Spark):
    """Contradictory relations of a pair: both mentors of each other, or unequal feelings."""
    return """SELECT x.in_id AS a, x.out_id AS b, 'mutual ' || x.rel_type AS violation, 'critical' AS severity FROM relates_ x JOIN relates_ y ON y.in_id = x.out_id AND y.out_id = x.in_id
        WHERE x.in_id < x.out_id AND x.rel_type = y.rel_type AND x.rel_type = 'mentor'
        UNION ALL SELECT x.in_id, x.out_id, 'feelings differ', CASE WHEN x.rel_type IN ('family', 'professional') THEN 'warning' ELSE 'info' END FROM perceives_ x JOIN perceives_ y
        ON y.in_id = x.out_id AND y.out_id = x.in_id WHERE x.in_id < x.out_id AND x.feelings <> y.feelings"""


NEGATIONS = ("no ", "not ", "cannot ", "never ", "without ", "lacks ")  # fixed values


@op
def fact_violations(d: Spark):
    """Statements of knowledge that deny a fact that applies: a word of its title or description (of more than three
    letters) comes within 20 characters after a negation. Confidence grows with the words of the title that the
    statement holds, from 0.3 to 0.9; statements of characters may be meant so, hence ``intentional``."""
    words = lambda c, v: f"SELECT DISTINCT id, w AS {v} FROM {d.explode(f'(SELECT id, {d.split_words(c)} AS ws FROM facts_)' + (' q' if d.name == 'spark' else ''), 'ws', 'w')}{' y' if d.name == 'duckdb' else ''} WHERE length(w) > 3"
    before = f"substring(lower(k.fact), greatest(1, {d.pos('fw.w', 'lower(k.fact)')} - 20), least(20, {d.pos('fw.w', 'lower(k.fact)')} - 1))"
    denied = " OR ".join(f"{before} LIKE '%{n}%'" for n in NEGATIONS)
    return f"""WITH fw AS ({words("lower(title || ' ' || description)", "w")}), tw AS ({words("lower(title)", "w")}),
        hit AS (SELECT a.fact_id, a.enforcement, k.id, k.fact, count(DISTINCT fw.w) AS n_words FROM applies_ a JOIN knowledge_ k ON k.id = a.entity_id JOIN fw ON fw.id = a.fact_id
            WHERE {d.pos('fw.w', 'lower(k.fact)')} > 1 AND ({denied}) GROUP BY a.fact_id, a.enforcement, k.id, k.fact)
        SELECT h.id, h.fact_id, h.n_words, CASE h.enforcement WHEN 'strict' THEN 'critical' WHEN 'warning' THEN 'warning' ELSE 'info' END AS severity, 1 AS intentional,
        round(0.3 + 0.6 * coalesce(avg(CASE WHEN {d.pos('tw.w', 'lower(h.fact)')} > 0 THEN 1.0 ELSE 0.0 END), 1.0 / 3), 6) AS confidence
        FROM hit h LEFT JOIN tw ON tw.id = h.fact_id GROUP BY h.id, h.fact_id, h.n_words, h.enforcement"""


@op
def entity_validation(d: Spark):
    """Violations per character over all checks."""
    return f"""SELECT in_id AS id, 'timeline' AS check_name, count(*) AS n FROM ({timeline_violations(d)}) t GROUP BY in_id UNION ALL SELECT a, 'relationship', count(*) FROM ({relationship_violations(d)}) r GROUP BY a"""


# --- vectors ----------------------------------------------------------------------------------------

_FIRST_LAST = """SELECT series, min_by(v, step) AS a, max_by(v, step) AS b, count(*) AS n FROM arc_ GROUP BY series"""


def _deltas_(d: Spark) -> str:
    return f"SELECT series, step, v, CASE WHEN p IS NOT NULL THEN 1 - {d.cosine('v', 'p')} END AS delta FROM (SELECT series, step, v, lag(v) OVER (PARTITION BY series ORDER BY step) AS p FROM arc_) z"


@op
def arc_history(d: Spark):
    """Drift of each series from snapshot to snapshot, and its running sum."""
    return f"""SELECT series, step, round(delta, 6) AS delta, round(sum(coalesce(delta, 0)) OVER (PARTITION BY series ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative FROM ({_deltas_(d)}) y"""


@op
def arc_drift(d: Spark):
    """Total drift, net displacement and efficiency of each series."""
    net = f"1 - {d.cosine('f.a', 'f.b')}"
    return f"""SELECT t.series, round(t.total, 6) AS total_drift, round({net}, 6) AS net, round(({net}) / t.total, 6) AS efficiency,
        {_graded(net, ARC)} AS assessment
        FROM (SELECT series, sum(delta) AS total FROM ({_deltas_(d)}) y GROUP BY series) t JOIN ({_FIRST_LAST}) f ON f.series = t.series WHERE t.total > 0"""


@op
def arc_comparison(d: Spark):
    """Every pair of series: similarity at first and at last, and of their displacements."""
    return f"""WITH fl AS ({_FIRST_LAST}) SELECT x.series AS a, y.series AS b, round({d.cosine('x.a', 'y.a')}, 6) AS first, round({d.cosine('x.b', 'y.b')}, 6) AS latest,
        CASE WHEN {d.cosine('x.b', 'y.b')} - {d.cosine('x.a', 'y.a')} > 0.02 THEN 'converging' WHEN {d.cosine('x.b', 'y.b')} - {d.cosine('x.a', 'y.a')} < -0.02 THEN 'diverging' ELSE 'stable' END AS trend,
        round({d.cosine(d.minus('x.b', 'x.a'), d.minus('y.b', 'y.a'))}, 6) AS direction FROM fl x JOIN fl y ON x.series < y.series"""


@op
def arc_moment(d: Spark, step: int = 7):
    """The last snapshot of each series at or before a step (as-of)."""
    return f"SELECT series, max(step) AS step, max_by(label, step) AS label FROM arc_ WHERE step <= {step} GROUP BY series"


@op
def convergence(d: Spark):
    """Positional comparison of neighbouring series: similarity per step and the rate of change."""
    return f"""WITH c AS (SELECT x.series, x.step, {d.cosine('x.v', 'y.v')} AS s FROM arc_ x JOIN arc_ y ON y.series = x.series + 1 AND y.step = x.step)
        SELECT series, count(*) AS n, round(min_by(s, step), 6) AS first, round(max_by(s, step), 6) AS current, round((max_by(s, step) - min_by(s, step)) / greatest(count(*) - 1, 1), 6) AS rate FROM c GROUP BY series"""


@op
def growth_vector(d: Spark, series: int = 3, limit: int = 5):
    """The vectors that lie in the direction in which a series grew."""
    g = d.minus("f.b", "f.a")
    return f"""WITH f AS (SELECT * FROM ({_FIRST_LAST}) q WHERE series = {series}) SELECT vec_id, score FROM (SELECT e.vec_id, round({d.cosine('e.embedding', g)}, 6) AS score,
        row_number() OVER (ORDER BY round({d.cosine('e.embedding', g)}, 6) DESC, e.vec_id) AS rn FROM embeddings e CROSS JOIN f) z WHERE rn <= {limit}"""


@op
def semantic_midpoint(d: Spark, a: int = 1, b: int = 2, limit: int = 5):
    """The vectors nearest to the middle between two."""
    m = d.plus("x.embedding", "y.embedding")
    return f"""SELECT vec_id, score FROM (SELECT e.vec_id, round({d.cosine('e.embedding', m)}, 6) AS score, row_number() OVER (ORDER BY round({d.cosine('e.embedding', m)}, 6) DESC, e.vec_id) AS rn
        FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {a}) x CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {b}) y WHERE e.vec_id NOT IN ({a}, {b})) z WHERE rn <= {limit}"""


@op
def semantic_join(d: Spark, query: int = 0, k: int = 10):
    """Top-k per label of all vectors by similarity to one, then over all labels; scores are absolute."""
    return f"""WITH s AS (SELECT e.vec_id, e.label, {d.cosine('e.embedding', 'q.embedding')} AS c FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {query}) q WHERE e.vec_id <> {query}),
        per AS (SELECT vec_id, label, c, row_number() OVER (PARTITION BY label ORDER BY round(c, 9) DESC, vec_id) AS rn FROM s)
        SELECT vec_id, label, score FROM (SELECT vec_id, label, round(abs(c), 6) AS score, row_number() OVER (ORDER BY round(abs(c), 6) DESC, vec_id) AS rn FROM per WHERE rn <= {2 * k}) z WHERE rn <= {k}"""


@op
def faceted_search(d: Spark, query: int = 0, facet: int = 1, k: int = 10):
    """Similarity on one of four facets, the quarters of a vector."""
    f = lambda c: d.slice(c, 16 * facet + 1, 16)
    return f"""SELECT vec_id, score FROM (SELECT e.vec_id, round({d.cosine(f('e.embedding'), f('q.embedding'))}, 6) AS score, row_number() OVER (ORDER BY round({d.cosine(f('e.embedding'), f('q.embedding'))}, 6) DESC, e.vec_id) AS rn
        FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {query}) q WHERE e.vec_id <> {query}) z WHERE rn <= {k}"""


@op
def multi_facet_search(d: Spark, query: int = 0, weights: tuple = (4, 3, 2, 1), k: int = 10):
    """Weighted similarity over the four facets."""
    f = lambda c, i: d.slice(c, 16 * i + 1, 16)
    score = " + ".join(f"{w / sum(weights)} * {d.cosine(f('e.embedding', i), f('q.embedding', i))}" for i, w in enumerate(weights))
    return f"""SELECT vec_id, score FROM (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rn FROM (SELECT e.vec_id, round({score}, 6) AS score
        FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {query}) q WHERE e.vec_id <> {query}) y) z WHERE rn <= {k}"""


@op
def facet_similarities(d: Spark):
    """Pairwise similarity of the facets of each vector."""
    f = lambda i: d.slice("embedding", 16 * i + 1, 16)
    cols = ", ".join(f"round({d.cosine(f(i), f(j))}, 6) AS s{i}{j}" for i in range(4) for j in range(i + 1, 4))
    return f"SELECT vec_id, {cols} FROM embeddings"


def _seen(d: Spark) -> str:
    # An observer's view of two others' vectors: the observer's own vector moved halfway to theirs.
    one = lambda k: f"SELECT o.vec_id AS observer, t.vec_id AS target, o.label AS label, {d.plus('o.embedding', 't.embedding')} AS v, t.embedding AS real_v FROM embeddings o JOIN embeddings t ON t.vec_id = o.vec_id + {k}"
    return f"{one(1)} UNION ALL {one(3)}"


@op
def perception_gap(d: Spark):
    """How far an observer's view of a target is from the target itself."""
    gap = f"1 - {d.cosine('v', 'real_v')}"
    return f"""SELECT observer, target, round({gap}, 6) AS gap, {_graded(gap, GAP)} AS label FROM ({_seen(d)}) z"""


@op
def perception_matrix(d: Spark):
    """Per target the observers' gaps and how far they agree with each other."""
    return f"""WITH s AS ({_seen(d)}) SELECT x.target, x.observer, round(1 - {d.cosine('x.v', 'x.real_v')}, 6) AS gap, max_by(y.observer, {d.cosine('x.v', 'y.v')}) AS agrees_with, round(max({d.cosine('x.v', 'y.v')}), 6) AS agreement
        FROM s x JOIN s y ON y.target = x.target AND y.observer <> x.observer GROUP BY x.target, x.observer, x.v, x.real_v"""


@op
def misperception_vector(d: Spark, observer: int = 4, limit: int = 5):
    """What an observer's view of a target adds to it, by the vectors nearest to that difference."""
    m = d.minus("s.v", "s.real_v")
    return f"""WITH s AS (SELECT * FROM ({_seen(d)}) q WHERE observer = {observer}) SELECT target, vec_id, score FROM (SELECT s.target, e.vec_id, round({d.cosine('e.embedding', m)}, 6) AS score,
        row_number() OVER (PARTITION BY s.target ORDER BY round({d.cosine('e.embedding', m)}, 6) DESC, e.vec_id) AS rn FROM s CROSS JOIN embeddings e WHERE e.vec_id <> {observer}) z WHERE rn <= {limit}"""


@op
def unresolved_tensions(d: Spark):
    """Pairs that perceive each other unequally, weighed down by the scenes they share."""
    return f"""WITH pair AS (SELECT a.in_id AS a, a.out_id AS b, abs(a.tension - b.tension) / 10.0 AS asymmetry FROM perceives_ a JOIN perceives_ b ON b.in_id = a.out_id AND b.out_id = a.in_id WHERE a.in_id < a.out_id AND a.tension <> b.tension),
        shared AS (SELECT p.a, p.b, count(*) AS n FROM pair p JOIN participates_ x ON x.in_id = p.a JOIN participates_ y ON y.in_id = p.b AND y.out_id = x.out_id GROUP BY p.a, p.b)
        SELECT p.a, p.b, round(p.asymmetry, 6) AS asymmetry, coalesce(s.n, 0) AS shared, round(p.asymmetry / (coalesce(s.n, 0) + 1), 6) AS score FROM pair p LEFT JOIN shared s ON s.a = p.a AND s.b = p.b"""


@op
def theme_clusters(d: Spark):
    """Clusters with frozen centres (the mean of each label): size, and members by nearness."""
    if d.name == "spark":
        off = d.minus("e.embedding", "m.centre")
        return f"""SELECT label, count(*) AS n, min_by(vec_id, struct(dist, vec_id)) AS most_central, round(avg(1 / (1 + dist)), 6) AS centrality FROM (SELECT e.vec_id, e.label, round(sqrt({d.dot(off, off)}), 9) AS dist
            FROM embeddings e JOIN (SELECT label, transform(array_sort(collect_list(struct(pos, x))), p -> p.x) AS centre FROM (SELECT label, pos, avg(cast(x AS DOUBLE)) AS x
            FROM embeddings LATERAL VIEW posexplode(embedding) ex AS pos, x GROUP BY label, pos) y GROUP BY label) m ON m.label = e.label) z GROUP BY label"""
    off = d.minus("e.embedding", "m.centre")
    return f"""SELECT label, count(*) AS n, arg_min(vec_id, (dist, vec_id)) AS most_central, round(avg(1 / (1 + dist)), 6) AS centrality FROM (SELECT e.vec_id, e.label, round(sqrt(greatest({d.dot(off, off)}, 0)), 9) AS dist
        FROM embeddings e JOIN (SELECT label, list(x ORDER BY pos) AS centre FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) u
        GROUP BY label, pos) y GROUP BY label) m ON m.label = e.label) z GROUP BY label"""


@op
def theme_gaps(d: Spark):
    """Labels that lack one of the expected kinds (vec_id modulo four stands for the kind)."""
    return """SELECT label, count(*) AS n, 4 - count(DISTINCT vec_id % 4) AS n_missing, round((4 - count(DISTINCT vec_id % 4)) / 4.0, 6) AS severity FROM embeddings GROUP BY label"""


@op
def phases(d: Spark):
    """Phases of the timeline: tenths of the sequence, with what takes place in each."""
    tenth = "least(9, cast(floor((sequence - a) * 10.0 / greatest(b - a, 1)) AS BIGINT))"
    return f"""WITH ph AS (SELECT id, {tenth} AS phase, sequence FROM events_ CROSS JOIN (SELECT min(sequence) AS a, max(sequence) AS b FROM events_) m)
        SELECT ph.phase, count(DISTINCT ph.id) AS n_events, count(DISTINCT s.id) AS n_scenes, min(ph.sequence) AS first, max(ph.sequence) AS last, round(median(ph.sequence), 3) AS middle FROM ph LEFT JOIN scenes_ s ON s.event = ph.id GROUP BY ph.phase"""


@op
def phase_transitions(d: Spark):
    """Characters that bridge phases: the phases they witnessed, and the span between."""
    tenth = "least(9, cast(floor((sequence - a) * 10.0 / greatest(b - a, 1)) AS BIGINT))"
    return f"""WITH ph AS (SELECT id, {tenth} AS phase, sequence FROM events_ CROSS JOIN (SELECT min(sequence) AS a, max(sequence) AS b FROM events_) m)
        SELECT i.in_id, count(DISTINCT ph.phase) AS n_phases, max(ph.sequence) - min(ph.sequence) AS span FROM involved_ i JOIN ph ON ph.id = i.out_id GROUP BY i.in_id HAVING count(DISTINCT ph.phase) >= 2"""


# --- text -------------------------------------------------------------------------------------------


@op
def keyword_search(d: Spark, query: tuple = ("mask", "repainted", "lantern"), k: int = 20):
    """BM25 over scene summaries (k1 = 1.2, b = 0.75)."""
    terms = ", ".join(f"'{t}'" for t in query)
    words = d.explode(f"(SELECT id, {d.words('summary')} AS ws FROM scenes_ WHERE summary IS NOT NULL){' q' if d.name == 'spark' else ''}", "ws", "w")
    return f"""WITH tok AS (SELECT id, w, count(*) AS tf FROM {words}{' q' if d.name == 'duckdb' else ''} GROUP BY id, w), len AS (SELECT id, sum(tf) AS dl FROM tok GROUP BY id), corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
        df AS (SELECT w, count(*) AS df FROM tok WHERE w IN ({terms}) GROUP BY w),
        s AS (SELECT t.id, sum(ln(1 + (c.n - df.df + 0.5) / (df.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.dl / c.avgdl))) AS score FROM tok t JOIN df ON df.w = t.w JOIN len l ON l.id = t.id CROSS JOIN corpus c GROUP BY t.id)
        SELECT id, score FROM (SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS rn FROM s) z WHERE rn <= {k}"""


@op
def fuzzy_search(d: Spark, query: str = "corestdric tusbenpospos", threshold: float = 0.7):
    """Names within an edit-distance ratio of the query, over all entity types."""
    s = f"1 - levenshtein(lower(name), '{query}') * 1.0 / greatest(length(name), {len(query)})"
    return f"SELECT id, entity_type, name, round({s}, 6) AS score FROM entity_ WHERE {s} >= {threshold}"


@op
def name_resolution(d: Spark, query: str = "corestdric tusbenpospus"):
    """Exact name first, else the five closest by edit distance."""
    return f"""SELECT id, entity_type, priority FROM (SELECT id, entity_type, priority, min(priority) OVER () AS best, row_number() OVER (PARTITION BY priority ORDER BY dist, id) AS rn FROM (
        SELECT id, entity_type, levenshtein(lower(name), '{query}') AS dist, CASE WHEN lower(name) = '{query}' THEN 0 WHEN levenshtein(lower(name), '{query}') <= 7 THEN 1 ELSE 2 END AS priority FROM entity_ WHERE entity_type <> 'knowledge') z) y WHERE priority = best AND rn <= 5"""


@op
def rank_fusion(d: Spark, word: str = "lantern", k: int = 20):
    """Reciprocal-rank fusion (constant 60) of two rankings of characters: how often their text holds a word, and how
    similar their vector is to that of the character who holds it most often."""
    return f"""WITH c AS (SELECT id, max(composite_text) AS t, max(CASE WHEN {d.size('embedding')} = 384 THEN embedding END) AS v FROM characters GROUP BY id),
        hits AS (SELECT id, n, row_number() OVER (ORDER BY n DESC, id) AS r FROM (SELECT id, (length(t) - length(replace(lower(t), '{word}', ''))) / {len(word)} AS n FROM c WHERE t IS NOT NULL) z WHERE n > 0),
        probe AS (SELECT c.v FROM hits JOIN c ON c.id = hits.id WHERE c.v IS NOT NULL AND {d.dot('c.v', 'c.v')} > 0 ORDER BY hits.r LIMIT 1),
        vec AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT c.id, round({d.cosine('c.v', 'p.v')}, 9) AS s FROM c CROSS JOIN probe p WHERE c.v IS NOT NULL AND {d.dot('c.v', 'c.v')} > 0) z),
        both_ AS (SELECT coalesce(h.id, x.id) AS id, coalesce(1.0 / (60 + h.r), 0) + coalesce(1.0 / (60 + x.r), 0) AS score FROM (SELECT * FROM hits WHERE r <= {2 * k}) h FULL OUTER JOIN (SELECT * FROM vec WHERE r <= {2 * k}) x ON x.id = h.id)
        SELECT id, round(score, 9) AS score FROM (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rn FROM both_) z WHERE rn <= {k}"""


@op
def search_log_latest(d: Spark):
    """Scores of earlier vector searches: the best per pair, absolute, ranked per probe."""
    return """SELECT probe_id, id, score, rank() OVER (PARTITION BY probe_id ORDER BY score DESC) AS place FROM (SELECT probe_id, id, round(max(abs(cast(score AS DOUBLE))), 6) AS score FROM search_results WHERE score IS NOT NULL GROUP BY probe_id, id) z"""


_EMOTIONS = {"anger": ("furious", "jealous"), "fear": ("wary", "suspicious"), "sadness": ("weary", "hollow"), "joy": ("amused", "grateful"), "love": ("tender", "gentle"), "pride": ("proud", "stubborn"), "calm": ("patient", "solemn")}


@op
def emotions(d: Spark):
    """Emotions of each scene by a lexicon: the dominant one and how many are active (share of at least 0.3)."""
    union = " UNION ALL ".join(f"SELECT id, '{e}' AS emotion, " + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) / {len(w)}" for w in ws) + " AS n FROM t" for e, ws in _EMOTIONS.items())
    return f"""WITH t AS (SELECT id, lower(title || ' ' || coalesce(summary, '')) AS t FROM scenes_), hits AS (SELECT id, emotion, n, n * 1.0 / nullif(sum(n) OVER (PARTITION BY id), 0) AS share FROM ({union}) z)
        SELECT id, emotion AS dominant, round(share, 6) AS score, n_active FROM (SELECT id, emotion, share, row_number() OVER (PARTITION BY id ORDER BY share DESC, emotion) AS rn, sum(CASE WHEN share >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS n_active
        FROM hits WHERE share > 0) y WHERE rn = 1"""


# --- reports ----------------------------------------------------------------------------------------


@op
def situation_report(d: Spark):
    """Counts of all that is open in the world, one row per section."""
    return """SELECT 'false beliefs' AS section, count(*) AS n FROM held_ WHERE certainty = 'believes_wrongly' UNION ALL SELECT 'secrets', count(*) FROM (SELECT out_id FROM held_ WHERE certainty = 'knows' GROUP BY out_id HAVING count(*) = 1) s
        UNION ALL SELECT 'strained pairs', count(*) FROM perceives_ WHERE tension >= 7 UNION ALL SELECT 'stale', count(*) FROM characters_ WHERE stale = 1
        UNION ALL SELECT 'recent beliefs', count(*) FROM knows_ k, (SELECT max(created_at) AS now_ FROM knows_) m WHERE k.created_at > m.now_ - INTERVAL 30 DAYS
        UNION ALL SELECT 'earlier beliefs', count(*) FROM knows_ k, (SELECT max(created_at) AS now_ FROM knows_) m WHERE k.created_at <= m.now_ - INTERVAL 30 DAYS AND k.created_at > m.now_ - INTERVAL 60 DAYS"""


@op
def character_dossier(d: Spark):
    """One row per character: ledger, perceptions both ways, relations and scenes."""
    return """SELECT c.id, c.name, coalesce(h.n, 0) AS n_held, coalesce(h.wrong, 0) AS n_wrong, coalesce(p.n, 0) AS n_perceived, coalesce(q.n, 0) AS n_perceiving, round(q.mean, 6) AS tension_about, coalesce(r.n, 0) AS n_relations, coalesce(s.n, 0) AS n_scenes
        FROM characters_ c LEFT JOIN (SELECT in_id, count(*) AS n, sum(CASE WHEN certainty = 'believes_wrongly' THEN 1 ELSE 0 END) AS wrong FROM held_ GROUP BY in_id) h ON h.in_id = c.id
        LEFT JOIN (SELECT in_id, count(*) AS n FROM perceives_ GROUP BY in_id) p ON p.in_id = c.id LEFT JOIN (SELECT out_id, count(*) AS n, avg(tension) AS mean FROM perceives_ GROUP BY out_id) q ON q.out_id = c.id
        LEFT JOIN (SELECT in_id, count(*) AS n FROM relates_ GROUP BY in_id) r ON r.in_id = c.id LEFT JOIN (SELECT in_id, count(*) AS n FROM participates_ GROUP BY in_id) s ON s.in_id = c.id"""


@op
def scene_planning(d: Spark):
    """For all pairs that perceive each other: asymmetric knowledge, tension and shared targets."""
    return """WITH pair AS (SELECT a.in_id AS a, a.out_id AS b, greatest(coalesce(a.tension, 0), coalesce(b.tension, 0)) AS tension FROM perceives_ a JOIN perceives_ b ON b.in_id = a.out_id AND b.out_id = a.in_id WHERE a.in_id < a.out_id),
        known AS (SELECT DISTINCT in_id, out_id FROM held_ WHERE certainty = 'knows'), cnt AS (SELECT in_id, count(*) AS n FROM known GROUP BY in_id),
        both_ AS (SELECT p.a, p.b, count(*) AS n FROM pair p JOIN known x ON x.in_id = p.a JOIN known y ON y.in_id = p.b AND y.out_id = x.out_id GROUP BY p.a, p.b)
        SELECT p.a, p.b, p.tension, coalesce(s.n, 0) AS both_know, coalesce(ca.n, 0) - coalesce(s.n, 0) AS only_a, coalesce(cb.n, 0) - coalesce(s.n, 0) AS only_b FROM pair p
        LEFT JOIN both_ s ON s.a = p.a AND s.b = p.b LEFT JOIN cnt ca ON ca.in_id = p.a LEFT JOIN cnt cb ON cb.in_id = p.b"""


@op
def context_ranking(d: Spark, focus: str = FOCUS):
    """Relevance for a context: linked characters by distance and recency, within a token budget."""
    return f"""WITH near AS (SELECT out_id AS id, 1 AS dist FROM edges_ WHERE in_id = {focus} UNION SELECT in_id, 1 FROM edges_ WHERE out_id = {focus}),
        recent AS (SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) - 1 AS place FROM characters_),
        scored AS (SELECT n.id, round(3.0 / n.dist + 5.0 / (r.place + 1), 6) AS score, {d.tokens('c.composite_text')} AS cost FROM near n JOIN recent r ON r.id = n.id JOIN characters_ c ON c.id = n.id),
        run AS (SELECT id, score, coalesce(cost, 100) AS cost, cast(sum(coalesce(cost, 100)) OVER w AS BIGINT) AS used, row_number() OVER w AS rn FROM scored WINDOW w AS (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT id, score, cost, used FROM run WHERE used <= 4000 AND rn <= 20"""


# --- upkeep -----------------------------------------------------------------------------------------


@op
def debounced_events(d: Spark, gap_us: int = 2_000_000):
    """Regenerations that survive a debounce: none of the same user within two seconds before."""
    return f"""SELECT event_id, user_id FROM (SELECT event_id, user_id, {d.micros('ts')} - {d.micros('lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS since FROM events) z WHERE since IS NULL OR since >= {gap_us}"""


@op
def recently_used(d: Spark, most: int = 100):
    """Most recently used users, newest first, each once."""
    return f"""SELECT user_id, last_us, rn FROM (SELECT user_id, {d.micros('last_ts')} AS last_us, row_number() OVER (ORDER BY last_ts DESC, user_id) AS rn FROM (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id) y) z WHERE rn <= {most}"""


@op
def stale_cascade(d: Spark):
    """Entities whose text must be made anew: stale characters, and whom they are related to."""
    return """SELECT id, min(why) AS why FROM (SELECT id, 0 AS why FROM characters_ WHERE stale = 1 UNION ALL SELECT r.out_id, 1 FROM relates_ r JOIN characters_ c ON c.id = r.in_id WHERE c.stale = 1
        UNION ALL SELECT r.in_id, 1 FROM relates_ r JOIN characters_ c ON c.id = r.out_id WHERE c.stale = 1) z GROUP BY id"""


@op
def location_current(d: Spark):
    """Latest-wins merge of partial updates, field by field (a set field may be set to null)."""
    def newest(f):
        rows = f"""SELECT id, {f} AS x, updated_at, 0 AS r FROM locations UNION ALL SELECT {d.link('location_id', LETTERS)}, {f}, updated_at, 1 FROM location_updates WHERE {d.has('fields_set', f"'{f}'")}"""
        return f"SELECT id, x AS {f} FROM (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, r DESC, coalesce(x, '') DESC) AS rn FROM ({rows}) z) y WHERE rn = 1"
    return f"SELECT n.id, n.name, t.loc_type FROM ({newest('name')}) n JOIN ({newest('loc_type')}) t ON t.id = n.id WHERE n.id IN (SELECT id FROM locations)"


@op
def delete_plan(d: Spark):
    """What deleting each logged entity would do: cascade, reject or unset."""
    return f"""WITH gone AS (SELECT DISTINCT entity_id AS id FROM deletion_log) SELECT g.id, coalesce(k.n, 0) AS cascades_knowledge, coalesce(s.n, 0) AS cascades_scenes, CASE WHEN coalesce(p.n, 0) + coalesce(c.n, 0) > 0 THEN 'rejected' ELSE 'allowed' END AS verdict
        FROM gone g LEFT JOIN (SELECT owner, count(*) AS n FROM knowledge_ GROUP BY owner) k ON k.owner = g.id LEFT JOIN (SELECT event, count(*) AS n FROM scenes_ GROUP BY event) s ON s.event = g.id
        LEFT JOIN (SELECT location, count(*) AS n FROM scenes_ GROUP BY location) p ON p.location = g.id LEFT JOIN (SELECT parent, count(*) AS n FROM locations_ GROUP BY parent) c ON c.parent = g.id"""
