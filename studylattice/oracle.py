"""DuckDB SQL with the same results as the queries of the registry.

Written from the definitions, in the plainest form: windows over whole groups, self joins and
subset enumeration, which the Spark side avoids.
"""

from __future__ import annotations

from studylattice import constants as K
from studylattice.plans import forests, lloyd
from studylattice.registry import SHOWN_DIGITS


def _round(x: str, digits: int) -> str:
    scale = f"1e{digits}"
    return f"(round_even(({x}) * {scale}, 0) / {scale} + CAST(0 AS DOUBLE))"


def _settled(x: str) -> str:
    return _round(x, 9)


def _case(column: str, table, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in table.items())
    return f"CASE {arms} ELSE {default} END"


def _level(code: str) -> str:
    return f"CASE {code} WHEN 0 THEN 'Easy' WHEN 1 THEN 'Intermediate' ELSE 'Hard' END"


_PERCENT = "CAST(score AS DOUBLE) / NULLIF(CAST(total AS DOUBLE), 0) * 100"
_RANK = _case("difficulty", K.LEVEL_RANK, "2")
_FACTOR = "CAST(" + _case("difficulty", K.GAP_FACTOR, "1.0") + " AS DOUBLE)"
_IDEAL = "CASE WHEN {p} IS NULL THEN NULL WHEN {p} >= 90 THEN 7 WHEN {p} >= 75 THEN 5 WHEN {p} >= 60 THEN 3 ELSE 2 END"

# Named building blocks; a query lists the ones it needs, in order.
_BLOCKS: dict[str, str] = {
    "attempts": f"""
        SELECT event_id % 31 * 1125899906842624 + event_id // 31 AS log_pos, ts AS attempt_ts, user_id,
          CASE event_type WHEN 'click' THEN 'Maths' WHEN 'view' THEN 'Science' WHEN 'purchase' THEN 'Social Studies'
            WHEN 'signup' THEN 'English' ELSE 'Other' END AS subject,
          {_level('k % 3')} AS difficulty,
          CAST((k // 3) % 6 AS INTEGER) AS score, 5 AS total, 'events' AS dataset,
          value / CAST(10 AS DOUBLE) AS time_spent_mins
        FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events)""",
    "numbered": """
        SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY user_id, subject ORDER BY log_pos) AS INTEGER) AS attempt_no
        FROM attempts""",
    "weights": """
        SELECT subject, difficulty, passes, fails,
          LN(base) + passes * LN(CAST(1.05 AS DOUBLE)) + fails * LN(CAST(0.95 AS DOUBLE)) AS ln_weight
        FROM (
          SELECT s.subject, d.difficulty, d.base,
            COUNT(*) FILTER (a.total > 0 AND CAST(a.score AS DOUBLE) / a.total >= CAST(0.6 AS DOUBLE)) AS passes,
            COUNT(*) FILTER (a.log_pos IS NOT NULL
              AND NOT COALESCE(a.total > 0 AND CAST(a.score AS DOUBLE) / a.total >= CAST(0.6 AS DOUBLE), FALSE)) AS fails
          FROM (VALUES ('Maths'), ('Science'), ('Social Studies'), ('English')) s(subject)
          CROSS JOIN (VALUES ('Easy', CAST(1.0 AS DOUBLE)), ('Intermediate', CAST(1.3 AS DOUBLE)), ('Hard', CAST(1.6 AS DOUBLE))) d(difficulty, base)
          LEFT JOIN attempts a ON a.subject = s.subject AND a.difficulty = d.difficulty
          GROUP BY s.subject, d.difficulty, d.base)""",
    "weighted": """
        SELECT a.*, COALESCE(ln_weight, 0) AS lw,
          CASE WHEN score > 0 THEN LN(CAST(score AS DOUBLE)) + COALESCE(ln_weight, 0) END AS ln_score
        FROM attempts a LEFT JOIN weights w ON a.subject = w.subject AND a.difficulty = w.difficulty""",
    "best": """
        SELECT subject, user_id, MAX(ln_score) AS ln_best, COUNT(score) AS attempts
        FROM weighted GROUP BY subject, user_id""",
    "progress": f"""
        SELECT subject, user_id, COUNT(*) AS attempts,
          {_round(_settled('''LEAST(100, GREATEST(-100,
             SUM(CASE WHEN rn = n THEN pct ELSE 0 END) - SUM(CASE WHEN rn = 1 THEN pct ELSE 0 END)))'''), 2)} AS progress_percent
        FROM (SELECT subject, user_id, CAST(score AS DOUBLE) / GREATEST(total, 1) * EXP(lw) * 100 AS pct,
            ROW_NUMBER() OVER (PARTITION BY subject, user_id ORDER BY log_pos) AS rn,
            COUNT(*) OVER (PARTITION BY subject, user_id) AS n
          FROM weighted)
        WHERE n > 1 GROUP BY subject, user_id""",
    "timed": f"""
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, subject ORDER BY attempt_ts, log_pos) - 1 AS i,
          COUNT(*) OVER (PARTITION BY user_id, subject) AS n, score * {_FACTOR} AS ws, {_RANK} AS level_rank
        FROM attempts""",
    "forecast": f"""
        SELECT *, LEAST(5, GREATEST(0, CAST(round_even({_settled('weighted_avg + slope')}, 0) AS INTEGER))) AS predicted,
          CASE WHEN slope > 0.1 THEN 'Improving' WHEN slope < -0.1 THEN 'Declining' ELSE 'Stable' END AS trend
        FROM (
          SELECT user_id, subject, COUNT(*) AS attempts,
            SUM(ws * (1 + CAST(i AS DOUBLE) / GREATEST(n - 1, 1))) / SUM(1 + CAST(i AS DOUBLE) / GREATEST(n - 1, 1)) AS weighted_avg,
            {_settled('CASE WHEN COUNT(*) < 2 THEN 0 ELSE regr_slope(ws, i) END')} AS slope,
            AVG(score) AS mean_score, AVG(level_rank) AS mean_level,
            MAX(CASE WHEN i = n - 1 THEN level_rank END) AS last_level, MIN(log_pos) AS first_pos
          FROM timed GROUP BY user_id, subject)""",
    "micro": f"""
        SELECT user_id, subject, AVG(score) AS recent_avg,
          {_settled('CASE WHEN COUNT(*) < 2 THEN 0 ELSE regr_slope(score, i) END')} AS micro_slope
        FROM timed WHERE i >= n - 3 GROUP BY user_id, subject""",
    "targets": """
        SELECT user_id, subject, difficulty FROM (SELECT DISTINCT user_id, subject FROM attempts)
          CROSS JOIN (VALUES ('Easy'), ('Intermediate'), ('Hard')) d(difficulty)
        UNION SELECT DISTINCT user_id, subject, difficulty FROM attempts""",
    "modes": """
        SELECT t.*, NOT EXISTS (SELECT 1 FROM attempts a WHERE a.user_id = t.user_id AND a.subject = t.subject
            AND a.difficulty = t.difficulty) AS is_prediction_mode
        FROM targets t""",
    "training": f"""
        SELECT m.user_id, m.subject, m.difficulty, m.is_prediction_mode, a.difficulty AS taken_at, a.log_pos,
          a.attempt_ts, a.score, a.total, a.time_spent_mins, {_PERCENT} AS pct
        FROM modes m JOIN attempts a ON a.user_id = m.user_id AND a.subject = m.subject
          AND (m.is_prediction_mode OR a.difficulty = m.difficulty)""",
    "summary": """
        SELECT *, CASE WHEN avg_percent IS NULL THEN NULL WHEN avg_percent >= 80 THEN 'Excellent'
            WHEN avg_percent >= 60 THEN 'Good' ELSE 'Needs Practice' END AS performance
        FROM (SELECT user_id, subject, difficulty, is_prediction_mode, AVG(pct) AS avg_percent, COUNT(*) AS attempts,
            AVG(time_spent_mins) AS avg_minutes
          FROM training GROUP BY user_id, subject, difficulty, is_prediction_mode)""",
    "plan_base": f"""
        SELECT user_id, subject, difficulty, is_prediction_mode,
          {_IDEAL.format(p=_settled("pct"))} AS base
        FROM (
          SELECT user_id, subject, difficulty, is_prediction_mode, arg_max(pct, log_pos) AS pct
          FROM training WHERE NOT is_prediction_mode GROUP BY user_id, subject, difficulty, is_prediction_mode
          UNION ALL
          SELECT user_id, subject, difficulty, TRUE, AVG(level_pct) FROM (
            SELECT user_id, subject, difficulty, taken_at, AVG(pct) AS level_pct
            FROM training WHERE is_prediction_mode GROUP BY user_id, subject, difficulty, taken_at)
          GROUP BY user_id, subject, difficulty)""",
    "revision": """
        SELECT *, CAST(14 AS DOUBLE) / sessions AS interval_days
        FROM (SELECT *, CAST(GREATEST(2, TRUNC(CAST(14 AS DOUBLE) / base)) AS INTEGER) AS sessions FROM plan_base)""",
    "sessions_out": """
        SELECT user_id, subject, difficulty, CAST(i + 1 AS INTEGER) AS session,
          strftime(moment, '%Y-%m-%d') AS date, strftime(moment, '%A') AS day,
          CAST(TRUNC(CAST(14 AS DOUBLE) - i * interval_days) AS INTEGER) AS days_until_quiz
        FROM (SELECT *, TIMESTAMP '2025-01-01 09:00:00'
              + to_microseconds(CAST(round_even(i * interval_days * 86400e6, 0) AS BIGINT)) AS moment
          FROM (SELECT *, UNNEST(range(sessions)) AS i FROM revision))""",
    "profiles": f"""
        SELECT user_id, AVG({_PERCENT}) AS avg_score, COUNT({_PERCENT}) AS attempts,
          AVG({_case('LOWER(TRIM(difficulty))', {k.lower(): v for k, v in K.LEVEL_RANK.items()})}) AS avg_difficulty
        FROM attempts GROUP BY user_id""",
    "questions": f"""
        SELECT p_partkey AS question_id, UPPER(SUBSTR(p_type, 1, 1)) || LOWER(SUBSTR(p_type, 2)) AS subject,
          {_level('p_size % 3')} AS difficulty, p_name AS question, p_brand AS answer,
          'Brand#' || ((b - 1) % 25 + 1) || '|Brand#' || ((b + 6) % 25 + 1) || '|Brand#' || ((b + 10) % 25 + 1)
            || '|Brand#' || ((b + 17) % 25 + 1) AS options
        FROM (SELECT *, CAST(regexp_extract(p_brand, '[0-9]+', 0) AS INTEGER) AS b FROM part)""",
    "graded": """
        SELECT l_orderkey AS session_id,
          CAST(COUNT(*) FILTER ((CASE WHEN l_returnflag = 'A' THEN p_brand ELSE 'Brand#' || (l_suppkey % 25 + 1) END) = p_brand) AS INTEGER) AS score,
          CAST(COUNT(*) AS INTEGER) AS total
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "fresh": f"""
        SELECT o_orderkey AS log_pos, date_trunc('second', finished_at) AS attempt_ts, o_custkey AS user_id,
          CASE SUBSTR(o_orderpriority, 1, 1) WHEN '1' THEN 'Maths' WHEN '2' THEN 'Science' WHEN '3' THEN 'Social Studies'
            WHEN '4' THEN 'English' ELSE 'Other' END AS subject,
          {_level('o_orderkey % 3')} AS difficulty, score, total, 'part.parquet' AS dataset,
          {_round(_settled("date_diff('microsecond', o_orderdate, finished_at) / 1e6 / 60"), 2)} AS time_spent_mins
        FROM (SELECT *, o_orderdate + to_microseconds(CAST(ROUND(o_totalprice * 10000) AS BIGINT)) AS finished_at FROM orders)
          JOIN graded ON o_orderkey = session_id""",
    "assignments": """
        SELECT l_orderkey AS course_id,
          ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos,
          'A' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS assignment_name, l_quantity AS weight,
          CASE WHEN l_linestatus = 'F' THEN CAST(100 AS DOUBLE) - CAST(500 AS DOUBLE) * l_discount END AS grade,
          CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'R' THEN CAST(1 AS DOUBLE) + CAST(100 AS DOUBLE) * l_tax END AS study_hours,
          l_linestatus = 'F' AS completed
        FROM lineitem""",
    "courses": """
        SELECT o_orderkey AS course_id, o_custkey AS user_id, CAST(3 AS DOUBLE) AS credits,
          CAST(60 + 8 * CAST(SUBSTR(o_orderpriority, 1, 1) AS INTEGER) AS DOUBLE) AS target,
          CAST(1 + o_custkey % 40 AS DOUBLE) AS available_hours
        FROM orders""",
    "sums": """
        SELECT course_id, COALESCE(SUM(weight / 100 * grade) FILTER (completed), 0) AS earned,
          COALESCE(SUM(weight) FILTER (completed), CAST(0 AS DOUBLE)) AS completed_weight,
          COALESCE(SUM(weight) FILTER (NOT completed), CAST(0 AS DOUBLE)) AS remaining_weight
        FROM assignments GROUP BY course_id""",
    "grades": """
        SELECT *, CASE WHEN completed_weight < 100 THEN current_grade ELSE projected_grade END AS display_grade
        FROM (SELECT course_id, completed_weight,
            CASE WHEN completed_weight > 0 THEN earned / (completed_weight / 100) ELSE CAST(0 AS DOUBLE) END AS current_grade,
            CASE WHEN completed_weight + remaining_weight = 0 THEN CAST(0 AS DOUBLE) ELSE earned END AS projected_grade
          FROM sums)""",
    "letters": f"""
        SELECT user_id, g.course_id, credits, display_grade, letter, grade_points
        FROM grades g JOIN courses c ON g.course_id = c.course_id
          JOIN (SELECT *, LEAD(min_grade, -1) OVER (ORDER BY min_grade DESC) AS next_grade
                FROM (VALUES {", ".join(f"('{a}', CAST({b} AS DOUBLE), CAST({c} AS DOUBLE))" for a, b, c in K.GPA_SCALE)})
                  s(letter, min_grade, grade_points)) s
          ON {_settled('display_grade')} >= min_grade AND (next_grade IS NULL OR {_settled('display_grade')} < next_grade)
        WHERE completed_weight > 0""",
    "items": """
        SELECT l_orderkey AS request_id,
          ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos,
          'Subject ' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS name,
          CAST(l_partkey % 5 + 1 AS INTEGER) AS priority, CAST(l_suppkey % 5 + 1 AS INTEGER) AS difficulty_level,
          CAST((l_linenumber % 4) * 0.5 AS DOUBLE) AS min_hours, CAST(2 + l_orderkey % 9 AS DOUBLE) AS total_hours
        FROM lineitem""",
    "softmax": f"""
        SELECT request_id, pos, name, priority, total_hours,
          round_even({_settled("2 * (min_hours + (total_hours - needed) * EXP(priority) / mass)")}, 0) / 2 AS hours
        FROM (SELECT *, SUM(min_hours) OVER (PARTITION BY request_id) AS needed,
            SUM(EXP(priority)) OVER (PARTITION BY request_id) AS mass FROM items)
        WHERE needed <= total_hours""",
    "balanced": f"""
        SELECT request_id, pos, name, priority, total_hours,
          round_even({_settled("2 * (min_hours + (total_hours - needed) * EXP(mix) / mass)")}, 0) / 2 AS hours
        FROM (SELECT *, SUM(min_hours) OVER (PARTITION BY request_id) AS needed,
            SUM(EXP(mix)) OVER (PARTITION BY request_id) AS mass
          FROM (SELECT *, CAST(2 AS DOUBLE) * (CAST(0.6 AS DOUBLE) * (priority / 5.0) + CAST(0.4 AS DOUBLE) * (difficulty_level / 5.0)) AS mix FROM items))
        WHERE needed <= total_hours""",
    "requests": """
        SELECT request_id, COUNT(*) AS n, MAX(priority) AS highest, MAX(total_hours) AS total_hours
        FROM items GROUP BY request_id""",
    "subsets": """
        SELECT m.request_id, m.mask, m.highest, COUNT(*) AS k, SUM(priority) AS points, MAX(min_hours / priority) AS demand,
          MIN(CASE WHEN min_hours > 0 THEN FLOOR(ROUND(i.total_hours * priority / min_hours, 9)) ELSE CAST('Infinity' AS DOUBLE) END) AS budget,
          COUNT(*) FILTER (priority = 5) AS c5, COUNT(*) FILTER (priority = 4) AS c4, COUNT(*) FILTER (priority = 3) AS c3,
          COUNT(*) FILTER (priority = 2) AS c2, COUNT(*) FILTER (priority = 1) AS c1
        FROM (SELECT request_id, highest, UNNEST(range(1, CAST(pow(2, n) AS BIGINT))) AS mask FROM requests) m
          JOIN items i ON i.request_id = m.request_id AND (m.mask >> i.pos) & 1 = 1
        GROUP BY m.request_id, m.mask, m.highest""",
    "chosen": """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY request_id
            ORDER BY k DESC, LEAST(points, highest) DESC, demand, points, c5, c4, c3, c2, c1, mask) AS choice
        FROM subsets WHERE budget >= GREATEST(points, highest)""",
    "proportional": f"""
        SELECT i.request_id, i.pos, i.name, i.priority, i.total_hours,
          round_even({_settled("2 * (priority * (i.total_hours / GREATEST(points, highest)))")}, 0) / 2 AS hours
        FROM chosen c JOIN items i ON i.request_id = c.request_id AND (c.mask >> i.pos) & 1 = 1
        WHERE choice = 1""",
}

_FEATURES = ("avg_score", "attempts", "avg_difficulty")
_LOW_K, _HIGH_K = K.CLUSTER_RANGE


def _away(p: str, c: str) -> str:
    return f"(({p}.x - {c}.x) * ({p}.x - {c}.x) + ({p}.y - {c}.y) * ({p}.y - {c}.y) + ({p}.z - {c}.z) * ({p}.z - {c}.z))"


# k-means the plain way: every place with every centre of every model, step by step.
_BLOCKS |= {
    "points": "SELECT user_id, "
    + ", ".join(
        f"CAST(round_even(({c} - AVG({c}) OVER ()) / COALESCE(NULLIF(stddev_pop({c}) OVER (), 0), 1) * 1e6, 0) AS BIGINT) AS {axis}"
        for c, axis in zip(_FEATURES, "xyz")
    )
    + " FROM profiles QUALIFY x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL",
    "places": "SELECT x, y, z, COUNT(*) AS w FROM points GROUP BY x, y, z",
    "starts": f"""
        SELECT k, restart, place - 1 AS c, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY restart
            ORDER BY md5('{K.MODEL_SEED}:' || restart || ':' || x || ':' || y || ':' || z), x, y, z) AS place
          FROM places, (SELECT UNNEST(range({K.CLUSTER_RESTARTS})) AS restart)),
          (SELECT UNNEST(range({_LOW_K}, {_HIGH_K + 1})) AS k)
        WHERE place <= k AND k <= (SELECT COUNT(*) FROM places) AND k < (SELECT COUNT(*) FROM points)""",
    "fit": f"""
        SELECT 0 AS step, k, restart, c, x, y, z, FALSE AS done FROM starts
        UNION ALL
        SELECT step + 1, k, restart, c, nx, ny, nz, SUM(shift) OVER (PARTITION BY k, restart) <= 1e8 FROM (
          SELECT f.step, f.k, f.restart, f.c, COALESCE(s.x, f.x) AS nx, COALESCE(s.y, f.y) AS ny, COALESCE(s.z, f.z) AS nz,
            COALESCE({_away("s", "f")}, 0) AS shift
          FROM fit f LEFT JOIN (
            SELECT k, restart, near.c AS c, SUM(w * x)::DOUBLE / SUM(w)::DOUBLE AS x, SUM(w * y)::DOUBLE / SUM(w)::DOUBLE AS y,
              SUM(w * z)::DOUBLE / SUM(w)::DOUBLE AS z
            FROM (SELECT g.k, g.restart, p.x, p.y, p.z, p.w, MIN({{'d': {_away("p", "g")}, 'c': g.c}}) AS near
              FROM places p, fit g WHERE NOT g.done GROUP BY g.k, g.restart, p.x, p.y, p.z, p.w)
            GROUP BY k, restart, near.c) s ON s.k = f.k AND s.restart = f.restart AND s.c = f.c
          WHERE NOT f.done AND f.step < {lloyd.MOST_STEPS})""",
    "centres": "SELECT k, restart, c, arg_max(x, step) AS x, arg_max(y, step) AS y, arg_max(z, step) AS z FROM fit GROUP BY k, restart, c",
    "nearest": f"""
        SELECT k, restart, x, y, z, w, near.c AS c, CAST(floor(near.d) AS HUGEINT) AS d
        FROM (SELECT g.k, g.restart, p.x, p.y, p.z, p.w, MIN({{'d': {_away("p", "g")}, 'c': g.c}}) AS near
          FROM places p, centres g GROUP BY g.k, g.restart, p.x, p.y, p.z, p.w)""",
    "cheapest": """
        SELECT k, restart FROM (SELECT k, restart, SUM(w * d) AS cost FROM nearest GROUP BY k, restart)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY cost, restart) = 1""",
    "placed": "SELECT n.* FROM nearest n JOIN cheapest USING (k, restart)",
    "between": f"""
        SELECT a.k, a.x, a.y, a.z, a.w, a.c, b.c AS other, SUM(b.w * CAST({_away("a", "b")} AS DOUBLE)) AS far, SUM(b.w) AS n
        FROM placed a JOIN placed b ON a.k = b.k GROUP BY a.k, a.x, a.y, a.z, a.w, a.c, b.c""",
    "silhouettes": """
        SELECT k, SUM(w * CASE WHEN own_n > 1 AND GREATEST(inside, outside) > 0 THEN (outside - inside) / GREATEST(inside, outside) ELSE 0 END) / SUM(w) AS silhouette
        FROM (SELECT k, x, y, z, w, MAX(n) FILTER (other = c) AS own_n, MAX(far / NULLIF(n - 1, 0)) FILTER (other = c) AS inside,
            MIN(far / n) FILTER (other <> c) AS outside FROM between GROUP BY k, x, y, z, w)
        GROUP BY k HAVING COUNT(outside) > 0""",
    "group_letters": """
        SELECT k, c, chr(CAST(64 + ROW_NUMBER() OVER (PARTITION BY k ORDER BY mx DESC, my, mz) AS INTEGER)) AS study_group
        FROM (SELECT k, c, SUM(w * x)::DOUBLE / SUM(w)::DOUBLE AS mx, SUM(w * y)::DOUBLE / SUM(w)::DOUBLE AS my,
          SUM(w * z)::DOUBLE / SUM(w)::DOUBLE AS mz FROM placed GROUP BY k, c)""",
    "student_groups": """
        SELECT p.user_id, study_group FROM profiles p LEFT JOIN (SELECT q.user_id, l.study_group
          FROM points q JOIN placed n ON n.x = q.x AND n.y = q.y AND n.z = q.z
          JOIN group_letters l ON l.k = n.k AND l.c = n.c
          WHERE n.k = (SELECT k FROM silhouettes ORDER BY ROUND(silhouette, 9) DESC, k LIMIT 1)) USING (user_id)""",
}


def _mixed(x: str, factor: int) -> str:
    return f"CAST(CAST({x} AS UHUGEINT) * {factor} % 18446744073709551616 AS UBIGINT)"


_DRAW_0 = f"CAST((CAST(id AS UHUGEINT) * {forests.MULTIPLIERS[0]} + CAST(tree AS UHUGEINT) * {forests.MULTIPLIERS[1]} + {K.MODEL_SEED}) % 18446744073709551616 AS UBIGINT)"
_ROW = "user_id, subject, level"

# A forest for every target the plain way: all cuts of all nodes, one level after the other.
_BLOCKS |= {
    "lacking": """
        SELECT user_id, subject, COUNT(DISTINCT difficulty) AS levels FROM numbered WHERE difficulty IS NOT NULL
        GROUP BY user_id, subject HAVING COUNT(DISTINCT difficulty) FILTER (difficulty IN ('Easy', 'Intermediate', 'Hard')) < 3""",
    "learned": f"""
        SELECT user_id, subject, difficulty AS level, log_pos AS id, {_PERCENT} AS x0, CAST(attempt_no AS DOUBLE) AS x1,
          CAST(time_spent_mins AS DOUBLE) AS x2, CAST(0 AS DOUBLE) AS x3, CAST({_IDEAL.format(p="(" + _PERCENT + ")")} AS DOUBLE) AS y
        FROM numbered WHERE difficulty IS NOT NULL
        UNION ALL
        SELECT user_id, subject, '', log_pos, {_PERCENT}, attempt_no, time_spent_mins,
          DENSE_RANK() OVER (PARTITION BY user_id, subject ORDER BY difficulty) - 1, {_IDEAL.format(p="(" + _PERCENT + ")")}
        FROM numbered SEMI JOIN lacking USING (user_id, subject) WHERE difficulty IS NOT NULL""",
    "asked": f"""
        SELECT user_id, subject, difficulty AS level, arg_max({_PERCENT}, log_pos) AS q0, CAST(MAX(attempt_no) AS DOUBLE) AS q1,
          CAST(arg_max(time_spent_mins, log_pos) AS DOUBLE) AS q2, CAST(0 AS DOUBLE) AS q3
        FROM numbered WHERE difficulty IS NOT NULL GROUP BY user_id, subject, difficulty
        UNION ALL
        SELECT user_id, subject, '', AVG(p), AVG(a), AVG(t), CAST(MAX(levels) // 2 AS DOUBLE)
        FROM (SELECT user_id, subject, difficulty, AVG({_PERCENT}) AS p, MAX(attempt_no) AS a, AVG(time_spent_mins) AS t
          FROM numbered WHERE difficulty IS NOT NULL GROUP BY user_id, subject, difficulty) JOIN lacking USING (user_id, subject)
        GROUP BY user_id, subject""",
    "drawn": f"""
        SELECT * EXCLUDE (h), len(list_filter([{", ".join(f"CAST({p!r} AS DOUBLE)" for p in forests.POISSON)}],
            lambda p: p <= CAST(h >> 11 AS DOUBLE) / 9007199254740992)) AS w
        FROM (SELECT * REPLACE (xor(h, h >> 31) AS h) FROM (
          SELECT * REPLACE ({_mixed("xor(h, h >> 27)", 0x94D049BB133111EB)} AS h) FROM (
          SELECT * REPLACE ({_mixed("xor(h, h >> 30)", 0xBF58476D1CE4E5B9)} AS h) FROM (
          SELECT l.*, tree, {_DRAW_0} AS h FROM learned l, (SELECT UNNEST(range({K.FOREST_TREES})) AS tree)
          WHERE x0 IS NOT NULL AND x2 IS NOT NULL))))""",
    "grown": f"""
        SELECT 0 AS depth, {_ROW}, tree, x0, x1, x2, x3, y, CAST(w AS DOUBLE) AS w, q0, q1, q2, q3
        FROM drawn JOIN asked USING ({_ROW}) WHERE w > 0
        UNION ALL
        SELECT e.depth + 1, {", ".join("e." + c for c in _ROW.split(", "))}, e.tree, x0, x1, x2, x3, y, w, q0, q1, q2, q3
        FROM grown e JOIN (
          SELECT {_ROW}, tree, arg_min({{'f': f, 'cut': (v + higher) / 2}}, {{'s': -(lt * lt / lw + (t - lt) * (t - lt) / (n - lw)), 'f': f, 'v': v}}) AS best
          FROM (SELECT {_ROW}, tree, f, v, LEAD(v) OVER along AS higher, SUM(w) OVER along AS lw, SUM(wy) OVER along AS lt,
              SUM(w) OVER whole AS n, SUM(wy) OVER whole AS t, MIN(low) OVER whole AS low, MAX(high) OVER whole AS high
            FROM (SELECT {_ROW}, tree, f, v, SUM(w) AS w, SUM(w * y) AS wy, MIN(y) AS low, MAX(y) AS high
              FROM (SELECT {_ROW}, tree, y, w, UNNEST([0, 1, 2, 3]) AS f, UNNEST([x0, x1, x2, x3]) AS v FROM grown)
              GROUP BY {_ROW}, tree, f, v)
            WINDOW along AS (PARTITION BY {_ROW}, tree, f ORDER BY v), whole AS (PARTITION BY {_ROW}, tree, f))
          WHERE higher IS NOT NULL AND low < high GROUP BY {_ROW}, tree) b
          ON b.user_id = e.user_id AND b.subject = e.subject AND b.level = e.level AND b.tree = e.tree
        WHERE ([x0, x1, x2, x3][best.f + 1] <= best.cut) = ([q0, q1, q2, q3][best.f + 1] <= best.cut)""",
    "intervals": f"""
        SELECT {_ROW}, {_settled("AVG(leaf)")} AS base FROM (
          SELECT {_ROW}, tree, SUM(w * y) / SUM(w) AS leaf
          FROM (SELECT * FROM grown QUALIFY depth = MAX(depth) OVER (PARTITION BY {_ROW}, tree)) GROUP BY {_ROW}, tree)
        GROUP BY {_ROW}""",
    "model_base": """
        SELECT m.user_id, m.subject, m.difficulty, is_prediction_mode, base FROM modes m LEFT JOIN intervals i
          ON i.user_id = m.user_id AND i.subject = m.subject AND i.level = CASE WHEN is_prediction_mode THEN '' ELSE m.difficulty END""",
}

_LOG = ("attempts", "weights", "weighted")
_TARGETS = ("attempts", "targets", "modes", "training")
_REVISION = (*_TARGETS, "plan_base", "revision")
_MODEL = ("attempts", "numbered", "targets", "modes", "lacking", "learned", "asked", "drawn", "grown", "intervals", "model_base")
_COURSES = ("assignments", "courses")
_CLUSTERS = ("attempts", "profiles", "points", "places", "starts", "fit", "centres", "nearest", "cheapest", "placed", "between", "silhouettes")
_GROUPS = (*_CLUSTERS, "group_letters", "student_groups")
_PROPORTIONAL = ("items", "requests", "subsets", "chosen", "proportional")

SQL: dict[str, str] = {}


def _add(name: str, blocks, select: str, doubles: tuple[str, ...] = ()) -> None:
    body = select
    if doubles:
        shown = ", ".join(f"{_round(f'CAST({c} AS DOUBLE)', SHOWN_DIGITS)} AS {c}" for c in doubles)
        body = f"SELECT * REPLACE ({shown}) FROM ({select})"
    ctes = ",\n".join(f"{b} AS ({_BLOCKS[b]})" for b in blocks)
    recursive = "RECURSIVE " if {"fit", "grown"} & set(blocks) else ""
    SQL[name] = f"WITH {recursive}{ctes}\n{body}" if blocks else body


_add("attempts_scan", ("attempts",), "SELECT * FROM attempts", ("time_spent_mins",))
_add("attempts_csv_scan", ("attempts", "numbered"), "SELECT * FROM numbered", ("time_spent_mins",))
_add("attempts_filter", ("attempts",), "SELECT * FROM attempts WHERE subject = 'Maths' AND difficulty = 'Hard'", ("time_spent_mins",))
_add("attempt_numbering", ("attempts", "numbered"), "SELECT log_pos, user_id, subject, attempt_no FROM numbered")
_add(
    "filter_domains",
    ("attempts",),
    """SELECT DISTINCT 'user' AS domain, CAST(user_id AS VARCHAR) AS value FROM attempts
       UNION SELECT DISTINCT 'subject', subject FROM attempts UNION SELECT DISTINCT 'difficulty', difficulty FROM attempts""",
)
_add("question_bank_scan", ("questions",), "SELECT * FROM questions")
_add("question_bank_csv_scan", ("questions",), "SELECT * EXCLUDE (question_id) FROM questions")
_add("question_bank_counts", ("questions",), "SELECT subject, difficulty, COUNT(*) AS questions FROM questions GROUP BY subject, difficulty")
_add(
    "quiz_sample",
    ("questions",),
    f"""SELECT * FROM (SELECT subject, difficulty, ROW_NUMBER() OVER (PARTITION BY subject, difficulty
          ORDER BY md5(question_id || ':{K.MODEL_SEED}'), question_id) AS place, question_id, question FROM questions)
        WHERE place <= 5""",
)
_add("grade_responses", ("graded",), "SELECT * FROM graded")
_add(
    "log_attempts",
    ("attempts", "graded", "fresh"),
    """SELECT f.*, CAST(COALESCE(n, 0) + ROW_NUMBER() OVER (PARTITION BY f.user_id, f.subject ORDER BY f.log_pos) AS INTEGER) AS attempt_no
       FROM fresh f LEFT JOIN (SELECT user_id, subject, COUNT(*) AS n FROM attempts GROUP BY user_id, subject) a
         ON a.user_id = f.user_id AND a.subject = f.subject""",
    ("time_spent_mins",),
)
_add(
    "combine_logs",
    ("attempts", "graded", "fresh"),
    """SELECT * FROM attempts UNION ALL BY NAME
       SELECT * REPLACE (log_pos + (SELECT MAX(log_pos) + 1 FROM attempts) AS log_pos) FROM fresh""",
    ("time_spent_mins",),
)

_add("difficulty_weights", ("attempts", "weights"), "SELECT *, EXP(ln_weight) AS weight FROM weights", ("ln_weight", "weight"))
_add(
    "weighted_score",
    _LOG,
    "SELECT log_pos, user_id, subject, difficulty, score, score * EXP(lw) AS weighted_score FROM weighted",
    ("weighted_score",),
)
_SUBJECT_BOARD = f"""SELECT subject, ROW_NUMBER() OVER (PARTITION BY subject ORDER BY {_settled('ln_best')} DESC NULLS LAST, user_id) AS rank,
    user_id, COALESCE(EXP(ln_best), 0) AS weighted_score, ln_best AS ln_weighted_score, attempts FROM best"""
for _name in ("subject_leaderboard", "attempts_stream"):
    _add(_name, (*_LOG, "best"), _SUBJECT_BOARD, ("weighted_score", "ln_weighted_score"))
_add(
    "overall_leaderboard",
    (*_LOG, "best"),
    f"""SELECT ROW_NUMBER() OVER (ORDER BY {_settled('LN(mean)')} DESC NULLS LAST, user_id) AS rank, user_id,
          COALESCE(mean, 0) AS average_best_score, LN(mean) AS ln_average_best_score, attempts
        FROM (SELECT user_id, SUM(EXP(ln_best)) / COUNT(*) AS mean, CAST(SUM(attempts) AS BIGINT) AS attempts
          FROM best GROUP BY user_id)""",
    ("average_best_score", "ln_average_best_score"),
)
_add(
    "progress_leaderboard",
    (*_LOG, "progress"),
    """SELECT subject, ROW_NUMBER() OVER (PARTITION BY subject ORDER BY progress_percent DESC, user_id) AS rank,
         user_id, progress_percent, attempts FROM progress""",
    ("progress_percent",),
)
_add(
    "top_improved",
    (*_LOG, "progress"),
    """SELECT subject, rank, user_id, progress_percent,
         ABS(progress_percent) / GREATEST(MAX(ABS(progress_percent)) OVER (PARTITION BY subject), 1) * 100 AS bar_width,
         progress_percent > 0 AS improved
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY subject ORDER BY progress_percent DESC, user_id) AS rank FROM progress)
       WHERE rank <= 10""",
    ("progress_percent", "bar_width"),
)
_add(
    "platform_kpis",
    ("attempts",),
    "SELECT COUNT(DISTINCT user_id) AS users, COUNT(*) AS attempts, COUNT(DISTINCT subject) AS subjects, AVG(score) AS mean_score FROM attempts",
    ("mean_score",),
)
_add(
    "subject_participation",
    ("attempts",),
    """SELECT subject, participants, participants * CAST(100 AS DOUBLE) / MAX(participants) OVER () AS share
       FROM (SELECT subject, COUNT(DISTINCT user_id) AS participants FROM attempts GROUP BY subject)""",
    ("share",),
)
_add(
    "difficulty_distribution",
    ("attempts",),
    """SELECT d.difficulty, COUNT(a.log_pos) AS attempts,
         COUNT(a.log_pos) * CAST(100 AS DOUBLE) / (SELECT COUNT(difficulty) FROM attempts) AS share
       FROM (VALUES ('Easy'), ('Intermediate'), ('Hard')) d(difficulty) LEFT JOIN attempts a ON a.difficulty = d.difficulty
       GROUP BY d.difficulty""",
    ("share",),
)

_add(
    "gap_weighted_score",
    ("attempts",),
    f"SELECT log_pos, user_id, subject, difficulty, score * {_FACTOR} AS weighted_score FROM attempts",
    ("weighted_score",),
)
_add(
    "gap_forecast",
    ("attempts", "timed", "forecast"),
    "SELECT user_id, subject, attempts, weighted_avg, slope, predicted, trend FROM forecast",
    ("weighted_avg", "slope"),
)
_add("gap_micro_trend", ("attempts", "timed", "micro"), "SELECT * FROM micro", ("recent_avg", "micro_slope"))
_add(
    "gap_reason",
    ("attempts", "timed", "forecast", "micro"),
    """SELECT f.user_id, f.subject, trend,
         CASE WHEN slope > 0.1 THEN 'IMPROVING' WHEN slope < -0.1 THEN 'DIPPED'
           WHEN micro_slope > 0.05 AND mean_score < 3 THEN 'STABLE_UP' WHEN mean_score < 2 THEN 'STABLE_LOW'
           WHEN recent_avg <= mean_score AND mean_score < 3 THEN 'STABLE_FLAT' WHEN mean_score < 4 THEN 'CONSISTENT'
           ELSE 'STRONG' END AS reason
       FROM forecast f JOIN micro m ON f.user_id = m.user_id AND f.subject = m.subject""",
)
_add(
    "gap_difficulty_context",
    ("attempts", "timed", "forecast"),
    """SELECT user_id, subject, mean_level, last_level,
         CASE WHEN last_level > mean_level + CAST(0.3 AS DOUBLE) THEN CASE WHEN slope >= 0 THEN 'HARDER_HOLDING' ELSE 'HARDER_DIP' END
           WHEN last_level < mean_level - CAST(0.3 AS DOUBLE) AND slope < 0 THEN 'EASIER_DIP' END AS context
       FROM forecast""",
    ("mean_level",),
)
_add("gap_scores", ("attempts", "timed"), "SELECT user_id, subject, i + 1 AS position, score FROM timed")
_add(
    "gap_score_path",
    ("attempts", "timed"),
    """SELECT user_id, subject, i // 1000 AS page, string_agg(CAST(score AS VARCHAR), ' → ' ORDER BY i) AS score_path
       FROM timed GROUP BY user_id, subject, i // 1000""",
)
_add(
    "gap_most_improved",
    ("attempts", "timed", "forecast"),
    """SELECT user_id, subject, slope, CASE WHEN slope > 0.1 THEN 'improved' ELSE 'consistent' END AS status
       FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY slope DESC, first_pos) AS rn FROM forecast) WHERE rn = 1""",
    ("slope",),
)
_add(
    "gap_percentile",
    ("attempts", "timed", "forecast"),
    f"""SELECT user_id, percentile, CASE WHEN percentile >= 85 THEN 'EXCELLENT' WHEN percentile >= 60 THEN 'GOOD' ELSE 'NEEDS_WORK' END AS band
        FROM (SELECT user_id, LEAST(100, GREATEST(0, {_round(_settled('AVG(predicted) / 5 * 100'), 1)})) AS percentile
          FROM forecast GROUP BY user_id)""",
    ("percentile",),
)

_add("score_percent", ("attempts",), f"SELECT log_pos, user_id, subject, difficulty, {_PERCENT} AS percent FROM attempts", ("percent",))
_add(
    "ideal_interval",
    ("attempts",),
    f"SELECT log_pos, user_id, subject, difficulty, percent, {_IDEAL.format(p='percent')} AS ideal_days FROM (SELECT *, {_PERCENT} AS percent FROM attempts)",
    ("percent",),
)
_add(
    "training_set_fallback",
    _TARGETS,
    """SELECT user_id, subject, difficulty, is_prediction_mode, COUNT(*) AS training_rows,
         (SELECT string_agg(d, ', ' ORDER BY d) FROM (SELECT DISTINCT a.difficulty AS d FROM attempts a
            WHERE a.user_id = t.user_id AND a.subject = t.subject)) AS available
       FROM training t GROUP BY user_id, subject, difficulty, is_prediction_mode""",
)
_add("revision_summary", (*_TARGETS, "summary"), "SELECT * FROM summary", ("avg_percent", "avg_minutes"))
_add(
    "performance_label",
    (*_TARGETS, "summary"),
    "SELECT user_id, subject, difficulty, avg_percent, performance FROM summary",
    ("avg_percent",),
)
_add(
    "revision_recommendations",
    (*_TARGETS, "summary"),
    """SELECT user_id, subject, difficulty, 0 AS position, CASE WHEN avg_percent < 60 THEN 'FOCUS_FUNDAMENTALS'
         WHEN avg_percent < 80 THEN 'FOCUS_CHALLENGES' ELSE 'MAINTAIN_KNOWLEDGE' END AS advice FROM summary
       UNION ALL SELECT user_id, subject, difficulty, 1, CASE WHEN avg_percent < 60 THEN 'SHORTER_FREQUENT'
         WHEN avg_percent < 80 THEN 'MIX_PRACTICE_THEORY' ELSE 'SPACED_REPETITION' END FROM summary
       UNION ALL SELECT user_id, subject, difficulty, 2, CASE WHEN avg_minutes < 10 THEN 'EXTEND_SESSIONS' ELSE 'TAKE_BREAKS' END
         FROM summary WHERE avg_minutes < 10 OR avg_minutes > 45""",
)
_add(
    "difficulty_label_encode",
    ("attempts",),
    """SELECT user_id, subject, difficulty,
         CAST(ROW_NUMBER() OVER (PARTITION BY user_id, subject ORDER BY difficulty) - 1 AS INTEGER) AS code,
         CAST(COUNT(*) OVER (PARTITION BY user_id, subject) // 2 AS INTEGER) AS unseen_code
       FROM (SELECT DISTINCT user_id, subject, difficulty FROM attempts)""",
)
_add(
    "recent_attempts",
    _TARGETS,
    f"""SELECT user_id, subject, difficulty, is_prediction_mode, CAST(back AS INTEGER) AS back, log_pos, taken_at, attempt_ts,
          score, total, time_spent_mins, {_round(_settled('pct'), 1)} AS percent
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, subject, difficulty ORDER BY log_pos DESC) AS back FROM training)
        WHERE back <= 5""",
    ("time_spent_mins", "percent"),
)
_add(
    "fallback_features",
    ("attempts", "numbered", "targets", "modes"),
    f"""SELECT user_id, subject, difficulty, AVG(p) AS mean_percent, AVG(a) AS mean_max_attempt, AVG(t) AS mean_minutes
        FROM (SELECT m.user_id, m.subject, m.difficulty, n.difficulty AS taken_at, AVG({_PERCENT}) AS p, MAX(attempt_no) AS a, AVG(time_spent_mins) AS t
          FROM modes m JOIN numbered n ON n.user_id = m.user_id AND n.subject = m.subject
          WHERE is_prediction_mode GROUP BY m.user_id, m.subject, m.difficulty, n.difficulty)
        GROUP BY user_id, subject, difficulty""",
    ("mean_percent", "mean_max_attempt", "mean_minutes"),
)
_add(
    "revision_plan",
    _REVISION,
    """SELECT user_id, subject, difficulty, is_prediction_mode, CAST(base AS DOUBLE) AS base_interval, sessions, interval_days,
         CEIL(interval_days * 2) / 2 AS rounded_days FROM revision""",
    ("base_interval", "interval_days", "rounded_days"),
)
for _name in ("revision_schedule", "export_schedule_csv"):
    _add(_name, (*_REVISION, "sessions_out"), "SELECT * FROM sessions_out")
_PLANNED = """SELECT user_id, subject, difficulty, is_prediction_mode, CAST(base AS DOUBLE) AS base_interval, sessions, interval_days,
  CEIL(interval_days * 2) / 2 AS rounded_days FROM revision"""
_BLOCKS["plan_base_rules"], _BLOCKS["plan_base"] = _BLOCKS["plan_base"], "SELECT * FROM model_base"
_add("revision_interval_model", (*_MODEL, "plan_base", "revision"), _PLANNED, ("base_interval", "interval_days", "rounded_days"))
_add("revision_schedule_model", (*_MODEL, "plan_base", "revision", "sessions_out"), "SELECT * FROM sessions_out")
_BLOCKS["plan_base"] = _BLOCKS.pop("plan_base_rules")

_add("student_profiles", ("attempts", "profiles"), "SELECT * FROM profiles", ("avg_score", "avg_difficulty"))
_add(
    "scaled_features",
    ("attempts", "profiles"),
    "SELECT user_id, "
    + ", ".join(
        f"({c} - AVG({c}) OVER ()) / COALESCE(NULLIF(stddev_pop({c}) OVER (), 0), 1) AS {c}_z"
        for c in ("avg_score", "attempts", "avg_difficulty")
    )
    + " FROM profiles",
    ("avg_score_z", "attempts_z", "avg_difficulty_z"),
)
_add(
    "cluster_k_selection",
    _CLUSTERS,
    """SELECT CAST(k AS INTEGER) AS k, silhouette, k = FIRST_VALUE(k) OVER (ORDER BY ROUND(silhouette, 9) DESC, k) AS best FROM silhouettes""",
    ("silhouette",),
)
_add("student_groups", _GROUPS, "SELECT * FROM student_groups")
_add(
    "group_members",
    _GROUPS,
    """SELECT study_group, page, COUNT(*) AS members, string_agg(CAST(user_id AS VARCHAR), ', ' ORDER BY user_id) AS member_ids
       FROM (SELECT *, (ROW_NUMBER() OVER (PARTITION BY study_group ORDER BY user_id) - 1) // 1000 AS page
         FROM student_groups WHERE study_group IS NOT NULL)
       GROUP BY study_group, page""",
)
_METRICS = (("AVG_SCORE", "avg_score", True), ("ATTEMPTS", "attempts", False), ("AVG_DIFFICULTY", "avg_difficulty", True))
_add(
    "compare_users",
    ("attempts", "profiles"),
    " UNION ALL ".join(
        f"SELECT a.user_id AS first_user, b.user_id AS second_user, '{label}' AS metric, "
        + ", ".join(
            (_round(_settled(f"{side}.{c}"), 2) if rounded else f"CAST({side}.{c} AS DOUBLE)") + f" AS {out}"
            for side, out in (("a", "first_value"), ("b", "second_value"))
        )
        + " FROM profiles a JOIN profiles b ON b.user_id = a.user_id + 1"
        for label, c, rounded in _METRICS
    ),
    ("first_value", "second_value"),
)
_PEERS = (
    "WITH peers AS (SELECT user_id, arg_min(peer_id, (score, peer_id)) AS peer_id FROM (SELECT a.user_id, b.user_id AS peer_id,"
    + " ROUND(ABS(ROUND(b.avg_difficulty, 9) - ROUND(a.avg_difficulty, 9))"
    + f" + ABS(ROUND(CAST({K.PEER_LAMBDA} AS DOUBLE) * b.avg_score, 9) - ROUND(CAST({K.PEER_LAMBDA} AS DOUBLE) * a.avg_score, 9)), 9) AS score"
    + " FROM profiles a JOIN profiles b ON a.user_id <> b.user_id) WHERE score IS NOT NULL GROUP BY user_id) "
    + " UNION ALL ".join(
        f"SELECT a.user_id AS first_user, b.user_id AS second_user, '{label}' AS metric, "
        + ", ".join(
            (_round(_settled(f"{side}.{c}"), 2) if rounded else f"CAST({side}.{c} AS DOUBLE)") + f" AS {out}"
            for side, out in (("a", "first_value"), ("b", "second_value"))
        )
        + " FROM peers p JOIN profiles a ON a.user_id = p.user_id JOIN profiles b ON b.user_id = p.peer_id"
        for label, c, rounded in _METRICS
    )
)
_add("peer_comparison", ("attempts", "profiles"), _PEERS, ("first_value", "second_value"))
_add(
    "compare_users_with_groups",
    _GROUPS,
    f"""SELECT c.*, f.study_group AS first_group, s.study_group AS second_group FROM ({_PEERS}) c
        LEFT JOIN student_groups f ON f.user_id = c.first_user LEFT JOIN student_groups s ON s.user_id = c.second_user""",
    ("first_value", "second_value"),
)
_add(
    "peer_recommendation",
    ("attempts", "profiles"),
    f"""SELECT user_id, peer_id, match_score FROM (
          SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY match_score, peer_id) AS rn FROM (
            SELECT a.user_id, b.user_id AS peer_id, ABS(b.avg_difficulty - a.avg_difficulty)
              + CAST({K.PEER_LAMBDA} AS DOUBLE) * ABS(b.avg_score - a.avg_score) AS match_score
            FROM profiles a JOIN profiles b ON a.user_id <> b.user_id))
        WHERE rn = 1""",
    ("match_score",),
)

_add("completed_from_grade", ("assignments",), "SELECT course_id, assignment_name, grade, grade IS NOT NULL AS completed FROM assignments", ("grade",))
_add("course_grades", ("assignments", "sums", "grades"), "SELECT * FROM grades", ("completed_weight", "current_grade", "projected_grade", "display_grade"))
_add(
    "required_scores",
    (*_COURSES, "sums"),
    """SELECT *, CASE WHEN remaining_weight > 0 THEN CASE WHEN required_score > 100 THEN 'UNACHIEVABLE' WHEN earned >= target THEN 'SECURED'
           ELSE 'NEEDS_SCORE' END WHEN earned >= target THEN 'MEETS_TARGET' ELSE 'BELOW_TARGET' END AS status
       FROM (SELECT s.course_id, target, earned, remaining_weight, GREATEST(0, CASE WHEN remaining_weight = 0 THEN earned
           ELSE (target - earned) / (remaining_weight / 100) END) AS required_score
         FROM sums s JOIN courses c ON s.course_id = c.course_id)""",
    ("target", "earned", "remaining_weight", "required_score"),
)
_add(
    "grade_trend",
    ("assignments",),
    f"""SELECT course_id, completed, slope,
          CASE WHEN slope IS NOT NULL THEN LEAST(100, GREATEST(0, mean + slope * (assignments - 1 - (completed - 1) / CAST(2 AS DOUBLE)))) END AS predicted_grade,
          CASE WHEN completed < 2 THEN 'NEED_MORE_DATA' WHEN slope > 1 THEN 'IMPROVING' WHEN slope < -1 THEN 'DECLINING' ELSE 'STABLE' END AS trend
        FROM (SELECT course_id, COUNT(grade) AS completed, COUNT(*) AS assignments, AVG(grade) AS mean,
            CASE WHEN COUNT(grade) > 1 THEN {_settled('regr_slope(grade, i)')} END AS slope
          FROM (SELECT course_id, CASE WHEN completed THEN grade END AS grade,
              ROW_NUMBER() OVER (PARTITION BY course_id, completed ORDER BY pos) - 1 AS i FROM assignments)
          GROUP BY course_id)""",
    ("slope", "predicted_grade"),
)
_add(
    "goal_status",
    _COURSES,
    """SELECT course_id, mean_grade, gap, CASE WHEN gap IS NULL THEN 'NO_DATA' WHEN gap <= 0 THEN 'ON_TRACK' WHEN gap <= 10 THEN 'CLOSE'
         ELSE 'NEEDS_IMPROVEMENT' END AS status
       FROM (SELECT c.course_id, AVG(grade) FILTER (completed) AS mean_grade, target - AVG(grade) FILTER (completed) AS gap
         FROM assignments a JOIN courses c ON a.course_id = c.course_id GROUP BY c.course_id, target)""",
    ("mean_grade", "gap"),
)
_add(
    "study_time_allocation",
    _COURSES,
    f"""SELECT a.course_id, assignment_name, weight,
          {_round(_settled('weight / SUM(weight) OVER (PARTITION BY a.course_id) * available_hours'), 1)} AS recommended_hours
        FROM assignments a JOIN courses c ON a.course_id = c.course_id WHERE NOT completed""",
    ("weight", "recommended_hours"),
)
_add(
    "grade_insights",
    _COURSES,
    f"""SELECT course_id, mean_grade, mean_grade >= target AS meets_target, grade_std,
          CASE WHEN {_settled('grade_std')} > 10 THEN 'VARIED' ELSE 'CONSISTENT' END AS consistency,
          CASE WHEN n > 1 THEN best END AS best, CASE WHEN n > 1 THEN weakest END AS weakest, points_per_hour
        FROM (SELECT c.course_id, target, COUNT(*) AS n, AVG(grade) AS mean_grade,
            CASE WHEN COUNT(grade) > 1 THEN stddev_samp(grade) END AS grade_std,
            MAX(CASE WHEN up = 1 THEN assignment_name END) AS best, MAX(CASE WHEN down = 1 THEN assignment_name END) AS weakest,
            AVG(grade / NULLIF(study_hours, 0)) AS points_per_hour
          FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY grade DESC NULLS LAST, pos) AS up,
              ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY grade ASC NULLS LAST, pos) AS down FROM assignments WHERE completed) a
            JOIN courses c ON a.course_id = c.course_id
          GROUP BY c.course_id, target)""",
    ("mean_grade", "grade_std", "points_per_hour"),
)
_add(
    "course_progress",
    ("assignments",),
    """SELECT course_id, COUNT(*) FILTER (completed) AS completed, COUNT(*) AS assignments,
         COUNT(*) FILTER (completed) * CAST(100 AS DOUBLE) / COUNT(*) AS percent_done FROM assignments GROUP BY course_id""",
    ("percent_done",),
)
_add(
    "course_weight_check",
    ("assignments",),
    "SELECT course_id, SUM(weight) AS total_weight FROM assignments GROUP BY course_id HAVING SUM(weight) <> 100",
    ("total_weight",),
)
_add(
    "grade_series",
    _COURSES,
    """SELECT a.course_id, assignment_name, grade, target FROM assignments a JOIN courses c ON a.course_id = c.course_id WHERE completed""",
    ("grade", "target"),
)
_add("letter_grade", (*_COURSES, "sums", "grades", "letters"), "SELECT * FROM letters", ("credits", "display_grade", "grade_points"))
_add(
    "weighted_gpa",
    (*_COURSES, "sums", "grades", "letters"),
    "SELECT user_id, SUM(grade_points * credits) / SUM(credits) AS gpa, SUM(credits) AS credits, COUNT(*) AS courses FROM letters GROUP BY user_id",
    ("gpa", "credits"),
)

for _name, _blocks in (
    ("allocate_proportional", _PROPORTIONAL),
    ("allocate_softmax", ("items", "softmax")),
    ("allocate_balanced", ("items", "balanced")),
):
    _add(_name, _blocks, f"SELECT request_id, name, priority, hours FROM {_blocks[-1]}", ("hours",))
_add("export_plan_csv", ("items", "balanced"), "SELECT request_id, name AS subject, hours, priority FROM balanced", ("hours",))
_add(
    "plan_summary",
    ("items", "softmax"),
    """SELECT request_id, COUNT(*) AS subjects, SUM(hours) AS hours, SUM(hours) / NULLIF(MAX(total_hours), 0) * 100 AS utilisation
       FROM softmax GROUP BY request_id""",
    ("hours", "utilisation"),
)
_add(
    "plan_shares",
    ("items", "softmax"),
    """SELECT request_id, name, hours, hours / NULLIF(SUM(hours) OVER (PARTITION BY request_id), 0) * 100 AS share FROM softmax""",
    ("hours", "share"),
)
_add(
    "block_schedule",
    ("items", "softmax"),
    """SELECT request_id, name, block, kind, starts_at, strftime(starts_at, '%I:%M %p') AS start_label,
         strftime(starts_at + to_microseconds(CAST(duration * 3600e6 AS BIGINT)), '%I:%M %p') AS end_label, duration
       FROM (SELECT request_id, name, CAST(block AS INTEGER) AS block, kind, duration,
           TIMESTAMP '2025-01-01 09:00:00' + to_microseconds(CAST((start + block * 1.75 + CASE kind WHEN 'break' THEN 1.5 ELSE 0 END) * 3600e6 AS BIGINT)) AS starts_at
         FROM (SELECT *, CASE kind WHEN 'break' THEN CAST(0.25 AS DOUBLE) ELSE LEAST(1.5, hours - 1.5 * block) END AS duration
           FROM (SELECT *, UNNEST(range(blocks)) AS block
             FROM (SELECT *, hours + (blocks - 1) * 0.25 AS length,
                 COALESCE(SUM(hours + (blocks - 1) * 0.25) OVER (PARTITION BY request_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
               FROM (SELECT *, CAST(CEIL(hours / 1.5) AS BIGINT) AS blocks FROM softmax WHERE hours > 0)))
           CROSS JOIN (VALUES ('study'), ('break')) k(kind)
           WHERE kind = 'study' OR block < blocks - 1))""",
    ("duration",),
)
