"""SQL of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

G = """WITH RECURSIVE g AS (
  SELECT user_id AS src, regexp_extract(props, '"k": ?([0-9]+)', 1)::BIGINT AS dst, round(value * 100)::BIGINT AS value, ts,
         event_id AS seq, (epoch_ms(ts) // 86400000 + 1) * 86400000 - 1 AS window_end
  FROM events WHERE regexp_matches(props, '"k": ?[0-9]+')),
u AS (SELECT src, dst, value, window_end, seq * 2 AS seq FROM g UNION ALL SELECT dst, src, value, window_end, seq * 2 + 1 FROM g),
ends AS (SELECT src AS id, seq * 2 AS seq FROM g UNION ALL SELECT dst, seq * 2 + 1 FROM g),
canon AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE src <> dst),
turn AS (SELECT src, dst, seq, CASE WHEN row_number() OVER (PARTITION BY src, dst ORDER BY seq) % 2 = 1 THEN 1 ELSE -1 END AS op FROM g)
"""
#: Labels sink to the smallest vertex that reaches them; the table holds one row a vertex.
REACH = """
component(id, component) USING KEY (id) AS (
  SELECT src, src FROM (SELECT DISTINCT src FROM u)
  UNION SELECT u.dst, min(c.component) FROM component c JOIN u ON u.src = c.id JOIN recurring.component k ON k.id = u.dst WHERE c.component < k.component GROUP BY u.dst)
"""
PARTS = """WITH RECURSIVE g AS (SELECT DISTINCT l_orderkey AS src, l_partkey + 10000000 AS dst FROM lineitem),
u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g),""" + REACH
COMPONENTS = PARTS + "SELECT id, component FROM component"
SIDES = PARTS + """,
walk(id, sign) AS (SELECT component, TRUE FROM component UNION SELECT u.dst, NOT w.sign FROM walk w JOIN u ON u.src = w.id)
SELECT c.id, c.component, w.sign FROM component c JOIN walk w USING (id)"""
#: The double cover of suppliers and parts: a vertex whose two sides are in one component lies on an odd closed walk.
DENSE = """WITH RECURSIVE g AS (SELECT DISTINCT l_suppkey * 2 AS s, (l_partkey + 1000000) * 2 AS d FROM lineitem),
ties AS (SELECT s AS src, d + 1 AS dst FROM g UNION ALL SELECT s + 1, d FROM g),
u AS (SELECT src, dst FROM ties UNION SELECT dst, src FROM ties),""" + REACH + """
SELECT count(*) FILTER (plus = minus) = 0 AS bipartite, count(*) FILTER (plus = minus) AS conflicts FROM (
  SELECT id // 2 AS v, min(component) FILTER (id % 2 = 0) AS plus, min(component) FILTER (id % 2 = 1) AS minus FROM component GROUP BY id // 2)"""
COVER = """,
pairs AS (SELECT DISTINCT src, dst FROM {edges}),
both_ways AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs),
walk(root, id, sign) AS (SELECT DISTINCT src, src, TRUE FROM both_ways UNION SELECT w.root, b.dst, NOT w.sign FROM walk w JOIN both_ways b ON b.src = w.id),
odd AS (SELECT DISTINCT root FROM walk WHERE id = root AND NOT sign)
SELECT count(*) = 0 AS bipartite, count(*) AS conflicts FROM odd"""

SQL = {
    "edges": G + "SELECT src, dst, value, seq FROM g",
    "map_edges": G + "SELECT src, dst, value * 2 + src - dst AS value, seq FROM g",
    "filter_edges": G + "SELECT src, dst, value, seq FROM g WHERE value > 5000",
    "filter_vertices": G + "SELECT src, dst, value, seq FROM g WHERE src > 50 AND dst > 50",
    "reverse": G + "SELECT dst AS src, src AS dst, value, seq FROM g",
    "undirected": G + "SELECT src, dst, value, seq FROM u",
    "distinct_edges": G + "SELECT src, dst, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY seq) AS n FROM g) WHERE n = 1",
    "union": G + "SELECT src, dst, value, seq FROM g WHERE value > 5000 UNION ALL SELECT src, dst, value, seq FROM g WHERE value > 8000",
    "vertices": G + "SELECT DISTINCT id FROM ends",
    "num_vertices": G + "SELECT count(DISTINCT id) AS n FROM ends",
    "num_vertices_trace": G + "SELECT row_number() OVER (ORDER BY min(seq)) AS n FROM ends GROUP BY id",
    "num_edges": G + "SELECT count(*) AS n FROM g",
    "num_edges_trace": G + "SELECT row_number() OVER (ORDER BY seq) AS n FROM g",
    "degrees": G + "SELECT id, count(*) AS degree FROM ends GROUP BY id",
    "degrees_trace": G + "SELECT id, count(*) OVER (PARTITION BY id ORDER BY seq) AS degree FROM ends",
    "in_degrees": G + "SELECT dst AS id, count(*) AS degree FROM g GROUP BY dst",
    "in_degrees_trace": G + "SELECT dst AS id, count(*) OVER (PARTITION BY dst ORDER BY seq) AS degree FROM g",
    "out_degrees": G + "SELECT src AS id, count(*) AS degree FROM g GROUP BY src",
    "out_degrees_trace": G + "SELECT src AS id, count(*) OVER (PARTITION BY src ORDER BY seq) AS degree FROM g",
    "neighborhood": G + "SELECT src AS id, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS neighbors FROM (SELECT DISTINCT src, dst FROM u) GROUP BY src",
    "neighborhood_trace": G + """SELECT src, dst, array_to_string(list_sort(list_distinct(array_agg(dst) OVER (PARTITION BY src ORDER BY seq))), ',') AS neighbors FROM g""",
    "aggregate_vertices": G + "SELECT id, sum(value)::BIGINT AS value FROM (SELECT src AS id, value FROM g UNION ALL SELECT dst, -value FROM g) GROUP BY id",
    "global_aggregate_updates": G + """SELECT value FROM (SELECT value, lag(value) OVER (ORDER BY seq) AS was FROM (
        SELECT max(value) OVER (ORDER BY seq) AS value, seq FROM g)) WHERE value IS DISTINCT FROM was""",
    "last_value_window": G + "SELECT src AS id, arg_max(value, seq) AS value, window_end FROM g GROUP BY src, window_end",
    "window_triangles": G + """, wc AS (SELECT DISTINCT window_end, least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE src <> dst),
        t AS (SELECT x.window_end, count(*) AS n FROM wc x JOIN wc y ON y.window_end = x.window_end AND y.a = x.b
              JOIN wc z ON z.window_end = x.window_end AND z.a = x.a AND z.b = y.b GROUP BY x.window_end)
        SELECT coalesce(n, 0) AS triangles, window_end FROM (SELECT DISTINCT window_end FROM g) LEFT JOIN t USING (window_end)""",
    "exact_triangles": G + "SELECT count(*) AS triangles FROM canon x JOIN canon y ON y.a = x.b JOIN canon z ON z.a = x.a AND z.b = y.b",
    "exact_triangles_local": G + """, t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM canon x JOIN canon y ON y.a = x.b JOIN canon z ON z.a = x.a AND z.b = y.b)
        SELECT id, count(*) AS triangles FROM (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY id""",
    "triangle_trace": G + """, f AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(seq) AS seq FROM g WHERE src <> dst GROUP BY 1, 2),
        t AS (SELECT greatest(x.seq, y.seq, z.seq) AS seq FROM f x JOIN f y ON y.a = x.b JOIN f z ON z.a = x.a AND z.b = y.b),
        c AS (SELECT seq, count(*) AS n FROM t GROUP BY seq)
        SELECT seq, sum(n) OVER (ORDER BY seq)::BIGINT AS triangles FROM c""",
    "triangle_trace_local": G + """, f AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(seq) AS seq FROM g WHERE src <> dst GROUP BY 1, 2),
        t AS (SELECT x.a AS p, x.b AS q, y.b AS r, greatest(x.seq, y.seq, z.seq) AS seq FROM f x JOIN f y ON y.a = x.b JOIN f z ON z.a = x.a AND z.b = y.b),
        c AS (SELECT id, seq, count(*) AS n FROM (SELECT p AS id, seq FROM t UNION ALL SELECT q, seq FROM t UNION ALL SELECT r, seq FROM t) GROUP BY id, seq)
        SELECT id, sum(n) OVER (PARTITION BY id ORDER BY seq)::BIGINT AS triangles, seq FROM c""",
    "degree_distribution": G + """, d AS (SELECT id, sum(op) AS degree FROM (SELECT src AS id, op FROM turn UNION ALL SELECT dst, op FROM turn) GROUP BY id)
        SELECT degree::BIGINT AS degree, count(*) AS vertices FROM d WHERE degree > 0 GROUP BY 1""",
    "degree_distribution_trace": G + """, e AS (SELECT src AS id, op, seq * 2 AS seq FROM turn UNION ALL SELECT dst, op, seq * 2 + 1 FROM turn),
        d AS (SELECT id, seq, sum(op) OVER (PARTITION BY id ORDER BY seq) AS new, op FROM e),
        c AS (SELECT new AS degree, 1 AS change, seq * 2 AS seq FROM d WHERE new > 0 UNION ALL SELECT new - op, -1, seq * 2 + 1 FROM d WHERE new - op > 0)
        SELECT degree::BIGINT AS degree, sum(change) OVER (PARTITION BY degree ORDER BY seq)::BIGINT AS vertices FROM c""",
    "degree_distribution_underflow": G + """, o AS (SELECT src, dst % 7 AS dst, seq, CASE WHEN seq % 5 < 3 THEN 1 ELSE -1 END AS op FROM g),
        e AS (SELECT src AS id, op, seq * 2 AS seq FROM o UNION ALL SELECT dst, op, seq * 2 + 1 FROM o),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM e),
        walk(id, k, old, new, seq) AS (SELECT id, k, 0, greatest(op, 0), seq FROM r WHERE k = 1
          UNION ALL SELECT r.id, r.k, w.new, greatest(w.new + r.op, 0), r.seq FROM walk w JOIN r ON r.id = w.id AND r.k = w.k + 1),
        c AS (SELECT new AS degree, 1 AS change, seq * 2 AS seq FROM walk WHERE new <> old AND new > 0 UNION ALL SELECT old, -1, seq * 2 + 1 FROM walk WHERE new <> old AND old > 0)
        SELECT degree::BIGINT AS degree, sum(change) OVER (PARTITION BY degree ORDER BY seq)::BIGINT AS vertices FROM c""",
    "connected_components": COMPONENTS,
    "connected_components_tree": COMPONENTS,
    "connected_components_iterative": COMPONENTS,
    "windowed_components": G + """, b AS (SELECT window_end AS w, src, dst FROM g UNION SELECT window_end, dst, src FROM g),
        component(w, id, component) USING KEY (w, id) AS (
          SELECT w, src, src FROM (SELECT DISTINCT w, src FROM b)
          UNION SELECT c.w, b.dst, min(c.component) FROM component c JOIN b ON b.w = c.w AND b.src = c.id JOIN recurring.component k ON k.w = c.w AND k.id = b.dst
          WHERE c.component < k.component GROUP BY c.w, b.dst)
        SELECT w AS window_end, id, component FROM component""",
    "cumulative_components": G + """, t AS (SELECT src, dst, (epoch_ms(ts) // 864000000 + 1) * 864000000 - 1 AS e FROM g),
        p AS (SELECT DISTINCT w.e AS w, src, dst FROM (SELECT DISTINCT e FROM t) w JOIN t ON t.e <= w.e),
        b AS (SELECT w, src, dst FROM p UNION SELECT w, dst, src FROM p),
        reach(w, id, low) AS (SELECT w, src, src FROM b UNION SELECT r.w, b.dst, r.low FROM reach r JOIN b ON b.w = r.w AND b.src = r.id WHERE r.low < b.dst),
        c AS (SELECT w, id, min(low) AS component FROM reach GROUP BY w, id)
        SELECT w AS window_end, count(DISTINCT component) AS components, count(*) AS vertices FROM c GROUP BY w""",
    "bipartite_check": G + COVER.format(edges="g"),
    "bipartite_sides": SIDES,
    "bipartite_dense": DENSE,
    "bipartite_summary_sides": SIDES,
}
#: One step of recursion an edge: the row 'step' holds how many edges have passed (k) and events were made (value), 'at' the edge
#: that a vertex is matched by, 'event' what happened.
MATCHING = G + """, e AS MATERIALIZED (SELECT src, dst, value, row_number() OVER (ORDER BY seq) AS k FROM g),
m(kind, id, event, src, dst, value, k) USING KEY (kind, id) AS (
  SELECT 'step', 0::BIGINT, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT
  UNION
  (WITH now AS (SELECT e.src, e.dst, e.value, e.k, m.value AS n FROM m JOIN e ON e.k = m.k + 1 WHERE m.kind = 'step'),
     met AS (SELECT c.src, c.dst, c.value, min(CASE WHEN c.id = now.src THEN 0 ELSE 1 END) AS o, any_value(now.value) AS w
       FROM now JOIN recurring.m c ON c.kind = 'at' AND (c.id = now.src OR c.id = now.dst) AND c.value IS NOT NULL GROUP BY c.src, c.dst, c.value),
     won AS (SELECT now.*, t.many FROM now, (SELECT coalesce(sum(value), 0) AS total, count(*) AS many FROM met) t WHERE now.value > 2 * t.total)
   SELECT 'step', 0, NULL, NULL, NULL, now.n + coalesce((SELECT many + 1 FROM won), 0), now.k FROM now
   UNION ALL SELECT 'at', x.id, NULL, NULL, NULL, NULL, NULL FROM won, (SELECT src AS id FROM met UNION SELECT dst FROM met) x WHERE x.id <> won.src AND x.id <> won.dst
   UNION ALL SELECT 'at', x.id, NULL, won.src, won.dst, won.value, NULL FROM won, (SELECT src AS id FROM now UNION SELECT dst FROM now) x
   UNION ALL SELECT 'event', won.n + row_number() OVER (ORDER BY met.o) - 1, 'REMOVE', met.src, met.dst, met.value, NULL FROM won, met
   UNION ALL SELECT 'event', won.n + won.many, 'ADD', won.src, won.dst, won.value, NULL FROM won))
"""
#: One step an edge: 'kept' and 'back' hold the spanner both ways; an edge stays if no path of two or three kept ones ties its ends.
SPANNER = G + """, e AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY seq) AS k FROM (
  SELECT src, dst, seq, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY seq) AS n FROM g WHERE src <> dst) WHERE n = 1),
s(kind, a, b, k) USING KEY (kind, a, b) AS (
  SELECT 'step', 0::BIGINT, 0::BIGINT, 0::BIGINT
  UNION
  (WITH now AS (SELECT e.src, e.dst, e.k FROM s JOIN e ON e.k = s.k + 1 WHERE s.kind = 'step'),
     p AS (SELECT r.b AS x FROM now JOIN recurring.s r ON r.kind <> 'step' AND r.a = now.src),
     q AS (SELECT r.b AS x FROM now JOIN recurring.s r ON r.kind <> 'step' AND r.a = now.dst),
     near AS (SELECT 1 AS one FROM p JOIN q USING (x) UNION ALL SELECT 1 FROM p JOIN recurring.s r ON r.kind <> 'step' AND r.a = p.x JOIN q ON q.x = r.b)
   SELECT 'step', 0, 0, now.k FROM now
   UNION ALL SELECT 'kept', now.src, now.dst, NULL FROM now WHERE NOT EXISTS (SELECT 1 FROM near)
   UNION ALL SELECT 'back', now.dst, now.src, NULL FROM now WHERE NOT EXISTS (SELECT 1 FROM near)))
SELECT a AS src, b AS dst FROM s WHERE kind = 'kept'"""
#: The draws of a sampler are digests, so both sides draw alike; 3735928559 is the seed.
ESTIMATE = G + """, d AS (SELECT src, dst, row_number() OVER (ORDER BY seq) AS place FROM (
          SELECT src, dst, seq, row_number() OVER (PARTITION BY src, dst ORDER BY seq) AS n FROM g) WHERE n = 1),
        v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS r FROM (SELECT src AS id FROM d UNION SELECT dst FROM d)),
        n AS (SELECT (SELECT count(*) FROM d) AS m, (SELECT count(*) FROM v) AS vertices),
        drawn AS (SELECT k,
            floor((('0x' || substr(md5('3735928559:edge:' || k), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE * m)::BIGINT + 1 AS place,
            floor((('0x' || substr(md5('3735928559:vertex:' || k), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE * (vertices - 2))::BIGINT AS skip
          FROM range(10000) s(k), n),
        held AS (SELECT k, place, d.src AS a, d.dst AS b, skip + CASE WHEN skip >= least(x.r, y.r) THEN 1 ELSE 0 END AS c0, greatest(x.r, y.r) AS high
          FROM drawn JOIN d USING (place) JOIN v x ON x.id = d.src JOIN v y ON y.id = d.dst),
        third AS (SELECT k, place, a, b, v.id AS c FROM held JOIN v ON v.r = c0 + CASE WHEN c0 >= high THEN 1 ELSE 0 END),
        last AS (SELECT least(src, dst) AS p, greatest(src, dst) AS q, max(place) AS last FROM d WHERE src <> dst GROUP BY 1, 2),
        hit AS (SELECT count(*) AS beta FROM third t JOIN last x ON x.p = least(a, c) AND x.q = greatest(a, c) AND x.last > place
          JOIN last y ON y.p = least(b, c) AND y.q = greatest(b, c) AND y.last > place)
        SELECT m AS edges, beta, trunc(beta::DOUBLE / 10000 * m * (vertices - 2))::BIGINT AS estimate FROM hit, n"""
SQL["window_triangles_summary"] = SQL["window_triangles"]
BOTH = "SELECT src AS id, value, seq * 16 AS seq FROM g UNION ALL SELECT dst, value, seq * 16 + 1 FROM g"
SQL |= {
    "fold_vertices": G + f"""SELECT id, count(*) OVER w AS n, max(value) OVER w AS most FROM ({BOTH})
        WINDOW w AS (PARTITION BY id ORDER BY seq)""",
    "global_fold_updates": G + "SELECT row_number() OVER (ORDER BY min(seq)) AS n FROM ends GROUP BY id",
    "map_edges_python": G + "SELECT src, dst, value, seq FROM (SELECT src, dst, value * 2 + src - dst AS value, seq FROM g) WHERE value % 3 = 0",
    "source_tab": G + "SELECT src, dst FROM g",
    "source_white_space": G + "SELECT src, dst FROM g",
    "source_timestamped": G + "SELECT src, dst, epoch_us(ts) // 1000 AS ms FROM g",
    "source_event_list": G + "SELECT src, dst, op FROM turn",
    "source_commented": G + "SELECT src, dst FROM g WHERE value <= 5000",
    "source_ratings": G + "SELECT src, dst + 1000000 AS dst, value % 50 AS value FROM g",
    "sink_csv": G + "SELECT src, dst, value FROM g",
    "generated_ring": "SELECT k AS src, (k + 2 * o) % 1000 AS dst, k * 2 + o - 1 AS seq FROM range(1000) r(k), (VALUES (1), (2)) v(o)",
    "generated_windows": "SELECT k AS src, k + o AS dst, k * 100 AS ms, k * 2 + o - 1 AS seq FROM range(1, 101) r(k), (VALUES (1), (2)) v(o)",
    "summary_values": G + """, e AS (SELECT *, (epoch_ms(ts) // 864000000 + 1) * 864000000 - 1 AS w FROM g)
        SELECT id, edges, total, most, w AS window_end FROM (
          SELECT e.src AS id, x.w AS w, count(*) AS edges, sum(e.value)::BIGINT AS total, max(e.value) AS most
          FROM (SELECT DISTINCT w FROM e) x JOIN e ON e.w <= x.w GROUP BY e.src, x.w)""",
    "summary_values_transient": G + """, e AS (SELECT *, (epoch_ms(ts) // 864000000 + 1) * 864000000 - 1 AS w FROM g)
        SELECT src AS id, count(*) AS edges, sum(value)::BIGINT AS total, max(value) AS most, w AS window_end FROM e GROUP BY src, w""",
    "spanner": SPANNER,
    "matching_events": MATCHING + "SELECT id AS at, event, src, dst, value FROM m WHERE kind = 'event'",
    "weighted_matching": MATCHING + "SELECT DISTINCT src, dst, value FROM m WHERE kind = 'at' AND value IS NOT NULL",
    "triangle_estimate_broadcast": ESTIMATE,
    "triangle_estimate_incidence": ESTIMATE,
    "bipartite_windows": G + """, b AS (SELECT window_end AS w, src * 2 AS src, dst * 2 + 1 AS dst FROM g UNION SELECT window_end, src * 2 + 1, dst * 2 FROM g),
        u2 AS (SELECT w, src, dst FROM b UNION SELECT w, dst, src FROM b),
        side(w, id, component) USING KEY (w, id) AS (
          SELECT w, src, src FROM (SELECT DISTINCT w, src FROM u2)
          UNION SELECT c.w, x.dst, min(c.component) FROM side c JOIN u2 x ON x.w = c.w AND x.src = c.id JOIN recurring.side k ON k.w = c.w AND k.id = x.dst
          WHERE c.component < k.component GROUP BY c.w, x.dst),
        v AS (SELECT w, id // 2 AS v, min(component) AS lo, max(component) AS hi FROM side GROUP BY w, id // 2)
        SELECT w AS window_end, bool_and(lo <> hi) AS bipartite, CASE WHEN bool_and(lo <> hi) THEN count(*) ELSE 0 END AS vertices FROM v GROUP BY w""",
}
for way, source, key in (("out", "g", "src"), ("in", "g", "dst"), ("all", "u", "src")):
    near = "src" if way == "in" else "dst"
    SQL[f"slice_fold_{way}"] = G + f"SELECT {key} AS id, sum(value + {near})::BIGINT AS value, window_end FROM {source} GROUP BY {key}, window_end"
    SQL[f"slice_reduce_{way}"] = G + f"SELECT {key} AS id, sum(value)::BIGINT AS value, window_end FROM {source} GROUP BY {key}, window_end"
    SQL[f"slice_apply_{way}"] = G + f"SELECT {key} AS id, CASE WHEN sum(value) > 10000 THEN 'big' ELSE 'small' END AS size, window_end FROM {source} GROUP BY {key}, window_end"
