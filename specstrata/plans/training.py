"""Queries of the general training-data problems and their SQL."""

from __future__ import annotations

from specstrata.operators import drift, hierarchy, hotkeys, nested, orphans, snapshots

QUERIES = {
    "p1_found": orphans.p1_found, "p1_counts": orphans.p1_counts,
    "p2_hot_keys": hotkeys.p2_hot_keys,
    "p3_found": snapshots.p3_found, "p3_counts": snapshots.p3_counts, "p3_changes": snapshots.p3_changes,
    "p4_found": nested.p4_found, "p4_tables": nested.p4_tables, "p4_rows": nested.p4_rows, "p4_definitions": nested.p4_definitions,
    "p5_found": hierarchy.p5_found, "p5_nodes": hierarchy.p5_nodes, "p5_descendants": hierarchy.p5_descendants,
    "p6_found": drift.p6_found, "p6_changes": drift.p6_changes, "p6_fields": drift.p6_fields,
}


def plain(col: str) -> str:
    """SQL of the spelling by which hrefs are compared."""
    head = f"CASE WHEN strpos({col}, '#') > 0 THEN left({col}, strpos({col}, '#') - 1) ELSE {col} END"
    frag = f"CASE WHEN strpos({col}, '#') > 0 THEN substr({col}, strpos({col}, '#')) ELSE '' END"
    rx = r"^([A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?)([^/?#]*)(.*)$"
    low = f"CASE WHEN regexp_matches({head}, '{rx}') THEN regexp_extract({head}, '{rx}', 1) || lower(regexp_extract({head}, '{rx}', 2)) || regexp_extract({head}, '{rx}', 3) ELSE {head} END"
    return f"(({low}) || url_decode({frag}))"


P1_BASE = f"""
WITH i AS (SELECT {plain('href')} k, first_seen b, removed_at g FROM ids WHERE href IS NOT NULL),
d AS (SELECT {plain('href')} k, first_seen b, removed_at g FROM dfns WHERE href IS NOT NULL
      UNION ALL SELECT {plain('href')}, first_seen, NULL FROM core_dfns WHERE href IS NOT NULL),
h AS (SELECT page_url p, unnest(list_distinct(list_concat([id], coalesce(alternate_ids, CAST([] AS VARCHAR[]))))) k, first_seen b, removed_at g FROM headings),
c AS (SELECT DISTINCT 'dfns.href' AS ref_table, 'ids' AS target, CAST(dfn_no AS BIGINT) AS row_id, {plain('href')} k, NULL AS p, crawled_at t FROM dfns WHERE href IS NOT NULL
      UNION ALL SELECT DISTINCT 'headings.href', 'ids', heading_no, {plain('href')}, NULL, crawled_at FROM headings WHERE href IS NOT NULL
      UNION ALL SELECT DISTINCT 'dfns.heading', 'headings', dfn_no, heading.id, page_url, crawled_at FROM dfns WHERE heading.id IS NOT NULL
      UNION ALL SELECT DISTINCT 'backrefs.href', 'dfns', backref_id, {plain('href')}, NULL, crawled_at FROM backrefs WHERE href IS NOT NULL),
l AS (SELECT target, k, p, t, 1 AS child, NULL AS gone, ref_table, row_id FROM c
      UNION ALL SELECT 'ids', k, NULL, b, 0, coalesce(g, 'infinity'), NULL, NULL FROM i WHERE b IS NOT NULL
      UNION ALL SELECT 'dfns', k, NULL, b, 0, coalesce(g, 'infinity'), NULL, NULL FROM d WHERE b IS NOT NULL
      UNION ALL SELECT 'headings', k, p, b, 0, coalesce(g, 'infinity'), NULL, NULL FROM h WHERE b IS NOT NULL AND p IS NOT NULL AND k IS NOT NULL),
w AS (SELECT *, max(gone) OVER (PARTITION BY target, k, p ORDER BY t NULLS FIRST, child ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS alive_to FROM l),
f AS (SELECT ref_table, target AS target_table, row_id, strftime(t AT TIME ZONE 'UTC', '%Y-%m') AS month_key FROM w WHERE child = 1 AND (t IS NULL OR alive_to IS NULL OR alive_to <= t))
"""

_LM = "try_strptime(last_modified, ['%a, %d %b %Y %H:%M:%S GMT', '%A, %d-%b-%y %H:%M:%S GMT', '%a %b %d %H:%M:%S %Y'])"
P3_BASE = f"""
WITH r AS (SELECT snapshot_no, {plain('href')} AS href, crawled_at, loaded_at,
   to_json([CAST(list_transform(coalesce(linking_text, CAST([] AS VARCHAR[])), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS VARCHAR), dfn_type,
     CAST(list_sort(list_distinct(coalesce(dfn_for, CAST([] AS VARCHAR[])))) AS VARCHAR), access_mode, CAST(informative AS VARCHAR), {plain('heading_href')}, crawled,
     CAST(coalesce(epoch_us({_LM}), epoch_us(try_cast(last_modified AS TIMESTAMPTZ))) AS VARCHAR)]) AS body
   FROM dfn_snapshots WHERE href IS NOT NULL AND snapshot_no IS NOT NULL),
l AS (SELECT snapshot_no, href, arg_max(body, struct_pack(c := crawled_at, l := loaded_at)) AS body FROM r GROUP BY ALL),
n AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS nxt FROM (SELECT DISTINCT snapshot_no FROM l)),
a AS (SELECT n.nxt AS s, l.href, l.body FROM l JOIN n USING (snapshot_no) WHERE n.nxt IS NOT NULL),
b AS (SELECT l.snapshot_no AS s, l.href, l.body FROM l WHERE l.snapshot_no IN (SELECT nxt FROM n)),
f AS (SELECT CAST(coalesce(a.s, b.s) AS INTEGER) AS snapshot_no, coalesce(a.href, b.href) AS href,
   CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
   FROM a FULL JOIN b ON a.s = b.s AND a.href = b.href WHERE a.s IS NULL OR b.s IS NULL OR a.body <> b.body)
"""

P5_BASE = """
WITH RECURSIVE nm AS (SELECT DISTINCT idl_no, trim(idl_name) AS name, trim(inheritance) AS inh, includes FROM idlnames),
hd AS (SELECT DISTINCT heading_no, page_url, pos, level_no FROM headings),
e AS (SELECT 'inheritance' AS k, c.idl_no AS v, p.idl_no AS parent FROM nm c JOIN nm p ON c.inh = p.name WHERE c.inh <> ''
      UNION SELECT 'includes', c.idl_no, p.idl_no FROM (SELECT idl_no, trim(unnest(includes)) AS u FROM nm) c JOIN nm p ON c.u = p.name WHERE c.u <> ''
      UNION SELECT 'headings', c.heading_no, max_by(p.heading_no, p.pos) FROM hd c JOIN hd p ON c.page_url = p.page_url AND p.pos < c.pos AND p.level_no < c.level_no GROUP BY ALL),
v AS (SELECT 'inheritance' AS k, idl_no AS v FROM nm UNION ALL SELECT 'includes', idl_no FROM nm UNION ALL SELECT 'headings', heading_no FROM hd),
up AS (SELECT k, v, parent AS u FROM e UNION SELECT up.k, up.v, e.parent FROM up JOIN e ON e.k = up.k AND e.v = up.u),
looped AS (SELECT DISTINCT k, v FROM up WHERE v = u),
bad AS (SELECT DISTINCT k, v FROM looped UNION SELECT up.k, up.v FROM up JOIN looped ON up.k = looped.k AND up.u = looped.v),
w AS (SELECT k, v, CAST(v AS VARCHAR) AS path, v AS root, 0 AS depth FROM v ANTI JOIN e USING (k, v)
      UNION ALL SELECT e.k, e.v, w.path || '/' || e.v, w.root, w.depth + 1 FROM w JOIN (SELECT e.* FROM e ANTI JOIN bad USING (k, v)) e ON e.k = w.k AND e.parent = w.v)
"""

_J = "CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') AND regexp_matches({x} ->> '$', '^[ \\t\\r\\n]*[\\[{{]') THEN ({x} ->> '$')::JSON ELSE {x} END"


def _held(x: str) -> str:
    return "(" + _J.format(x=x) + ")"


def _items(x: str) -> str:
    held = _held(x)
    return f"CASE json_type({held}) WHEN 'ARRAY' THEN json_extract({held}, '$[*]') WHEN 'NULL' THEN [] ELSE [{held}] END"


P4_BASE = f"""
WITH r AS (SELECT DISTINCT rec_id, CAST(payload AS JSON) AS p FROM crawl_results WHERE payload IS NOT NULL AND json_valid(payload)),
s0 AS (SELECT rec_id, CASE WHEN coalesce(json_type(p -> 'results'), 'NULL') <> 'NULL' THEN {_items("(p -> 'results')")} ELSE [p] END AS rows FROM r),
s AS (SELECT rec_id, i - 1 AS i, {_held('rows[i]')} AS spec FROM (SELECT rec_id, rows, unnest(range(1, len(rows) + 1)) AS i FROM s0)),
n AS (SELECT rec_id, i, {_held("(spec -> 'nightly')")} AS nightly, {_held("(spec -> 'refs')")} AS refs, {_items("(spec -> 'dfns')")} AS dfns FROM s),
pg AS (SELECT rec_id, i, {_items("(nightly -> 'pages')")} AS xs FROM n),
rf AS (SELECT rec_id, i, {_items("(refs -> 'informative')")} AS xs FROM n),
d AS (SELECT rec_id, i, j - 1 AS j, {_held('dfns[j]')} AS dfn FROM (SELECT rec_id, i, dfns, unnest(range(1, len(dfns) + 1)) AS j FROM n)),
tx AS (SELECT rec_id, i, j, {_items("(dfn -> 'linkingText')")} AS xs FROM d)
"""
P4_SQL = P4_BASE + f"""
SELECT CAST(rec_id AS BIGINT) AS rec_id, 'page' AS child, i || '/' || (k - 1) AS item_path, xs[k] ->> '$' AS val FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM pg) WHERE json_type(xs[k]) = 'VARCHAR'
UNION ALL SELECT rec_id, 'ref', i || '/' || (k - 1), {_held('xs[k]')} ->> 'url' FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM rf) WHERE json_type({_held('xs[k]')} -> 'url') = 'VARCHAR'
UNION ALL SELECT rec_id, 'heading', i || '/' || j, {_held("(dfn -> 'heading')")} ->> 'href' FROM d WHERE json_type({_held("(dfn -> 'heading')")} -> 'href') = 'VARCHAR'
UNION ALL SELECT rec_id, 'text', i || '/' || j || '/' || (k - 1), xs[k] ->> '$' FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM tx) WHERE json_type(xs[k]) = 'VARCHAR'
"""

P6_BASE = r"""
WITH rec AS (SELECT row_number() OVER () AS rid, * FROM (SELECT DISTINCT feed, seq, payload FROM extract_files)),
tree AS (SELECT rid, feed, seq, payload, j.fullkey AS fk, j.value AS v, CASE j.type WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 4 WHEN 'ARRAY' THEN 8 WHEN 'NULL' THEN 0 ELSE 2 END AS bit
  FROM (SELECT * FROM rec WHERE json_valid(payload) AND json_type(payload) = 'OBJECT') r, json_tree(r.payload) j WHERE j.type <> 'OBJECT'),
leaf AS (SELECT *, replace(substr(regexp_replace(fk, '\[[0-9]+\]', '', 'g'), 3), '"', '') AS path, regexp_extract(fk, '^([^\]]*\])\.', 1) AS one, regexp_extract(fk, '^(.*\])\.', 1) AS two
  FROM tree WHERE NOT ends_with(fk, ']') AND (bit <> 8 OR len(list_filter(json_extract(v, '$[*]'), lambda x: json_type(x) IN ('OBJECT', 'ARRAY'))) = 0)),
item AS (SELECT feed, seq, path, bit, CAST(v AS VARCHAR) AS val, CAST(payload -> 'url' AS VARCHAR) || '|' || regexp_replace(one, '\[[0-9]+\]', '') || '=' || coalesce(CASE WHEN one <> '' THEN CAST(json_extract(payload, one || '.id') AS VARCHAR) END, regexp_extract(one, '\[[0-9]+\]', 0))
  || CASE WHEN two <> one THEN '|' || regexp_replace(two, '\[[0-9]+\]', '', 'g') || '=' || coalesce(CAST(json_extract(payload, two || '.id') AS VARCHAR), regexp_extract(two, '.*(\[[0-9]+\])', 1)) ELSE '' END AS item FROM leaf),
held AS (SELECT feed, seq, path, bit_or(bit) AS kinds FROM item WHERE bit > 0 GROUP BY ALL),
step AS (SELECT * FROM (SELECT feed, seq, lag(seq) OVER (PARTITION BY feed ORDER BY seq) AS before FROM (SELECT DISTINCT feed, seq FROM extract_files)) WHERE before IS NOT NULL),
n AS (SELECT s.feed, s.seq, s.before, h.path, h.kinds FROM step s JOIN held h ON h.feed = s.feed AND h.seq = s.seq),
o AS (SELECT s.feed, s.seq, s.before, h.path, h.kinds FROM step s JOIN held h ON h.feed = s.feed AND h.seq = s.before),
change AS (SELECT coalesce(n.feed, o.feed) AS feed, coalesce(n.seq, o.seq) AS seq, coalesce(n.before, o.before) AS before, coalesce(n.path, o.path) AS path, o.kinds AS k_before, n.kinds AS k_now,
  CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'retyped' END AS kind FROM n FULL JOIN o ON n.feed = o.feed AND n.seq = o.seq AND n.path = o.path WHERE o.path IS NULL OR n.path IS NULL OR o.kinds <> n.kinds),
shared AS (SELECT s.feed, s.seq, a.item FROM step s JOIN (SELECT DISTINCT feed, seq, item FROM item) a ON a.feed = s.feed AND a.seq = s.seq JOIN (SELECT DISTINCT feed, seq, item FROM item) b ON b.feed = s.feed AND b.seq = s.before AND b.item = a.item),
vals AS (SELECT c.feed, c.seq, c.path, c.kind, list_sort(list(DISTINCT i.item || ' ' || i.val)) AS vs FROM change c JOIN item i ON i.feed = c.feed AND i.seq = CASE c.kind WHEN 'added' THEN c.seq ELSE c.before END AND i.path = c.path AND i.bit > 0
  JOIN shared ON shared.feed = c.feed AND shared.seq = c.seq AND shared.item = i.item WHERE c.kind <> 'retyped' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feed, seq, kind, vs ORDER BY path) AS k FROM vals),
moved AS (SELECT a.feed, a.seq, a.path AS old_path, b.path AS new_path FROM ranked a JOIN ranked b ON a.feed = b.feed AND a.seq = b.seq AND a.vs = b.vs AND a.k = b.k WHERE a.kind = 'removed' AND b.kind = 'added'),
f AS (SELECT c.feed, c.seq, c.path AS field_path, c.kind AS change_kind, CAST(NULL AS VARCHAR) AS old_path, k_before, k_now FROM change c WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.feed = c.feed AND m.seq = c.seq AND (c.kind = 'removed' AND m.old_path = c.path OR c.kind = 'added' AND m.new_path = c.path))
  UNION ALL SELECT m.feed, m.seq, m.new_path, 'renamed', m.old_path, a.k_before, b.k_now FROM moved m JOIN change a ON a.feed = m.feed AND a.seq = m.seq AND a.path = m.old_path AND a.kind = 'removed' JOIN change b ON b.feed = m.feed AND b.seq = m.seq AND b.path = m.new_path AND b.kind = 'added')
"""
_KINDS = "nullif(array_to_string(list_filter([CASE WHEN ({k}) & 1 > 0 THEN 'string' END, CASE WHEN ({k}) & 2 > 0 THEN 'number' END, CASE WHEN ({k}) & 4 > 0 THEN 'boolean' END, CASE WHEN ({k}) & 8 > 0 THEN 'array' END], lambda x: x IS NOT NULL), '|'), '')"

P6_FIELDS = P6_BASE.replace("WITH rec", "WITH RECURSIVE rec", 1) + r""",
was AS (SELECT feed, seq, path, lag(seq) OVER (PARTITION BY feed, path ORDER BY seq) AS last FROM held),
link AS (SELECT w.feed, w.seq, w.path, CASE WHEN m.seq IS NOT NULL THEN s.before WHEN w.last IS NOT NULL AND NOT EXISTS (SELECT 1 FROM moved x WHERE x.feed = w.feed AND x.old_path = w.path AND x.seq > w.last AND x.seq <= w.seq) THEN w.last END AS p_seq, coalesce(m.old_path, w.path) AS p_path
  FROM was w LEFT JOIN moved m ON m.feed = w.feed AND m.seq = w.seq AND m.new_path = w.path LEFT JOIN step s ON s.feed = w.feed AND s.seq = w.seq),
root AS (SELECT feed, seq, path, CASE WHEN row_number() OVER (PARTITION BY feed, path ORDER BY seq) = 1 THEN path ELSE path || '@' || seq END AS name FROM link WHERE p_seq IS NULL),
named AS (SELECT feed, seq, path, name FROM root UNION ALL SELECT l.feed, l.seq, l.path, n.name FROM named n JOIN link l ON l.feed = n.feed AND l.p_seq = n.seq AND l.p_path = n.path),
rows AS (SELECT DISTINCT row_no, feed, seq, payload FROM extract_files WHERE row_no IS NOT NULL AND feed IS NOT NULL),
leaves AS (SELECT l.*, CASE WHEN bit = 8 AND json_array_length(v) = 1 THEN json_extract(v, '$[0]') ELSE v END AS u FROM leaf l WHERE bit > 0)
SELECT r.row_no, r.feed, r.seq, CASE WHEN one = '' THEN '' ELSE '|' || substr(regexp_replace(one, '\[[0-9]+\]', ''), 3) || '=' || coalesce(CAST(json_extract(r.payload, one || '.id') AS VARCHAR), regexp_extract(one, '\[[0-9]+\]', 0)) END
  || CASE WHEN two <> one THEN '|' || substr(regexp_replace(two, '\[[0-9]+\]', '', 'g'), 3) || '=' || coalesce(CAST(json_extract(r.payload, two || '.id') AS VARCHAR), regexp_extract(two, '.*(\[[0-9]+\])', 1)) ELSE '' END AS item,
  CASE WHEN bit = 1 THEN v ->> '$' END AS val_text, CASE WHEN bit = 2 THEN CAST(v AS DOUBLE) END AS val_number, CASE WHEN bit = 2 AND regexp_full_match(CAST(v AS VARCHAR), '-?[0-9]+') THEN TRY_CAST(v AS BIGINT) END AS val_integer,
  CASE WHEN bit = 4 THEN CAST(CAST(v AS BOOLEAN) AS INTEGER) END AS val_flag, CASE WHEN bit = 8 THEN CAST(v AS VARCHAR) END AS val_list, CASE WHEN json_type(u) = 'VARCHAR' THEN u ->> '$' ELSE CAST(u AS VARCHAR) END AS val_text_form, n.name AS field_path
FROM rows r JOIN leaves l ON l.feed = r.feed AND l.seq = r.seq AND l.payload = r.payload JOIN named n ON n.feed = l.feed AND n.seq = l.seq AND n.path = l.path
"""

ORACLE = {
    "p1_found": P1_BASE + "SELECT ref_table, row_id, month_key FROM f",
    "p1_counts": P1_BASE + "SELECT ref_table, target_table, month_key, count(*) AS n_dangling FROM f GROUP BY ALL",
    "p2_hot_keys": f"""
        WITH b AS (SELECT DISTINCT backref_id, defining_shortname, {plain('href')} AS h, ref_shortname, crawled_at FROM backrefs),
        d AS (SELECT DISTINCT {plain('href')} AS h FROM (SELECT href FROM dfns UNION ALL SELECT href FROM core_dfns) WHERE href IS NOT NULL)
        SELECT 'spec' AS key_kind, defining_shortname AS key_value, count(*) AS n_backrefs, count(DISTINCT ref_shortname) AS n_ref_specs, min(crawled_at) AS first_crawled, max(crawled_at) AS last_crawled
        FROM b WHERE defining_shortname IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'definition', d.h, count(b.backref_id), count(DISTINCT ref_shortname), min(crawled_at), max(crawled_at) FROM d LEFT JOIN b USING (h) GROUP BY ALL""",
    "p3_found": P3_BASE + "SELECT * FROM f",
    "p3_counts": P3_BASE + "SELECT snapshot_no, change_kind, count(*) AS n_records FROM f GROUP BY ALL",
    "p4_found": P4_SQL,
    "p4_definitions": P4_BASE + "SELECT CAST(rec_id AS BIGINT) AS rec_id, i || '/' || j AS row_key, 'spec' AS parent_table, CAST(i AS VARCHAR) AS parent_key, CAST(j AS INTEGER) AS pos, " + ", ".join(f"CASE WHEN json_type(dfn -> '{c}') <> 'NULL' THEN dfn ->> '{c}' END AS {c}" for c in ("id", "href", "type")) + " FROM d WHERE json_type(dfn) <> 'NULL'",
    "p6_found": P6_BASE + "SELECT feed, seq, field_path, change_kind FROM f",
    "p6_changes": P6_BASE + "SELECT feed, seq, field_path, change_kind, old_path, " + ", ".join(f"{_KINDS.format(k=k)} AS types_{name}" for name, k in (("before", "coalesce(k_before, 0)"), ("now", "coalesce(k_now, 0)"), ("come", "coalesce(k_now, 0) & ~coalesce(k_before, 0)"), ("gone", "coalesce(k_before, 0) & ~coalesce(k_now, 0)"))) + " FROM f",
    "p6_fields": P6_FIELDS,
    "p5_found": P5_BASE + "SELECT k AS hierarchy, v AS node_id, path AS node_path FROM w ANTI JOIN bad USING (k, v) UNION ALL SELECT k, v, 'cycle' FROM bad",
    "p5_nodes": P5_BASE + """, good AS (SELECT k, v, path, root, depth, CAST(string_split(path, '/') AS BIGINT[]) AS way FROM w ANTI JOIN bad USING (k, v)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY k, root ORDER BY way) - 1 AS pre FROM good),
        size AS (SELECT a.k, a.path, count(*) AS n FROM good a JOIN good b ON a.k = b.k AND a.root = b.root AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY ALL),
        below AS (SELECT k, u, count(*) AS n FROM (SELECT DISTINCT k, u, v FROM up) GROUP BY ALL)
        SELECT r.k AS hierarchy, r.v AS node_id, r.path AS node_path, root AS root_id, depth, 2 * pre - depth AS entry_no, 2 * pre - depth + 2 * s.n - 1 AS exit_no, coalesce(b.n, 0) AS n_descendants, false AS is_endless
        FROM ranked r JOIN size s USING (k, path) LEFT JOIN below b ON b.k = r.k AND b.u = r.v
        UNION ALL SELECT bad.k, bad.v, 'cycle', NULL, NULL, NULL, NULL, coalesce(b.n, 0), true FROM bad LEFT JOIN below b ON b.k = bad.k AND b.u = bad.v""",
    "p5_descendants": P5_BASE + "SELECT DISTINCT k AS hierarchy, u AS ancestor_id, v AS descendant_id FROM up",
}
