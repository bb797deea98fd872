"""SQL for DuckDB that must give the same rows as the query of the same name."""

SPACES = r"[\x20\x09-\x0D]"

OP5 = rf"""WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, sha256(regexp_replace(coalesce(text, ''), '{SPACES}', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)"""

OP9 = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s),
e AS (SELECT DISTINCT doc_id, md5(array_to_string(sh, ' ')) AS h FROM (SELECT doc_id, unnest(shingles) AS sh FROM s)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
    WHERE 100 * common >= 75 * (a.n_shingles + b.n_shingles - common)),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.x = n.doc_id"""

OP6 = r"""WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, source IS NULL AS bare, coalesce(source, '') AS name,
    ('0x' || substr(md5('1/shard:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS lot,
    ('0x' || substr(md5('1/order:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS turn FROM documents),
s AS (SELECT bare, name, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY bare, name) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY bare, name),
-- sources in the order in which they reach three times their size; the level if exactly those before are full
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM s
    WINDOW before AS (ORDER BY source_size::DOUBLE / weight, bare, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(source_size * 3.0::DOUBLE, weight * (SELECT level FROM l WHERE source_size * 3 > weight * level
        ORDER BY source_size::DOUBLE / weight, bare, name LIMIT 1)) AS target,
    (SELECT floor(sum(source_size) / 16 + 0.5) FROM s)::BIGINT AS house FROM s),
q AS (SELECT bare, name, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, bare, name) AS place, house
    FROM (SELECT *, unnest(range(0, house)) AS k FROM t)),
b AS (SELECT t.bare, t.name, source_size, target, count(q.name) AS blocks, greatest(1, ceil(source_size / 262144))::BIGINT AS shards
    FROM t LEFT JOIN q ON q.bare = t.bare AND q.name = t.name AND q.place <= q.house GROUP BY t.bare, t.name, source_size, target),
p AS (SELECT d.*, source_size, target, blocks, lot % shards AS shard FROM d JOIN b ON b.bare = d.bare AND b.name = d.name),
h AS (SELECT bare, name, shard, sum(size)::BIGINT AS words, any_value(blocks) AS blocks,
    greatest(1, round(sum(size) / 16))::BIGINT AS parts FROM p GROUP BY bare, name, shard),
r AS (SELECT bare, name, shard, blocks, row_number() OVER (PARTITION BY bare, name ORDER BY words / (2 * k + 1) DESC, shard) AS place
    FROM (SELECT *, unnest(range(0, blocks)) AS k FROM h)),
z AS (SELECT h.bare, h.name, h.shard, words, parts, least(count(r.name), 3 * parts) AS seats
    FROM h LEFT JOIN r ON r.bare = h.bare AND r.name = h.name AND r.shard = h.shard AND r.place <= r.blocks GROUP BY h.bare, h.name, h.shard, words, parts),
n AS (SELECT p.*, seats // parts AS rounds, ((seats % parts) * words) // parts AS front, coalesce(sum(size) OVER w, 0) AS start
    FROM p JOIN z ON z.bare = p.bare AND z.name = p.name AND z.shard = p.shard
    WINDOW w AS (PARTITION BY p.bare, p.name, p.shard ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, size::BIGINT AS size, source_size, target, (rounds * size + greatest(0, least(size, front - start)))::BIGINT AS taken FROM n"""

OP12 = r"""WITH l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
r AS (SELECT k.*, keeper IS NULL OR doc_id = keeper AS stays FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256 FROM r GROUP BY doc_id"""

SQL = {"op5_exact_copies": OP5, "op6_mix": OP6, "op9_near_copies": OP9, "op12_common_lines": OP12}
