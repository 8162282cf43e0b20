"""DuckDB SQL for the registered llm queries that SQL can express on whole tables."""

ORACLES: dict[str, str] = {}

GAPS = r"[\x20\x09-\x0D]+"

ORACLES["op1_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
e AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
wi AS (
  SELECT rid, i, array_to_string(w[i + 1:i + 5], ' ') AS win
  FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - 4, 0))) AS i FROM e)),
rp AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest(range(i, i + 5)) AS p FROM (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wi) WHERE c >= 2) GROUP BY rid),
ls AS (SELECT rid, unnest(l) AS x FROM e),
lf AS (
  SELECT rid, x, length(x) AS n, length(x) - length(replace(x, ' ', '')) + 1 AS gaps,
         length(x) - length(translate(x, '|<>', '')) AS seps,
         length(x) - length(translate(x, '!#*$%&', '')) AS marks,
         right(rtrim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 1) AS last FROM ls),
lk AS (
  SELECT rid, n, NOT ((seps >= 3 AND seps * 100 >= gaps * 25) OR (marks >= 4 AND marks * 100 >= gaps * 30)
    OR (n < 20 AND instr('.!?:;)"''…”’»', last) = 0)
    OR (n <= 200 AND regexp_matches(x, '(?i)(all rights reserved|licensed under|released under the|copyright|privacy policy|terms of (use|service)|cookie|javascript|subscribe|click here|sign (in|up)|lorem ipsum)'))) AS ok
  FROM lf),
la AS (
  SELECT rid, sum(n) AS line_chars, coalesce(sum(n) FILTER (ok), 0) AS kept_line_chars, count(*) AS n_lines,
         count(*) FILTER (ok) AS n_kept_lines FROM lk GROUP BY rid),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(translate(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rp.n, 0)::BIGINT AS n_repeat_words,
    coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(kept_line_chars, 0)::BIGINT AS kept_line_chars,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_kept_lines, 0)::BIGINT AS n_kept_lines
  FROM e LEFT JOIN rp USING (rid) LEFT JOIN la USING (rid)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND kept_line_chars * 100 >= line_chars * 50 AS kept FROM g
"""

ORACLES["op4_sharding"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, coalesce(md5(text), repeat('0', 32)) AS key,
    (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS salt FROM documents),
g AS (SELECT key, sum(size)::BIGINT AS b FROM d GROUP BY key),
p AS (SELECT key, b, sum(b) OVER (ORDER BY key)::BIGINT AS e FROM g),
ends AS (SELECT list(e ORDER BY e) AS es, max(e) AS total FROM p),
search AS (
  SELECT 0::BIGINT AS lo, total AS hi, es, total FROM ends
  UNION ALL
  SELECT CASE WHEN ok THEN lo ELSE mid + 1 END, CASE WHEN ok THEN mid ELSE hi END, es, total FROM (
    SELECT lo, hi, mid, es, total,
      list_reduce(range(8), lambda a, i: coalesce(list_max(list_filter(es, lambda x: x <= a + mid)), a), 0::BIGINT) >= total AS ok
    FROM (SELECT lo, hi, es, total, (lo + hi) // 2 AS mid FROM search WHERE lo < hi))),
best AS (SELECT lo AS cap, es, total FROM search WHERE lo >= hi),
cut(n, pos) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT n + 1, (SELECT coalesce(max(e), pos) FROM p WHERE e <= pos + (SELECT max(cap) FROM best)) FROM cut WHERE n < 8),
sh AS (SELECT key, (SELECT count(*) - 1 FROM cut WHERE pos <= p.e - p.b AND n < 8
                    AND pos < (SELECT max(total) FROM best)) AS shard FROM p),
tab AS (
  SELECT list(c ORDER BY v) AS t FROM (
    SELECT v, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS v))),
crc AS (
  SELECT rid, xor(list_reduce(
      list_transform(range(octet_length(encode(coalesce(text, '')))),
                     lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM d, tab)
SELECT d.doc_id, size, crc AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(d.key, 1, 3), salt, d.key, d.doc_id) - 1)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard
FROM d JOIN sh USING (key) JOIN crc USING (rid)
"""

ORACLES["op7_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (
  SELECT rid, source, i, ls[i] AS line, trim(ls[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM (
    SELECT rid, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
      SELECT rid, source, string_split(text, chr(10)) AS ls FROM d))),
pages AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
bad AS (
  SELECT source, k FROM (SELECT source, k, count(DISTINCT rid) AS n FROM l WHERE k <> '' GROUP BY source, k) s
  JOIN pages USING (source) WHERE n >= 3 AND n > pages * 0.1),
m AS (SELECT l.rid, i, line, bad.k IS NOT NULL AS hit FROM l LEFT JOIN bad ON l.source = bad.source AND l.k = bad.k),
a AS (
  SELECT rid, count(*) AS n, count(*) FILTER (hit) AS dropped, string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit) AS kept
  FROM m GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(dropped, 0)::BIGINT AS n_dropped_lines,
  sha256(CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN a USING (rid)
"""


def _order(n: int, k: int = 5, weight: float = 4.0) -> str:
    """SQL of order n of the character model: gram, pa, pr."""
    sums = f"SELECT substr(gram, {k - n + 1}, {n}) AS gram, sum(acc) AS acc, sum(rej) AS rej FROM top GROUP BY 1"
    if n == 1:
        return (f"o1 AS (SELECT gram, (acc + {weight} * (1.0::DOUBLE / 95)) / (sum(acc) OVER () + {weight})::DOUBLE AS pa, "
                f"(rej + {weight} * (1.0::DOUBLE / 95)) / (sum(rej) OVER () + {weight})::DOUBLE AS pr FROM ({sums}))")
    return (f"o{n} AS (SELECT t.gram, (acc + {weight} * pa) / (na + {weight}) AS pa, (rej + {weight} * pr) / (nr + {weight}) AS pr "
            f"FROM (SELECT *, sum(acc) OVER (PARTITION BY substr(gram, 1, {n - 1})) AS na, "
            f"sum(rej) OVER (PARTITION BY substr(gram, 1, {n - 1})) AS nr FROM ({sums})) t "
            f"JOIN o{n - 1} ON substr(t.gram, 2) = o{n - 1}.gram)")


ORACLES["op3_url_filter"] = r"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT rid, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule, arg_max(v, length(rules.h || rules.p)) AS said
  FROM p JOIN rules ON (p.host = rules.h OR ends_with(p.host, '.' || rules.h)) AND starts_with(p.path, rules.p) GROUP BY rid),
r AS (
  SELECT p.*, rule, said,
    regexp_replace(lower(regexp_replace(host || path, '[^\x20-\x7e]', '~', 'g')), '[1-9]', '0', 'g') AS s
  FROM p LEFT JOIN m USING (rid)),
seen AS (
  SELECT s, substr(md5(s), 1, 1) < '3' AS cal, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b
  FROM r GROUP BY s),
g AS (
  SELECT s, cal, a, b, substr('^^^^' || s || '$', i, 5) AS gram
  FROM (SELECT *, unnest(range(1, length(s) + 2)) AS i FROM seen)),
top AS (
  SELECT gram, sum(CASE WHEN cal THEN 0 ELSE a END) AS acc, sum(CASE WHEN cal THEN 0 ELSE b END) AS rej FROM g GROUP BY gram),
""" + ",\n".join(_order(n) for n in range(1, 6)) + r""",
sc AS (
  SELECT s, any_value(cal) AS cal, any_value(a) AS a, any_value(b) AS b, round(avg(ln(pa / pr)), 9) AS score
  FROM g JOIN o5 USING (gram) GROUP BY s),
mo AS (
  SELECT sum(a) AS na, sum(a * score) / sum(a) AS ma, sum(a * score * score) / sum(a) AS qa,
    sum(b) AS nb, sum(b * score) / sum(b) AS mb, sum(b * score * score) / sum(b) AS qb FROM sc WHERE cal),
sd AS (SELECT *, sqrt(greatest(qa - ma * ma, 0)) AS sa, sqrt(greatest(qb - mb * mb, 0)) AS sb FROM mo),
th AS (
  SELECT CASE WHEN coalesce(na, 0) = 0 OR coalesce(nb, 0) = 0 THEN
      CASE WHEN (SELECT sum(a) FILTER (NOT cal) > 0 AND sum(b) FILTER (NOT cal) > 0 FROM seen) THEN 0.0::DOUBLE ELSE '-infinity'::DOUBLE END
    WHEN sa + sb > 0 THEN round((ma * sb + mb * sa) / (sa + sb), 9) ELSE round((ma + mb) / 2, 9) END AS t FROM sd)
SELECT page_id, host, path, rule,
  coalesce(said, CASE WHEN score >= (SELECT t FROM th) THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN sc USING (s)
"""

ORACLES["op8_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
    FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
    SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, win)),
p AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
t AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""

ORACLES["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM (
    SELECT rid, doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY 1, 2),
l AS (
  SELECT dx.doc_id AS x, dy.doc_id AS y FROM p JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y JOIN d dx ON dx.rid = x JOIN d dy ON dy.rid = y
  WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN c ON c.a = doc_id
"""

ORACLES["op10_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, o, substr(h, 2 * o + 1, 200) AS s FROM (
  SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS o FROM d)),
g AS (SELECT doc_id, o, row_number() OVER (PARTITION BY s ORDER BY doc_id, o) AS k FROM w),
m AS (SELECT doc_id, o, max(o + 100) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM g WHERE k > 1),
r AS (SELECT doc_id, o, sum(CASE WHEN upto IS NULL OR o > upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY o) AS run FROM m),
sp AS (SELECT doc_id, run, min(o) AS a, max(o) + 100 AS b FROM r GROUP BY doc_id, run),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY doc_id),
edges AS (
  SELECT doc_id, 0 AS run, 0 AS a, 0 AS b FROM d UNION ALL SELECT doc_id, run, a, b FROM sp),
k AS (
  SELECT e.doc_id, e.run, substr(h, 2 * e.b + 1,
    2 * (coalesce(lead(e.a) OVER (PARTITION BY e.doc_id ORDER BY e.run), length(h) // 2) - e.b)) AS piece
  FROM edges e JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY run) AS h FROM k GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES["op11_prefix_trie"] = r"""
WITH tab AS (
  SELECT list(c ORDER BY v) AS t FROM (
    SELECT v, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS v))),
o AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT c, xor(list_reduce(list_transform(range(length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, i + 1, 1))::BIGINT),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM o), tab),
q AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, sha256(length(r) || ':' || r || x) AS e, octet_length(encode(x)) AS bytes
  FROM (SELECT h.c, 0 AS own, p, r, x FROM h JOIN o ON o.c = h.c - h.c % 5 AND p <= h
        UNION ALL SELECT h.c, 1, p, r, x FROM h JOIN o ON o.c = h.c AND p > h)),
pre AS (
  SELECT c, 0 AS d, '' AS k, NULL AS up, 0 AS bytes FROM h
  UNION ALL
  SELECT c, d, k, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), ''), bytes
  FROM (SELECT c, d, bytes, sha256(string_agg(e, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM q)),
n AS (SELECT k, d, min(c) AS conv, count(*) AS n, any_value(up) AS up, any_value(bytes) AS bytes FROM pre GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
s AS (
  SELECT pre.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n - 1) * f.bytes) AS saved
  FROM f JOIN pre ON pre.c = f.conv AND pre.d <= f.d GROUP BY pre.k),
e AS (
  SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM pre GROUP BY c) GROUP BY k)
SELECT f.conv AS conv_id, f.d::BIGINT AS depth, a.conv AS parent_conv_id, f.n::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN s USING (k) LEFT JOIN e USING (k) LEFT JOIN n a ON a.k = f.up
"""


def _network(src: str) -> str:
    """SQL of the keyed permutation's six rounds over ``src(x, a, b, k0 ... k5)``: adds y."""
    q = f"SELECT *, x // b AS l0, x % b AS r0 FROM {src}"
    for i in range(6):
        t = f"((r{i} + k{i}) % 2147483647)"
        q = (f"SELECT *, r{i} AS l{i + 1}, (l{i} + ({t} * {t} % 2147483647) * {t} % 2147483647) % {'ab'[i % 2]} AS r{i + 1} "
             f"FROM ({q})")
    return f"SELECT *, l6 * b + r6 AS y FROM ({q})"


_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_KEYS = ", ".join(f"k{i}" for i in range(6))

ORACLES["op12_source_mix"] = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    {_HASH.format("'17|' || coalesce(doc_id::VARCHAR, '')")} AS place, {_HASH.format("text")} AS th FROM documents),
s0 AS (
  SELECT source, size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS si,
    coalesce(sum(size) OVER (ORDER BY source IS NULL, source {_BEFORE}), 0)::BIGINT AS src_start
  FROM (SELECT source, sum(size)::BIGINT AS size FROM d GROUP BY source)),
s1 AS (SELECT *, [5, 2, 1][si % 3 + 1]::BIGINT AS w FROM s0),
s2 AS (
  SELECT *, coalesce(sum(2 * size) OVER (ORDER BY (2 * size)::DOUBLE / w, si {_BEFORE}), 0) AS fill,
    coalesce(sum(w) OVER (ORDER BY (2 * size)::DOUBLE / w, si {_BEFORE}), 0) AS weighed FROM s1),
line AS (
  SELECT max((1.5::DOUBLE * (SELECT sum(size) FROM s1)::DOUBLE - fill::DOUBLE)
    / ((SELECT sum(w) FROM s1) - weighed)::DOUBLE) AS v FROM s2),
s3 AS (SELECT si, source, size, src_start, least((2 * size)::DOUBLE, w::DOUBLE * (SELECT v FROM line)) AS target,
  ((size + 63) // 64)::BIGINT AS blocks FROM s2),
s4 AS (SELECT *, CASE WHEN size > 0 THEN least(floor(target * blocks / size + 0.5)::BIGINT, 2 * blocks) ELSE 0 END AS want FROM s3),
s AS (SELECT *, coalesce(sum(want) OVER (ORDER BY si {_BEFORE}), 0)::BIGINT AS lo FROM s4),
nn AS (SELECT sum(want)::BIGINT AS n FROM s),
draws AS (
  SELECT i // 4096 AS shard, {_HASH.format("'17|draw|' || (i // 4096) || '|' || (i % 4096)")} % n AS x
  FROM (SELECT n, unnest(range(n)) AS i FROM nn)),
c0 AS (SELECT shard, si, count(*)::BIGINT AS n FROM draws JOIN s ON x >= lo AND x < lo + want GROUP BY shard, si),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY si ORDER BY shard {_BEFORE}), 0)::BIGINT AS before FROM c0),
t0 AS (SELECT s.si, want, blocks, coalesce(sum(n), 0)::BIGINT AS drew FROM s LEFT JOIN c0 USING (si) GROUP BY ALL),
t AS (
  SELECT *, coalesce(sum(greatest(drew - want, 0)) OVER (ORDER BY si {_BEFORE}), 0)::BIGINT AS over_at,
    coalesce(sum(greatest(want - drew, 0)) OVER (ORDER BY si {_BEFORE}), 0)::BIGINT AS under_at FROM t0),
sl AS (SELECT shard, c.si, want, over_at, unnest(range(before, before + n)) AS slot FROM c JOIN t USING (si)),
short AS (SELECT si, unnest(range(drew, want)) AS slot, under_at - drew AS shift FROM t WHERE drew < want),
slots AS (
  SELECT shard, si, slot FROM sl WHERE slot < want
  UNION ALL
  SELECT sl.shard, short.si, short.slot FROM sl JOIN short ON sl.over_at + sl.slot - sl.want = short.shift + short.slot
  WHERE sl.slot >= sl.want),
ky AS (SELECT si, epoch, {", ".join(_HASH.format(f"'17|' || si || '|' || epoch || '|{r}'") + f" % 2147483647 AS k{r}" for r in range(6))}
  FROM (SELECT si, unnest([0, 1]) AS epoch FROM s)),
start AS (
  SELECT si, slot, blocks, a, greatest(ceil(blocks / a)::BIGINT, 1) AS b, slot % blocks AS x, {_KEYS}
  FROM (SELECT slots.si, slot, t.blocks, slot // t.blocks AS epoch, greatest(ceil(sqrt(t.blocks))::BIGINT, 1) AS a FROM slots JOIN t USING (si))
  JOIN ky USING (si, epoch)),
walk AS (
  SELECT si, slot, blocks, a, b, y AS x, {_KEYS} FROM ({_network("start")})
  UNION ALL
  SELECT si, slot, blocks, a, b, y, {_KEYS} FROM ({_network("(SELECT * FROM walk WHERE x >= blocks)")})),
used AS (SELECT si, x AS block, count(*) AS times FROM walk WHERE x < blocks GROUP BY si, x),
r AS (
  SELECT rid, doc_id, d.size AS size, s.size AS source_size, target, si,
    (coalesce(sum(d.size) OVER (ORDER BY si, place, doc_id NULLS FIRST, th NULLS FIRST, rid {_BEFORE}), 0) - src_start)::BIGINT AS lo
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (SELECT rid, si, lo, lo + size AS hi, unnest(range(lo // 64, (lo + size - 1) // 64 + 1)) AS block FROM r WHERE size > 0),
k AS (SELECT rid, sum(times * (least(hi, (block + 1) * 64) - greatest(lo, block * 64)))::BIGINT AS taken FROM p JOIN used USING (si, block) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM r LEFT JOIN k USING (rid)
"""
