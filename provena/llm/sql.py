"""DuckDB SQL for the queries that SQL can express over whole tables."""

TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_HOST = r"translate(regexp_extract({0}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract({0}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"

_QUERY = r"regexp_extract({0}, '^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1, 's')"
_ADDRESS = f"({_HOST} || {_PATH} || {_QUERY})"
_SEGMENTS = """list_reduce(
    [[]::VARCHAR[]] || list_transform(string_split(folder || plain, '/')[2:], lambda x: [x]),
    lambda a, b: CASE WHEN b[1] = '..' THEN a[1:len(a) - 1] WHEN b[1] = '.' THEN a ELSE a || b END)"""

URL_FILTER = f"""
WITH RECURSIVE rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), p AS (
  SELECT page_id, url, html, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path, coalesce({_ADDRESS.format('url')}, '') AS node FROM pages
), tags AS (
  SELECT url, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM p WHERE html IS NOT NULL
), targets AS (
  SELECT url, host, path, CASE
    WHEN regexp_matches(tag, '(?i)\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)
  END AS t FROM tags
), pieces AS (
  SELECT *, regexp_extract(url, '^(.*?)://', 1, 's') AS scheme, CASE regexp_replace(path, '[^/]*$', '') WHEN '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS folder,
         regexp_extract(t, '^([^?#]*)', 1, 's') AS plain, regexp_extract(t, '^[^?#]*(.*)$', 1, 's') AS more FROM targets WHERE t <> ''
), walked AS (
  SELECT *, {_SEGMENTS} AS kept, string_split(folder || plain, '/')[-1] AS final FROM pieces
), full_targets AS (
  SELECT url, CASE
    WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t
    WHEN t LIKE '//%' THEN scheme || ':' || t
    WHEN t LIKE '/%' THEN 'http://' || host || t
    WHEN plain LIKE '%://%' OR host = '' THEN t
    WHEN plain = '' THEN scheme || '://' || host || path || more
    ELSE scheme || '://' || host || '/' || array_to_string(kept, '/') || CASE WHEN final IN ('.', '..') AND len(kept) > 0 THEN '/' ELSE '' END || more
  END AS t FROM walked
), edges AS (
  SELECT DISTINCT {_ADDRESS.format('url')} AS a, {_ADDRESS.format('t')} AS b FROM full_targets WHERE t LIKE '%://%'
), both_ways AS (
  SELECT a, b FROM edges WHERE a <> '' AND b <> '' UNION SELECT b, a FROM edges WHERE a <> '' AND b <> ''
), reach(node, seen) AS (
  SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen
), roots AS (
  SELECT node, min(seen) AS root FROM reach GROUP BY node
), judged AS (
  SELECT n.node, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM (SELECT DISTINCT node, host, path FROM p
        UNION SELECT node, {_HOST.format("('x://' || node)")}, {_PATH.format("('x://' || node)")} FROM roots) n
  JOIN rules r ON (n.host = r.rhost OR n.host LIKE '%.' || r.rhost) AND starts_with(n.path, r.rpath)
  GROUP BY n.node
), spread AS (
  SELECT root, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS v
  FROM roots LEFT JOIN judged USING (node) GROUP BY root
)
SELECT p.page_id, p.host, p.path, j.rule, coalesce(j.verdict, s.v, 'allow') AS verdict, r.root AS alias_root
FROM p LEFT JOIN judged j ON j.node = p.node AND p.host <> ''
LEFT JOIN roots r ON r.node = p.node LEFT JOIN spread s ON s.root = r.root
"""

#: Every third page names another as its canonical address, in turn by all kinds of link; every seventh redirects.
LINKED_PAGES = """
linked AS (
  SELECT page_id, url, coalesce(html, '') || CASE
    WHEN page_id % 21 = 0 THEN '<meta http-equiv="refresh" content="0; url=http://hub.example.net/de/' || page_id % 5 || '">'
    WHEN page_id % 15 = 0 THEN '<link rel="canonical" href="//mirror' || page_id % 4 || '.example.org/fr/x?p=' || page_id % 3 || '">'
    WHEN page_id % 12 = 0 THEN '<link rel="canonical" href="../fr/./all?p=' || page_id % 7 || '#top">'
    WHEN page_id % 3 = 0 THEN '<link href="/index?page=' || page_id % 2 || '" rel="canonical">'
    WHEN page_id % 7 = 0 THEN '<meta http-equiv=refresh content="0; url=http://hub.example.net/de/' || page_id % 5 || '">'
    ELSE '' END AS html FROM pages
)"""
LINKED_URL_FILTER = URL_FILTER.replace("FROM pages\n", "FROM linked\n").replace("WITH RECURSIVE rules", "WITH RECURSIVE" + LINKED_PAGES + ", rules")

QUOTATIONS = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, text, row_number() OVER (ORDER BY conv_id, turn, text) AS rid FROM conversations
), l AS (
  SELECT rid, conv_id, turn, i, x, length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(x, '^((?:[ \t]*>)+)[ \t]?', '')) AS body
  FROM (SELECT rid, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM m)
), marked AS (
  SELECT *, coalesce(level <> lag(level) OVER w OR body = '' OR lag(body) OVER w = '', true)::INTEGER AS opens,
         lead(level) OVER w AS below FROM l WINDOW w AS (PARTITION BY rid ORDER BY i)
), runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY rid ORDER BY i) AS run FROM marked
), passages AS (
  SELECT rid, conv_id, turn, level, md5(trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY i)), '[ \t\r\x0b\x0c]+', ' ', 'g'))) AS key
  FROM runs GROUP BY rid, conv_id, turn, run, level HAVING string_agg(body, ' ' ORDER BY i) <> ''
), quotes AS (
  SELECT DISTINCT conv_id, turn, level, key FROM passages WHERE level > 0
), within AS (
  SELECT key, conv_id, min(turn) AS own_turn FROM passages WHERE level = 0 GROUP BY ALL
), firsts AS (
  SELECT key, min({'c': conv_id, 't': own_turn}) AS at FROM within GROUP BY key
), found AS (
  SELECT q.conv_id, q.turn, q.level,
         CASE WHEN w.own_turn < q.turn THEN q.conv_id WHEN f.at.c <> q.conv_id THEN f.at.c END AS to_conv,
         CASE WHEN w.own_turn < q.turn THEN w.own_turn WHEN f.at.c <> q.conv_id THEN f.at.t END AS to_turn
  FROM quotes q LEFT JOIN within w USING (key, conv_id) LEFT JOIN firsts f USING (key)
), per AS (
  SELECT conv_id, turn, count(*) AS n_quotes, max(level) AS quote_depth, count(to_conv) AS n_linked,
         min({'o': to_conv <> conv_id, 'l': level, 'b': -to_turn, 'c': to_conv, 't': to_turn}) FILTER (WHERE to_conv IS NOT NULL) AS best
  FROM found GROUP BY conv_id, turn
), up(conv_id, turn, root, depth) AS (
  SELECT conv_id, turn, best.t, 1 FROM per WHERE best.c = conv_id
  UNION SELECT u.conv_id, u.turn, p.best.t, u.depth + 1 FROM up u JOIN per p ON p.conv_id = u.conv_id AND p.turn = u.root WHERE p.best.c = p.conv_id
), roots AS (
  SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM up GROUP BY ALL
), bodies AS (
  SELECT rid, regexp_replace(string_agg(x, chr(10) ORDER BY i), '^[ \n]+|[ \n]+$', '', 'g') AS body
  FROM runs WHERE level = 0 AND NOT (regexp_matches(x, '(?i)^[^>]*\bwrote:[ \t]*$') AND coalesce(below, 0) > 0) GROUP BY rid
)
SELECT m.conv_id, m.turn, coalesce(n_quotes, 0)::BIGINT AS n_quotes, coalesce(quote_depth, 0)::INTEGER AS quote_depth,
       coalesce(n_linked, 0)::BIGINT AS n_linked, best.c::BIGINT AS parent_conv, best.t::BIGINT AS parent_turn,
       coalesce(r.root, m.turn)::BIGINT AS root_turn, coalesce(r.depth, 0)::BIGINT AS reply_depth,
       CASE WHEN text LIKE '%>%' THEN coalesce(body, '') ELSE text END AS body
FROM m LEFT JOIN per p USING (conv_id, turn) LEFT JOIN roots r USING (conv_id, turn) LEFT JOIN bodies USING (rid)
"""

#: Every turn but the first quotes the first paragraph of the one before it; every fourth quotes the one before that too, a
#: level deeper, and every fifth conversation quotes the first paragraph that another one begins with.
QUOTED_TURNS = r"""
quoted AS (
  SELECT c.conv_id, c.turn, CASE
    WHEN b.turn IS NOT NULL AND a.turn IS NOT NULL AND c.turn % 4 = 2 THEN 'On Monday ' || b.role || ' wrote:' || chr(10) || '>> ' || replace(string_split(a.text, chr(10))[1], ' ', '  ') || chr(10) || '> ' || string_split(b.text, chr(10))[1] || chr(10) || chr(10)
    WHEN b.turn IS NOT NULL THEN '> ' || string_split(b.text, chr(10))[1] || chr(10)
    WHEN o.turn IS NOT NULL THEN '> > ' || string_split(o.text, chr(10))[1] || chr(10)
    ELSE '' END || c.text AS text
  FROM conversations c LEFT JOIN conversations b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1
  LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn - 2
  LEFT JOIN conversations o ON c.conv_id % 5 = 0 AND c.turn = 0 AND o.turn = 0 AND o.conv_id = c.conv_id + 1
)"""
QUOTED_LINKS = QUOTATIONS.replace("FROM conversations\n", "FROM quoted\n").replace("WITH RECURSIVE m AS", "WITH RECURSIVE" + QUOTED_TURNS + ", m AS")


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _levels(name: str, first: str, heights: int) -> str:
    """Tables name_0 to name_{heights} of nodes (g, i, h, m: nodes of the group) over a first one, and name_run_k of runs of 16."""
    out = [f"{name}_0 AS ({first})"]
    for k in range(heights):
        out.append(f"{name}_run_{k} AS (SELECT g, i // 16 AS i, string_agg(h, '' ORDER BY i) AS run, any_value(m) AS m FROM {name}_{k} GROUP BY g, i // 16)")
        out.append(f"{name}_{k + 1} AS (SELECT g, i, CASE WHEN m = 1 THEN run ELSE sha256(run) END AS h, (m + 15) // 16 AS m FROM {name}_run_{k})")
    return ",\n".join(out)


def _climb(name: str, first: str, heights: int) -> str:
    """Tables up_name_0 to up_name_{heights}: the rows of a first one with what is folded and the siblings so far."""
    out = [f"up_{name}_0 AS ({first})"]
    for k in range(heights):
        a, b = "left(run, 64 * (u.i % 16))", "substr(run, 64 * (u.i % 16) + 65)"
        out.append(
            f"up_{name}_{k + 1} AS (SELECT u.* REPLACE (u.i // 16 AS i, CASE WHEN m = 1 THEN f ELSE sha256({a} || f || {b}) END AS f, CASE WHEN m = 1 THEN p ELSE p || {a} || {b} END AS p)"
            f" FROM up_{name}_{k} u JOIN {name}_run_{k} r ON r.g = u.g AND r.i = u.i // 16)"
        )
    return ",\n".join(out)


_CRC = """list_reduce(flatten([[4294967295::UBIGINT]] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: [ord(substr(doc_id::VARCHAR, j, 1))::UBIGINT] || list_transform(range(8), lambda z: 4294967296::UBIGINT))),
    lambda acc, x: CASE WHEN x = 4294967296 THEN xor(acc >> 1, CASE WHEN acc % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) ELSE xor(acc, x) END)"""
_HASHED = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))

MANIFEST = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS g, sha256({_HASHED} || {_field('text')}) AS h,
         CASE WHEN xor({_CRC}, 4294967295::UBIGINT) % 5 = 0
              THEN sha256({_HASHED} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS t
  FROM documents
), l AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d
), {_levels('n', 'SELECT g, i, h, m FROM l', 6)},
s AS (SELECT g AS member, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM n_6),
{_levels('r', "SELECT 'forest' AS g, i, h, m FROM s", 4)},
{_climb('n', "SELECT doc_id, g, i, h AS leaf, coalesce(t, h) AS f, '' AS p FROM l", 6)},
{_climb('r', "SELECT u.* REPLACE ('forest' AS g, s.i AS i), s.h AS subroot FROM up_n_6 u JOIN s ON s.member = u.g", 4)}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM up_r_4, r_4 r
"""

#: Of pages whose one article is an element of that name: its text without tags. What recurs on a host lies outside it there.
ARTICLES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
d AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS x FROM t),
e AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars, 0::INTEGER AS n_template FROM e
"""
