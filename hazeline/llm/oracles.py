"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from hazeline.llm import linkgraph, phrases, sharding


def _draw(parent: str, child: str, weight: str) -> str:
    digest = f"md5({parent} || '/' || {child} || '/' || k)"
    return f"-ln((CAST(('0x' || substr({digest}, 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight}"


def _descend(name: str, shards: int) -> str:
    nodes = ", ".join(
        f"({r}, {k}, {s}, {w})" for r, racks in sharding.even_tree(shards).items() for k, own in racks.items() for s, w in own.items()
    )
    return f"""
{name}_nodes AS (SELECT * FROM (VALUES {nodes}) t(region, rack, shard, w)),
{name}_1 AS (SELECT k, arg_min(region, {_draw("'top'", "region", "w")}) AS region
  FROM keys, (SELECT region, sum(w) AS w FROM {name}_nodes GROUP BY 1) GROUP BY 1),
{name}_2 AS (SELECT k, any_value(region) AS region, arg_min(rack, {_draw("'region/' || region", "rack", "w")}) AS rack
  FROM {name}_1 JOIN (SELECT region, rack, sum(w) AS w FROM {name}_nodes GROUP BY 1, 2) USING (region) GROUP BY 1),
{name} AS (SELECT k, arg_min(shard, {_draw("'rack/' || region || '/' || rack", "shard", "w")}) AS shard
  FROM {name}_2 JOIN {name}_nodes USING (region, rack) GROUP BY 1)"""


def _crc_table() -> str:
    """CTEs up to crc_table, made by the rule of CRC-32 (reflected polynomial 0xEDB88320)."""
    step = "CASE WHEN {0} % 2 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    rounds = ", ".join(f"t{i + 1} AS (SELECT i, {step.format('c')} AS c FROM t{i})" for i in range(8))
    return f"""t0 AS (SELECT i, CAST(i AS BIGINT) AS c FROM range(256) r(i)), {rounds},
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM t8)"""


def shards_sql() -> str:
    return f"""
WITH {_crc_table()},
texts AS (SELECT DISTINCT coalesce(text, '') AS txt FROM documents),
hexed AS (SELECT txt, hex(encode(txt)) AS h, octet_length(encode(txt)) AS n FROM texts),
bytes AS (SELECT txt, list_transform(range(n), lambda j: CAST(('0x' || substr(h, CAST(2 * j + 1 AS INT), 2)) AS BIGINT)) AS b FROM hexed),
crcs AS (SELECT txt, xor(list_reduce(b, lambda a, x: xor(a >> 8, tab[CAST(xor(a, x) & 255 AS INT) + 1]), 4294967295::BIGINT), 4294967295) AS crc
  FROM bytes, crc_table),
rows AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(text, '') AS txt FROM documents),
keys AS (SELECT DISTINCT k FROM rows),
{_descend("now", sharding.SHARDS)},
{_descend("grown", sharding.SHARDS + 1)},
placed AS (SELECT doc_id, CAST(size AS BIGINT) AS size, crc, now.shard AS shard, grown.shard AS grown_shard,
    CAST(('0x' || substr(md5('slot/' || rows.k || '/' || size || '/' || crc), 1, 13)) AS BIGINT) AS point
  FROM rows JOIN crcs USING (txt) JOIN now ON rows.k = now.k JOIN grown ON rows.k = grown.k)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY point, doc_id, size, crc) - 1 AS slot, grown_shard
FROM placed
"""


def pages_sql() -> str:
    fits = []
    for _, rule in linkgraph.RULES:
        name, slash, rest = rule.partition("/")
        fits.append(f"('{rule}', '{name}', '{slash}{rest}')")
    kinds = ", ".join(f"('{k}', '{r}')" for k, r in linkgraph.RULES)
    link = linkgraph.LINK.replace("'", "''")
    d, n = linkgraph.DAMPING, linkgraph.most_rounds()
    turns = [
        f"""s{i + 1} AS (SELECT kind, "to" AS host, sum(score * share * {d}) AS score FROM s{i} JOIN steps USING (kind, host) GROUP BY 1, 2)"""
        for i in range(n)
    ]
    every = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(n + 1))
    return f"""
WITH p AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, url FROM pages),
q AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
fits(rule, name, start) AS (VALUES {", ".join(fits)}),
kinds(own, rule) AS (VALUES {kinds}),
j AS (SELECT page_id, html, host, path,
    (SELECT max_by(rule, length(rule)) FROM fits WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)) AS rule FROM q),
judged AS (SELECT j.*, own FROM j LEFT JOIN kinds USING (rule)),
seeds AS (SELECT CASE own WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, CAST(count(*) AS DOUBLE) AS seed
  FROM judged WHERE own IS NOT NULL AND host != '' GROUP BY 1, 2),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM q),
edges AS (SELECT src, dst, count(*) AS links FROM links WHERE src != '' AND dst != '' AND src != dst GROUP BY 1, 2),
ways AS (SELECT 'trust' AS kind, src AS host, dst AS "to", links FROM edges UNION ALL SELECT 'distrust', dst, src, links FROM edges),
steps AS (SELECT kind, host, "to", links / sum(links) OVER (PARTITION BY kind, host) AS share FROM ways),
s0 AS MATERIALIZED (SELECT kind, host, seed * {1 - d} AS score FROM seeds),
{", ".join(turns).replace(" AS (", " AS MATERIALIZED (")},
hosts AS (SELECT host, (t - b) / (t + b) AS host_score FROM (SELECT host, sum(CASE kind WHEN 'trust' THEN score ELSE 0 END) AS t,
  sum(CASE kind WHEN 'distrust' THEN score ELSE 0 END) AS b FROM ({every}) GROUP BY 1))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN host_score < {linkgraph.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(host_score, 0.0), 6) AS host_score
FROM judged LEFT JOIN hosts USING (host)
"""


WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def repeats_sql() -> str:
    return f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
firsts AS (SELECT h, min(doc_id * 4294967296 + i) AS first FROM win GROUP BY 1),
later AS (SELECT doc_id, i FROM win JOIN firsts USING (h) WHERE doc_id * 4294967296 + i > first),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
marked AS (SELECT words.doc_id, word, words.i AS i, max(CAST(later.i IS NOT NULL AS INTEGER)) OVER (PARTITION BY words.doc_id ORDER BY words.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone
  FROM words LEFT JOIN later ON words.doc_id = later.doc_id AND words.i = later.i),
done AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN done USING (doc_id)
"""


def lines_sql() -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, line, doc_id * 4294967296 + line AS place, list_sort(list_distinct({WORDS.format("t")})) AS ws FROM l),
sets AS (SELECT ws, min(place) AS first, len(ws) AS n, row_number() OVER () AS id FROM s WHERE len(ws) > 0 GROUP BY ws),
tok AS (SELECT id, n, first, unnest(ws) AS w FROM sets),
df AS (SELECT w, count(*) AS c FROM tok GROUP BY 1),
ranked AS (SELECT id, n, first, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS r FROM tok JOIN df USING (w)),
pre AS (SELECT * FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM pre a JOIN pre b ON a.w = b.w AND a.first > b.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
late AS (SELECT DISTINCT x FROM cand JOIN sets a ON a.id = x JOIN sets b ON b.id = y WHERE 9 * len(list_intersect(a.ws, b.ws)) >= 4 * (a.n + b.n)),
judged AS (SELECT doc_id, line, x IS NOT NULL OR place > first AS removed FROM s JOIN sets USING (ws) LEFT JOIN late ON id = x)
SELECT d.doc_id, count(line) AS n_lines, CAST(count_if(removed) AS BIGINT) AS n_removed, coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (WHERE removed), '') AS removed_lines
FROM documents d LEFT JOIN judged USING (doc_id) GROUP BY d.doc_id
"""


def phrases_sql() -> str:
    runs = "\n  UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(ws[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})".replace("- -1", "+ 1")
        for k in range(1, phrases.MOST_WORDS + 1)
    )
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, phrase, count(*) AS f FROM ({runs}) GROUP BY 1, 2, 3 HAVING count(*) >= {phrases.THRESHOLD}),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, k, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, cuts.k, j, x.f AS l, y.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head AND x.k = j JOIN f y ON y.lang = cuts.lang AND y.phrase = rest AND y.k = cuts.k - j),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + n - 1], ' ') AS phrase, max(a) AS cover
  FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM c WHERE k > 2)) GROUP BY 1, 2),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE cover IS NULL OR CAST(cover AS HUGEINT) * 100 < CAST(a AS HUGEINT) * {phrases.COVERED}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= {phrases.MOST_RANKS}
"""


def conversations_sql() -> str:
    """The edits are tried row by row; of the ways to one state the least cost and then the least audit goes on."""
    return f"""
WITH RECURSIVE {_crc_table()},
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS b FROM conversations),
hit AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(range(octet_length(b)), lambda j: CAST(('0x' || substr(hex(b), CAST(2 * j + 1 AS INT), 2)) AS BIGINT)),
  lambda a, x: xor(a >> 8, tab[CAST(xor(a, x) & 255 AS INT) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS h FROM said, crc_table),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, substr(role, 1, 1) AS own FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o),
r AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(own) OVER (PARTITION BY conv_id ORDER BY i) || own AS pair FROM s),
nx(state, nxt, word) AS (VALUES ('', 'u', 'user'), ('s', 'u', 'user'), ('u', 'a', 'assistant'), ('a', 'u', 'user')),
heads AS (SELECT state, state AS base, '' AS pre, 0 AS paid, CAST([] AS VARCHAR[]) AS added FROM nx UNION ALL SELECT state, nxt, 'I', 3, [word || ':'] FROM nx),
ways AS (SELECT heads.state AS state, base, pre, paid, added, nxt, word, way FROM heads JOIN nx ON nx.state = base, (VALUES ('D'), ('K'), ('R')) v(way)),
walk(conv_id, i, state, cost, audit, said_rows) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM r
  UNION ALL
  SELECT conv_id, i, state, best.cost, best.audit, best.rows FROM (
    SELECT walk.conv_id, r.i, CASE way WHEN 'D' THEN base WHEN 'K' THEN own ELSE nxt END AS state, min({{'cost': cost + paid
        + CASE way WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN way != 'D' AND fault = 'truncated' THEN 3 ELSE 0 END, 'audit': audit || pre || way,
        'rows': list_concat(list_concat(said_rows, added), CASE way WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [word || ':' || text] END)}}) AS best
    FROM walk JOIN r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.i = walk.i + 1 JOIN ways ON ways.state = walk.state
    WHERE way = 'D' OR fault NOT IN ('blank', 'duplicate') AND (way = 'R' OR own = nxt OR own = 's' AND base = '') GROUP BY 1, 2, 3)),
ends AS (SELECT walk.conv_id, min({{'cost': cost + CASE state WHEN 'u' THEN 3 ELSE 0 END, 'audit': audit || CASE state WHEN 'u' THEN 'I' ELSE '' END,
    'rows': list_concat(said_rows, CASE state WHEN 'u' THEN ['assistant:'] ELSE [] END)}}) AS best
  FROM walk JOIN (SELECT conv_id, max(i) AS n FROM r GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM walk.conv_id AND walk.i = n WHERE state != 's' GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
  count_if(fault = 'truncated') AS truncated, count_if(pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id
"""
