"""DuckDB SQL of the queries that SQL can express, written from their
contracts and not from the operators."""

#: Words of five-word shingles, shared shingles by a join, links, and the
#: smallest id reachable.
JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : least(i + 4, len(w))], ' ') || CASE WHEN len(w) < 5 THEN ' ' ELSE '' END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT DISTINCT a AS node, a AS seen FROM both_ways
  UNION
  SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.seen = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) m ON m.node = d.doc_id
"""

#: All pairs of whole vectors by cosine, links, and the smallest id reachable.
COSINE_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
normed AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM vectors WHERE list_dot_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
reach AS (
  SELECT DISTINCT a AS node, a AS seen FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
parts AS (SELECT node, min(seen) AS c FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counts ON a = vec_id LEFT JOIN parts ON node = vec_id
"""

#: Shares, a bisection of the exponent on multiples of 2^-24, quotas, and a
#: running sum over every use of every document.
MIXING_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, ''))) AS mark,
         greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS tokens FROM documents),
s AS (SELECT k, CAST(sum(tokens) AS BIGINT) AS t, count(*) AS n, sum(tokens) / (SELECT CAST(sum(tokens) AS DOUBLE) FROM d) AS p FROM d GROUP BY k),
bisect AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT max(p) / min(p) FROM s) ^ (1 - (lo + hi) / 2) <= 1.5 AS fits FROM bisect WHERE step < 24)),
a AS (SELECT CASE WHEN (SELECT max(p) / min(p) FROM s) <= 1.5 THEN 0.0 ELSE hi END AS a FROM bisect WHERE step = 24),
w AS (SELECT k, t, n, p ^ a / (SELECT sum(p ^ a) FROM s, a) AS weight FROM s, a),
q AS (SELECT *, weight * (SELECT max(t / weight) FROM w) AS quota, CAST(ceil(n / 1000) AS BIGINT) AS blocks FROM w),
uses AS (
  SELECT d.*, q.t, weight, quota, CAST('0x' || md5('mix|' || mark)[1:8] AS BIGINT) % blocks AS block,
         unnest(range(1, CAST(greatest(ceil(quota / t - 1e-9), 1) AS BIGINT) + 1)) AS epoch
  FROM d JOIN q USING (k)),
runs AS (
  SELECT *, (epoch - 1) * t + coalesce(sum(tokens) OVER (PARTITION BY k, epoch
      ORDER BY md5('mix|' || epoch || '|' || block), block, md5('mix|' || epoch || '|' || mark), mark, tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM uses),
starts AS (SELECT *, min(before) OVER (PARTITION BY k, epoch, block) AS block_before FROM runs)
SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, round(weight, 9) AS weight, CAST(epoch AS INTEGER) AS epoch, block,
       round(block_before / quota, 9) AS "at"
FROM starts WHERE before < quota * (1 + 1e-12)
"""

#: The derived records, written out again, and an as-of lookup by id.
REVISIT_SQL = r"""
WITH p AS (
  SELECT coalesce(page_id, 0) AS p, url, coalesce(html, '') AS body, 1600000000 + coalesce(page_id, 0) * 7919 % 1000003 AS start FROM pages),
t AS (SELECT *, '"' || md5(body)[1:12] || '"' AS tag, '"' || md5(body || 'v2')[1:12] || '"' AS newer, p % 3 = 0 AS second,
             'day ' || CAST(floor(start / 86400) AS BIGINT) AS modified FROM p),
full_responses AS (
  SELECT p * 4 AS id, url AS uri, start AS ts, CASE WHEN p % 7 <> 0 THEN tag END AS etag, CASE WHEN p % 14 <> 0 THEN modified END AS modified, body,
         [['Content-Type', 'text/html'], ['Content-Length', CAST(length(body) AS VARCHAR)], ['ETag', CASE WHEN p % 7 <> 0 THEN tag END],
          ['Last-Modified', CASE WHEN p % 14 <> 0 THEN modified END], ['Cache-Control', 'max-age=60'], ['Server', 'a']] AS headers FROM t
  UNION ALL
  SELECT p * 4 + 1, url, start + 864000, 'W/' || newer, NULL, body || 'v2',
         [['content-type', 'text/html'], ['etag', 'W/' || newer], ['X-Copy', '2']] FROM t WHERE second),
revisits AS (
  SELECT p * 4 + 2 AS id, upper(regexp_extract(url, '^[a-z]+://[^/?#]*')) || regexp_replace(url, '^[a-z]+://[^/?#]*', '') || '#part' AS uri,
         start + 1728000 AS ts, CASE WHEN p % 5 = 0 THEN '"other"' WHEN p % 7 <> 0 THEN CASE WHEN second THEN newer ELSE tag END END AS etag, modified,
         [['ETag', CASE WHEN p % 5 = 0 THEN '"other"' WHEN p % 7 <> 0 THEN CASE WHEN second THEN newer ELSE tag END END], ['Last-Modified', modified],
          ['Cache-Control', 'max-age=600'], ['Content-Length', '0'], ['Connection', 'close, X-Hop'], ['X-Hop', '1'], ['Date', 't' || start]] AS headers FROM t
  UNION ALL
  SELECT p * 4 + 3, url, start + CASE WHEN p % 11 = 0 THEN -86400 ELSE 432000 END, 'W/' || tag, NULL, [['ETag', 'W/' || tag]] FROM t),
every AS (SELECT id, uri, ts, etag, modified, body, list_filter(headers, lambda h: h[2] IS NOT NULL) AS headers, TRUE AS is_full FROM full_responses
          UNION ALL SELECT id, uri, ts, etag, modified, NULL, list_filter(headers, lambda h: h[2] IS NOT NULL), FALSE FROM revisits),
bare AS (SELECT *, regexp_replace(trim(uri), '#.*$', '') AS u FROM every),
split AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)(.*)$', 1)) AS scheme,
  regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)(.*)$', 2)), '^.*@', '') AS host,
  regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)(.*)$', 3) AS rest FROM bare),
named AS (SELECT *, CASE WHEN scheme = '' THEN u ELSE scheme || '://' ||
    CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END ||
    CASE WHEN regexp_extract(rest, '^[^?]*') = '' THEN '/' ELSE regexp_extract(rest, '^[^?]*') END ||
    CASE WHEN regexp_extract(rest, '^[^?]*[?](.*)$', 1) = '' THEN '' ELSE
      '?' || array_to_string(list_sort(string_split(regexp_extract(rest, '^[^?]*[?](.*)$', 1), '&')), '&') END END AS url FROM split),
refs AS (
  SELECT r.id AS rid, max(struct_pack(ts := f.ts, id := f.id)).id AS ref_id
  FROM named r JOIN named f ON f.is_full AND NOT r.is_full AND f.url = r.url AND f.ts < r.ts GROUP BY r.id),
judged AS (
  SELECT r.id AS record_id, r.url, ref_id, r.headers AS new, f.headers AS old, f.body,
         CASE WHEN r.url IS NULL THEN 'unplaced' WHEN ref_id IS NULL THEN 'no_earlier_response'
              WHEN r.etag IS NOT NULL AND f.etag IS NOT NULL THEN
                CASE WHEN regexp_replace(r.etag, '^W/', '') = regexp_replace(f.etag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
              WHEN r.modified IS NOT NULL AND f.modified IS NOT NULL THEN
                CASE WHEN r.modified = f.modified THEN 'resolved' ELSE 'validator_mismatch' END
              ELSE 'no_validator' END AS outcome
  FROM named r LEFT JOIN refs ON rid = r.id LEFT JOIN named f ON f.is_full AND f.id = ref_id WHERE NOT r.is_full),
updates AS (SELECT *, list_filter(new, lambda h: lower(h[1]) NOT IN ('content-length', 'connection', 'x-hop')) AS up FROM judged),
final AS (SELECT *, CASE WHEN outcome = 'resolved' THEN
    list_concat(list_filter(old, lambda h: NOT list_contains(list_transform(up, lambda g: lower(g[1])), lower(h[1]))), up) ELSE new END AS hs FROM updates)
SELECT record_id, url, ref_id, outcome, sha256(array_to_string(list_transform(hs, lambda h: h[1] || ': ' || h[2]), chr(13) || chr(10))) AS headers_sha256,
       CASE WHEN outcome = 'resolved' THEN sha256(body) END AS payload_sha256
FROM final
"""


def crc32_sql(points: str) -> str:
    """crc32 of a list of code points up to U+00FF as UTF-8, four bits a step."""
    halves = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p & 15, p >> 4] ELSE [3, 12, (p - 64) & 15, (p - 64) >> 4] END))"
    # The reflected polynomial's remainders of 0 to 15.
    table = """[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
                3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"""
    step = f"lambda c, b: xor(c >> 4, ({table})[(xor(c, b) & 15) + 1])"
    return f"xor(list_reduce(list_transform({halves}, lambda b: CAST(b AS BIGINT)), {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _points(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '(?s).'), lambda p: unicode(p))"


#: Words after the slips, near words by what is left without one letter, forms
#: and the last form reachable.
VARIANTS_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
slips AS (SELECT run, c, {crc32_sql(_points("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM runs),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word,
         CAST(sum(c) AS BIGINT) AS n
  FROM slips GROUP BY 1 HAVING length(word) >= 7 AND n >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT a.word AS w, b.word AS v, b.n AS vn FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.d = b.word),
best AS (SELECT w, count(*) AS n_near, first(v ORDER BY vn DESC, v) AS v, max(vn) AS vn FROM near GROUP BY w),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN vn >= 10 * n THEN v END AS form, CASE WHEN vn >= 10 * n THEN vn END AS form_n
  FROM words LEFT JOIN best ON w = word),
follow AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL
  SELECT f.word, g.form, step + 1 FROM follow f JOIN formed g ON g.word = f.root WHERE g.form IS NOT NULL)
SELECT formed.word, form, last AS root, n, n_near, form_n
FROM formed JOIN (SELECT word, last(root ORDER BY step) AS last FROM follow GROUP BY word) r ON r.word = formed.word
"""

#: The smallest document of every 13-word window, and the words under windows
#: that a smaller document has.
SUBSTRING_SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
spans AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM words)),
least AS (SELECT s, min(doc_id) AS m FROM spans GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM spans JOIN least USING (s) WHERE m < doc_id),
places AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS k
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_BACK = """
  SELECT conv, i, [least(m[1], 5 + least(m[3], 5 + m[4])), least(m[2], 5 + least(m[3], 5 + m[4])), least(m[3], 5 + m[4]), least(m[4], 5 + m[3])] AS v
  FROM (SELECT r.conv, r.i, list_transform([1, 2, 3, 4], lambda q: least(
          b.v[q] + 2,
          CASE WHEN fault IN ('', 'truncated') THEN b.v[new_state[q]] + 1 + extra ELSE 1000000 END,
          CASE WHEN fault IN ('', 'truncated') AND kept_state[q] > 0 THEN b.v[kept_state[q]] + extra ELSE 1000000 END)) AS m
        FROM back b JOIN rows r ON r.conv = b.conv AND r.i = b.i - 1)"""

#: Faults by window functions, least costs from the end by recursion, and the
#: letters by a second recursion from the start.  States 1 to 4: start, after
#: system, after user, after assistant.
DIALOGUE_SQL = f"""
WITH RECURSIVE base AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql(_points("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))} % 20 AS way
  FROM conversations),
damaged AS (
  SELECT conv, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role,
         CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE way WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM base WHERE way <> 0),
numbered AS (
  SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending
  FROM damaged),
rows AS (
  SELECT conv, turn, role, text, i, fault, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra, [3, 3, 4, 3] AS new_state,
         CASE left(role, 1) WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS kept_state,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS pair
  FROM (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered)),
sizes AS (
  SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv),
back AS (
  SELECT conv, n + 1 AS i, [0, 10, 5, 0] AS v FROM sizes
  UNION ALL {_BACK}),
walk AS (
  SELECT conv, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS kept FROM sizes
  UNION ALL
  SELECT conv, CASE edit WHEN 'I' THEN i ELSE i + 1 END,
         CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept_state[q] ELSE ([3, 3, 4, 3])[q] END, audit || edit,
         CASE edit WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text)
              ELSE list_append(kept, (CASE q WHEN 3 THEN 'assistant:' ELSE 'user:' END) || CASE edit WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT w.*, r.role, r.text, r.kept_state, CASE
        WHEN here.v[w.q] = next.v[w.q] + 2 THEN 'D'
        WHEN here.v[w.q] = here.v[([3, 3, 4, 3])[w.q]] + 5 THEN 'I'
        WHEN r.i IS NULL THEN NULL
        WHEN r.kept_state[w.q] > 0 AND fault IN ('', 'truncated') AND here.v[w.q] = next.v[r.kept_state[w.q]] + extra THEN 'K'
        ELSE 'R' END AS edit
    FROM walk w JOIN back here ON here.conv = w.conv AND here.i = w.i
    LEFT JOIN rows r ON r.conv = w.conv AND r.i = w.i LEFT JOIN back next ON next.conv = w.conv AND next.i = w.i + 1)
  WHERE edit IS NOT NULL),
ends AS (SELECT conv, last(audit ORDER BY length(audit)) AS audit, last(kept ORDER BY length(audit)) AS kept FROM walk GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(back.v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM base) LEFT JOIN sizes USING (conv) LEFT JOIN ends USING (conv)
LEFT JOIN back ON back.conv = sizes.conv AND back.i = 1
"""
