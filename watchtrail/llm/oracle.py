"""SQL with the same rows as the corpus queries, where SQL can express them."""



def _spans(name: str, pattern: str) -> str:
    """CTE ``name`` (doc_id, first, until, v): places of a pattern's matches, by the lengths of the pieces between."""
    return f"""{name}_found AS (
  SELECT doc_id, regexp_extract_all(t, '{pattern}') AS vs, string_split_regex(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}')
), {name} AS (
  SELECT doc_id, v, first, first + length(v) AS until FROM (
    SELECT doc_id, vs[i] AS v, list_sum(list_transform(gaps[1:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(vs[1:i - 1], lambda g: length(g))), 0) AS first
    FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM {name}_found))
)"""


def _hot(name: str, letters: str, must: list[str], bits: float) -> str:
    """CTE ``name``: what the windows of 20 characters of enough entropy cover, per run of one class."""
    wanted = " AND ".join(f"regexp_matches(v, '{m}')" for m in must)
    return _spans(f"{name}_run", f"[{letters}]{{20,}}") + f""", {name} AS (
  SELECT doc_id, first + min(i) AS first, first + max(i) + 20 AS until FROM (
    SELECT r.*, unnest(range(0, length(v) - 19)) AS i FROM {name}_run r
    WHERE {wanted} AND NOT regexp_matches(v, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
      AND NOT regexp_matches(v, '(?i)example|placeholder|changeme|0123456789|abcdefghij')
      AND NOT regexp_matches(v, '^(sha1|sha256|sha384|sha512|md5)[-=]')
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.first <= r.first AND b.until >= r.until))
  WHERE list_aggregate(string_split(substr(v, i + 1, 20), ''), 'entropy') >= {bits} GROUP BY doc_id, first, v
)"""


_ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
_SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans("assign", _ASSIGN)}, {_spans("access", "AKIA[A-Z0-9]{16,}")}, {_spans("hex", "[0-9a-f]{24,}")},
base AS (
  SELECT doc_id, 0 AS rank, 'assign' AS kind, first, until FROM assign WHERE length(regexp_extract(v, '{_ASSIGN}', 2)) >= 6
  UNION ALL SELECT doc_id, 1, 'access', first, until FROM access UNION ALL SELECT doc_id, 2, 'hex', first, until FROM hex
), {_hot("hexadecimal", "0-9a-fA-F", ["[0-9]", "[a-fA-F]"], 3.0)},
{_hot("upper_case", "A-Z0-9", ["[0-9].*[0-9]", "[A-Z].*[A-Z]"], 3.4)},
{_hot("base64", "A-Za-z0-9+/_=-", ["[0-9].*[0-9]", "[A-Z].*[A-Z]", "[a-z].*[a-z]"], 3.8)},
added AS (SELECT doc_id, first, until FROM hexadecimal UNION SELECT doc_id, first, until FROM upper_case
  UNION SELECT doc_id, first, until FROM base64),
every AS (
  SELECT * FROM base UNION ALL SELECT doc_id, 3, 'entropy', first, until FROM added a WHERE NOT EXISTS (
    SELECT 1 FROM added o WHERE o.doc_id = a.doc_id AND o.first <= a.first AND o.until >= a.until AND o.until - o.first > a.until - a.first)
), joined AS (
  SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || first || ':' || until, ',' ORDER BY first, rank, until) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || first || ':' || until, ',' ORDER BY first, rank, until) AS spans FROM every GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op9_secret_scan": _SECRETS,
    "op1_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS overlap
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * overlap >= 85 * (x.n + y.n - overlap)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes USING (doc_id)
GROUP BY d.doc_id
""",
    "op5_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2.0::DOUBLE * source_size AS cap FROM totals
), leveled AS (
  SELECT *, row_number() OVER o AS spot,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM totals)::DOUBLE
      - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighted WINDOW o AS (ORDER BY cap / w, place)
), plan AS (
  SELECT source, source_size,
    coalesce(least(cap, (SELECT arg_min(level, spot) FROM leveled WHERE level * w < cap) * w), cap) AS target FROM leveled
), parts AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target,
    floor(CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END)::INT AS whole
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), rooms AS (
  SELECT *, target - whole * source_size AS room,
    (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM parts
), pool AS (
  SELECT *, sum(CASE WHEN size > 0 AND size <= room THEN size END) OVER (PARTITION BY source) AS available,
    size > 0 AND size <= room AS able, (size <= room * 0.05)::INT + (size <= room * 0.01)::INT AS stratum FROM rooms
), chances AS (
  SELECT *, least(room / available, 1 - 1e-12::DOUBLE) AS p FROM pool
), ranked AS (
  SELECT *, (u / (1 - u)) / (p / (1 - p)) AS r, p * size AS expected FROM chances WHERE able
), s0 AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY r, doc_id) AS upto, sum(expected) OVER (PARTITION BY source) AS words
  FROM ranked WHERE stratum = 0
), d0 AS (
  SELECT *, (upto <= words OR upto - words < size - (upto - words)) AS drawn FROM s0
), m0 AS (
  SELECT source, sum(expected) - sum(CASE WHEN drawn THEN size ELSE 0 END) AS words FROM d0 GROUP BY source
), s1 AS (
  SELECT r.*, sum(size) OVER (PARTITION BY r.source ORDER BY r, doc_id) AS upto,
    sum(expected) OVER (PARTITION BY r.source) + coalesce(m0.words, 0) AS words
  FROM ranked r LEFT JOIN m0 ON r.source IS NOT DISTINCT FROM m0.source WHERE stratum = 1
), d1 AS (
  SELECT *, (upto <= words OR upto - words < size - (upto - words)) AS drawn FROM s1
), m1 AS (
  SELECT source, sum(words) AS words FROM (
    SELECT source, words FROM m0 UNION ALL SELECT source, expected - CASE WHEN drawn THEN size ELSE 0 END FROM d1) GROUP BY source
), s2 AS (
  SELECT r.*, sum(size) OVER (PARTITION BY r.source ORDER BY r, doc_id) AS upto,
    sum(expected) OVER (PARTITION BY r.source) + coalesce(m1.words, 0) AS words
  FROM ranked r LEFT JOIN m1 ON r.source IS NOT DISTINCT FROM m1.source WHERE stratum = 2
), d2 AS (
  SELECT *, (upto <= words OR upto - words < size - (upto - words)) AS drawn FROM s2
), drawn AS (
  SELECT doc_id, drawn FROM d0 UNION ALL SELECT doc_id, drawn FROM d1 UNION ALL SELECT doc_id, drawn FROM d2
)
SELECT c.doc_id, c.size, c.source_size, c.target, ((c.whole + coalesce(d.drawn, false)::INT) * c.size)::BIGINT AS taken
FROM chances c LEFT JOIN drawn d USING (doc_id)
""",
    "op6_top_scores": r"""
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM valid q JOIN valid c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS "rank", vec_id, score
FROM scored QUALIFY "rank" <= 5
""",
    "op10_vector_dedup": r"""
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
    ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id,
  e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
""",
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COLLOCATIONS = f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS size))),
c AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, size, phrase, f AS a FROM c WHERE size >= 2 AND f >= 30),
sub AS (SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, a AS outer_a FROM (
  SELECT lang, a, ws, s, unnest(range(1, size - s + 2)) AS i FROM (
    SELECT lang, a, size, string_split(phrase, ' ') AS ws, unnest(range(2, size)) AS s FROM cand WHERE size >= 3))),
kept AS (SELECT * FROM cand x WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = x.lang AND sub.phrase = x.phrase AND 100 * sub.outer_a >= 80 * x.a)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM (
  SELECT lang, phrase, a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM kept)),
scored AS (SELECT u.lang, u.phrase, u.a, u.k, lc.f AS l, rc.f AS r, (u.a::HUGEINT * 2000000) // (lc.f + rc.f)::HUGEINT AS score
  FROM cuts u JOIN c lc ON lc.lang = u.lang AND lc.phrase = u.lp JOIN c rc ON rc.lang = u.lang AND rc.phrase = u.rp),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, n.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN n USING (lang) WHERE r.rank <= 2000"""

_FILL_MIDDLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS toks,
  ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
  ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d),
y AS (SELECT *, len(toks) AS n FROM x),
z AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM y),
o AS (SELECT *, coalesce(list_sum(list_transform(toks[1:c1], lambda v: length(v))), 0)::BIGINT AS p,
  coalesce(list_sum(list_transform(toks[1:c2], lambda v: length(v))), 0)::BIGINT AS m FROM z),
q AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, m - p) AS mid, substr(t, m + 1) AS suf FROM o)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form = 'plain' THEN NULL ELSE p END::BIGINT AS prefix_chars,
  CASE WHEN form = 'plain' THEN NULL ELSE m - p END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM q"""

_SUBSTRINGS = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY s) >= 2),
words AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
marked AS (SELECT words.rid, word, j, max(dup.i) OVER (PARTITION BY words.rid ORDER BY j ROWS UNBOUNDED PRECEDING) AS last_dup
  FROM words LEFT JOIN dup ON dup.rid = words.rid AND dup.i = words.j),
per AS (SELECT rid, count(*) AS n_words, count(*) FILTER (WHERE last_dup >= j - 34) AS n_removed,
  string_agg(word, ' ' ORDER BY j) FILTER (WHERE last_dup IS NULL OR last_dup < j - 34) AS kept FROM marked GROUP BY rid)
SELECT w.doc_id, coalesce(per.n_words, 0)::BIGINT AS n_words, coalesce(per.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(per.kept, '')) AS kept_sha256
FROM w LEFT JOIN per USING (rid)"""

ORACLE |= {
    "op11_collocations": _COLLOCATIONS,
    "op12_fill_middle": _FILL_MIDDLE,
    "op13_substring_dedup": _SUBSTRINGS,
}
