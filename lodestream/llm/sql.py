"""DuckDB SQL for the corpus queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWERED}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM edges
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), c AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP5 = rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), spots AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, n FROM spots JOIN win USING (n, s)
), covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), which AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN which USING (doc_id)
"""

_ESCAPED = r"replace({}, '\', '\\')"
for _first, _strings in {"l": ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>"), "b": ("[INST]", "[/INST]")}.items():
    for _s in _strings:
        _ESCAPED = f"replace({_ESCAPED}, '{_s}', '\\{_first}{_s[1:]}')"

OP6 = f"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|><|text|><|end|>') + 1 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), k AS (SELECT *, octet_length(encode(h))::BIGINT AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM k
"""

OP8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

#: The given pages hold no canonical or refresh link, so no alias changes a verdict and the default is to allow.
OP9 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(action, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), best AS (
  SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(action, length(h || q)) AS action
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""

#: The crc32 of a text of letters up to U+00FF, byte by byte: DuckDB has none.
_TABLE = "(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) t(i))"
_BYTES = "flatten(list_transform(string_split({}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END))"
OP12 = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), crc(t) AS MATERIALIZED (SELECT {_TABLE}
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format("doc_id || ':' || w")}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc
), typed AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM hashed
), words AS (SELECT word, count(*) AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), cut AS (SELECT word, length(word) AS l, unnest(range(length(word))) AS i, n FROM words
), less AS (SELECT word, l, i, n, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS s FROM cut
), shorter AS (SELECT DISTINCT less.word AS long, words.word AS short, less.n AS long_n, words.n AS short_n FROM less JOIN words ON words.word = s
), near AS (
  SELECT x.word, y.word AS other, y.n FROM less x JOIN less y ON x.s = y.s AND x.i = y.i AND x.word <> y.word
  UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter
), best AS (SELECT word, count(*) AS n_near, min(struct_pack(least := -n, form := other)) AS b FROM near GROUP BY word
), formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.least >= 10 * n THEN b.form END AS form, CASE WHEN -b.least >= 10 * n THEN -b.least END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
), ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10
), cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1
), s AS (SELECT c.lang, c.phrase, c.k, c.a, min(struct_pack(score := (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT, cut := cut, l := x.f, r := y.f)) AS b
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, cut), ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ') GROUP BY ALL
), inside AS (SELECT lang, unnest([array_to_string(list_slice(string_split(phrase, ' '), 1, 2), ' '), array_to_string(list_slice(string_split(phrase, ' '), 2, 3), ' ')]) AS phrase, f FROM f WHERE k = 3
), longer AS (SELECT lang, phrase, max(f) AS longer FROM inside GROUP BY ALL
), kept AS (SELECT s.* FROM s LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a
), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM r JOIN total USING (lang) WHERE rank <= 2000
"""

SQL = {"op4_minhash": OP4, "op5_decontamination": OP5, "op6_chat": OP6, "op7_warc": OP7, "op8_exact_dedup": OP8, "op9_url_rules": OP9, "op12_spelling": OP12, "op13_collocations": OP13}
