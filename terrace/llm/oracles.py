"""SQL that other engines can run for the queries of this package."""

from terrace.llm.licenses import HOLDER, SENTENCES, USUAL, normalised, ordered_rules

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN = r"[^\x20\x09-\x0D]+"

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + least(10, len(w)) - 1), ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d),
dw AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win FROM dp, sizes WHERE p + n - 1 <= len(w)),
hit AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
spans AS (SELECT DISTINCT doc_id, p, n FROM hit),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM spans) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS w FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM d WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
hit AS (SELECT doc_id, p FROM win JOIN least USING (h) WHERE doc_id > m),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(generate_series(p, p + 49)) AS q FROM hit) GROUP BY doc_id),
flags AS (SELECT doc_id, q FROM gone, unnest(qs) AS t(q)),
pos AS (SELECT doc_id, w[q] AS word, q FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS q FROM d)),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.q) AS t FROM pos LEFT JOIN flags ON pos.doc_id = flags.doc_id AND pos.q = flags.q WHERE flags.q IS NULL GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PLAIN}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, p, p + 2), ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(node, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT b, r FROM reach JOIN link ON node = a WHERE r < b),
comp AS (SELECT node, min(r) AS r FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, r AS component_id, d.doc_id = r AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp ON node = d.doc_id
"""

OP9 = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ok AS (SELECT vec_id, label, list_transform(v, lambda x: coalesce(x, 0.0)) AS v FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE CASE WHEN len(a.v) = len(b.v) AND len(a.v) > 0 THEN list_cosine_similarity(a.v, b.v) END >= 0.98),
reach(node, r) AS (SELECT vec_id, vec_id FROM e UNION SELECT b, r FROM reach JOIN link ON node = a WHERE r < b),
comp AS (SELECT node, min(r) AS r FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, r AS component_id, vec_id = r AS kept FROM e JOIN comp ON node = vec_id LEFT JOIN n ON a = vec_id
"""

OP2 = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
c AS (SELECT *, list_transform(w, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS h FROM d),
r AS (SELECT *, list_transform(generate_series(1, len(h)), lambda i: (h[i] + 31 * (CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END)) % 4294967296) AS r FROM c),
e AS (SELECT *, list_filter(generate_series(1, len(r)), lambda i: i = len(r) OR (i > 1 AND i < len(r) - 1 AND r[i] < r[i - 1] AND r[i] <= r[i + 1])
  OR (i > 2 AND i < len(r) - 1 AND i % 2 = 0 AND r[i] = r[i - 2] AND r[i] = r[i - 1] AND r[i] = r[i + 1])) AS ends FROM r),
k AS (SELECT doc_id, no, CASE WHEN no = 1 THEN 1 ELSE ends[no - 1] + 1 END AS a, ends[no] AS b, w FROM (SELECT doc_id, ends, w, unnest(generate_series(1, len(ends))) AS no FROM e)),
t AS (SELECT doc_id, no, a, b, list_slice(w, a, b) AS lines FROM k),
n AS (SELECT *, array_to_string(lines, chr(10)) AS bytes, list_reverse(coalesce(lag(lines) OVER (PARTITION BY doc_id ORDER BY no), [])) AS before, coalesce(lead(lines) OVER (PARTITION BY doc_id ORDER BY no), []) AS after FROM t),
f AS (SELECT *, row_number() OVER p AS place, first_value(before) OVER p AS before1, first_value(after) OVER p AS after1 FROM n WHERE b > a WINDOW p AS (PARTITION BY bytes ORDER BY doc_id, no)),
x AS (SELECT doc_id, a, b, list_transform(generate_series(1, least(len(before), len(before1))), lambda i: before[i] = before1[i]) AS up, list_transform(generate_series(1, least(len(after), len(after1))), lambda i: after[i] = after1[i]) AS down FROM f WHERE place > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(a - coalesce(list_position(up, false) - 1, len(up)), b + coalesce(list_position(down, false) - 1, len(down)))) AS line FROM x),
gone AS (SELECT doc_id, list(line) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(w) END AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{PLAIN}')) AS BIGINT) AS size, md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS drawn FROM documents),
sh AS (SELECT source AS own, greatest(1, CAST(floor(sqrt(sum(size) / 2048.0)) AS BIGINT)) AS shards FROM d GROUP BY source),
d2 AS (SELECT doc_id, source, size, drawn, CAST('0x' || substr(drawn, 1, 8) AS BIGINT) % shards AS shard FROM d JOIN sh ON source IS NOT DISTINCT FROM own),
cells AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS v FROM d2 GROUP BY ALL),
s0 AS (SELECT source, CAST(sum(v) AS BIGINT) AS source_size FROM cells GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS no FROM s0),
s2 AS (SELECT *, CAST([5, 2, 1][(no - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM s1),
s3 AS (SELECT *, cap / weight AS level FROM s2),
s4 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY level, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY level, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS th FROM s3),
s5 AS (SELECT *, max(CASE WHEN th <= level THEN th END) OVER () AS theta FROM s4),
s6 AS (SELECT source, source_size, coalesce(least(cap, weight * theta), cap) AS target FROM s5),
n AS (SELECT CAST(round(sum(target) / 32) AS BIGINT) AS seats FROM s6),
sq AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source IS NULL, source) AS r FROM (SELECT source, target, unnest(generate_series(1, CAST(ceil(target / 32) AS BIGINT) + 40)) AS k FROM s6 WHERE target > 0)),
won AS (SELECT source, count(*) AS seats FROM sq, n WHERE r <= n.seats GROUP BY source),
sn AS (SELECT s6.source, greatest(1, coalesce(won.seats, 0)) AS seats FROM s6 LEFT JOIN won ON s6.source IS NOT DISTINCT FROM won.source WHERE target > 0),
cq AS (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY v / (2 * k - 1) DESC, shard) AS r
  FROM (SELECT cells.source, shard, v, seats, unnest(generate_series(1, CAST(ceil(2 * v / 32.0) AS BIGINT) + 80)) AS k FROM cells JOIN sn ON cells.source IS NOT DISTINCT FROM sn.source WHERE v > 0)),
cn AS (SELECT source, shard, count(*) AS quota FROM cq WHERE r <= seats GROUP BY source, shard),
q AS (SELECT cells.source, cells.shard, v, coalesce(quota, 0) * 32 AS words, CASE WHEN v > 0 THEN least(2, coalesce(quota, 0) * 32 // v) ELSE 0 END AS passes
  FROM cells LEFT JOIN cn ON cells.source IS NOT DISTINCT FROM cn.source AND cells.shard = cn.shard),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY drawn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM d2)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, CASE WHEN passes < 2 THEN words - passes * v ELSE 0 END - bef)) AS BIGINT) AS taken
FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard JOIN s6 ON p.source IS NOT DISTINCT FROM s6.source
"""

def _op7() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({quote(normalised(v))}, {quote(k)})" for k, v in SENTENCES.items())
    rules = ", ".join(f"({i}, {quote(name)}, [{', '.join(map(quote, ids))}])" for i, (name, ids) in enumerate(ordered_rules(), 1))

    def sentences(breaks: str) -> str:
        marked = rf"regexp_replace(regexp_replace(coalesce(text, ''), '{breaks}', chr(1), 'g'), '([.;:!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g')"
        return rf"list_filter(list_transform(string_split(regexp_replace(translate({marked}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\pL\pN\x01]+', ' ', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"

    return rf"""
WITH RECURSIVE known(t, id) AS (VALUES {table}), ordered(no, name, ids) AS (VALUES {rules}),
rules AS (SELECT no, name, '<' || array_to_string(ids, '>((?:<[^>]*>)*?)<') || '>' AS pattern, array_to_string(list_transform(generate_series(1, len(ids) - 1), lambda i: '\\' || i), '') AS rest, '<(?:' || array_to_string(ids, '|') || ')>' AS each FROM ordered),
d AS (SELECT doc_id, {sentences(r'\n')} AS l, {sentences(r'\n[\x20\x09-\x0D]*\n')} AS r FROM documents),
cut AS (SELECT doc_id, 'l' AS k, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM d UNION ALL SELECT doc_id, 'r', unnest(r), generate_subscripts(r, 1) FROM d),
s AS (SELECT doc_id, k, pos, id FROM (SELECT doc_id, k, pos, regexp_replace(t, '{HOLDER}', '{USUAL}', 'g') AS t FROM cut) JOIN known USING (t)),
q AS (SELECT doc_id, k, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids, '<' || string_agg(id, '><' ORDER BY pos) || '>' AS seq FROM s GROUP BY doc_id, k),
pair AS (SELECT doc_id, coalesce(max(seq) FILTER (WHERE k = 'l'), '') AS a, coalesce(max(seq) FILTER (WHERE k = 'r'), '') AS b FROM q GROUP BY doc_id),
m(doc_id, no, a, b, names) AS (SELECT doc_id, 0, a, b, CAST([] AS VARCHAR[]) FROM pair UNION ALL
  SELECT doc_id, rules.no, CASE WHEN regexp_matches(a, pattern) THEN regexp_replace(a, pattern, rest, 'g') WHEN regexp_matches(b, pattern) THEN regexp_replace(a, each, '', 'g') ELSE a END,
    CASE WHEN regexp_matches(b, pattern) THEN regexp_replace(b, pattern, rest, 'g') WHEN regexp_matches(a, pattern) THEN regexp_replace(b, each, '', 'g') ELSE b END,
    CASE WHEN regexp_matches(a, pattern) OR regexp_matches(b, pattern) THEN list_append(names, name) ELSE names END FROM m JOIN rules ON rules.no = m.no + 1),
f AS (SELECT doc_id, array_to_string(list_sort(list_distinct(names)), ',') AS licences FROM m WHERE no = (SELECT max(no) FROM rules))
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_sentences, CAST(coalesce(n, 0) AS BIGINT) AS n_known, coalesce(ids, '') AS sentence_ids, coalesce(licences, '') AS licences
FROM d LEFT JOIN (SELECT * FROM q WHERE k = 'l') q USING (doc_id) LEFT JOIN f USING (doc_id)
""".replace("\\\\", "\\")


OP1 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
e AS (SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + length(role) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Each letter from U+00C0 to U+00FF, and a sign of one byte that words do not have, as levenshtein() counts bytes.
WIDE, NARROW = "".join(map(chr, range(0xC0, 0x100))), "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.islower())[:64]

OP11 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents),
u AS (SELECT doc_id, r, count(*) AS c FROM t GROUP BY ALL),
bits AS (SELECT r, c, flatten(list_transform(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)),
  lambda b: list_transform(generate_series(0, 7), lambda i: CAST((b >> i) & 1 AS BIGINT)))) AS bits FROM u),
h AS (SELECT r, c, xor(list_reduce(list_prepend(4294967295, bits), lambda x, y: xor(x >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295) AS h FROM bits),
k AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n, length(word) AS size, translate(word, '{WIDE}', '{NARROW.replace("'", "''")}') AS z FROM k WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM (SELECT *, unnest([size - 1, size, size + 1]) AS s FROM w) a JOIN w b ON b.size = a.s AND a.z <> b.z AND levenshtein(a.z, b.z) = 1),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word JOIN f g ON g.word = chain.root WHERE g.form IS NULL
"""

OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, n, (CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c) c JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(w, 1, cut), ' ') JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(w, cut + 1, c.k), ' ') JOIN n ON n.lang = c.lang),
weak AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(list_slice(w, i, i + j - 1), ' ') AS phrase, max(a) AS most FROM (SELECT *, unnest(generate_series(1, k - j + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS j FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT weak.* FROM weak LEFT JOIN inside ON inside.lang = weak.lang AND inside.phrase = weak.phrase WHERE coalesce(100 * most < 100 * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept QUALIFY rank <= 2000
"""

ORACLES = {"op11_spelling_variants": OP11, "op13_collocations": OP13, "op1_chat_format": OP1, "op7_license_scan": _op7(), "op2_line_dedup": OP2, "op4_mixing": OP4, "op9_embedding_dedup": OP9, "op5_near_duplicates": OP5, "op3_substring_dedup": OP3, "op10_decontamination": OP10}
