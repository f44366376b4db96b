"""The corpus queries opN_<name>, each over its whole table, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecurve.llm import bpe, chat, fim, html_text, licenses, line_dedup, lsh_forest, media, packing, pii, quality, spelling, vector_join
from tidecurve.llm.common import table


def op1_packing(spark, sf_dir):
    packed = packing.pack(packing.sequences(table(spark, sf_dir, "documents")))
    return packed.withColumnRenamed("key", "doc_id").withColumn("start", F.col("part") * packing.WINDOW)


def op2_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = map(count, pii.BASE)
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii")).alias("spans"))


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op4_chat(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT CAST(id AS LONG) AS conv_id, CAST(turn AS LONG) AS turn, role, text FROM VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}') AS t(id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    chats = chat.format_chat(turns.withColumn("parts", chat.text_part(F.col("text"))))
    back = chats.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL_op4_chat = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*)(\||/?s>|/?<SYS>>|</SYS>>|/?start_of_turn>|/?end_of_turn>)', '\1\\\2\3', 'g'),
                           '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g') AS shown FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, shown)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, shown)) AS loss_sha256,
  CAST(sum(8 + length(url_encode(role)) + 1 + length(shown) + 8) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op5_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_lines(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op8_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op9_minhash(spark, sf_dir):
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, over classes of equal sets; components by reachability.
SQL_op9_minhash = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
c AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT node, n, unnest(s) AS x FROM c),
links AS (SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.x = b.x AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT node, node AS reach FROM c UNION SELECT links.b, r.reach FROM r JOIN links ON links.a = r.node),
k AS (SELECT node, min(reach) AS component FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, s.doc_id = coalesce(k.component, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN k ON k.node = c.node
"""


def op10_media(spark, sf_dir):
    return media.media_column(table(spark, sf_dir, "documents"))


def op11_fim(spark, sf_dir):
    told = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL_op11_fim = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(w) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def op12_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


#: The checksum bit by bit; all near pairs by wildcards and deletions; roots by recursion.
SQL_op12_spelling = r"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY 1, 2),
bits AS (SELECT *, list_transform(range(CAST(octet_length(encode(s)) * 8 AS BIGINT)), lambda i: (CAST('0x' || hex(encode(s))[2 * (i // 8) + 1:2 * (i // 8) + 2] AS BIGINT) >> CAST(i % 8 AS INT)) & 1) AS bit
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s FROM runs)),
crc AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bit), lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h FROM bits),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM crc),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
k AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
del AS (SELECT DISTINCT word, n, a || z AS short FROM k),
near AS (SELECT x.word, y.word AS other, y.n AS m FROM k x JOIN k y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION ALL SELECT del.word, v.word, v.n FROM del JOIN v ON v.word = del.short UNION ALL SELECT v.word, del.word, del.n FROM del JOIN v ON v.word = del.short),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY 1),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word)
SELECT word, n, CAST(n_near AS BIGINT) AS n_near, form, form_n, root FROM f JOIN r USING (word)
"""


def op13_vectors(spark, sf_dir):
    return vector_join.near_vectors(table(spark, sf_dir, "embeddings"))


SQL_op13_vectors = r"""
WITH RECURSIVE v AS (SELECT *, row_number() OVER () AS row, label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fit FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.row <> b.row AND a.fit AND b.fit AND len(a.embedding) = len(b.embedding)
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT links.b, r.reach FROM r JOIN links ON links.a = r.node),
k AS (SELECT node, min(reach) AS component FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component AS component_id, vec_id = component AS kept FROM v LEFT JOIN n ON n.a = vec_id JOIN k ON k.node = vec_id
"""


def pii_base(spark, sf_dir):
    """The base counts of op2_pii, which SQL can state."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


SQL_pii_base = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS i,
  list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS p FROM t)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email,
  CAST(len(list_filter(i, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR CAST('0' || right(ltrim(y, '0'), 3) AS INT) > 255)) = 0)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN (length(x) - k) % 2 = 0 THEN CAST(x[k] AS INT)
    ELSE CASE WHEN CAST(x[k] AS INT) > 4 THEN 2 * CAST(x[k] AS INT) - 9 ELSE 2 * CAST(x[k] AS INT) END END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(list_filter(p, lambda x: length(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone FROM m
"""


def quality_base(spark, sf_dir):
    """The base rules of op3_quality, which SQL can state."""
    return op3_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


SQL_quality_base = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM tri),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n >= 2) GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)
"""


def licenses_base(spark, sf_dir):
    """The base phrases of op8_licenses, which SQL can state."""
    return op8_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


SQL_licenses_base = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS spot, CASE WHEN w[i] = 'gnu' AND w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
  WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by' WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' END AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
g AS (SELECT doc_id, count(*) AS n, min(spot) AS lo, max(spot) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""


def media_payload(spark, sf_dir):
    """The payload columns of op10_media, which SQL can state."""
    return op10_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


SQL_media_payload = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT *, octet_length(b) AS n, greatest(1, (octet_length(b) + 63) // 64) * 64 AS size FROM t)
SELECT doc_id, n AS n_bytes, CAST(size AS BIGINT) AS payload_bytes, sha256(b || unhex(repeat('00', CAST(size - n AS BIGINT)))) AS payload_sha256 FROM n
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and (k.startswith("op") or f"SQL_{k}" in globals())}


def oracle_sql() -> dict[str, str]:
    return {k.removeprefix("SQL_"): v for k, v in globals().items() if k.startswith("SQL_")}
