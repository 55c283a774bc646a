"""Registered queries of the training-data operators, over whole tables with production parameters.

Each takes (spark, sf_dir).  Several run Spark jobs while they are built
(model fits, checkpoints); none collects more than a model's parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysafe.llm import chat, decontam, exact, langid, ngram_join, packing, periods, quality, resample, sharding, substring, suffix, urls
from polysafe.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_language_id(spark, sf_dir):
    """Language of every whole text, learnt from the rows not held out."""
    return langid.identify(read(spark, sf_dir, "documents"))


@register
def op2_ngram_jaccard(spark, sf_dir):
    """Whole documents whose 3-word shingles are similar to 90 in a hundred, by component."""
    return ngram_join.similar_components(read(spark, sf_dir, "documents")).drop("class_id")


ORACLE["op2_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


@register
def op3_packing(spark, sf_dir):
    """Whole documents as pieces of full token windows."""
    return packing.pack(read(spark, sf_dir, "documents"))


@register
def op4_recompression(spark, sf_dir):
    """Whole documents without the word windows that a smaller doc_id has."""
    return substring.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


ORACLE["op4_recompression"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w, unnest(generate_series(1, len(ws) - 12)) AS g(i)),
m AS (SELECT win, min(doc_id) AS first_doc FROM p GROUP BY win),
r AS (SELECT DISTINCT p.doc_id, i + k AS i FROM p JOIN m USING (win), generate_series(0, 12) AS s(k) WHERE m.first_doc < p.doc_id),
e AS (SELECT w.doc_id, i, ws[i] AS word, r.i IS NOT NULL AS gone
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w) w LEFT JOIN r USING (doc_id, i))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
                  FROM e GROUP BY doc_id) USING (doc_id)
"""


@register
def op5_exact_dedup(spark, sf_dir):
    """Whole documents equal up to white space: who stays, and for whom."""
    return exact.duplicate_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op5_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


@register
def op6_suffix_dedup(spark, sf_dir):
    """Whole documents, as bytes, without the 100-byte strings that start earlier."""
    return suffix.remove_repeats(read(spark, sf_dir, "documents")).drop("removed")


ORACLE["op6_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(0, octet_length(h))) AS i FROM d),
p AS (SELECT doc_id, i, h[i + 1:i + 1] AS byte, CASE WHEN i + 100 <= octet_length(h) THEN h[i + 1:i + 100] END AS win FROM b),
f AS (SELECT win, min(struct_pack(doc_id := doc_id, i := i)) AS first_at FROM p WHERE win IS NOT NULL GROUP BY win),
m AS (SELECT p.doc_id, p.i, byte, max(CASE WHEN first_at < struct_pack(doc_id := p.doc_id, i := p.i) THEN p.i END)
        OVER (PARTITION BY p.doc_id ORDER BY p.i) AS back FROM p LEFT JOIN f USING (win)),
g AS (SELECT *, coalesce(back > i - 100, false) AS gone FROM m),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
r AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
        string_agg(hex(byte), '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


@register
def op7_decontamination(spark, sf_dir):
    """Every occurrence of a benchmark item in whole documents."""
    return decontam.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), short="words")


@register
def op8_chat_format(spark, sf_dir):
    """Conversations formatted, and what is read back from the output."""
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(table.unionByName(extra)))


ORACLE["op8_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, CASE role WHEN 'user' THEN 'INST' WHEN 'assistant' THEN 'OUT' WHEN 'system' THEN 'SYS' END AS tag,
    regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:INST|OUT|SYS|ROLE=[A-Za-z0-9_.~%-]*)\])', '\1\\\2\3', 'g') AS body
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + 2 * length(tag) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@register
def op9_url_rules(spark, sf_dir):
    """Verdict on every page's url: listed rules first, mined rules for the rest."""
    return urls.filter_urls(read(spark, sf_dir, "pages"))


@register
def op10_quality(spark, sf_dir):
    """Perplexity of every whole text under a model of all trusted text, and whether it is kept."""
    return quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: CRC-32 in SQL: the 256 steps from their rule, then a fold over the bytes of ``{0}`` (a blob), starting from the table ``ct``.
_CRC_TABLE = """ct AS (SELECT list(list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i))"""
_CRC = """xor(4294967295, list_reduce(list_transform(range(octet_length({0})), lambda k: ('0x' || hex({0}[k + 1:k + 1]))::BIGINT),
  lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT))"""


@register
def op11_resample(spark, sf_dir):
    """Whole documents weighted towards the benchmark's texts, and the draw of five in a hundred."""
    return resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


ORACLE["op11_resample"] = r"""
WITH """ + _CRC_TABLE + r""",
x AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM x),
f AS (SELECT side, doc_id, array_to_string(ws[i:i + n - 1], ' ') AS f
      FROM w, (SELECT unnest(range(1, 4)) AS n) g, unnest(range(1, len(ws) - n + 2)) AS p(i)),
b AS (SELECT f, """ + _CRC.format("encode(f)") + r""" % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), ct),
c AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f JOIN b USING (f) GROUP BY bucket),
n AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c, n),
k AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
d AS (SELECT w.doc_id, len(ws) >= 20 AS able, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296))) AS BIGINT) AS noise
      FROM w LEFT JOIN k ON k.doc_id = w.doc_id WHERE side = 0),
r AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS able FROM d WHERE able)
SELECT d.doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 5 * r.able // 100 THEN place END AS rank
FROM d LEFT JOIN r USING (doc_id)
"""


@register
def op12_sharding(spark, sf_dir):
    """Whole documents in eight shards by rendezvous hashing of their ids, their places there, and their shard of nine."""
    return sharding.place(read(spark, sf_dir, "documents"))


ORACLE["op12_sharding"] = r"""
WITH """ + _CRC_TABLE + r""",
d AS (SELECT doc_id, encode(coalesce(text, '')) AS e, ('0x' || substr(md5('slot:17:' || doc_id), 1, 15))::BIGINT AS mixed FROM documents),
u AS (SELECT doc_id, s, (('0x' || substr(md5('shard ' || s || ':17:' || doc_id), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS u FROM d, range(9) r(s)),
b AS (SELECT doc_id, arg_max(s, 1 / -ln(u)) FILTER (s < 8) AS shard, arg_max(s, 1 / -ln(u)) AS grown_shard FROM u GROUP BY doc_id),
r AS (SELECT doc_id, octet_length(e) + 1 AS size, """ + _CRC.format("e") + r""" AS text_crc32, mixed FROM d, ct)
SELECT doc_id, size, coalesce(text_crc32, 0) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY mixed, doc_id, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM r JOIN b USING (doc_id)
"""


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of ``documents``, where one document in ten repeats a stretch of its words to its end.

    With h the CRC-32 of the id as text, g = h // 10 and n words: where h is
    divisible by ten and there are words, each word i >= a = g % n becomes word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).  All other texts stay as they are.
    """
    chosen = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).withColumn(
        "ws", F.when(F.col("h") % 10 == 0, F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)")))
    sized = chosen.withColumn("n", F.size("ws")).withColumn("g", F.expr("h div 10"))
    cut = sized.withColumn("a", F.expr("CASE WHEN n > 0 THEN CAST(g % n AS INT) END"))
    step = cut.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    again = F.expr("array_join(slice(concat(slice(ws, 1, a), flatten(array_repeat(slice(ws, a + 1, p), CAST(1 + (n - a) div p AS INT)))), 1, n), ' ')")
    return step.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


@register
def op13_periodic_runs(spark, sf_dir):
    """Periodic runs of words in whole documents, the planted ones among them."""
    return periods.digests(periods.periodic_runs(planted(read(spark, sf_dir, "documents"))))


ORACLE["op13_periodic_runs"] = r"""
WITH """ + _CRC_TABLE + r""",
o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, """ + _CRC.format("encode(doc_id::VARCHAR)") + r""" AS h FROM documents, ct),
a AS (SELECT doc_id, ws, h, h // 10 AS g, CASE WHEN len(ws) > 0 AND h % 10 = 0 THEN (h // 10) % len(ws) END AS a FROM o),
p AS (SELECT *, 1 + (len(ws) - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, i, CASE WHEN a IS NULL OR i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END AS word FROM p, unnest(range(len(ws))) AS u(i)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS stretch
      FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i),
l AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM m GROUP BY doc_id, q, stretch HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM l WHERE NOT EXISTS (
        SELECT 1 FROM l z WHERE z.doc_id = l.doc_id AND z.q < l.q AND z.s <= l.s AND z.s + z.n >= l.s + l.n)),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n::DOUBLE / q DESC, s, q) AS place FROM r),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + n)) AS i FROM r),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i WHERE gone.i IS NULL GROUP BY w.doc_id)
SELECT o.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM o LEFT JOIN t ON t.doc_id = o.doc_id LEFT JOIN best ON best.doc_id = o.doc_id AND place = 1 LEFT JOIN k ON k.doc_id = o.doc_id
"""
