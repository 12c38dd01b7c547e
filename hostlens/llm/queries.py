"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, exact, language, minhash, mixing, pii, quality, secrets, suffix, trie, warc
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and the probe -7, and reads the digests back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS probe(turn, role)"))
    out = chat.format_chat(turns).withColumn("_read", chat.parse_chat(F.col("formatted")))
    # the loss mask is the segments' own flag, not the role
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: chat.unescape(s.text)), "")
    said = F.array_join(F.transform("_read", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("_read").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), "valid",
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as an archive, looks up the key of every URL in its index and reads the records back by range."""
    pages = table(spark, sf_dir, "pages")
    out = warc.captures(warc.write_archive(pages), pages.select(warc.url_key(F.col("url")).alias("key")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s.kind.isin(*pii.BASE))
    of = lambda kind: F.filter("pii", lambda s: s.kind == kind)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("pii")).alias("spans"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with the forest's decision; texts of secrets are not repeated here."""
    docs = table(spark, sf_dir, "documents")
    likely = secrets.letter_steps(docs)
    return secrets.scan(docs, secrets.train(spark, likely=likely), likely=likely).drop("candidate")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents whose crc32 of the id is not 2 modulo 4. A rejected guess is a guess still: its column says so."""
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    out = language.identify(docs, language.train(docs.filter(part != 2)))
    return out.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_chat_format, op3_decontaminate, op4_mix, op5_warc, op6_pii, op7_minhash, op8_quality, op9_exact_dedup, op10_secrets, op11_language, op12_divergence, op13_trie)}

ORACLES = {
    "op1_suffix_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 - 99, 0))) AS i FROM t) u),
firsts AS (SELECT s, min(struct_pack(d := doc_id, i := i)) AS f FROM starts GROUP BY s HAVING count(*) > 1),
again AS (SELECT doc_id, i FROM starts JOIN firsts USING (s) WHERE struct_pack(d := doc_id, i := i) > f),
steps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS opens FROM again WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM steps) s GROUP BY doc_id, n),
gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS n_removed, count(*) AS n_spans FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, cast(cast(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY payload) AS least FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + list_sum(list_transform(range(5), lambda j: cast(substr(bits, 5 * i + j + 1, 1) AS INT) * (16 >> j))) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM d
""",
    "op2_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, v, CASE v WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(v)
), marked AS (
  SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END
    + length(text) + length(text) - length(replace(text, chr(92), ''))
    + list_sum(list_transform(['<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '<s>', '</s>', '[TURN]', '[BODY]', '[/TURN]'],
        lambda c: (length(text) - length(replace(text, c, ''))) // length(c))) AS chars,
    lag(role, 1, 'start') OVER w AS before, lead(role) OVER w AS after
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(before || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')
    AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM marked GROUP BY conv_id
""",
    "op4_mix": """
WITH sizes AS (SELECT coalesce(source, '') AS s, cast(sum(coalesce(length(text), 0)) AS BIGINT) AS mass FROM documents GROUP BY 1),
rates AS (SELECT s, CASE WHEN mass > 0 THEN pow(mass, 0.5) / (SELECT cast(sum(cast(pow(mass, 0.5) AS DECIMAL(38,12))) AS DOUBLE) FROM sizes) * (SELECT sum(mass) FROM sizes) / mass ELSE 0 END AS rate FROM sizes),
means AS (SELECT s, rate, greatest(ceil(rate / 30), 1) AS parts, rate / greatest(ceil(rate / 30), 1) AS mean FROM rates WHERE rate > 0),
terms AS (SELECT s, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cdf FROM means, range(120) r(k)),
draws AS (SELECT doc_id, d.s, cast('0x' || substr(md5('42:' || doc_id || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT doc_id, m.s, unnest(range(cast(parts AS BIGINT))) AS j FROM documents JOIN means m ON coalesce(source, '') = m.s) d),
counts AS (SELECT doc_id, count(*) AS n FROM draws JOIN terms USING (s) WHERE cdf <= u GROUP BY doc_id)
SELECT doc_id, text, lang, source, n_chars, copy, md5('42:order:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT documents.*, unnest(range(1, n + 1)) AS copy FROM documents JOIN counts USING (doc_id)) c
""",
    "op9_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) d
WINDOW g AS (PARTITION BY t)
""",
    "op12_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
w AS (SELECT n, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 30),
used AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN sizes USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS total FROM used GROUP BY ALL) u USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (total + 5 * v) AS p FROM grp g JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(c) AS c FROM used GROUP BY ALL) x JOIN sizes USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) r WHERE part = 'pair' OR rank <= 50
""",
    "op13_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, cast(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(cast(conv_id AS VARCHAR), ''), lambda x: ord(x)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1)))), 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM t) i),
r AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, string_agg(sha256(length(role) || ':' || role || text), '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, substr(path, 1, 64 * (depth - 1)) AS above FROM p GROUP BY path, depth),
kids AS (SELECT above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
tree AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
sums AS (SELECT substr(path, 1, 64 * i) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS i FROM tree) a GROUP BY 1),
ends AS (SELECT path, sha256(string_agg(cast(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) e GROUP BY path)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, cast(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM tree a LEFT JOIN tree b ON a.depth > 0 AND b.path = a.above JOIN sums s ON s.path = a.path LEFT JOIN ends e ON e.path = a.path
""",
}
