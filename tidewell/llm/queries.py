"""The contract queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, chat, decontam, fertility, langid, lengths, ordinal, simhash, suffix, urllist

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the tokeniser-fertility verdict on every document, by bands of those labelled of quality and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return fertility.assess(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, public_tokenizers.path(PIECES), good=good)


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, and whether it is probably not of the lowest (toxic). Grades: 0 toxic, 1 neither, 2 of quality."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1)
    model = ordinal.fit(docs, labels.select("doc_id", grade.alias("grade")), grades=3)
    return ordinal.score(docs, model, tail=1).withColumn("kept", F.col("tail_probability") >= 0.5)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes they decode to."""
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected. What a conversation is held against goes by its id mod 4: itself with the last answer cut in half, without its last turn, with its last turn said twice, and the conversation of the next id (no turns if there is none)."""
    own = chat.cut_answers(chat.turns(conversations))
    following = own.select((F.col("conv_id") - 1).alias("conv_id"), F.col("turns").alias("following")).where("pmod(conv_id, 4) = 3")
    case = F.pmod("conv_id", F.lit(4))
    rejected = F.when(case == 1, F.slice("turns", F.lit(1), F.size("turns") - 1)).when(case == 2, F.concat("turns", F.slice("turns", -1, 1))).when(case == 3, F.col("following")).otherwise(F.col("rejected"))
    return own.join(following, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against another one, as preference_pairs has it."""
    pairs = preference_pairs(table(spark, sf_dir, "conversations"))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["from"], s["to"])), ",")
    return chat.preferences(pairs).select(
        "conv_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", F.col("chosen_text").alias("chosen"), F.col("rejected_text").alias("rejected"), shown("chosen_spans").alias("chosen_mask"), shown("rejected_spans").alias("rejected_mask")
    )


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations
), a AS (
  SELECT *, max(CASE WHEN role = 'assistant' THEN i END) OVER (PARTITION BY conv_id) AS last_i, count(*) OVER (PARTITION BY conv_id) AS n, (conv_id % 4 + 4) % 4 AS k FROM t
), other AS (
  SELECT conv_id, i, role, CASE WHEN i = last_i THEN text[1:length(text) // 2] ELSE text END AS text FROM a WHERE k = 0
  UNION ALL SELECT conv_id, i, role, text FROM a WHERE k = 1 AND i < n
  UNION ALL SELECT conv_id, i, role, text FROM a WHERE k = 2
  UNION ALL SELECT conv_id, i + 1, role, text FROM a WHERE k = 2 AND i = n
  UNION ALL SELECT conv_id - 1, i, role, text FROM a WHERE k = 0
), parted AS (
  SELECT conv_id, min(i) AS at FROM (
    SELECT coalesce(a.conv_id, o.conv_id) AS conv_id, coalesce(a.i, o.i) AS i FROM a FULL JOIN other o ON a.conv_id = o.conv_id AND a.i = o.i
    WHERE a.i IS NULL OR o.i IS NULL OR a.role <> o.role OR a.text <> o.text) GROUP BY conv_id
), said AS (
  SELECT s.conv_id, side, i, i >= coalesce(p.at, i + 1) AS later, role, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM (SELECT conv_id, 1 AS side, i, role, text FROM t UNION ALL SELECT conv_id, 2, i, role, text FROM other WHERE conv_id IN (SELECT conv_id FROM t)) s LEFT JOIN parted p ON s.conv_id = p.conv_id
), e AS (
  SELECT *, (sum(length(head || body)) OVER (PARTITION BY conv_id, side, later ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS ends FROM said
)
SELECT conv_id, count(*) FILTER (WHERE NOT later AND side = 1)::BIGINT AS prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE NOT later AND side = 1), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE later AND side = 1), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE later AND side = 2), '') AS rejected,
  coalesce(string_agg((ends - length(body)) || '-' || ends, ',' ORDER BY i) FILTER (WHERE later AND side = 1 AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg((ends - length(body)) || '-' || ends, ',' ORDER BY i) FILTER (WHERE later AND side = 2 AND role = 'assistant'), '') AS rejected_mask
FROM e GROUP BY conv_id
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items of every document against the benchmark, and whether it is contaminated."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("items").cast("array<string>")), ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP7_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(13, len(w)) AS size FROM item WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
), spot AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, size, i, item_id FROM spot JOIN win USING (size, g)
), words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lengths of all documents with the suffix sums that answer every context limit."""
    counts = bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return lengths.suffix_sums(lengths.length_histogram(counts))


def url_list(pages: DataFrame) -> DataFrame:
    """Dated entries on the pages' own domains: of three labels, one in four by the MD5 of its name, is listed on a day; half of these are taken off 90 days later and half of those are listed again after 200."""
    domain = F.array_join(F.slice(F.split(urllist.host_of(F.col("url")), r"\."), -3, 3), ".")
    three = F.size(F.split(urllist.host_of(F.col("url")), r"\.")) >= 3
    code = F.conv(F.substring(F.md5(F.col("domain").cast("binary")), 1, 6), 16, 10).cast("int")
    names = pages.where(three).select(domain.alias("domain")).distinct().withColumn("code", code).where("code % 4 = 0").withColumn("day", F.expr("code div 16 % 600"))
    days = F.when(F.col("code") % 16 == 0, F.array("day", F.col("day") + 90, F.col("day") + 200)).when(F.col("code") % 8 == 0, F.array("day", F.col("day") + 90)).otherwise(F.array("day"))
    return names.select("domain", F.posexplode(days).alias("k", "since")).select("domain", "since", (F.col("k") != 1).alias("listed"))


def op9_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, fetched on a day that its id gives, against the list as of that day."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.pmod(F.col("page_id") * 7919, F.lit(900)).cast("int"))
    found = urllist.evaluate(captures, url_list(pages))
    return found.select("page_id", "host", "fetched", "blocked", "blocked_by", "blocked_since")


OP9_SQL = r"""
WITH capture AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '\.$', ''), '') AS host, (((page_id * 7919) % 900 + 900) % 900)::INT AS fetched FROM pages
), name AS (
  SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM capture WHERE len(string_split(host, '.')) >= 3
), coded AS (
  SELECT domain, ('0x' || substr(md5(domain), 1, 6))::INT AS code FROM name
), entry AS (
  SELECT domain, code // 16 % 600 AS since, TRUE AS listed FROM coded WHERE code % 4 = 0
  UNION ALL SELECT domain, code // 16 % 600 + 90, FALSE FROM coded WHERE code % 8 = 0
  UNION ALL SELECT domain, code // 16 % 600 + 200, TRUE FROM coded WHERE code % 16 = 0
), span AS (
  SELECT domain, since, listed, lead(since) OVER (PARTITION BY domain ORDER BY since) AS until FROM entry
), hit AS (
  SELECT page_id, domain, since, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS k
  FROM capture JOIN span ON (host = domain OR ends_with(host, '.' || domain)) AND listed AND since <= fetched AND (until IS NULL OR fetched < until)
)
SELECT capture.page_id, host, fetched, domain IS NOT NULL AS blocked, domain AS blocked_by, since::INT AS blocked_since
FROM capture LEFT JOIN hit ON capture.page_id = hit.page_id AND k = 1
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is left of every document."""
    found = suffix.repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH doc AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM doc WHERE n >= 100)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), mark AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS new FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), span AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark) GROUP BY doc_id, g
), piece AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER w, 0) AS start, lead(a) OVER w IS NULL AS last_ FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), kept AS (
  SELECT doc_id, n, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * start + 1, 2 * (a - start)) || CASE WHEN last_ THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS h FROM piece JOIN doc USING (doc_id) GROUP BY doc_id, n
)
SELECT doc.doc_id, doc.n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, doc.h))) AS kept_sha256
FROM doc LEFT JOIN kept ON doc.doc_id = kept.doc_id
"""


QUERIES = {f.__name__: f for f in (op1_fertility, op2_ordinal_quality, op3_byte_bpe, op4_simhash, op5_language_id, op6_preference_format, op7_decontamination, op8_length_histogram, op9_url_list, op10_suffix_dedup)}
ORACLE_SQL = {"op6_preference_format": OP6_SQL, "op7_decontamination": OP7_SQL, "op9_url_list": OP9_SQL, "op10_suffix_dedup": OP10_SQL}
