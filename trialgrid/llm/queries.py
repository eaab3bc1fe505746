"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trialgrid.llm import (chat, decontaminate, html, jaccard, langid, linededup, mixing, quality, repair, resample, suffixdedup,
                           tokens, warc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    hostile = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                    role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    segments = chat.format_conversations(turns.unionByName(hostile))
    return chat.read_back(segments, ordered=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from three quarters of the rows."""
    return langid.language_id(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a test item, with the item."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1, repeating: how often each is taken, in words."""
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents"), seed=20))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as ids in files of directly addressable codes, read back."""
    return tokens.token_output(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 100-byte strings that start earlier."""
    return suffixdedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component of near duplicates."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by a field trained on a sample of them."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the lines that an equal or nearly equal line comes before."""
    return linededup.line_duplicates(table(spark, sf_dir, "documents"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the longer documents, drawn by likeness to the benchmark's texts: weight, score and rank of all."""
    ranked = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of archives with revisits resolved, as read back from them."""
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to_key").alias("refers_to"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged by a rule, their faults and the cheapest repair of each."""
    steps = repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))
    return repair.summary(steps, ordered=True)


LLM_QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_output": op5_token_output,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_extract": op9_html_extract,
    "op10_line_dedup": op10_line_dedup,
    "op11_resample": op11_resample,
    "op12_warc": op12_warc,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

# Marks and the spaces beside them take 14, 13 and 9 characters of a turn; other and null roles: 24 and the escaped
# role, and 17. Each control string in a text gets one more character.
CONTROL = r"(</s>|<s>|\[/?(INST|SYS|ANON|ROLE)\]|\[SAYS\])"
OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), numbered AS (
  SELECT *, row_number() OVER w - 1 AS turn_no, lag(coalesce(role, '')) OVER w AS before FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
), judged AS (
  SELECT *, coalesce((turn_no = 0 AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
                  OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user'), false) AS fits,
         length(text) + len(regexp_extract_all(text, '{CONTROL}')) + CASE
           WHEN role IS NULL THEN 17 WHEN role = 'system' THEN 13 WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 9
           ELSE 24 + length(role) + len(regexp_extract_all(role, '{CONTROL}')) END AS chars
  FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn_no)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn_no) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       bool_and(fits) AND coalesce(arg_max(role, turn_no) = 'assistant', false) AS valid,
       min(turn_no) FILTER (NOT fits) AS first_bad_turn
FROM judged GROUP BY conv_id
"""

OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('20|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest
  FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 3.0 * source_size AS cap,
         CAST([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, CAST(least(cap, max(level) OVER () * weight) AS DOUBLE) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.size, CAST(t.source_size AS BIGINT) AS source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (passes + CASE WHEN position + size / 2.0 < target - passes * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

# All pairs of documents that share a shingle, and everything reachable over the links.
OP8_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS no, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT no, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [words]
                          ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])) END AS shingles
  FROM docs
), members AS (
  SELECT no, unnest(shingles) AS shingle FROM sets
), shared AS (
  SELECT a.no AS a, b.no AS b, count(*) AS n FROM members a JOIN members b ON a.shingle = b.shingle AND a.no < b.no GROUP BY a.no, b.no
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.no = a JOIN sets y ON y.no = b WHERE 100 * n >= 75 * (len(x.shingles) + len(y.shingles) - n)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT no, no AS other FROM sets UNION SELECT r.no, b FROM reached r JOIN both_ways ON r.other = a
)
SELECT any_value(s.doc_id) AS doc_id, CAST(any_value(len(s.shingles)) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM reached r JOIN sets s ON s.no = r.no JOIN sets o ON o.no = r.other GROUP BY r.no
"""

# CRC-32 by its rule: the table of a byte's eight steps, then a step per byte of the text.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY b) AS steps
  FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))
)"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text that isn't empty; `steps` is the table."""
    codes = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}), 4294967295)"


OP11_SQL = rf"""
WITH {CRC_TABLE}, texts AS (
  SELECT 'd' AS side, row_number() OVER () AS no, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), cut AS (
  SELECT side, no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
), features AS (
  SELECT side, no, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS feature FROM cut
), hashed AS (
  SELECT feature, {crc32('feature')} % 10000 AS bucket FROM (SELECT DISTINCT feature FROM features), crc_table
), placed AS (
  SELECT side, no, bucket FROM features JOIN hashed USING (feature)
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket
), totals AS (
  SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1.0::DOUBLE) * (all_s + 10000)) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM counts, totals
), means AS (
  SELECT no, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY no
), scored AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM cut LEFT JOIN means USING (no) WHERE side = 'd'
), noisy AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
         25 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS drawn
  FROM noisy
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank
FROM ranked
"""

OP12_SQL = """
WITH pages_read AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS place,
         first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) AS kept
  FROM pages_read
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND place > 1 THEN kept END AS refers_to
FROM judged
"""


def _repair_sql() -> str:
    """From the last row on: per grammar state the least (cost, initials, lines), straight from the rules of the edits."""
    def insert(state: int, to: str) -> str:
        role = "assistant" if state == 2 else "user"
        return f"{{'cost': {to}.cost + 2, 'audit': 'I' || {to}.audit, 'lines': list_prepend('{role}:', {to}.lines)}}"

    def options(state: int) -> str:
        to, role = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}[state]
        found = [f"{{'cost': b{state}.cost + 3, 'audit': 'D' || b{state}.audit, 'lines': b{state}.lines}}",
                 f"CASE WHEN fault NOT IN (1, 2) THEN {{'cost': b{to}.cost + 2 + late, 'audit': 'R' || b{to}.audit, "
                 f"'lines': list_prepend('{role}:' || text, b{to}.lines)}} END"]
        for initial, kept in {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}[state]:
            found.append(f"CASE WHEN fault NOT IN (1, 2) AND substr(role, 1, 1) = '{initial}' THEN {{'cost': b{kept}.cost + late, "
                         f"'audit': 'K' || b{kept}.audit, 'lines': list_prepend(role || ':' || text, b{kept}.lines)}} END")
        return f"list_min([{', '.join(found)}])"

    def settle(source: str, name: str, b: dict[int, str], keep: str) -> str:
        """Inserts lead to another state of the same place: two of them pay at most."""
        return f"""
  SELECT {keep}, list_min([m0, {insert(0, 'n2')}]) AS b0, list_min([m1, {insert(1, 'n2')}]) AS b1, n2 AS b2, n3 AS b3 FROM (
    SELECT *, list_min([m2, {insert(2, 'm3')}]) AS n2, list_min([m3, {insert(3, 'm2')}]) AS n3 FROM (
      SELECT *, {b[0]} AS m0, {b[1]} AS m1, {b[2]} AS m2, {b[3]} AS m3 FROM {source}) AS {name}_m) AS {name}_n"""

    done = "{'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])}"
    never = "{'cost': 1000000, 'audit': '', 'lines': CAST([] AS VARCHAR[])}"
    return rf"""
WITH RECURSIVE {CRC_TABLE}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, role || chr(10) || sha256(text) AS place, {crc32('name')} % 20 AS kind FROM given, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, place,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, place, copy) AS no FROM damaged
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY no) > 1 THEN 2
                 WHEN regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY no) || substr(role, 1, 1) AS pair,
         max(no) OVER (PARTITION BY conv_id) AS n
  FROM ordered
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (no > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), steps AS (
  {settle("(SELECT DISTINCT conv_id, n + 1 AS no FROM judged)", "e", {0: done, 1: never, 2: never, 3: done}, "conv_id, no")}
  UNION ALL
  {settle("(SELECT s.conv_id, j.no, j.role, j.text, j.fault, CASE WHEN j.fault = 3 THEN 1 ELSE 0 END AS late, b0, b1, b2, b3 "
          "FROM steps s JOIN judged j ON j.conv_id IS NOT DISTINCT FROM s.conv_id AND j.no = s.no - 1)", "s",
          {k: options(k) for k in range(4)}, "conv_id, no")}
), best AS (
  SELECT conv_id, b0 FROM steps WHERE no = 1
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b0.cost, 0) AS BIGINT) AS cost,
       coalesce(b0.audit, '') AS audit, sha256(coalesce(array_to_string(b0.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


#: Every 100-byte string of every text, cut from blocks so that no long text is scanned once per string.
OP6_SQL = """
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(coalesce(text, '')) AS h FROM documents
), blocks AS (
  SELECT doc_id, n, origin, substring(h, 2 * origin + 1, 2198) AS b
  FROM (SELECT *, unnest(range(0, n - 99, 1000)) AS origin FROM d WHERE n >= 100)
), windows AS (
  SELECT doc_id, origin + i AS low, md5_number(substring(b, 2 * i + 1, 200)) AS w
  FROM (SELECT *, unnest(range(0, least(1000, n - 99 - origin))) AS i FROM blocks)
), later AS (
  SELECT doc_id, low FROM windows
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, low) > 1
), spans AS (
  SELECT doc_id, min(low) AS low, max(low) + 100 AS high
  FROM (SELECT doc_id, low, sum(new) OVER (PARTITION BY doc_id ORDER BY low) AS run
        FROM (SELECT doc_id, low, CASE WHEN low <= lag(low) OVER (PARTITION BY doc_id ORDER BY low) + 100
                                       THEN 0 ELSE 1 END AS new FROM later))
  GROUP BY doc_id, run
), sums AS (
  SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
), cuts AS (
  SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS first, low AS last
  FROM (SELECT doc_id, low, high FROM spans UNION ALL SELECT doc_id, n, n FROM d)
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * first + 1, 2 * (last - first)), '' ORDER BY first) AS h
  FROM cuts JOIN d USING (doc_id) WHERE last > first GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


LLM_ORACLE: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op4_mix_sources": OP4_SQL,
    "op6_suffix_dedup": OP6_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op11_resample": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_conversation_repair": _repair_sql(),
}
