"""Registered queries of the training-data operators: thin selections of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtally.llm import ann, hardneg, htmltext, linededup, mixing, packing, quality, runs, secrets, simhash, substring, urls, warc
from prismtally.llm.common import WORD, table
from prismtally.session import scratch_path

VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json
SPECIAL = {"<|endoftext|>": 50256}

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


URL_RULES = [
    urls.parse_rule("org/", urls.ALLOW),
    urls.parse_rule("example.org/es/", urls.BLOCK),
    urls.parse_rule("example.org/en/1", urls.BLOCK),
    urls.parse_rule("com/fr/", urls.ALLOW),
    urls.parse_rule("com/de/", urls.BLOCK),
]

# A small labelled url table: words of hosts that training corpora block, and of hosts and paths that they keep.
BLOCKED_WORDS = (
    "casino win jackpot slots poker bets betting bonus pills pharmacy viagra cheap discount loans payday adult sex porn xxx cams escort "
    "spam farm links seo ads track tracker popunder banner click torrent warez crack keygen replica lottery free"
).split()
KEPT_WORDS = (
    "news blog journal library museum school college science history garden recipes travel weather sport music books review forum help docs "
    "health council village city river mountain castle theatre film radio paper market bakery studio design photo craft"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, blocked``: hosts made of two listed words under neutral names and paths."""
    rows = []
    for words, blocked in ((BLOCKED_WORDS, 1), (KEPT_WORDS, 0), (KEPT_WORDS, 0)):
        for k, word in enumerate(words):
            other = words[(k + 7 + len(rows) % 5) % len(words)]
            front = ("", "www.", "m.", "blog.")[k % 4]
            end = ("com", "net", "org")[k % 3]
            lang = ("en", "de", "fr", "es")[k % 4]
            host = f"{word}-{other}" if blocked or k % 2 else word + other
            rows.append((f"https://{front}{host}.example.{end}/{lang}/{100 + 13 * k}", blocked))
    return spark.createDataFrame(rows, "url string, blocked int")


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", simhash.hex_text(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"), window=50, with_text=False)


ORACLES["op3_substring_dedup"] = r"""
  WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  w AS (SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS body
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)),
  g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY body) AS least FROM w) WHERE least < doc_id),
  r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM g),
  k AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
  t AS (SELECT d.doc_id, unnest(d.words) AS word, unnest(range(1, len(d.words) + 1)) AS i FROM d),
  s AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.i) AS kept, count(*) AS n_kept FROM t ANTI JOIN r ON t.doc_id = r.doc_id AND t.i = r.i GROUP BY t.doc_id)
  SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(len(k.gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
  FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), uri)
    records = warc.read_records(spark, uri).where(F.col("record_type").isin("response", "revisit"))
    size = F.coalesce(F.length("payload").cast("long"), F.col("payload_bytes"))
    first = F.expr(r"try_cast(regexp_extract(refers_to, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)")
    return records.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", first.alias("refers_to"))


ORACLES["op4_warc"] = """
  WITH p AS (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
  h AS (SELECT *, sha1(body) AS hex FROM p)
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             ((CAST('0x' || substr(hex, 10 * (k // 8) + 1, 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31) + 1, 1)), '') AS payload_digest,
         CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
         CASE WHEN first < page_id THEN first END AS refers_to
  FROM h"""


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(
        table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, SPECIAL, with_ids=False
    )
    return packing.placed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed_lines")


ORACLES["op8_line_dedup"] = r"""
  WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
  w AS (SELECT *, list_filter(range(1, len(lines) + 1), lambda i: regexp_matches(lines[i], '[^\x20\x09-\x0D]')) AS worded FROM d),
  p AS (SELECT doc_id, lines, worded, unnest(range(1, len(worded))) AS no FROM w WHERE len(worded) > 1),
  b AS (SELECT doc_id, no, worded[no] AS top, worded[no + 1] AS bottom, array_to_string(lines[worded[no] : worded[no + 1]], chr(10)) AS body FROM p),
  f AS (SELECT doc_id, no, top, bottom, first_value(doc_id) OVER x AS first_doc, first_value(no) OVER x AS first_no
        FROM b WINDOW x AS (PARTITION BY body ORDER BY doc_id, no)),
  r AS (SELECT DISTINCT doc_id, unnest(range(top + CASE WHEN doc_id = first_doc AND no = first_no + 1 THEN 1 ELSE 0 END, bottom + 1)) AS i
        FROM f WHERE doc_id <> first_doc OR no <> first_no),
  g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
  SELECT w.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(
           list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: lines[i]), chr(10)) END AS text,
         CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed_lines
  FROM w LEFT JOIN g ON w.doc_id = g.doc_id"""


@query
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.fit_urls(labelled_urls(spark))
    return urls.judged(table(spark, sf_dir, "pages"), URL_RULES, model).select("page_id", "host", "path", "rule", "verdict")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_spans(table(spark, sf_dir, "documents"), name="found")
    base = secrets.of_kinds("found", tuple(r.kind for r in secrets.BASE))
    counts = [F.size(secrets.of_kinds("found", (r.kind,))).cast("long").alias(f"n_{r.kind}") for r in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written("found").alias("spans"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hardneg.hard_negatives(rows, F.col("vec_id") % 100 == 0, every_row=True)


ORACLES["op12_hard_negatives"] = """
  WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
             FROM embeddings
             WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
               CAST(list_sum(list_transform(range(1, len(a.parts) + 1), lambda i: a.parts[i] * c.parts[i])) AS BIGINT) AS score
        FROM e a, e c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS place
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
  SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS "rank", negative_id, positive_score, negative_score FROM n WHERE place <= 10"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts whose hashed id ends in 0 repeat their words from some place on; all others are unchanged."""
    h = F.crc32(F.col("doc_id").cast("string"))
    picked = docs.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)))
    n, a = F.size("words"), F.col("at")
    placed = picked.withColumn("at", F.when(n > 0, F.col("g") % n))
    placed = placed.withColumn("period", 1 + F.floor((n - a) / (3 + F.col("g") % 8)))
    word = lambda i: F.get("words", F.when(i < a, i).otherwise(a + (i - a) % F.col("period")).cast("int"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return placed.withColumn("text", F.when(a.isNotNull(), repeated).otherwise(F.col("text"))).select(*docs.columns)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("top", runs.strongest("found.runs"))
    return found.select(
        "doc_id",
        F.size("found.runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(runs.written("found.runs"), 256).alias("runs_sha256"),
        F.sha2("found.collapsed", 256).alias("collapsed_sha256"),
    )


# Five words in a row match at least wherever a run goes on, so places whose next five words stand earlier in the text are
# enough; the check value of the id is taken bit by bit.
ORACLES["op13_periodic_runs"] = r"""
  WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                 list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                 lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) AS h
             FROM documents),
  m AS (SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, h // 10 AS g FROM d),
  q AS (SELECT doc_id, list_transform(range(0, len(w)), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) END]) AS words FROM m),
  t AS (SELECT doc_id, unnest(range(0, len(words))) AS i, words FROM q),
  c AS (SELECT doc_id, i, len(words) AS n, array_to_string(words[i + 1 : i + 5], ' ') AS body FROM t WHERE i + 5 <= len(words)),
  p AS (SELECT x.doc_id, x.i, x.i - y.i AS lag FROM c x JOIN c y ON x.doc_id = y.doc_id AND x.body = y.body AND y.i < x.i WHERE 4 * (x.i - y.i) <= x.n),
  s AS (SELECT doc_id, lag, i, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM p),
  f AS (SELECT doc_id, lag, min(i) - lag AS start, count(*) + 4 + lag AS length FROM s GROUP BY doc_id, lag, island),
  r AS (SELECT doc_id, start, length, min(lag) AS period FROM f WHERE length >= greatest(6, 4 * lag) GROUP BY doc_id, start, length),
  l AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS listed FROM r GROUP BY doc_id),
  b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
  k AS (SELECT t.doc_id, string_agg(t.words[t.i + 1], ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
  SELECT q.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
         CAST(1000 * length // period AS BIGINT) AS exponent_milli, coalesce(listed, sha256('')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
  FROM q LEFT JOIN l ON q.doc_id = l.doc_id LEFT JOIN b ON q.doc_id = b.doc_id LEFT JOIN k ON q.doc_id = k.doc_id"""
