"""The registered queries of the text and vector operators, and their DuckDB oracles.

Each query runs its operator over the whole of its table and derives the digest columns from the
operator's real output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesmill.llm import audit, chat, credentials, exact, hashing, jaccard, languages, packing, pieces, quality, resampling, sharding, toxicity
from seriesmill.llm.common import FILE, ROW, fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def utf8_sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes; equal texts stay together."""
    placed = sharding.shard_by_size(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming exact deduplication; of equal texts the largest doc_id stays."""
    groups = exact.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE["op8_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query
def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector, by inner product."""
    return hashing.nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of three kinds in every text and, by ownership, live credentials and examples.

    The owner of a document is its source, its repositories are the owner's languages.
    """
    docs = table(spark, sf_dir, "documents")
    found = credentials.scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        utf8_sha(text(base)).alias("base_sha256"), text(F.col("found")).alias("spans"))


ORACLE["op10_secret_scan"] = r"""
WITH texts AS (SELECT doc_id, source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
cut AS (
    SELECT doc_id, source, lang, 'assign' AS kind, 1 AS place, 12 AS least,
           string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS gaps,
           regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS found,
           regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS held
    FROM texts
    UNION ALL
    SELECT doc_id, source, lang, 'access', 2, 18, string_split_regex(text, 'AKIA[A-Z0-9]+'),
           regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+')
    FROM texts
    UNION ALL
    SELECT doc_id, source, lang, 'hex', 3, 16, string_split_regex(text, '[0-9a-f]+'),
           regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+')
    FROM texts),
lined AS (
    SELECT doc_id, source, lang, kind, place, least, generate_subscripts(found, 1) AS i,
           unnest(gaps[1:len(found)]) AS gap, unnest(found) AS match, unnest(held) AS value
    FROM cut WHERE len(found) > 0),
placed AS (
    SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM lined),
base AS (
    SELECT doc_id, source, source || '/' || lang AS repository, kind, place, stop - length(match) AS start, stop, value
    FROM placed WHERE length(value) >= least),
owned AS (
    SELECT value, count(DISTINCT source) AS owners, count(DISTINCT repository) AS repositories FROM base GROUP BY value),
added AS (
    SELECT DISTINCT doc_id,
           CASE WHEN owners <= 1 AND repositories <= 3 AND len(list_distinct(string_split(value, ''))) >= 6
                     AND regexp_matches(value, '[0-9]') THEN 'live' ELSE 'example' END AS kind,
           stop - length(value) AS start, stop
    FROM base JOIN owned USING (value)),
spans AS (
    SELECT doc_id, kind, place, start, stop FROM base
    UNION ALL SELECT doc_id, kind, CASE kind WHEN 'live' THEN 4 ELSE 5 END, start, stop FROM added),
joined AS (
    SELECT doc_id, count(*) FILTER (place = 1) AS n_assign, count(*) FILTER (place = 2) AS n_access,
           count(*) FILTER (place = 3) AS n_hex,
           coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place <= 3), '') AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place, stop) AS spans
    FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN joined USING (doc_id)"""


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether it is within its language's quantile."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded with a SentencePiece vocabulary."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    decoded = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        utf8_sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        utf8_sha(F.col("text")).alias("decoded_sha256"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens in the proportions of their sources."""
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learnt from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, network).select(
        "doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document by the Jaccard index of its five-word n-grams."""
    return jaccard.similar_texts(table(spark, sf_dir, "documents")).drop(FILE, ROW)


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, formatted and read back."""
    tricky = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations")
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(rows.select("conv_id", "turn", "role", "text").unionByName(extra))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for conv_id, text, loss in zip(frame["conv_id"], frame["formatted"], frame["loss"], strict=True):
                turns, learnt = hashlib.sha256(), "".join(chat.unescape(text[s["start"]:s["end"]]) for s in loss)
                said = chat.read_back(text)
                for role, content in said:
                    turns.update(f"{role}\n{content}\n".encode())
                found.append((conv_id, len(said), turns.hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            yield pd.DataFrame(found, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInPandas(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE["op6_chat_format"] = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(text, '(\\*)(\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[TEXT\])', '\1\1\\\2', 'g')) + 3
                + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                  ELSE 21 + length(regexp_replace(role, '(\\*)(\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[TEXT\])', '\1\1\\\2', 'g')) END) AS BIGINT)
           AS formatted_chars
FROM turns GROUP BY conv_id"""


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of all 120 orders, by language."""
    counted = audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return counted.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE["op11_filter_audit"] = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, [w FOR w IN string_split_regex(text, '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM texts),
failed AS (
    SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
           100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) AS c,
           regexp_matches(text, '[#$%&*|]') AS d,
           doc_id > min(doc_id) OVER (PARTITION BY text) AS e,
           EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = worded.doc_id AND l.quality = 1) AS good,
           EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = worded.doc_id AND l.toxic = 1) AS toxic
    FROM worded),
listed AS (
    SELECT part, good, toxic, count(*) AS n,
           concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(coalesce(e, false), 'E', '')) AS failing
    FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (failing = translate(failing, before || own, '')), 0) AS kept,
           coalesce(sum(n) FILTER (contains(failing, own) AND failing = translate(failing, before, '')), 0) AS removed,
           coalesce(sum(n) FILTER (contains(failing, own) AND failing <> translate(failing, before, '')), 0) AS redundant,
           coalesce(sum(n) FILTER (failing = own), 0) AS unique_fails,
           coalesce(sum(n) FILTER (good AND contains(failing, own) AND failing = translate(failing, before, '')), 0) AS good_lost,
           coalesce(sum(n) FILTER (toxic AND contains(failing, own) AND failing = translate(failing, before, '')), 0) AS toxic_lost
    FROM listed, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted"""


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by how much their words are those of the benchmark texts."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every whole text, learnt outside the held-out fold."""
    return languages.classify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "shares")
