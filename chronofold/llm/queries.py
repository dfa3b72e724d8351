"""Registered queries of the corpus operators and the SQL that some are checked with."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontamination, language_id, main_text, near_dedup, ngram_quality, periodic, rule_ledger, substring_dedup, toxicity, transcripts, warc
from .shared import documents, fold, store

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_quality(spark: SparkSession, directory: str) -> DataFrame:
    labels = spark.read.parquet(f"{directory}/labels.parquet").filter("quality = 1").select("doc_id")
    return ngram_quality.judge(documents(spark, directory, "doc_id", "text", "lang"), labels)


def op2_rule_ledger(spark: SparkSession, directory: str) -> DataFrame:
    rows = rule_ledger.apply_policy(rule_ledger.ledger(documents(spark, directory)), rule_ledger.POLICIES["v1"])
    first = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return rows.select(*first, "n_lines", "n_capitals", "n_exclamations", "failed_bits", "policy")


def op3_bpe(spark: SparkSession, directory: str) -> DataFrame:
    def digests(codec: bpe.Codec, ids: bytes) -> tuple[str, str]:
        return hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

    return bpe.encode(documents(spark, directory), then=digests, schema="ids_sha256 string, decoded_sha256 string")


def op4_substring_dedup(spark: SparkSession, directory: str) -> DataFrame:
    found = substring_dedup.repeats(documents(spark, directory))
    return found.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_chat(spark: SparkSession, directory: str) -> DataFrame:
    turns = spark.read.parquet(f"{directory}/conversations.parquet").select("conv_id", "turn", "role", "text")
    known = store(transcripts.lines_of(transcripts.mark(turns)), "transcript")
    model = transcripts.learn(known.filter(fold("conv_id") != 0))
    decoded = store(transcripts.decode(known.select("conv_id", "at", "line"), model), "decoded")
    right = transcripts.joined_on(decoded.select("conv_id", "at", F.col("role").alias("found")), known.select("conv_id", "at", "role"), ["conv_id", "at"])
    lines = right.groupBy("conv_id").agg(F.count("*").alias("n_lines"), F.count(F.when(F.col("found") == F.col("role"), 1)).alias("n_right"))
    # A conversation's digest is a sum over its messages, so that no conversation is gathered.
    digest = F.xxhash64("message", "rendered").cast("decimal(38,0)")
    chats = transcripts.messages(decoded).groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.sum(F.length("rendered")).alias("n_chars"), F.sum(digest).cast("string").alias("rendered_digest")
    )
    return transcripts.joined_on(lines, chats, ["conv_id"]).select("conv_id", (fold("conv_id") == 0).alias("held_out"), "n_lines", "n_right", "n_messages", "n_chars", "rendered_digest")


def op6_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return near_dedup.groups(documents(spark, directory))


def op7_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs, labels = documents(spark, directory), spark.read.parquet(f"{directory}/labels.parquet")
    model = toxicity.learn(docs, labels.select("doc_id", "toxic").filter(fold() != 0))
    return toxicity.score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def op8_warc(spark: SparkSession, directory: str) -> DataFrame:
    records = warc.round_trip(spark.read.parquet(f"{directory}/pages.parquet").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{directory}/benchmark.parquet").select("item_id", "text")
    found = decontamination.matches(documents(spark, directory), benchmark)
    return found.withColumn("contaminated", F.lit(True))


def op9_language(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory, "doc_id", "text", "lang")
    learned = language_id.learn(docs.filter(fold() != 0))
    found = language_id.predict(docs.select("doc_id", "text"), learned)
    return found.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score", "accepted")


def op11_centroids(spark: SparkSession, directory: str) -> DataFrame:
    return centroids.clusters(spark.read.parquet(f"{directory}/embeddings.parquet").select("vec_id", "embedding"))


def planted_run(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of a document; in every tenth one, by checksum of the key, the rest after some word repeats a stretch."""
    check, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or check % 10 or not n:
        return words
    a, parts = check // 10 % n, 3 + check // 10 % 8
    period = 1 + (n - a) // parts
    return words[:a] + [words[a + i % period] for i in range(n - a)]


def op12_periodic(spark: SparkSession, directory: str) -> DataFrame:
    return periodic.runs(documents(spark, directory), planted_run)


def op13_main_text(spark: SparkSession, directory: str) -> DataFrame:
    return main_text.extract(spark.read.parquet(f"{directory}/pages.parquet").select("page_id", "url", "html"))


QUERIES: dict[str, Query] = {
    "op1_ngram_quality": op1_ngram_quality,
    "op2_rule_ledger": op2_rule_ledger,
    "op3_bpe": op3_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat": op5_chat,
    "op6_near_dedup": op6_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_language": op9_language,
    "op10_decontamination": op10_decontamination,
    "op11_centroids": op11_centroids,
    "op12_periodic": op12_periodic,
    "op13_main_text": op13_main_text,
}

_RULES = ",\n    ".join(f"({rule}) as r{place}" for place, rule in enumerate(rule_ledger.RULES.values()))
_BITS = " + ".join(f"case when r{place} then {1 << place} else 0 end" for place in range(len(rule_ledger.RULES)))
_WORD = r"[^\x20\x09-\x0D]"

_SQUARED = "cast(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(k.v, c.v)]) as bigint)"


def _assigned(place: int) -> str:
    return f"""a{place} as (
  select k.row, k.vec_id, k.v, c.c, {_SQUARED} as d from kept k, c{place} c
  qualify row_number() over (partition by k.row order by d, c.c) = 1
)"""


def _replaced(place: int) -> str:
    return f"""m{place} as (
  select c, i, sum(v[i]) as s, count(*) as n from (select c, v, unnest(range(1, 65)) as i from a{place}) group by c, i
), c{place + 1} as (
  select c.c, coalesce(m.v, c.v) as v from c{place} c
  left join (select c, list(cast(floor_mean as bigint) order by i) as v from (select c, i, (s - ((s % n) + n) % n) // n as floor_mean from m{place}) group by c) m on m.c = c.c
)"""


ORACLES: dict[str, str] = {
    "op2_rule_ledger": rf"""
with texts as (
  select row_number() over () as row, doc_id, coalesce(text, '') as text from documents
), split as (
  select row, doc_id, text, regexp_extract_all(text, '{_WORD}+') as words,
    [x for x in string_split(text, chr(10)) if regexp_matches(x, '{_WORD}')] as lines
  from texts
), windows as (
  select row, unnest(range(1, len(words) - 1)) as i, unnest([words[j:j + 2] for j in range(1, len(words) - 1)]) as w from split
), twice as (
  select row, i from (select row, i, count(*) over (partition by row, w) as n from windows) where n > 1
), covered as (
  select row, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by row
), measured as (
  select s.doc_id, cast(len(words) as bigint) as n_words,
    cast(coalesce(list_sum([length(w) for w in words]), 0) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
    cast(len(lines) as bigint) as n_lines,
    cast(length(regexp_replace(text, '[^A-Z]', '', 'g')) as bigint) as n_capitals,
    cast(length(regexp_replace(text, '[^!]', '', 'g')) as bigint) as n_exclamations
  from split s left join covered c using (row)
), judged as (
  select *, {_RULES} from measured
), bits as (
  select *, cast({_BITS} as bigint) as failed_bits from judged
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 or r1 as base_failed, failed_bits = 0 as kept,
  n_lines, n_capitals, n_exclamations, failed_bits, 'v1' as policy
from bits
""",
    "op8_warc": """
with payloads as (
  select page_id, encode(coalesce(html, '')) as payload from pages
), digests as (
  select page_id, cast(octet_length(payload) as bigint) as payload_bytes, sha1(payload) as payload_digest from payloads
), groups as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as response from digests
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> response then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> response then response end as refers_to
from groups
""",
    "op11_centroids": f"""
with kept as (
  select row_number() over () as row, vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v
  from embeddings where len(embedding) = 64 and list_bool_and([x is not null and isfinite(x) for x in embedding])
), c0 as (
  select row_number() over (order by digest, v) - 1 as c, v from (
    select sha256('1:' || cast(vec_id as varchar)) as digest, v from kept where vec_id is not null order by 1, 2 limit 16)
), {_assigned(0)}, {_replaced(0)}, {_assigned(1)}, {_replaced(1)}, {_assigned(2)}, {_replaced(2)}, {_assigned(3)}
select a.vec_id, cast(a.c as integer) as cluster, a.d as distance,
  cast(sum(a.d) over (partition by a.c) as bigint) as cluster_inertia, cast(sum(a.d) over () as bigint) as inertia,
  sha256(array_to_string(c.v, ',')) as centroid_sha256
from a3 a join c3 c on c.c = a.c
""",
    # For pages with one article element and nothing but headings, paragraphs and bold text in it, as the given ones.
    "op13_main_text": r"""
with articles as (
  select page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') as inner_html from pages
), lines as (
  select page_id, url, string_split(regexp_replace(replace(regexp_replace(inner_html, '</?(h1|p)>', chr(10), 'g'), '<br>', ' '), '<[^>]*>', '', 'g'), chr(10)) as lines from articles
), decoded as (
  select page_id, url, [trim(regexp_replace(regexp_replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) for x in lines] as lines from lines
), whole as (
  select page_id, url, coalesce(array_to_string([x for x in lines if x <> ''], chr(10)), '') as text from decoded
)
select page_id, url, text, cast(length(text) as bigint) as n_chars from whole
""",
}
