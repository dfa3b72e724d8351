"""Scans of raw JSON documents held as text columns (or read with `read_documents`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import temporal

MATCH_DOC = "name string, matches array<struct<round:string,date:string,time:string,team1:string,team2:string,score:string>>"
PROVIDER_DOC = ("array<struct<match_id:bigint,home_team:struct<home_team_id:bigint,home_team_name:string>,away_team:struct<away_team_id:bigint,away_team_name:string>,"
                "home_score:bigint,away_score:bigint,match_date:string,kick_off:string,match_status:string>>")
ARRAYS_DOC = ("utc_offset_seconds int, hourly_units struct<time:string,temperature_2m:string,precipitation:string>, "
              "hourly struct<time:array<string>,temperature_2m:array<double>,precipitation:array<double>>")
SERIES_DOC = ("properties struct<meta:struct<updated_at:string,units:struct<air_temperature:string,precipitation_amount:string>>,timeseries:array<struct<time:string,"
              "data:struct<instant:struct<details:struct<air_temperature:double>>,next_1_hours:struct<details:struct<precipitation_amount:double>>>>>>")
POLICY_DOC = ("source_id string, terms_status string, license_status string, terms_verification string, license_verification string, reviewed_at string, host string, "
              "allowed_urls array<string>, content_types array<string>, stale_after_seconds bigint")


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns evaluated once per row.

    A plain projection may be inlined into every later mention, which would parse a document
    again for each of them; a one-element explode keeps the optimizer from doing that.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(packed)).alias("_pinned")).select(*df.columns, "_pinned.*")


def _within(value: Column, limit: int | None) -> Column:
    """True without a limit."""
    return F.lit(True) if limit is None else value <= limit


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (path, body).  Whole files, split across tasks by Spark."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    return policies(spark.read.text(path).select(F.col("value").alias("body")))


def policies(docs: DataFrame, body: str = "body") -> DataFrame:
    parsed = docs.select(F.from_json(body, POLICY_DOC).alias("_p")).select("_p.*")
    return parsed.withColumn("reviewed_at", text.offset_timestamp(F.col("reviewed_at")))


def strict_json(body: Column, max_bytes: int | None = None) -> Column:
    """Null when acceptable, else why not: syntax, repeated keys, non-finite numbers, scalar root, and size where a limit is given."""
    parsed = F.try_parse_json(body)
    root = F.substring(F.ltrim(body), 1, 1)
    return (F.when(F.octet_length(body) > F.lit(max_bytes).cast("bigint"), "MAX_BYTES_EXCEEDED")
            .when(parsed.isNull() | ~root.isin("{", "["), "PARSE_FAILED"))


def match_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), max_goals: int | None = None, max_matches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected documents); limits hold only where the caller sets them.

    A document is all or nothing: one malformed match rejects it.  A bare score list is kept
    as UNKNOWN_FORMAT and is never final.
    """
    parsed = pin(docs.select(*keep, "body"), d=F.from_json("body", MATCH_DOC)).select(*keep, "d.*")

    def blank(c: Column) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) == ""

    def bad(m: Column) -> Column:
        score = m["score"]
        goals = F.from_json(F.get_json_object(score, "$.ft"), "array<int>")
        ft_text = F.get_json_object(score, "$.ft")
        ft_ok = (F.size(goals) == 2) & F.coalesce(F.forall(goals, lambda g: g.isNotNull() & (g >= 0) & _within(g, max_goals)), F.lit(False))
        bad_score = score.isNotNull() & F.when(score.startswith("{"), ft_text.isNotNull() & ~F.coalesce(ft_ok, F.lit(False))).otherwise(~score.startswith("["))
        return (blank(m["round"]) | blank(m["date"]) | blank(m["team1"]) | blank(m["team2"]) | (m["team1"] == m["team2"])
                | ~F.coalesce(m["date"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) | m["date"].try_cast("date").isNull() | F.coalesce(bad_score, F.lit(False)))

    reason = (F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "NAME_MISSING").when(F.col("matches").isNull() | (F.size("matches") < 1) | ~_within(F.size("matches"), max_matches), "MATCH_COUNT")
              .when(F.exists("matches", bad), "SCHEMA_CHANGED"))
    judged = pin(parsed, reason=reason)
    rows = judged.filter(F.col("reason").isNull()).select(*keep, F.col("name").alias("competition"), F.explode("matches").alias("m")).select(*keep, "competition", "m.*")
    goals, final = F.col("goals"), F.col("goals").isNotNull()
    shaped = pin(rows, goals=F.from_json(F.get_json_object("score", "$.ft"), "array<int>")).select(
        *keep, "competition", "round", F.col("date").cast("date").alias("match_date"), F.col("time").alias("kickoff_local"), F.col("team1").alias("home_team"),
        F.col("team2").alias("away_team"), goals[0].alias("home_score"), goals[1].alias("away_score"),
        F.when(F.col("score").isNull(), "NOT_REPORTED").when(final, "PARSED_FULL_TIME").otherwise("UNKNOWN_FORMAT").alias("score_state"),
        F.when(final, "REPORTED_FINAL").otherwise("SCHEDULED").alias("status"))
    return shaped, judged.filter(F.col("reason").isNotNull()).select(*keep, "reason")


def provider_matches(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), provider: str = "provider") -> tuple[DataFrame, DataFrame]:
    """(matches, rejected entries) of integer-keyed documents; ids become provider-scoped text keys."""
    entries = docs.select(*keep, F.posexplode_outer(F.from_json("body", PROVIDER_DOC)).alias("position", "m"))
    m = F.col("m")
    missing = m["match_id"].isNull() | m["home_team"]["home_team_id"].isNull() | m["away_team"]["away_team_id"].isNull()
    sound = (m["home_score"] >= 0) & (m["away_score"] >= 0) & m["match_date"].try_cast("date").isNotNull()
    reason = F.when(m.isNull(), "PARSE_FAILED").when(missing, "KEY_MISSING").when(~F.coalesce(sound, F.lit(False)), "INVALID_VALUE")
    judged = pin(entries, reason=reason)

    def scoped(kind: str, c: Column) -> Column:
        return F.concat_ws(":", F.lit(provider), F.lit(kind), c.cast("string"))

    rows = judged.filter(F.col("reason").isNull()).select(
        *keep, scoped("match", m["match_id"]).alias("fixture_id"), scoped("team", m["home_team"]["home_team_id"]).alias("home_entity_id"),
        scoped("team", m["away_team"]["away_team_id"]).alias("away_entity_id"), m["home_score"].alias("home_score"), m["away_score"].alias("away_score"),
        m["match_date"].cast("date").alias("match_date"), F.coalesce(m["match_status"], F.lit("unknown")).alias("match_status"))
    return rows, judged.filter(F.col("reason").isNotNull()).select(*keep, "position", "reason")


def _ascending(times: Column) -> Column:
    """No null and strictly increasing, checked inside the array."""
    n = F.size(times)
    return F.forall(F.sequence(F.lit(0), n - 1), lambda i: times[i].isNotNull() & ((i == 0) | (F.get(times, i) > F.get(times, i - 1))))


def forecast_arrays(docs: DataFrame, captured_at: Column, keep: tuple[str, ...] = ("doc_id",), max_hours: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(still-future hours, rejected documents) of parallel-array forecasts; values stay hypotheses.

    max_hours rejects longer documents and later hours, where the caller sets it.
    """
    read = pin(docs.select(*keep, captured_at.alias("captured_at"), "body"), d=F.from_json("body", ARRAYS_DOC)).drop("body")
    h, u, times = F.col("d.hourly"), F.col("d.hourly_units"), F.col("times")
    parsed = pin(read, times=F.transform(h["time"], lambda t: t.try_cast("timestamp_ntz")))
    def within(c: Column, lo: float, hi: float) -> Column:
        return F.forall(c, lambda v: F.coalesce(v.between(lo, hi), F.lit(False)))
    sound = (
        (F.col("d.utc_offset_seconds") == 0) & (u["time"] == "iso8601") & (u["temperature_2m"] == "°C") & (u["precipitation"] == "mm")
        & (F.size(h["time"]) >= 1) & _within(F.size(h["time"]), max_hours) & (F.size(h["time"]) == F.size(h["temperature_2m"])) & (F.size(h["time"]) == F.size(h["precipitation"]))
        & within(h["temperature_2m"], -100, 70) & within(h["precipitation"], 0, 500) & _ascending(times)
        & (F.try_element_at(times, F.lit(-1)) > F.col("captured_at"))
        & (F.lit(True) if max_hours is None else F.try_element_at(times, F.lit(-1)) <= F.col("captured_at") + F.make_dt_interval(hours=F.lit(max_hours))))
    judged = parsed.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    zipped = F.arrays_zip(times.alias("target_at"), h["temperature_2m"].alias("temperature_c"), h["precipitation"].alias("precipitation_mm"))
    rows = judged.filter("_ok").select(*keep, "captured_at", F.explode(zipped).alias("z")).select(
        *keep, F.col("z.target_at").alias("target_at"), F.col("z.temperature_c").alias("temperature_c"), F.col("z.precipitation_mm").alias("precipitation_mm"), "captured_at")
    future = rows.filter(F.col("target_at") > F.col("captured_at")).withColumn("epistemic_state", F.lit("HYPOTHESIS"))
    return future, judged.filter(~F.col("_ok")).select(*keep)


def forecast_series(docs: DataFrame, captured_at: Column, keep: tuple[str, ...] = ("doc_id",), max_points: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hours of the next three days, rejected documents) of nested series; missing rain is flagged, not filled."""
    read = pin(docs.select(*keep, captured_at.alias("captured_at"), "body"), d=F.from_json("body", SERIES_DOC)).drop("body")
    at, meta = F.col("captured_at"), F.col("d.properties.meta")
    def point(s: Column) -> Column:
        data = s["data"]
        return F.struct(text.offset_timestamp(s["time"]).alias("at"), data["instant"]["details"]["air_temperature"].alias("degrees"),
                        data["next_1_hours"]["details"]["precipitation_amount"].alias("rain"))
    clocked = pin(read, series=F.transform("d.properties.timeseries", point), updated=text.offset_timestamp(F.col("d.properties.meta.updated_at")))
    parsed = clocked.withColumn("times", F.col("series.at"))  # clocks are parsed once
    series, times, updated = F.col("series"), F.col("times"), F.col("updated")
    def point_ok(p: Column) -> Column:
        degrees, rain, when = p["degrees"], p["rain"], p["at"]
        asked = (when > at) & (when <= at + F.expr("interval 3 days"))
        return ~asked | (F.coalesce(degrees.between(-100, 70), F.lit(False)) & (rain.isNull() | rain.between(0, 500)))
    sound = (
        (meta["units"]["air_temperature"] == "celsius") & (meta["units"]["precipitation_amount"] == "mm") & (F.size(series) >= 1) & _within(F.size(series), max_points)
        & (updated <= at) & (updated >= at - F.expr("interval 2 days")) & _ascending(times) & F.forall(series, point_ok)
        & F.exists(times, lambda t: (t > at) & (t <= at + F.expr("interval 3 days"))))
    judged = parsed.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    rows = judged.filter("_ok").select(*keep, "captured_at", F.explode(series).alias("s")).select(
        *keep, F.col("s.at").alias("target_at"), F.col("s.degrees").alias("temperature_c"), F.col("s.rain").alias("precipitation_next_hour_mm"), "captured_at")
    asked = rows.filter((F.col("target_at") > at) & (F.col("target_at") <= at + F.expr("interval 3 days")))
    return asked.withColumn("precipitation_missing", F.col("precipitation_next_hour_mm").isNull()), judged.filter(~F.col("_ok")).select(*keep)


# -- envelopes ---------------------------------------------------------------------------------

SOURCE = "struct<source_id:string,url:string,source_type:string,observed_at:string,access_method:string,terms_status:string,license_status:string,robots_status:string,confidence:double>"
ARTIFACT = "struct<relative_path:string,sha256:string,media_type:string,size_bytes:bigint,downloaded_at:string>"
OBSERVATION = "struct<observation_type:string,entity_type:string,entity_name:string,value:string,unit:string,observed_at:string,effective_at:string,source_id:string,confidence:double,synthetic:boolean>"
ENVELOPE = (f"schema_version string, handoff_id string, producer string, created_at string, capture_method string, status string, reason string, observed_failure string, "
            f"browser_evidence string, sources array<{SOURCE}>, artifacts array<{ARTIFACT}>, observations array<{OBSERVATION}>")
FIELDS = tuple(f.split(" ")[0] for f in ENVELOPE.split(", "))
# What each producer must use, and the provenance it confers.
CAPTURE = {"codex-desktop": "desktop-browser", "human-browser": "human-browser", "python-fetch": "python-fetch", "test-fixture": "synthetic"}
ACCESS = {"codex-desktop": "rendered-browser", "human-browser": "manual-browser", "python-fetch": "python-fetch", "test-fixture": "synthetic"}
PROVENANCE = {"codex-desktop": "DESKTOP_CONFIRMED", "human-browser": "MANUAL", "python-fetch": "CLI_FETCHED", "test-fixture": "SYNTHETIC"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _repeats(values: Column) -> Column:
    return F.size(F.array_distinct(values)) < F.size(values)


def envelopes(docs: DataFrame, now: Column, keep: tuple[str, ...] = ("doc_id",), limits: tuple[int | None, int | None, int | None] = (None, None, None)) -> DataFrame:
    """Parsed envelope with its reason codes (all of them, in rule order) and provenance.

    limits: most sources, artifacts and observations, where the caller sets them.
    """
    parsed = pin(docs.select(*keep, "body"), e=F.from_json("body", ENVELOPE))
    e = F.col("e")
    producer, sources, artifacts, observations = e["producer"], e["sources"], e["artifacts"], e["observations"]

    def clocked(rows: Column, clock: str, *fields: str) -> Column:
        return F.transform(rows, lambda x: F.struct(text.offset_timestamp(x[clock]).alias("at"), *[x[f].alias(f) for f in fields]))
    # every clock is parsed once, not again in each rule and for each pair
    timed = pin(parsed, created=text.offset_timestamp(e["created_at"]), _seen=clocked(sources, "observed_at", "source_id"),
                _fetched=clocked(artifacts, "downloaded_at"), _said=clocked(observations, "observed_at", "source_id"))
    created = F.col("created")
    blocked, genuine = e["status"] == "BLOCKED", producer != "test-fixture"
    known_ids = F.transform(sources, lambda s: s["source_id"])
    def late(x: Column) -> Column:
        return x["at"].isNull() | (x["at"] > created)
    def observed_after_source(o: Column) -> Column:
        own = F.filter("_seen", lambda s: s["source_id"] == o["source_id"])
        return F.exists(own, lambda s: o["at"] > s["at"])
    unexpected = F.size(F.array_except(F.json_object_keys("body"), F.array(*[F.lit(f) for f in FIELDS]))) > 0
    rules = {
        "PARSE_FAILED": strict_json(F.col("body")).isNotNull(),
        "UNEXPECTED_OR_MISSING_FIELDS": unexpected | e["handoff_id"].isNull() | sources.isNull() | observations.isNull() | artifacts.isNull(),
        "INVALID_SCHEMA_ENUM": ~F.coalesce(producer.isin(*CAPTURE) & e["status"].isin("SUCCESS", "BLOCKED"), F.lit(False)),
        "ARRAY_LIMIT": (F.size(sources) < 1) | ~_within(F.size(sources), limits[0]) | ~_within(F.size(artifacts), limits[1]) | ~_within(F.size(observations), limits[2]),
        "PRODUCER_CAPTURE_MISMATCH": e["capture_method"] != _lookup(CAPTURE, producer),
        "FUTURE_TIMESTAMP": created.isNull() | (created > now),
        "INVALID_BLOCKED_EVIDENCE": blocked & (e["reason"].isNull() | e["observed_failure"].isNull() | (F.size(observations) > 0)),
        "SUCCESS_REQUIRES_DATA_AND_ARTIFACT": ~blocked & ((F.size(observations) == 0) | (F.size(artifacts) == 0)),
        "DESKTOP_EVIDENCE_REQUIRED": (producer == "codex-desktop") & ~blocked & e["browser_evidence"].isNull(),
        "DUPLICATE_SOURCE": _repeats(known_ids),
        "ACCESS_METHOD_MISMATCH": F.exists(sources, lambda s: s["access_method"] != _lookup(ACCESS, producer)),
        "ROBOTS_UNVERIFIED": ~blocked & genuine & F.exists(sources, lambda s: ~s["robots_status"].isin("ALLOWED", "ABSENT")),
        "SYNTHETIC_SOURCE_REQUIRED": ~genuine & F.exists(sources, lambda s: s["source_type"] != "SYNTHETIC"),
        "DUPLICATE_ARTIFACT": _repeats(F.transform(artifacts, lambda a: F.lower(a["relative_path"]))) | _repeats(F.transform(artifacts, lambda a: a["sha256"])),
        "OBSERVATION_SOURCE_UNKNOWN": F.exists(observations, lambda o: ~F.array_contains(known_ids, o["source_id"])),
        "INVALID_TIMESTAMP_ORDER": F.exists("_seen", late) | F.exists("_fetched", late) | F.exists("_said", lambda o: late(o) | observed_after_source(o)),
        "SYNTHETIC_LABEL_REQUIRED": ~genuine & F.exists(observations, lambda o: ~o["synthetic"]),
        "INVALID_ODDS": F.exists(observations, lambda o: (o["observation_type"] == "decimal_odds") & ~F.coalesce(o["value"].try_cast("double") > 1, F.lit(False))),
        "DUPLICATE_OBSERVATION": _repeats(F.transform(observations, lambda o: F.to_json(o))),
    }
    confirmed = _lookup(PROVENANCE, producer)
    judged = pin(timed, reasons=temporal.reasons(rules), provenance=F.when(blocked & (confirmed == "DESKTOP_CONFIRMED"), "DESKTOP_BLOCKED").otherwise(confirmed))
    return judged.select(*parsed.columns, "reasons", "created", "provenance")


def envelope_observations(judged: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Observations of accepted envelopes enriched from their own source; confidence is the weaker one."""
    good = judged.filter(F.size("reasons") == 0)
    rows = good.select(*keep, F.col("e.handoff_id").alias("handoff_id"), F.col("provenance"), F.col("created").alias("available_at"), F.col("e.sources").alias("_s"), F.posexplode("e.observations").alias("position", "o"))
    own = F.filter("_s", lambda s: s["source_id"] == F.col("o.source_id"))[0]
    return rows.select(
        *keep, "handoff_id", "position", F.col("o.observation_type").alias("observation_type"), F.col("o.entity_name").alias("entity_name"), F.col("o.value").alias("value"),
        F.col("o.source_id").alias("source_id"), own["url"].alias("source_url"), own["source_type"].alias("source_type"),
        text.offset_timestamp(F.col("o.observed_at")).alias("observed_at"), "available_at",
        F.least(F.col("o.confidence"), own["confidence"]).alias("confidence"), F.when(F.col("o.synthetic"), "SYNTHETIC").otherwise(F.col("provenance")).alias("provenance"),
        F.sha2(F.concat_ws("|", "o.source_id", "o.observation_type", "o.entity_type", "o.entity_name", F.coalesce("o.unit", F.lit("")), F.col("o.synthetic").cast("string")), 256).alias("natural_key"))
