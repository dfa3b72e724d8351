"""Evidence selection, graph audit, identities and the crosswalk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import crosswalk, evidence, running, temporal
from .registry import query
from .sqlviews import with_
from .views import Tables, span, ts

EVIDENCE = """
v_evidence as (select event_id as version_id, event_type as source, user_id as entity, 'level' as predicate, 'int' as value_type,
  cast(cast(floor(value/150) as bigint) as varchar) as value, 'FACT' as claim_kind, ts as available_at, ts + interval '7' day as expires_at,
  case when event_id % 41 = 0 then 'SUSPICIOUS' when event_id % 29 = 0 then 'UNKNOWN' else 'KNOWN' end as status from events),
v_supersession as (select event_id * 2 as edge_id, lag(event_id) over w as previous_id, event_id as replacement_id from events
  window w as (partition by event_type, user_id order by ts, event_id) qualify lag(event_id) over w is not null),
v_conflict as (select event_id * 2 + 1 as edge_id, event_id as left_id, lag(event_id) over w as right_id, ts + interval '1' hour as available_at from events
  window w as (partition by user_id order by ts, event_id) qualify lag(event_id) over w is not null and event_id % 19 = 0),
requests as (select u.user_id * 10 + c.i as request_id, u.user_id as entity, 'level' as predicate,
    case when c.i = 3 then 'click' end as source, c.at, c.boundary
  from (select distinct user_id from events) u cross join (values (0, timestamp '2024-01-03 00:00:00', 'AT_OR_BEFORE'),
    (1, timestamp '2024-01-12 06:00:00', 'AT_OR_BEFORE'), (2, timestamp '2024-01-25 00:00:00', 'STRICTLY_BEFORE'), (3, timestamp '2024-02-03 00:00:00', 'AT_OR_BEFORE'),
    (4, timestamp '2024-03-01 00:00:00', 'AT_OR_BEFORE')) c(i, "at", boundary)),
dated as (select v.*, n.available_at as replaced_at from v_evidence v left join v_supersession s on s.previous_id = v.version_id
  left join v_evidence n on n.version_id = s.replacement_id),
met as (select r.request_id, r.at, r.boundary, d.*,
    d.available_at < r.at or (r.boundary = 'AT_OR_BEFORE' and d.available_at = r.at) as avail,
    coalesce(d.replaced_at < r.at or (r.boundary = 'AT_OR_BEFORE' and d.replaced_at = r.at), false) as replaced,
    r.at < d.expires_at as alive
  from requests r join dated d on d.entity = r.entity and (r.source is null or r.source = d.source)),
cur as (select * from met where avail and not replaced and alive),
edge as (select distinct r.request_id from requests r join v_conflict c on c.available_at < r.at or (r.boundary='AT_OR_BEFORE' and c.available_at = r.at)
  join cur a on a.request_id = r.request_id and a.version_id = c.left_id join cur b on b.request_id = r.request_id and b.version_id = c.right_id),
agg as (select r.request_id, any_value(r.boundary) as boundary, count(m.version_id) as n_match, count(case when avail and not replaced and alive then 1 end) as n_current,
    coalesce(bool_or(m.available_at > m.at), false) as future, coalesce(bool_or(m.boundary = 'STRICTLY_BEFORE' and m.available_at = m.at), false) as exact,
    coalesce(bool_or(replaced), false) as superseded, coalesce(bool_or(avail and not replaced), false) as active,
    coalesce(bool_or(avail and not replaced and not alive), false) as expired,
    count(distinct case when avail and not replaced and alive then value end) as claims,
    coalesce(bool_or(avail and not replaced and alive and status='SUSPICIOUS'), false) as susp, coalesce(bool_or(avail and not replaced and alive and status='UNKNOWN'), false) as unk
  from requests r left join met m using (request_id) group by r.request_id)"""


def versions(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select(
        e.alias("version_id"), F.col("event_type").alias("source"), F.col("user_id").alias("entity"), F.lit("level").alias("predicate"),
        F.lit("int").alias("value_type"), F.floor(F.col("value") / 150).cast("string").alias("value"), F.lit("FACT").alias("claim_kind"),
        F.col("ts").alias("available_at"), (F.col("ts") + span("7 days")).alias("expires_at"),
        F.when(e % 41 == 0, "SUSPICIOUS").when(e % 29 == 0, "UNKNOWN").otherwise("KNOWN").alias("status"))


def supersessions(t: Tables) -> DataFrame:
    linked = running.with_previous(t.events, ["event_type", "user_id"], ["ts", "event_id"], ["event_id"], running.calendar_slice("ts"))
    return linked.filter("prev_exists").select((F.col("event_id") * 2).alias("edge_id"), F.col("prev_event_id").alias("previous_id"), F.col("event_id").alias("replacement_id"))


def conflicts(t: Tables) -> DataFrame:
    linked = running.with_previous(t.events, ["user_id"], ["ts", "event_id"], ["event_id"], running.calendar_slice("ts"))
    return linked.filter(F.col("prev_exists") & (F.col("event_id") % 19 == 0)).select(
        (F.col("event_id") * 2 + 1).alias("edge_id"), F.col("event_id").alias("left_id"), F.col("prev_event_id").alias("right_id"),
        (F.col("ts") + span("1 hour")).alias("available_at"))


CURSORS = (("2024-01-03 00:00:00", "AT_OR_BEFORE", None), ("2024-01-12 06:00:00", "AT_OR_BEFORE", None), ("2024-01-25 00:00:00", "STRICTLY_BEFORE", None),
           ("2024-02-03 00:00:00", "AT_OR_BEFORE", "click"), ("2024-03-01 00:00:00", "AT_OR_BEFORE", None))


def requests(t: Tables) -> DataFrame:
    cursors = F.array(*[F.struct(F.lit(i).alias("i"), ts(at).alias("at"), F.lit(b).alias("boundary"), F.lit(s).cast("string").alias("source"))
                        for i, (at, b, s) in enumerate(CURSORS)])
    return t.events.select(F.col("user_id").alias("entity")).distinct().select("entity", F.explode(cursors).alias("c")).select(
        (F.col("entity") * 10 + F.col("c.i")).alias("request_id"), "entity", F.lit("level").alias("predicate"), "c.source", "c.at", "c.boundary")


@query("evidence_select", with_(EVIDENCE) + """
select request_id, case when n_current = 0 and active then 'STALE' when n_current = 0 then 'MISSING'
    when claims > 1 or request_id in (select request_id from edge) then 'CONFLICTING' when susp then 'SUSPICIOUS' when unk then 'UNKNOWN' else 'KNOWN' end as status,
  concat_ws(',', case when future then 'FUTURE_INFORMATION_REJECTED' end, case when exact then 'EXACT_TARGET_AVAILABILITY_REJECTED' end,
    case when superseded then 'SUPERSEDED_VERSIONS_RETAINED_FOR_REPLAY' end, case when expired then 'EVIDENCE_EXPIRED' end,
    case when n_current = 0 then 'NO_USABLE_EVIDENCE' when claims > 1 or request_id in (select request_id from edge) then 'ACTIVE_EVIDENCE_CONFLICT'
      when susp then 'VALIDATION_SUSPICION' when unk then 'UNRESOLVED_EVIDENCE' when boundary = 'STRICTLY_BEFORE' then 'AVAILABLE_STRICTLY_BEFORE_TARGET'
      else 'AVAILABLE_AT_OR_BEFORE_TARGET' end) as reasons, n_current, n_match - n_current as n_rejected from agg""")
def evidence_select(t: Tables) -> DataFrame:
    out = evidence.select(requests(t), versions(t), supersessions(t), conflicts(t))
    return out.select("request_id", "status", "reasons", "n_current", "n_rejected")


@query("evidence_rejected", with_(EVIDENCE) + "select request_id, version_id from met where not (avail and not replaced and alive)")
def evidence_rejected(t: Tables) -> DataFrame:
    return evidence.rejected(requests(t), versions(t), supersessions(t))


BROKEN = EVIDENCE + """,
bs as (select edge_id, case when replacement_id % 173 = 0 then -1 when replacement_id % 131 = 0 then replacement_id
    when replacement_id % 113 = 0 then previous_id - 1 else previous_id end as previous_id, replacement_id from v_supersession),
bc as (select edge_id, left_id, case when left_id % 7 = 0 then left_id + 1 else right_id end as right_id,
    case when left_id % 5 = 0 then available_at - interval '30' day else available_at end as available_at from v_conflict),
ls as (select s.*, p.version_id as pv, n.version_id as nv, p.source as ps, n.source as ns, p.entity as pe, n.entity as ne, p.available_at as pa, n.available_at as na
  from bs s left join v_evidence p on p.version_id = s.previous_id left join v_evidence n on n.version_id = s.replacement_id),
lc as (select c.*, a.version_id as av, b.version_id as bv, a.entity as ae, b.entity as be, greatest(a.available_at, b.available_at) as ma
  from bc c left join v_evidence a on a.version_id = c.left_id left join v_evidence b on b.version_id = c.right_id)"""


@query("evidence_audit", with_(BROKEN) + """
select edge_id, 'LINKED_VERSION_MISSING' as violation from ls where pv is null or nv is null
union all select edge_id, 'LINK_ACROSS_SUBJECTS' from ls where pe <> ne
union all select edge_id, 'SUPERSESSION_ACROSS_SOURCES' from ls where ps <> ns
union all select edge_id, 'AVAILABILITY_NOT_ADVANCING' from ls where na <= pa
union all select edge_id, 'CHAIN_BRANCHES' from bs where previous_id in (select previous_id from bs group by 1 having count(*) > 1)
union all select edge_id, 'CHAIN_MERGES' from bs where replacement_id in (select replacement_id from bs group by 1 having count(*) > 1)
union all select edge_id, 'LINKED_VERSION_MISSING' from lc where av is null or bv is null
union all select edge_id, 'LINK_ACROSS_SUBJECTS' from lc where ae <> be
union all select edge_id, 'CONFLICT_KNOWN_TOO_EARLY' from lc where available_at < ma""")
def evidence_audit(t: Tables) -> DataFrame:
    n, p, left = F.col("replacement_id"), F.col("previous_id"), F.col("left_id")
    bad_links = supersessions(t).withColumn("previous_id", F.when(n % 173 == 0, -1).when(n % 131 == 0, n).when(n % 113 == 0, p - 1).otherwise(p))
    bad_edges = conflicts(t).withColumns({
        "right_id": F.when(left % 7 == 0, left + 1).otherwise(F.col("right_id")),
        "available_at": F.when(left % 5 == 0, F.col("available_at") - span("30 days")).otherwise(F.col("available_at"))})
    return evidence.graph_violations(versions(t), bad_links, bad_edges)


# -- crosswalk ---------------------------------------------------------------------------------

CROSSWALK = """
v_crosswalk as (
  select 'p' || cast(c_nationkey % 3 as varchar) as provider, 'team' as entity_type, c_custkey as provider_key,
    case when c_custkey % 2 = 0 then '  Team   ' else 'TEAM ' end || cast(c_custkey % 400 as varchar) as provider_name,
    case when c_custkey % 31 = 0 then null else c_nationkey end as canonical_id, timestamp '2020-01-01 00:00:00' as valid_from,
    cast(null as timestamp) as valid_to, timestamp '2020-02-01 00:00:00' + (c_custkey % 60) * interval '1' day as recorded_at,
    case when c_custkey % 31 = 0 then 'UNRESOLVED' else 'DECLARED_ALIAS' end as method, case when c_custkey % 23 = 0 then 'PENDING' else 'CONFIRMED' end as review_state,
    cast(1 as bigint) as revision from customer
  union all
  select 'p' || cast(c_nationkey % 3 as varchar), 'team', c_custkey, 'Team ' || cast(c_custkey % 400 as varchar),
    case when c_custkey % 7 = 1 then (c_nationkey + 1) % 25 else c_nationkey end, timestamp '2020-01-01 00:00:00' + (c_custkey % 5) * interval '100' day,
    case when c_custkey % 7 = 0 then timestamp '2021-06-01 00:00:00' end, timestamp '2021-01-01 00:00:00' + (c_custkey % 90) * interval '1' day,
    'DECLARED_ALIAS', case when c_custkey % 19 = 0 then 'REJECTED' else 'CONFIRMED' end, 2 from customer where c_custkey % 7 < 2),
named as (select *, trim(regexp_replace(lower(provider_name), '\\s+', ' ', 'g')) as normal_name from v_crosswalk)"""


def crosswalk_view(t: Tables) -> DataFrame:
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    shared = {"provider": F.concat(F.lit("p"), (nation % 3).cast("string")), "entity_type": F.lit("team"), "provider_key": k}
    number = (k % 400).cast("string")
    def days(base: str, n):
        return ts(base) + F.make_dt_interval(days=n)
    first = t.customer.select(
        *[v.alias(c) for c, v in shared.items()],
        F.concat(F.when(k % 2 == 0, "  Team   ").otherwise("TEAM "), number).alias("provider_name"),
        F.when(k % 31 != 0, nation).alias("canonical_id"), ts("2020-01-01 00:00:00").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), days("2020-02-01 00:00:00", k % 60).alias("recorded_at"),
        F.when(k % 31 == 0, "UNRESOLVED").otherwise("DECLARED_ALIAS").alias("method"),
        F.when(k % 23 == 0, "PENDING").otherwise("CONFIRMED").alias("review_state"), F.lit(1).cast("bigint").alias("revision"))
    second = t.customer.filter(k % 7 < 2).select(
        *[v.alias(c) for c, v in shared.items()], F.concat(F.lit("Team "), number).alias("provider_name"),
        F.when(k % 7 == 1, (nation + 1) % 25).otherwise(nation).alias("canonical_id"), days("2020-01-01 00:00:00", k % 5 * 100).alias("valid_from"),
        F.when(k % 7 == 0, ts("2021-06-01 00:00:00")).alias("valid_to"), days("2021-01-01 00:00:00", k % 90).alias("recorded_at"),
        F.lit("DECLARED_ALIAS").alias("method"), F.when(k % 19 == 0, "REJECTED").otherwise("CONFIRMED").alias("review_state"), F.lit(2).cast("bigint").alias("revision"))
    return ids.with_normal_name(first.unionByName(second), "provider_name")


POINTS = (("2020-03-01 00:00:00", "2020-03-15 00:00:00"), ("2020-12-01 00:00:00", "2021-02-01 00:00:00"),
          ("2021-05-31 00:00:00", "2022-01-01 00:00:00"), ("2021-06-01 00:00:00", "2022-01-01 00:00:00"))
LOOKUP_POINTS = "(values " + ",".join(f"({i}, timestamp '{v}', timestamp '{k}')" for i, (v, k) in enumerate(POINTS)) + ") p(i, valid_at, known_at)"


def points():
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ts(v).alias("valid_at"), ts(k).alias("known_at")) for i, (v, k) in enumerate(POINTS)])).alias("p")


RESOLVED = CROSSWALK + f""",
lookups as (select c_custkey * 10 + p.i as lookup_id, 'p' || cast(c_nationkey % 3 as varchar) as provider, c_custkey as provider_key, p.valid_at, p.known_at
  from customer cross join {LOOKUP_POINTS}),
picked as (select l.lookup_id, l.valid_at, x.* from lookups l join named x on x.provider = l.provider and x.provider_key = l.provider_key
  and x.recorded_at <= l.known_at and x.valid_from <= l.valid_at qualify row_number() over (partition by l.lookup_id order by x.revision desc) = 1),
in_force as (select * from picked where valid_to is null or valid_at < valid_to)"""


@query("crosswalk_resolve", with_(RESOLVED) + """, ladder as (
select l.lookup_id, case when f.revision is null then 'NO_VALID_KNOWN_MAPPING' when f.canonical_id is null or f.review_state <> 'CONFIRMED' then 'UNRESOLVED_OR_UNCONFIRMED'
  else 'RESOLVED' end as reason, f.canonical_id from lookups l left join in_force f using (lookup_id))
select lookup_id, reason, case when reason = 'RESOLVED' then canonical_id end as canonical_id from ladder""")
def crosswalk_resolve(t: Tables) -> DataFrame:
    lookups = t.customer.select("c_custkey", F.concat(F.lit("p"), (F.col("c_nationkey") % 3).cast("string")).alias("provider"), points()).select(
        (F.col("c_custkey") * 10 + F.col("p.i")).alias("lookup_id"), "provider", F.lit("team").alias("entity_type"), F.col("c_custkey").alias("provider_key"), "p.valid_at", "p.known_at")
    return crosswalk.resolve(lookups, crosswalk_view(t))


@query("name_resolve", with_(CROSSWALK) + f""",
lookups as (select g.n * 100 + pr.k * 10 + p.i as lookup_id, 'p' || cast(pr.k as varchar) as provider, 'team ' || cast(g.n as varchar) as asked, p.valid_at, p.known_at
  from (select distinct c_custkey % 410 as n from customer) g cross join (values (0),(1),(2)) pr(k) cross join {LOOKUP_POINTS}),
picked as (select l.lookup_id, l.asked, l.valid_at, x.* from lookups l join named x on x.provider = l.provider
  and x.recorded_at <= l.known_at and x.valid_from <= l.valid_at
  qualify row_number() over (partition by l.lookup_id, x.provider_key order by x.revision desc) = 1),
hit as (select * from picked where (valid_to is null or valid_at < valid_to) and normal_name = asked),
f as (select lookup_id, bool_or(canonical_id is null or review_state <> 'CONFIRMED') as open, count(distinct canonical_id) as n, min(canonical_id) as c from hit group by 1),
ladder as (select lookup_id, case when open then 'UNREVIEWED_NAME_CANDIDATE' when n is null or n = 0 then 'NAME_NOT_FOUND' when n > 1 then 'AMBIGUOUS_NAME' else 'UNIQUE_CONFIRMED_NAME' end as reason, c
  from lookups left join f using (lookup_id))
select lookup_id, reason, case when reason = 'UNIQUE_CONFIRMED_NAME' then c end as canonical_id from ladder""")
def name_resolve(t: Tables) -> DataFrame:
    n = F.col("n")
    lookups = t.customer.select((F.col("c_custkey") % 410).alias("n")).distinct().select(n, F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select(
        "n", "k", points()).select((n * 100 + F.col("k") * 10 + F.col("p.i")).alias("lookup_id"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("provider"),
                                   F.lit("team").alias("entity_type"), F.concat(F.lit("team "), n.cast("string")).alias("normal_name"), "p.valid_at", "p.known_at")
    return crosswalk.resolve_names(lookups, crosswalk_view(t))


@query("crosswalk_audit", with_(CROSSWALK) + """,
bad as (select provider, provider_key, canonical_id, valid_from, method, case when provider_key % 37 = 0 then revision + 1 else revision end as revision,
  case when provider_key % 29 = 0 and revision = 2 then recorded_at - interval '800' day else recorded_at end as recorded_at,
  case when provider_key % 41 = 0 then valid_from else valid_to end as valid_to from v_crosswalk),
s as (select *, lag(revision) over w as pr, lag(recorded_at) over w as pa from bad window w as (partition by provider, provider_key order by revision, recorded_at))
select provider, provider_key, revision, 'REVISION_NOT_CONSECUTIVE' as violation from s where revision <> coalesce(pr, 0) + 1
union all select provider, provider_key, revision, 'KNOWLEDGE_BACKWARDS' from s where recorded_at < pa
union all select provider, provider_key, revision, 'EMPTY_INTERVAL' from s where valid_to <= valid_from
union all select provider, provider_key, revision, 'UNREGISTERED_ENTITY' from s where canonical_id is not null and canonical_id not in (select n_nationkey from nation where n_nationkey < 24)
union all select provider, provider_key, revision, 'RESOLVED_WITHOUT_ID' from s where method <> 'UNRESOLVED' and canonical_id is null""")
def crosswalk_audit(t: Tables) -> DataFrame:
    k = F.col("provider_key")
    rows = crosswalk_view(t).drop("normal_name")
    bad = rows.withColumns({
        "recorded_at": F.when((k % 29 == 0) & (F.col("revision") == 2), F.col("recorded_at") - span("800 days")).otherwise(F.col("recorded_at")),
        "revision": F.when(k % 37 == 0, F.col("revision") + 1).otherwise(F.col("revision")),
        "valid_to": F.when(k % 41 == 0, F.col("valid_from")).otherwise(F.col("valid_to"))})
    entities = t.nation.filter("n_nationkey < 24").select(F.col("n_nationkey").alias("canonical_id"))
    return crosswalk.violations(bad, entities).select("provider", "provider_key", "revision", "violation")


@query("alias_append", with_(CROSSWALK) + """,
adds as (select provider, entity_type, provider_key, canonical_id, recorded_at + (case when provider_key % 3 = 0 then 0 when provider_key % 3 = 1 then 2000 else -30 end) * interval '1' day as recorded_at
  from v_crosswalk where canonical_id is not null and provider_key % 4 < 3),
heads as (select provider, provider_key, max(revision) as head, max(recorded_at) as head_at from v_crosswalk group by 1,2),
fresh as (select a.* from adds a anti join v_crosswalk x on x.provider = a.provider and x.provider_key = a.provider_key and x.canonical_id = a.canonical_id and x.recorded_at = a.recorded_at),
num as (select *, row_number() over (partition by provider, provider_key order by recorded_at, canonical_id) as i from fresh)
select n.provider, n.provider_key, n.canonical_id, n.recorded_at, coalesce(head, 0) + i as revision from num n left join heads using (provider, provider_key)
where head_at is null or n.recorded_at >= head_at""")
def alias_append(t: Tables) -> DataFrame:
    k, base = F.col("provider_key"), crosswalk_view(t)
    shift = F.when(k % 3 == 0, 0).when(k % 3 == 1, 2000).otherwise(-30)
    adds = base.filter(F.col("canonical_id").isNotNull() & (k % 4 < 3)).select(
        *crosswalk.KEY, "canonical_id", (F.col("recorded_at") + F.make_dt_interval(days=shift)).alias("recorded_at"))
    return crosswalk.append_aliases(base, adds).select("provider", "provider_key", "canonical_id", "recorded_at", "revision")


@query("registry_projection", with_(CROSSWALK) + """
select n_nationkey as canonical_id, n_name, count(x.provider_key) as mappings, max(x.recorded_at) as latest_recorded_at, count(distinct x.provider_key) as aliases,
  min(x.provider_key) as first_alias, max(x.provider_key) as last_alias from nation left join v_crosswalk x on x.canonical_id = n_nationkey group by 1,2""")
def registry_projection(t: Tables) -> DataFrame:
    entities = t.nation.select(F.col("n_nationkey").alias("canonical_id"), "n_name")
    return crosswalk.registry_projection(entities, crosswalk_view(t))


@query("normal_names", with_(CROSSWALK) + "select normal_name, count(*) as mappings, count(distinct provider_name) as spellings from named group by 1")
def normal_names(t: Tables) -> DataFrame:
    return crosswalk_view(t).groupBy("normal_name").agg(F.count(F.lit(1)).alias("mappings"), F.count_distinct("provider_name").alias("spellings"))


@query("uuid5_ids", """with j as (select o_orderkey as match_id, '["fixture","' || o_orderpriority || '","' || cast(o_orderkey as varchar) || '"]' as payload from orders),
h as (select match_id, sha1(from_hex('ba1d50eb87a65d259c90f86e8501d91f') || encode(payload)) as x from j)
select match_id, substr(x,1,8) || '-' || substr(x,9,4) || '-5' || substr(x,14,3) || '-' ||
  case when substr(x,17,1) in ('0','4','8','c') then '8' when substr(x,17,1) in ('1','5','9','d') then '9' when substr(x,17,1) in ('2','6','a','e') then 'a' else 'b' end
  || substr(x,18,3) || '-' || substr(x,21,12) as fixture_uuid from h""")
def uuid5_ids(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("match_id"), ids.entity_id("fixture", F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("fixture_uuid"))


@query("market_ids", """select event_id as snapshot_id, sha256('["bookmaker","p' || cast(user_id % 3 as varchar) || '","' || cast(event_id % 12 as varchar) || '"]') as bookmaker_uid,
  sha256('["market","p' || cast(user_id % 3 as varchar) || '","' || cast(user_id % 40 as varchar) || '","HDA_REGULATION"]') as market_uid from events""")
def market_ids(t: Tables) -> DataFrame:
    provider = F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string"))
    return t.events.select(
        F.col("event_id").alias("snapshot_id"), ids.market_id("bookmaker", provider, (F.col("event_id") % 12).cast("string")).alias("bookmaker_uid"),
        ids.market_id("market", provider, (F.col("user_id") % 40).cast("string"), F.lit("HDA_REGULATION")).alias("market_uid"))


@query("alias_keys", """select c_custkey, 'declared-alias:' || cast(c_nationkey as varchar) || ':' || sha256(lower(c_name)) as alias_key from customer""")
def alias_keys(t: Tables) -> DataFrame:
    named = ids.with_normal_name(t.customer, "c_name")
    return named.select("c_custkey", ids.alias_key(F.col("c_nationkey").cast("string"), F.col("normal_name")).alias("alias_key"))


@query("natural_key_predecessor", """with k as (select event_id, ts, sha256(concat_ws('|', event_type, cast(user_id % 25 as varchar), cast(event_id % 2 as varchar))) as natural_key from events)
select event_id, natural_key, lag(event_id) over (partition by natural_key order by ts, event_id) as supersedes_id from k""")
def natural_key_predecessor(t: Tables) -> DataFrame:
    key = F.sha2(F.concat_ws("|", "event_type", (F.col("user_id") % 25).cast("string"), (F.col("event_id") % 2).cast("string")), 256)
    keyed = t.events.select("event_id", "ts", key.alias("natural_key"))
    out = running.with_previous(keyed, ["natural_key"], ["ts", "event_id"], ["event_id"], running.calendar_slice("ts"))
    return out.select("event_id", "natural_key", F.col("prev_event_id").alias("supersedes_id"))
