"""DuckDB SQL of the event queries."""

from __future__ import annotations

from pressline.functions import vocab as V
from pressline.sources.adapter import DUCK_PREFIX, HOUR

DAY = 24 * HOUR
QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)
RANK = "case source_role " + " ".join(f"when '{n}' then {r}" for n, (r, _, _) in V.SOURCE_ROLES.items()) + " else 0 end"
STRENGTH = "case source_role " + " ".join(f"when '{n}' then {low}::double + {gain}::double * least(1.0, greatest(0.0, reliability))" for n, (_, low, gain) in V.SOURCE_ROLES.items()) + " end"
POSITIVE = QUOTED(V.POSITIVE_RELATIONS)


def level(x: str, steps) -> str:
    return "case " + " ".join(f"when {x} < {end} then '{name}'" for end, name in steps[:-1]) + f" else '{steps[-1][1]}' end"


HEAT = f"""
h1 as (select *, fingerprint is not null and length(fingerprint) > 0 fp, row_number() over (partition by event_id, source_id, fingerprint order by seen_us desc, id) rn from mention),
h2 as (select *, row_number() over (partition by event_id, item_id order by fp, id desc) rm from h1 where not fp or rn = 1),
kept as (select * from h2 where rm = 1),
elig as (select k.*, l.as_of from kept k, latest_us l where seen_us >= l.as_of - {7 * DAY}),
fac as (select *, count(*) over (partition by event_id, source_id order by seen_us range between {6 * HOUR} preceding and current row)
   - count(*) over (partition by event_id, source_id, seen_us) + row_number() over (partition by event_id, source_id, seen_us order by item_id) - 1 rep from elig),
con as (select *, case when content_form = 'repost' then 0.25 when materiality = 'duplicate' then 0.0 when content_form = 'quote' then (case when materiality = 'material_update' then 0.7 else 0.4 end) else 1.0 end::double base_weight,
   pow(2.0, -greatest(0.0, (as_of - seen_us) / {float(HOUR)}) / 12) time_decay, (case rep when 0 then 1.0 when 1 then 0.5 when 2 then 0.25 else 0.1 end)::double source_repeat_factor from fac),
hraw as (select event_id, sum(base_weight * time_decay * source_repeat_factor) raw from con group by 1),
hcnt as (select event_id, count(*) message_count_total, count(distinct case when seen_us between as_of - {DAY} and as_of then item_id end) message_count_24h,
   count(distinct case when seen_us between as_of - {DAY} and as_of then source_id end) unique_sources_24h from kept, latest_us group by 1),
heat as (select e.event_id, round(coalesce(raw, 0), 6) heat_raw, round(1 - exp(-coalesce(raw, 0) / 6), 6) heat_score, {level('round(1 - exp(-coalesce(raw, 0) / 6), 6)', V.HEAT_LEVELS)} heat_level,
   message_count_total, message_count_24h, unique_sources_24h, e.n - message_count_total deduplicated_count
   from (select event_id, count(*) n from mention group by 1) e join hcnt using (event_id) left join hraw using (event_id))"""
CRED = f"""
c1 as (select *, {STRENGTH} s from mention where length(independence_group) > 0 and relation <> 'mentions'),
c2 as (select event_id, independence_group, max(s) filter (relation in ({POSITIVE}) and s > 0) pos, max(s) filter (relation = 'denies') neg,
   coalesce(bool_or(relation in ({POSITIVE}) and s > 0 and source_role = 'responsible_official'), false) official,
   coalesce(bool_or(relation = 'denies' and source_role in ('responsible_official', 'direct_subject')), false) authority from c1 group by 1, 2),
c3 as (select event_id, coalesce(max(pos), 0) pos, coalesce(max(neg), 0) neg, count(pos) p, count(neg) n, count_if(official)::bigint o, count_if(authority)::bigint a, count_if(official or authority)::bigint oa, count_if(pos is not null or neg is not null)::bigint ind from c2 group by 1),
c4 as (select e.event_id, coalesce(pos, 0) pos, coalesce(neg, 0) neg, coalesce(p, 0) p, coalesce(n, 0) n, coalesce(o, 0) o, coalesce(a, 0) a, coalesce(oa, 0) oa, coalesce(ind, 0) ind from (select distinct event_id from mention) e left join c3 using (event_id)),
c5 as (select *, (o > 0 and a > 0) or (pos >= 70 and neg >= 70) dis, least(95.0, greatest(0.0, pos + 8 * least(greatest(p - 1, 0), 3) - 15 * least(n, 2))) op from c4),
c6 as (select *, case when dis then 50.0 when a > 0 then 0.0 when o > 0 then 100.0 else op end pts from c5),
cred as (select event_id, round(pts / 100, 6) credibility_score, case when dis then 'disputed' when a > 0 then 'denied' when o > 0 then 'officially_confirmed' when p >= 2 and pts >= 70 then 'corroborated' when pts >= 40 then 'plausible' else 'unverified' end credibility_level,
   round(pos, 4) strongest_positive, round(neg, 4) strongest_negative, p supporting_sources, n contradicting_sources, ind independent_sources, oa official_sources from c6)"""
REASON = f"""case when materiality is distinct from 'material_update' then 'non_material' when importance_score is null then 'missing_or_invalid_domain_score'
   when importance_score not between 0 and 1 then 'domain_score_out_of_range' when importance_profile is null or importance_profile not in ({QUOTED(V.SCORE_BANDS)}) then 'missing_or_invalid_profile' end"""
IMP = f"""
i1 as (select *, {REASON} reason from mention),
i2 as (select *, row_number() over (partition by event_id order by round(importance_score, 4) desc, item_id, item_revision, mention_index) rn from i1 where reason is null),
i3 as (select event_id, count_if(reason is null)::bigint contributions, count_if(reason is not null)::bigint ignored from i1 group by 1),
imp as (select i3.event_id, coalesce(round(t.importance_score, 4), 0) importance_score, {level('coalesce(round(t.importance_score, 4), 0)', V.IMPORTANCE_LEVELS)} importance_level, t.importance_profile dominant_profile, t.item_id dominant_item_id,
   contributions, ignored, (select string_agg(item_id, ',' order by rn) from i2 x where x.event_id = i3.event_id and rn <= 10) evidence_items from i3 left join i2 t on t.event_id = i3.event_id and t.rn = 1)"""
TIMES = "times as (select event_id, min(time_us) first_seen_us, max(time_us) last_seen_us, max(time_us) filter (materiality = 'material_update') last_material_us from mention group by 1)"
REFS = f"""
r1 as (select *, {RANK} rk, row_number() over (partition by event_id, materiality = 'material_update' order by time_us, id) mo, row_number() over (partition by event_id, materiality = 'material_update' order by time_us desc, id desc) ml from mention),
r2 as (select *, row_number() over (partition by event_id, relation in ({POSITIVE}) order by rk desc, reliability desc, time_us, id) pr, row_number() over (partition by event_id, has_media order by rk desc, (materiality = 'material_update') desc, time_us desc, id desc) me from r1),
refs as (select event_id, max(item_id) filter (materiality = 'material_update' and mo = 1) origin_item, max(item_id) filter (materiality = 'material_update' and ml = 1) latest_item,
   max(item_id) filter (relation in ({POSITIVE}) and pr = 1) primary_item, max(item_id) filter (has_media and me = 1) media_item from r2 group by 1)"""
LIFE = """
snap as (select id mention_id, case id % 5 when 0 then 'confirmed' when 1 then 'resolved' when 2 then 'denied' when 3 then null else 'developing' end st from mention),
l1 as (select m.event_id, coalesce(s.st, 'developing') st, row_number() over (partition by event_id order by time_us desc, id desc) rn from mention m join snap s on s.mention_id = m.id where materiality = 'material_update'),
l2 as (select b.event_id, coalesce(l1.st, case when b.m then 'developing' else 'stale' end) status from (select event_id, bool_or(materiality = 'material_update') m from mention group by 1) b left join l1 on l1.event_id = b.event_id and rn = 1),
life as (select l2.event_id, case when credibility_level = 'officially_confirmed' and status in ('unconfirmed', 'developing', 'disputed', 'stale') then 'confirmed' when credibility_level = 'denied' then 'denied' when credibility_level = 'disputed' then 'disputed'
   when status in ('confirmed', 'denied', 'disputed') then 'developing'
   else status end lifecycle from l2 join cred using (event_id))"""


def q(parts: str, select: str) -> str:
    return f"{DUCK_PREFIX},\n{parts}\n{select}"


SQL = {
    "event_heat": q(HEAT, "select * from heat"),
    "event_heat_contributions": q(HEAT, "select event_id, item_id, base_weight, round(time_decay, 6) time_decay, source_repeat_factor, round(base_weight * time_decay * source_repeat_factor, 6) contribution from con"),
    "event_credibility": q(CRED, "select * from cred"),
    "event_importance": q(IMP, "select event_id, importance_score, importance_level, dominant_profile, dominant_item_id, contributions, ignored, evidence_items from imp"),
    "event_importance_ignored": q(IMP, "select event_id, reason, count(*) n from i1 where reason is not null group by 1, 2"),
    "event_times": q(TIMES, "select * from times"),
    "event_references": q(REFS, "select * from refs"),
    "event_lifecycle": q(f"{CRED},\n{LIFE}", "select * from life"),
    "event_refresh_all": q(
        ",\n".join((HEAT, CRED, IMP, TIMES, REFS, LIFE)),
        "select * exclude (evidence_items) from times join heat using (event_id) join cred using (event_id) join imp using (event_id) join refs using (event_id) join life using (event_id)",
    ),
}
