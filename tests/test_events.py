"""Known values of the event scores."""

import random

from pyspark.sql import functions as F

from pressline.operators import events as E

HOUR = 3_600_000_000
NOW = 1_000 * 24 * HOUR


def mention(i, **kw):
    row = dict(event_id=1, id=i, item_id=i, item_revision=1, mention_index=0, source_id=1, content_form="original", materiality="material_update", fingerprint=None, relation="reports",
               source_role="independent_media", independence_group="g", reliability=0.5, importance_profile="leak_general", importance_score=0.5, seen_us=NOW, time_us=NOW, has_media=False)
    return {**row, **kw}


SCHEMA = "event_id long, id long, item_id long, item_revision int, mention_index int, source_id long, content_form string, materiality string, fingerprint string, relation string, source_role string, independence_group string, reliability double, importance_profile string, importance_score double, seen_us long, time_us long, has_media boolean"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def test_heat_repeats_of_one_source(spark):
    rows = E.heat_contributions(frame(spark, [mention(i) for i in range(1, 5)]), F.lit(NOW)).orderBy("item_id").collect()
    assert [r.source_repeat_factor for r in rows] == [1.0, 0.5, 0.25, 0.1]


def test_heat_same_fingerprint_counts_once(spark):
    r = E.event_heat(frame(spark, [mention(1, fingerprint="x"), mention(2, fingerprint="x", seen_us=NOW - HOUR)]), F.lit(NOW)).first()
    assert (r.message_count_total, r.deduplicated_count) == (1, 1)


def test_heat_of_reposts_falls(spark):
    rows = [mention(1)] + [mention(i, source_id=i, content_form="repost", materiality="duplicate") for i in range(2, 22)]
    now, later = (E.event_heat(frame(spark, rows), F.lit(t)).first() for t in (NOW, NOW + 24 * HOUR))
    assert (now.message_count_total, now.unique_sources_24h) == (21, 21) and later.heat_score < now.heat_score


def test_heat_against_loop(spark):
    rng = random.Random(4)
    rows = [mention(i, event_id=rng.randint(1, 3), item_id=rng.randint(1, 40), source_id=rng.randint(1, 4), seen_us=NOW - rng.choice([0, 1, 2, 6, 7, 30, 200]) * HOUR, fingerprint=rng.choice([None, "a", "b", "c"]),
                    content_form=rng.choice(["original", "quote", "repost"]), materiality=rng.choice(["material_update", "duplicate"])) for i in range(200)]
    got = {r.event_id: r.heat_raw for r in E.event_heat(frame(spark, rows), F.lit(NOW)).collect()}
    for event in (1, 2, 3):
        best, free = {}, []
        for r in sorted((r for r in rows if r["event_id"] == event), key=lambda r: r["id"]):
            if r["fingerprint"]:
                k = (r["source_id"], r["fingerprint"])
                if k not in best or r["seen_us"] > best[k]["seen_us"]:
                    best[k] = r
            else:
                free.append(r)
        by_item = {r["item_id"]: r for r in [*sorted(best.values(), key=lambda r: r["id"]), *free]}
        total, history = 0.0, []
        for r in sorted((r for r in by_item.values() if r["seen_us"] >= NOW - 168 * HOUR), key=lambda r: (r["seen_us"], r["item_id"])):
            n = sum(s == r["source_id"] and r["seen_us"] - t <= 6 * HOUR for s, t in history)
            history.append((r["source_id"], r["seen_us"]))
            base = 0.25 if r["content_form"] == "repost" else 0 if r["materiality"] == "duplicate" else 0.7 if r["content_form"] == "quote" else 1
            total += base * 2 ** (-(NOW - r["seen_us"]) / HOUR / 12) * ([1, 0.5, 0.25][n] if n < 3 else 0.1)
        assert abs(got.get(event, 0) - total) < 1e-5


def test_credibility(spark):
    leak = dict(source_role="known_leaker", reliability=0.8)
    one = E.event_credibility(frame(spark, [mention(1, **leak)] + [mention(i, source_role="republisher") for i in range(2, 22)])).first()
    assert (one.credibility_score, one.credibility_level) == (0.69, "plausible")
    two = E.event_credibility(frame(spark, [mention(1, **leak), mention(2, reliability=0.8, independence_group="h")])).first()
    assert two.credibility_level == "corroborated"
    official = dict(source_role="responsible_official")
    for rows, want in (([mention(1, **official)], (1.0, "officially_confirmed")), ([mention(1, relation="denies", **official)], (0.0, "denied")), ([mention(1, **official), mention(2, relation="denies", independence_group="h", **official)], (0.5, "disputed"))):
        r = E.event_credibility(frame(spark, rows)).first()
        assert (r.credibility_score, r.credibility_level) == want


def test_importance(spark):
    rows = [mention(1, importance_score=0.5), mention(2, importance_score=0.7), mention(3, importance_score=0.86), mention(4, importance_score=None), mention(5, importance_score=1.5), mention(6, importance_profile="none")]
    rows += [mention(i, materiality="duplicate") for i in (7, 8, 9)]
    r = E.event_importance(frame(spark, rows)).first()
    assert (r.importance_score, r.dominant_item_id, r.contributions, r.ignored, r.importance_level) == (0.86, 3, 3, 6, "critical")
    assert {x.reason: x.n for x in E.importance_ignored(frame(spark, rows)).collect()} == {"non_material": 3, "missing_or_invalid_domain_score": 1, "domain_score_out_of_range": 1, "missing_or_invalid_profile": 1}


def test_empty(spark):
    assert E.refresh_event_metrics(frame(spark, []), F.lit(NOW)).count() == 0


def test_lifecycle_uses_newest_snapshot(spark):
    rows = [mention(1, time_us=NOW), mention(2, time_us=NOW - HOUR)]
    snapshots = spark.createDataFrame([(1, "resolved"), (2, "unconfirmed")], "mention_id long, lifecycle_status string")
    assert E.event_lifecycle(frame(spark, rows), snapshots).first().lifecycle == "resolved"
    assert E.event_lifecycle(frame(spark, [mention(1, materiality="duplicate")])).first().lifecycle == "stale"
