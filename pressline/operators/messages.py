"""Scoring, validity and routing of messages, as column expressions and broadcastable
dimension joins; nothing here shuffles the messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressline.functions import vocab as V

# Signals in the text that select a profile (fixed values).
HOTFIX = r"不停机.{0,8}(?:更新|维护)|(?:无需|不用)停机.{0,8}(?:更新|维护)|热(?:更新|修复)|hotfix|micro\s*patch|server[-\s]?side\s+update"
FULL_PREVIEW = r"full\s+preview|完整预览"
RARE_COSMETIC = r"稀有|限定|绝版|rare|limited|神话炫彩"
COSMETIC = r"炫彩|皮肤|chroma|skin"
BULK_REFRESH = r"大量|批量|上新|版本更新|全新内容|多款|multiple|refresh"
PAID_CHROMA = r"臻彩"
EXPLICIT_PRESTIGE = r"至臻|神话(?:级)?(?:皮肤|炫彩)|prestige\s+(?:skin|chroma)|mythic\s+(?:skin|chroma)"
WORLD_EVENT = r"worlds|全球总决赛|世界赛"
FINAL = r"总决赛|决赛|\bfinals?\b"
PLAYOFF = r"季后赛|淘汰赛|半决赛|playoffs?|semifinals?"
FREE_SKIN = (
    r"(?:免费|无偿|必得|可领|领取|领到|获得|兑换|解锁|开箱).{0,16}(?:随机|限定|至臻|神话)?皮肤"
    r"|皮肤.{0,16}(?:免费|无偿|必得|可领|可以领取|开放领取|领取|领到|获得|兑换|开箱)|free.{0,16}skin|skin.{0,16}(?:claim|reward|unbox)"
)
LOTTERY = r"抽奖|概率|有机会|召唤"
WEEKLY_FREE = r"周免(?:英雄)?|每周免费英雄|免费英雄(?:更新|轮换)|weekly\s+free\s+champions?|free(?:-to-play)?\s+champion\s+rotation"


def says(content: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode classes; a dot stops at line feeds only."""
    return content.rlike("(?iudU)" + pattern)


def special_profile(message_type: Column, families: Column, content: Column) -> Column:
    """Profiles that the text decides; null where the routing table does."""
    has = lambda name: F.array_contains(families, name)
    shop = F.when(says(content, RARE_COSMETIC), "shop_rare_cosmetic").when(says(content, BULK_REFRESH), "shop_bulk_refresh").when(says(content, COSMETIC), "shop_cosmetic_rotation").otherwise("shop_daily_standard")
    final, playoff = says(content, FINAL), says(content, PLAYOFF)
    match = (
        F.when(says(content, WORLD_EVENT), F.when(final | playoff, "worlds_key").otherwise("worlds_regular"))
        .when(final, "esports_final").when(playoff, "esports_playoffs").otherwise("esports_regular")
    )
    return (
        F.when((message_type == "game_notice") & says(content, HOTFIX), "patch_hotfix")
        .when((message_type == "game_official_preview") & says(content, FULL_PREVIEW), "patch_full_preview")
        .when((message_type == "game_announcement") & has("gameplay") & says(content, WEEKLY_FREE), "weekly_free_champion_rotation")
        .when((message_type == "game_community_notice") & has("commerce"), shop)
        .when((message_type == "game_community_notice") & has("activity") & says(content, FREE_SKIN) & ~says(content, LOTTERY), "activity_free_skin")
        .when((message_type == "esports_announcement") & has("esports_matches"), match)
    )


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def topic_families(topics: Column) -> Column:
    """Scoring families of a topic list, in order, without repeats; unknown codes are dropped."""
    table = _map({t: f for t, _, f in V.TOPICS})
    return F.array_distinct(F.filter(F.transform(topics, lambda t: table[t]), lambda f: f.isNotNull()))


def importance_profile(df: DataFrame) -> DataFrame:
    """Adds ``profile`` to message_type, topics, content: the text's verdict, or the
    first route of the type that meets one of the topics' families."""
    families = topic_families(F.col("topics"))
    routes = {}
    for t, rs in V.PROFILE_ROUTES.items():
        out = None
        for names, profile in reversed(rs):
            out = F.lit(profile) if names == V.ANY else F.when(F.arrays_overlap(F.col("_families"), F.array(*map(F.lit, names))), profile).otherwise(out)
        routes[t] = out
    routed = F.lit(None).cast("string")
    for t, c in routes.items():
        routed = F.when(F.col("message_type") == t, c).otherwise(routed)
    chosen = F.when(F.size("_families") > 0, F.coalesce(special_profile(F.col("message_type"), F.col("_families"), F.col("content")), routed))
    return df.withColumn("_families", families).withColumn("profile", chosen).drop("_families")


def _in(profile: Column, names: str) -> Column:
    return profile.isin(*names.split())


def profile_score(df: DataFrame) -> DataFrame:
    """Adds ``profile_score`` and ``modifier_total`` to a frame with profile, content and features."""
    spark = df.sparkSession
    p, skin = F.col("profile"), _in(F.col("profile"), "cosmetic_announcement promotion_cosmetic")
    strong = _in(p, "patch_hotfix service_notice security_notice")
    scale = F.when(F.col("scale") == "minor", F.when(strong, -0.07).otherwise(-0.03)).when(F.col("scale") == "major", F.when(strong, 0.09).otherwise(0.03)).otherwise(0.0)
    bulk = F.when(F.col("is_bulk_update") & ~_in(p, "shop_bulk_refresh patch_full_preview patch_official_notes weekly_free_champion_rotation"), 0.03).otherwise(0.0)
    r = F.col("competition_region")
    region = F.when(p.startswith("esports_") | p.startswith("worlds_"), F.when(r == "lpl", 0.03).when(r == "lck", 0.0).when(r == "international", 0.01).otherwise(-0.03)).otherwise(0.0)
    fame = F.when(_in(p, "esports_regular esports_playoffs esports_final worlds_regular worlds_key roster_announcement esports_rumor"), F.when(F.col("prominence") == "notable", 0.03).when(F.col("prominence") == "star", 0.07).otherwise(0.0)).otherwise(0.0)
    t = F.col("skin_tier")
    lowered = (t == "prestige_or_mythic") & says(F.col("content"), PAID_CHROMA) & ~says(F.col("content"), EXPLICIT_PRESTIGE)
    tier = F.when(skin & ~lowered, F.when(t == "legendary", 0.04).when(t == "prestige_or_mythic", 0.06).when(t == "ultimate", 0.10).otherwise(0.0)).otherwise(0.0)
    joined = df.join(F.broadcast(V.bands_table(spark)), "profile", "left")
    total = scale + bulk + region + fame + tier
    clamped = F.round(F.least(F.col("cap"), F.greatest(F.col("floor"), F.col("base") + total)), 4)
    return joined.withColumn("modifier_total", F.round(total, 4)).withColumn("profile_score", clamped).drop("base", "floor", "cap")


def message_importance(df: DataFrame) -> DataFrame:
    """Adds ``profile``, ``modifier_total``, ``profile_score`` and ``importance``."""
    scored = profile_score(importance_profile(df))
    form = F.when(F.col("content_form") == "repost", -0.08).otherwise(0.0)
    return scored.withColumn("importance", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("profile_score") + form)), 4))


def priority(score: Column, content_form: Column, audience_region: Column) -> Column:
    delta = F.when(content_form == "quote", -0.02).otherwise(0.0) + F.when(audience_region == "international_only", -0.12).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + delta)), 4)


def published_labels(df: DataFrame) -> DataFrame:
    """What is published of message_type, topics, importance and priority: a message that
    is media or a link only has unknown labels and zero scores."""
    bare = F.col("content_form").isin("media_only", "link_only")
    return df.withColumns({
        "message_type": F.when(bare, "unknown").otherwise(F.col("message_type")), "topics": F.when(bare, F.array(F.lit("unknown"))).otherwise(F.col("topics")),
        "importance": F.when(bare, 0.0).otherwise(F.col("importance")), "priority": F.when(bare, 0.0).otherwise(F.col("priority")),
    })


#: The account whose pictures preview patches (fixed value).
PREVIEW_ACCOUNT = "riotphroxzon"


def is_patch_preview(has_media: Column, title: Column, text: Column, connector: Column, account: Column) -> Column:
    """Whether a message's images are previews of a patch: by its words and its account."""
    words = F.lower(F.concat_ws("\n", title, text))
    named = words.contains("preview") | words.contains("micropatch") | words.contains("hotfix")
    return F.coalesce(has_media & named & (connector == "x_twitter") & (F.lower(account) == PREVIEW_ACCOUNT), F.lit(False))


# ---- classification ---------------------------------------------------------------

#: Texts of the rules (fixed values).
ERRORS = {
    "source_kind": "source_kind 包含不受支持的值",
    "product_count": "products 必须包含 1-3 个不重复值",
    "product_value": "products 包含不受支持的值",
    "product_order": "products 必须按受控目录顺序输出",
    "product_unknown": "unknown product 不能与其他产品并列",
    "form_value": "content_form 包含不受支持的值",
    "form_products": "纯媒体或纯链接消息的 products 必须为 unknown",
    "type_value": "message_type 包含不受支持的值",
    "topic_count": "topics 必须包含至少一个不重复值",
    "topic_value": "topics 包含不受支持的值",
    "topic_order": "topics 必须按受控目录顺序输出",
    "topic_unknown": "unknown topic 不能与其他主题并列",
    "form_type": "纯媒体或纯链接消息的 message_type 和 topics 必须为 unknown",
    "type_product": "message_type 不适用于所选 products",
    "type_source": "message_type 不适用于当前信源性质",
    "topic_product": "topic={} 不适用于所选 products",
    "bare_content": "纯媒体或纯链接消息的摘要和实体必须为空",
    "title": "可处理消息必须生成标题",
    "summary": "可处理消息必须生成摘要",
}


def _literals(xs) -> Column:
    return F.array(*map(F.lit, xs))


def _content_rules(products: Column, content_form: Column, e: dict[str, Column]) -> Column:
    n = F.coalesce(F.size(products), F.lit(0))
    return (
        F.when((n < 1) | (n > 3) | (F.size(F.array_distinct(products)) < n), e["product_count"])
        .when(F.size(F.array_except(products, _literals(V.PRODUCTS))) > 0, e["product_value"])
        .when(F.filter(_literals(V.PRODUCTS), lambda c: F.array_contains(products, c)) != products, e["product_order"])
        .when(F.array_contains(products, "unknown") & (n > 1), e["product_unknown"])
        .when(~F.coalesce(content_form.isin(*V.CONTENT_FORMS), F.lit(False)), e["form_value"])
        .when(content_form.isin("media_only", "link_only") & (products != F.array(F.lit("unknown"))), e["form_products"])
    )


def content_error(products: Column, content_form: Column, title: Column, summary: Column, n_entities: Column) -> Column:
    """The first rule that an analysis violates, or null: products and form, then what a
    message of that form must say and must not."""
    e = {k: F.lit(v) for k, v in ERRORS.items()}
    says = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    bare = content_form.isin("media_only", "link_only")
    rest = F.when(bare, F.when(says(summary) | (F.coalesce(n_entities, F.lit(0)) > 0), e["bare_content"])).when(~says(title), e["title"]).when(~says(summary), e["summary"])
    return F.coalesce(_content_rules(products, content_form, e), rest)


def classification_error(products: Column, content_form: Column, message_type: Column, topics: Column, source_kind: Column) -> Column:
    """The first violated rule, or null; rules are checked in a fixed order."""
    e = {k: F.lit(v) for k, v in ERRORS.items()}
    in_order = lambda xs, catalogue: F.filter(_literals(catalogue), lambda c: F.array_contains(xs, c)) == xs
    unsupported = lambda xs, catalogue: F.size(F.array_except(xs, _literals(catalogue))) > 0
    repeated = lambda xs: F.size(F.array_distinct(xs)) < F.size(xs)
    n, m = F.coalesce(F.size(products), F.lit(0)), F.coalesce(F.size(topics), F.lit(0))
    bare = content_form.isin("media_only", "link_only")
    none = F.array(F.lit("unknown"))
    fits, side = F.lit(False), F.lit(False)
    for code, ps, s in V.MESSAGE_TYPES:
        applies = (message_type == code) & F.arrays_overlap(products, _literals(ps))
        fits = fits | applies
        side = side | (applies & ((source_kind == "unknown") | (F.lit(s) == "any") | (source_kind == s)))
    topic_products = F.create_map(*(x for t, ps, _ in V.TOPICS for x in (F.lit(t), _literals(ps))))
    stray = F.get(F.filter(topics, lambda t: (t != "unknown") & ~F.arrays_overlap(products, topic_products[t])), F.lit(0))
    return (
        F.when(~source_kind.isin(*V.SOURCE_KINDS), e["source_kind"])
        .when((n < 1) | (n > 3) | repeated(products), e["product_count"])
        .when(unsupported(products, V.PRODUCTS), e["product_value"])
        .when(~in_order(products, V.PRODUCTS), e["product_order"])
        .when(F.array_contains(products, "unknown") & (n > 1), e["product_unknown"])
        .when(~content_form.isin(*V.CONTENT_FORMS), e["form_value"])
        .when(bare & (products != none), e["form_products"])
        .when(~message_type.isin(*(t for t, _, _ in V.MESSAGE_TYPES)), e["type_value"])
        .when((m < 1) | repeated(topics), e["topic_count"])
        .when(unsupported(topics, V.TOPIC_ORDER), e["topic_value"])
        .when(~in_order(topics, V.TOPIC_ORDER), e["topic_order"])
        .when(F.array_contains(topics, "unknown") & (m > 1), e["topic_unknown"])
        .when(bare, F.when((message_type != "unknown") | (topics != none), e["form_type"]))
        .when((message_type != "unknown") & ~fits, e["type_product"])
        .when((message_type != "unknown") & ~side, e["type_source"])
        .when(stray.isNotNull(), F.replace(e["topic_product"], F.lit("{}"), stray))
    )


# ---- event routing ----------------------------------------------------------------


def event_admission(status: Column, content_form: Column, title: Column, text: Column) -> Column:
    """(decision, reason): whether a message takes part in events, and why."""
    nothing = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    blank = content_form.isin("media_only", "link_only") | (nothing(title) & nothing(text))
    reason = F.when(~status.eqNullSafe(F.lit("published")), "normalized item is not published").when(blank, "normalized item has no semantic text").otherwise("semantic published message")
    return F.struct(F.when(reason.startswith("semantic"), "process").otherwise("skip").alias("decision"), reason.alias("reason"))



def event_families(products: Column, topics: Column) -> Column:
    """Families that a message may belong to, in catalogue order: those of its topics
    that its products allow, else all that they allow, else the residual family."""
    lists = lambda table: F.create_map(*(x for k, v in table.items() for x in (F.lit(k), _literals(v))))
    collect = lambda xs, table: F.flatten(F.filter(F.transform(xs, lambda x: lists(table)[x]), lambda f: f.isNotNull()))
    known = F.filter(products, lambda p: p != "unknown")
    allowed, of_topics = collect(known, V.PRODUCT_EVENT_FAMILIES), collect(topics, V.TOPIC_EVENT_FAMILIES)
    routed = F.array_intersect(allowed, of_topics)
    ordered = lambda xs: F.filter(_literals(V.EVENT_FAMILIES), lambda f: F.array_contains(xs, f))
    other = F.array(F.lit("other_named_development"))
    return F.when(F.size(known) == 0, other).when(F.size(routed) > 0, ordered(routed)).when(F.size(allowed) > 0, ordered(allowed)).otherwise(other)


def event_category(event_family: Column, products: Column) -> Column:
    has = lambda p: F.array_contains(products, p)
    return (
        F.when(event_family.isin(*V.ESPORTS_FAMILIES) | has("lol_esports"), "esports")
        .when(event_family.isin(*V.ECOSYSTEM_FAMILIES) | has("riot_ecosystem") | has("lol_universe"), "ecosystem")
        .when(has("lol_pc"), "lol_pc").when(has("tft"), "tft").otherwise("other_products")
    )


def report_section(products: Column) -> Column:
    has = lambda p: F.array_contains(products, p)
    return F.when(has("lol_esports"), "esports").when(has("lol_pc"), "lolpc").when(has("tft"), "tft").otherwise("other")
