"""Controlled vocabularies of the news model (fixed values), as plain tuples and as
small DataFrames for joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRODUCTS = ("lol_pc", "tft", "lol_esports", "lol_universe", "other_lol_product", "riot_ecosystem", "unknown")
CONTENT_FORMS = ("original", "repost", "quote", "media_only", "link_only")
SOURCE_KINDS = ("official", "unofficial", "unknown")

_GAME = ("lol_pc", "tft")
#: code, products, side of the source
MESSAGE_TYPES = (
    ("game_patch_notes", _GAME, "official"),
    ("game_official_preview", _GAME, "official"),
    ("game_announcement", _GAME, "official"),
    ("game_notice", _GAME, "official"),
    ("game_promotion_interaction", _GAME, "official"),
    ("game_community_notice", _GAME, "unofficial"),
    ("game_community_promotion_interaction", _GAME, "unofficial"),
    ("game_leak", _GAME, "unofficial"),
    ("game_community_discussion", _GAME, "unofficial"),
    ("esports_announcement", ("lol_esports",), "official"),
    ("esports_promotion_interaction", ("lol_esports",), "official"),
    ("esports_rumor_speculation", ("lol_esports",), "unofficial"),
    ("esports_community_discussion", ("lol_esports",), "unofficial"),
    ("esports_community_promotion_interaction", ("lol_esports",), "unofficial"),
    ("lol_universe_announcement", ("lol_universe",), "official"),
    ("lol_universe_promotion_interaction", ("lol_universe",), "official"),
    ("lol_universe_leak", ("lol_universe",), "unofficial"),
    ("lol_universe_community_discussion", ("lol_universe",), "unofficial"),
    ("other_lol_product_announcement", ("other_lol_product",), "official"),
    ("other_lol_product_promotion_interaction", ("other_lol_product",), "official"),
    ("other_lol_product_leak", ("other_lol_product",), "unofficial"),
    ("other_lol_product_community_discussion", ("other_lol_product",), "unofficial"),
    ("riot_ecosystem_announcement", ("riot_ecosystem",), "official"),
    ("riot_ecosystem_promotion_interaction", ("riot_ecosystem",), "official"),
    ("riot_ecosystem_leak", ("riot_ecosystem",), "unofficial"),
    ("riot_ecosystem_community_discussion", ("riot_ecosystem",), "unofficial"),
    ("unknown", PRODUCTS, "any"),
)

_THREE = ("lol_pc", "tft", "other_lol_product")
#: code, products, scoring family
TOPICS = (
    ("balance_gameplay", _THREE, "gameplay"),
    ("champions", ("lol_pc",), "gameplay"),
    ("items_runes_systems", ("lol_pc",), "gameplay"),
    ("game_modes", _THREE, "gameplay"),
    ("gameplay", ("lol_pc", "other_lol_product"), "gameplay"),
    ("service_technical", ("lol_pc", "tft", "other_lol_product", "riot_ecosystem"), "service"),
    ("cosmetics", _THREE, "cosmetics"),
    ("shop_monetization", _THREE, "commerce"),
    ("activities_rewards", _THREE, "activity"),
    ("security_fair_play", _THREE, "security"),
    ("community", PRODUCTS[:-1], "community"),
    ("guides_education", _THREE, "guide"),
    ("tft_gameplay", ("tft",), "tft"),
    ("esports_competition", ("lol_esports",), "esports_competition"),
    ("esports_schedule", ("lol_esports",), "esports_schedule"),
    ("esports_matches", ("lol_esports",), "esports_matches"),
    ("esports_rosters", ("lol_esports",), "esports_rosters"),
    ("esports_analysis", ("lol_esports",), "esports_analysis"),
    ("esports_broadcast", ("lol_esports",), "esports_media"),
    ("esports_fandom_live", ("lol_esports",), "esports_media"),
    ("lore_universe", ("lol_universe",), "universe"),
    ("media_entertainment", ("lol_universe", "other_lol_product", "riot_ecosystem"), "media"),
    ("merchandise_collectibles", ("other_lol_product", "riot_ecosystem"), "merchandise"),
    ("corporate_partnerships", ("riot_ecosystem",), "corporate"),
    ("platform_services", ("riot_ecosystem",), "platform"),
    ("unknown", PRODUCTS, "unknown"),
)
TOPIC_ORDER = tuple(code for code, _, _ in TOPICS)

#: profile: base, floor, cap
SCORE_BANDS = {
    "unknown": (0.0, 0.0, 0.0),
    "patch_official_notes": (0.92, 0.88, 0.95),
    "patch_full_preview": (0.90, 0.87, 0.93),
    "official_gameplay_preview": (0.86, 0.80, 0.93),
    "official_content_preview": (0.76, 0.66, 0.84),
    "gameplay_announcement": (0.86, 0.78, 0.95),
    "tft_announcement": (0.82, 0.74, 0.90),
    "activity_announcement": (0.72, 0.62, 0.82),
    "cosmetic_announcement": (0.68, 0.58, 0.80),
    "commerce_announcement": (0.58, 0.48, 0.70),
    "weekly_free_champion_rotation": (0.50, 0.44, 0.56),
    "game_announcement_general": (0.62, 0.52, 0.76),
    "patch_hotfix": (0.72, 0.62, 0.84),
    "service_notice": (0.68, 0.54, 0.86),
    "security_notice": (0.82, 0.72, 0.92),
    "promotion_gameplay": (0.52, 0.38, 0.68),
    "promotion_activity": (0.50, 0.36, 0.66),
    "promotion_cosmetic": (0.48, 0.34, 0.64),
    "promotion_community": (0.34, 0.16, 0.50),
    "promotion_general": (0.42, 0.26, 0.58),
    "shop_daily_standard": (0.48, 0.42, 0.54),
    "shop_cosmetic_rotation": (0.58, 0.52, 0.64),
    "shop_rare_cosmetic": (0.66, 0.60, 0.72),
    "shop_bulk_refresh": (0.66, 0.60, 0.72),
    "free_reward": (0.62, 0.52, 0.75),
    "activity_free_skin": (0.84, 0.78, 0.90),
    "community_game_notice": (0.54, 0.42, 0.68),
    "community_service_notice": (0.58, 0.46, 0.72),
    "community_notice_general": (0.46, 0.34, 0.60),
    "leak_gameplay": (0.62, 0.50, 0.75),
    "leak_content": (0.54, 0.42, 0.68),
    "leak_general": (0.50, 0.38, 0.64),
    "gameplay_guide": (0.42, 0.32, 0.52),
    "game_discussion": (0.34, 0.16, 0.55),
    "esports_schedule": (0.52, 0.46, 0.62),
    "esports_regular": (0.60, 0.54, 0.68),
    "esports_playoffs": (0.70, 0.66, 0.76),
    "esports_final": (0.76, 0.71, 0.82),
    "worlds_regular": (0.68, 0.62, 0.74),
    "worlds_key": (0.80, 0.74, 0.86),
    "roster_announcement": (0.62, 0.54, 0.74),
    "esports_announcement_general": (0.56, 0.44, 0.70),
    "esports_promotion": (0.44, 0.28, 0.62),
    "esports_rumor": (0.50, 0.38, 0.68),
    "esports_analysis": (0.44, 0.30, 0.60),
    "esports_discussion": (0.34, 0.18, 0.54),
    "universe_announcement": (0.66, 0.58, 0.78),
    "universe_promotion": (0.46, 0.32, 0.62),
    "universe_leak": (0.54, 0.42, 0.68),
    "universe_discussion": (0.38, 0.22, 0.56),
    "other_product_announcement": (0.68, 0.56, 0.82),
    "other_product_promotion": (0.46, 0.32, 0.62),
    "other_product_leak": (0.54, 0.42, 0.70),
    "other_product_discussion": (0.38, 0.22, 0.56),
    "merch_release": (0.52, 0.44, 0.64),
    "partnership": (0.58, 0.50, 0.68),
    "media_release": (0.58, 0.48, 0.70),
    "riot_announcement": (0.66, 0.58, 0.76),
    "riot_promotion": (0.46, 0.32, 0.62),
    "riot_leak": (0.54, 0.42, 0.68),
    "riot_discussion": (0.38, 0.22, 0.56),
}

ANY = "*"
_PROMOTION = ((("activity", "commerce"), "promotion_activity"), (("cosmetics",), "promotion_cosmetic"), (("gameplay", "tft"), "promotion_gameplay"), (("community", "guide", "media"), "promotion_community"), (ANY, "promotion_general"))
#: message type: (topic families, profile) in order of precedence (fixed values)
PROFILE_ROUTES = {
    "game_patch_notes": ((ANY, "patch_official_notes"),),
    "game_official_preview": ((("gameplay", "tft"), "official_gameplay_preview"), (ANY, "official_content_preview")),
    "game_announcement": (
        (("security",), "security_notice"), (("service",), "service_notice"), (("activity",), "activity_announcement"), (("commerce",), "commerce_announcement"),
        (("cosmetics",), "cosmetic_announcement"), (("tft",), "tft_announcement"), (("gameplay",), "gameplay_announcement"), (ANY, "game_announcement_general"),
    ),
    "game_notice": ((("security",), "security_notice"), (ANY, "service_notice")),
    "game_promotion_interaction": _PROMOTION,
    "game_community_notice": ((("commerce",), "shop_daily_standard"), (("activity",), "free_reward"), (("service", "security"), "community_service_notice"), (("gameplay", "tft", "cosmetics"), "community_game_notice"), (ANY, "community_notice_general")),
    "game_community_promotion_interaction": _PROMOTION,
    "game_leak": ((("gameplay", "tft", "service", "security"), "leak_gameplay"), (("cosmetics", "commerce", "activity"), "leak_content"), (ANY, "leak_general")),
    "game_community_discussion": ((("guide",), "gameplay_guide"), (ANY, "game_discussion")),
    "esports_announcement": ((("esports_matches",), "esports_regular"), (("esports_schedule",), "esports_schedule"), (("esports_rosters",), "roster_announcement"), (ANY, "esports_announcement_general")),
    "esports_promotion_interaction": ((ANY, "esports_promotion"),),
    "esports_rumor_speculation": ((ANY, "esports_rumor"),),
    "esports_community_discussion": ((("esports_analysis",), "esports_analysis"), (ANY, "esports_discussion")),
    "esports_community_promotion_interaction": ((ANY, "esports_promotion"),),
    "lol_universe_announcement": ((ANY, "universe_announcement"),),
    "lol_universe_promotion_interaction": ((ANY, "universe_promotion"),),
    "lol_universe_leak": ((ANY, "universe_leak"),),
    "lol_universe_community_discussion": ((ANY, "universe_discussion"),),
    "other_lol_product_announcement": ((ANY, "other_product_announcement"),),
    "other_lol_product_promotion_interaction": ((ANY, "other_product_promotion"),),
    "other_lol_product_leak": ((ANY, "other_product_leak"),),
    "other_lol_product_community_discussion": ((ANY, "other_product_discussion"),),
    "riot_ecosystem_announcement": ((("merchandise",), "merch_release"), (("corporate",), "partnership"), (("media",), "media_release"), (ANY, "riot_announcement")),
    "riot_ecosystem_promotion_interaction": ((ANY, "riot_promotion"),),
    "riot_ecosystem_leak": ((ANY, "riot_leak"),),
    "riot_ecosystem_community_discussion": ((ANY, "riot_discussion"),),
    "unknown": ((ANY, "unknown"),),
}

EVENT_FAMILIES = (
    "gameplay_balance", "gameplay_release", "cosmetic_release", "player_activity", "commercial_offer", "service_incident", "security_enforcement", "esports_match",
    "esports_schedule", "roster_change", "esports_rules", "universe_release", "media_release", "corporate_change", "platform_service", "other_named_development",
)
TOPIC_EVENT_FAMILIES = {
    "balance_gameplay": ("gameplay_balance",),
    "champions": ("gameplay_release", "gameplay_balance"),
    "items_runes_systems": ("gameplay_balance",),
    "game_modes": ("gameplay_release",),
    "gameplay": ("gameplay_balance", "gameplay_release"),
    "service_technical": ("service_incident", "platform_service"),
    "cosmetics": ("cosmetic_release",),
    "shop_monetization": ("commercial_offer",),
    "activities_rewards": ("player_activity",),
    "security_fair_play": ("security_enforcement",),
    "tft_gameplay": ("gameplay_balance", "gameplay_release"),
    "esports_competition": ("esports_rules", "esports_match"),
    "esports_schedule": ("esports_schedule",),
    "esports_matches": ("esports_match",),
    "esports_rosters": ("roster_change",),
    "esports_analysis": ("esports_match", "roster_change", "esports_rules"),
    "esports_broadcast": ("media_release",),
    "esports_fandom_live": ("player_activity",),
    "lore_universe": ("universe_release",),
    "media_entertainment": ("media_release", "universe_release"),
    "merchandise_collectibles": ("commercial_offer", "media_release"),
    "corporate_partnerships": ("corporate_change",),
    "platform_services": ("platform_service",),
}
PRODUCT_EVENT_FAMILIES = {
    "lol_pc": ("gameplay_balance", "gameplay_release", "cosmetic_release", "player_activity", "commercial_offer", "service_incident", "security_enforcement", "platform_service", "other_named_development"),
    "tft": ("gameplay_balance", "gameplay_release", "cosmetic_release", "player_activity", "commercial_offer", "service_incident", "other_named_development"),
    "lol_esports": ("esports_match", "esports_schedule", "roster_change", "esports_rules", "player_activity", "media_release", "other_named_development"),
    "lol_universe": ("universe_release", "media_release", "player_activity", "other_named_development"),
    "other_lol_product": ("gameplay_balance", "gameplay_release", "cosmetic_release", "player_activity", "commercial_offer", "service_incident", "universe_release", "media_release", "other_named_development"),
    "riot_ecosystem": ("commercial_offer", "media_release", "corporate_change", "platform_service", "player_activity", "other_named_development"),
}

RELATIONS = ("reports", "supports", "confirms", "denies", "corrects", "mentions")
POSITIVE_RELATIONS = ("reports", "supports", "confirms", "corrects")
MATERIALITIES = ("material_update", "corroboration_only", "duplicate", "context_only")
LIFECYCLES = ("unconfirmed", "developing", "confirmed", "disputed", "denied", "resolved", "stale")
CREDIBILITY_LEVELS = ("unverified", "plausible", "corroborated", "officially_confirmed", "disputed", "denied")
#: role: rank as a source, strength at reliability 0, gain up to reliability 1
SOURCE_ROLES = {
    "responsible_official": (100, 100.0, 0.0),
    "direct_subject": (90, 85.0, 0.0),
    "first_party_participant": (80, 80.0, 0.0),
    "independent_media": (70, 35.0, 55.0),
    "known_leaker": (60, 25.0, 55.0),
    "ordinary_account": (30, 10.0, 50.0),
    "republisher": (10, 0.0, 0.0),
    "unknown": (0, 10.0, 0.0),
}
#: upper ends (exclusive) and names
IMPORTANCE_LEVELS = ((0.30, "low"), (0.55, "medium"), (0.80, "high"), (None, "critical"))
HEAT_LEVELS = ((0.15, "cold"), (0.35, "emerging"), (0.60, "active"), (0.80, "hot"), (None, "surging"))
ESPORTS_FAMILIES = ("esports_match", "esports_schedule", "roster_change", "esports_rules")
ECOSYSTEM_FAMILIES = ("corporate_change", "platform_service", "universe_release", "media_release")
REPORT_SECTIONS = {"lolpc": 5, "esports": 3, "tft": 3, "other": 3}
CONNECTORS = ("x_twitter", "weibo", "baidu_tieba", "riot_official", "tencent_lol", "manual")

ENTITY_ANCHORS = {
    "patch": "patch_version", "activity": "activity_name", "champion": "champion", "item": "item", "rune": "rune", "skin": "skin", "game_mode": "game_mode",
    "team": "team", "player": "player", "coach": "player", "tournament": "tournament", "league": "league", "region": "region", "organization": "organization",
    "product": "product", "system": "system",
}


def legal_types(product: str, sides: tuple[str, ...] = ("official", "unofficial", "any")) -> list[str]:
    return [code for code, products, side in MESSAGE_TYPES if product in products and side in sides]


def legal_topics(product: str) -> list[str]:
    return [code for code, products, _ in TOPICS if product in products]


def bands_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, *b) for p, b in SCORE_BANDS.items()], "profile string, base double, floor double, cap double")
