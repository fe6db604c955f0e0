"""Rule lists and tables. Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

# Results depend on these lists and patterns as they stand.
GEO_PATTERN = r"(?i)\b(V[67][VBCEYX]|Richmond|YVR)\b"
GEO_REASON = "Richmond/YVR location"
VALUE_TIERS = [(10_000_000, 2, "Value > $10M"), (1_000_000, 1, "Value > $1M")]
HIGH_VALUE = [
    "pipeline", "civil", "electrical", "steel", "concrete", "infrastructure", "sewer", "watermain", "substation", "bridge", "paving",
    "excavation", "demolition", "manufacturing", "warehouse", "logistics", "industrial", "feature film", "tv series", "production",
    "season", "conference", "summit", "congress", "trade show", "convention", "symposium",
]
LOW_VALUE = ["interior renovation", "residential", "landscaping", "tenant improvement", "single family", "duplex", "townhouse", "condo", "signage", "swimming pool"]
# Permit types that count as commercial.
COMMERCIAL_SUB_TYPES = [
    "hotel", "warehouse", "manufacturing/warehouse", "office", "medical office", "dental office", "financial institute", "restaurant",
    "retail", "apartment", "educational facility", "community hall", "recreational", "industrial", "canopy", "nursing home",
]
PERMIT_TYPE_PREFIXES = ["industrial", "commercial", "assembly", "institutional"]
MIN_PERMIT_VALUE = 500_000
# Production types and the names of the short forms.
PRODUCTION_TYPES = ["feature film", "tv series"]
PRODUCTION_NAMES = {
    "feature": "Feature Film", "tv series": "TV Series", "doc series": "Documentary Series", "mini series": "Mini Series",
    "new media feature": "New Media Feature", "new media series": "New Media Series",
}
# Words by which cards, events and news items are kept or dropped.
VENUE_DROP = ["consumer show", "home show", "auto show", "art fair", "comedy", "concert", "wedding", "graduation", "public show"]
VENUE_NAV_WORDS = ["organize", "attend", "news", "about", "contact", "career", "privacy", "term"]
EVENT_POSITIVE = [
    "conference", "summit", "forum", "convention", "trade show", "symposium", "professional", "industry", "business", "networking",
    "corporate", "training", "association", "government", "tech",
]
EVENT_NEGATIVE = ["party", "concert", "dance", "nightlife", "yoga", "fitness", "dating", "hobby", "craft", "market", "sale", "festival", "clubbing", "rave"]
NEWS_POSITIVE = [
    "construction", "infrastructure", "contract awarded", "expansion", "groundbreaking", "permit", "development", "industrial",
    "warehouse", "building", "residential", "housing", "project",
]
NEWS_NEGATIVE = ["score", "game", "match", "win", "loss", "election", "campaign"]
# Contact data and the marks that replace it.
EMAIL_PATTERN = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
PHONE_PATTERN = r"(\+?\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
#: What every phone number ends in.
PHONE_END = r"\d{3}[\s.-]?\d{4}"
EMAIL_MARK, PHONE_MARK = "[REDACTED EMAIL]", "[REDACTED PHONE]"
# Disruption scores, states and weather tuning.
SEATS, CONNECTING = 160, 0.58
STATE_BANDS = [(20.0, "Ignore"), (60.0, "Watch"), (120.0, "SoftAlert")]
TOP_STATE = "HardAlert"
HOUR_FACTORS = [(21, 1.5), (18, 1.2), (6, 1.0)]
NIGHT_FACTOR = 0.8
DWELL_MINUTES = 30
ALERT_STATES = ["SoftAlert", "HardAlert"]
FOG_MINUTES, RIVER_SCORE = 20, 40.0
LATENCY_BOUNDS = [100, 500, 1000, 2500, 5000, 10000, 20000, 30000]
WEATHER_TUNING = {
    "AtmosphericRiver": {"duration_weight": 1.0, "pre_alert": False, "watch_threshold": 40.0, "lookback_hours": 48},
    "Snow": {"duration_weight": 1.0, "pre_alert": True, "watch_threshold": 60.0, "lookback_hours": 24},
    "Fog": {"duration_weight": 1.5, "pre_alert": False, "watch_threshold": 60.0, "lookback_hours": 24},
}
WEATHER_DEFAULT = {"duration_weight": 1.0, "pre_alert": False, "watch_threshold": 60.0, "lookback_hours": 24}
EARLIEST_CLEAR = "~8–10 hrs"
ALERT_ACTIONS = ["Monitor flight status", "Check distressed rates", "Verify room inventory"]
