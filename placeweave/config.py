"""Fixed values of the engine: what sources, scores, tags and plans are defined by."""

from __future__ import annotations

# Sources, in the order in which they resolve (geocoded first, mentions last).
SOURCES = ("google_places", "yelp", "blog", "reddit")

# Trust in a single signal of a source.
CREDIBILITY = {"google_places": 1.00, "yelp": 0.85, "reddit": 0.80, "blog": 0.45}
CREDIBILITY_UNKNOWN = 0.5

# Fixed values: (mean, sd) of ratings while fewer than MIN_SAMPLES are measured.
FALLBACK_DISTRIBUTION = {"google_places": (4.45, 0.25), "yelp": (4.10, 0.45), "reddit": (0.0, 0.40), "blog": (0.0, 1.0)}
FALLBACK_UNKNOWN = (4.2, 0.4)
MIN_SAMPLES = 8
MIN_SD = 0.08

# The scoring model.
PRIOR_REVIEWS = 50.0
VOLUME_HALF = 120.0
VOLUME_UNKNOWN = 0.35
RECENCY_HALF_LIFE_DAYS = 540.0
RECENCY_FLOOR = 0.15
RECENCY_UNKNOWN = 0.7
Z_SLOPE = 0.8
MENTION_EVIDENCE_HALF = 6.0
THREAD_SCORE_HALF = 400.0
MENTION_SHARE, THREAD_SHARE = 0.65, 0.35
LISTED_QUALITY = 0.66
BONUS_MAX = 0.12
DISAGREEMENT_MAX = 0.30
EVIDENCE_HALF = 0.35
NEUTRAL = 0.5
SCALE = 100.0
MODEL_VERSION = "1.0"

# Entity resolution. A rule is (distance, similarity, needs a shared distinctive token, label), first match wins.
BLOCK_RADIUS_M = 400.0
MERGE_RADIUS_M = 250.0
MIN_SIMILARITY = 0.55
MERGE_RULES = (
    (40.0, 0.62, True, "same footprint + shared distinctive token"),
    (120.0, 0.80, False, "same block + strong name agreement"),
    (250.0, 0.92, False, "same street + near-identical name"),
)
REVIEW_CONFIDENCE = 0.62
REVIEW_SIMILARITY = 0.60
PROXIMITY_HALF_M = 90.0
NAME_ONLY_SIMILARITY = 0.90
NAME_ONLY_CONTAINED = 0.85

# Tokens that say nothing in a name's key, and tokens that are kept but identify no place.
NOISE_TOKENS = (
    "restaurante", "restaurant", "restaurante&bar", "cafeteria", "coffee", "coffeehouse", "shop", "museum", "museo",
    "hotel", "hostal", "the", "el", "la", "los", "las", "de", "del", "y", "and", "of", "&",
)
GENERIC_TOKENS = (
    "casa", "taberna", "tasca", "bodega", "bar", "cafe", "café", "mercado", "market", "plaza", "square", "parque", "park", "jardin",
    "jardín", "garden", "palacio", "palace", "teatro", "theatre", "theater", "calle", "puerta", "gate", "centro", "centre", "center",
    "nacional", "national", "real", "royal", "arte", "art", "madrid", "espana", "españa", "spain", "bistro", "brasserie", "club",
    "house", "grande", "gran", "nuevo", "nueva", "viejo", "vieja", "antigua", "antiguo",
)
DISTINCTIVE_LENGTH = 4

# Geometry and travel.
EARTH_RADIUS_M = 6_371_000.0
DETOUR = 1.35
SPEED_MPS = {"walk": 1.25, "transit": 4.2, "drive": 6.0}
TRANSIT_OVERHEAD_S, TRANSIT_FROM_M = 360.0, 800.0

# Places.
CATEGORIES = ("restaurant", "cafe", "bar", "attraction", "museum", "park", "shopping", "hotel", "nightlife", "other")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
PRICE_TAGS = {1: "budget", 2: "mid-range", 3: "upscale", 4: "splurge"}

# Structural and consensus tags.
LATE_CLOSE = 25 * 60
EARLY_OPEN = 8 * 60 + 30
HIGHLY_RATED = 68.0
GEM_MAX_REVIEWS, GEM_MIN_SENTIMENT = 2_500, 0.35
TRAP_MIN_REVIEWS, TRAP_MAX_SENTIMENT = 40_000, -0.15
CONSENSUS_MENTIONS, CONSENSUS_UPVOTES = 2, 100

# The planner.
PACES = {
    "relaxed": {"stops": 4, "start": 10, "end": 22, "meals": 1},
    "moderate": {"stops": 6, "start": 9, "end": 23, "meals": 2},
    "packed": {"stops": 8, "start": 8, "end": 24, "meals": 2},
}
DWELL = {"restaurant": 75, "cafe": 40, "bar": 60, "attraction": 75, "museum": 105, "park": 60, "shopping": 50, "hotel": 0, "nightlife": 90, "other": 60}
DAILY_LIMIT = {"restaurant": 2, "nightlife": 1, "cafe": 2, "bar": 2, "museum": 3}
CATEGORY_GAP = {"restaurant": 240, "cafe": 180, "bar": 120}
DEFAULT_WINDOWS = {
    "restaurant": (("13:00", "16:00"), ("20:00", "23:30")),
    "cafe": (("08:30", "20:00"),),
    "bar": (("18:00", "02:00"),),
    "nightlife": (("23:00", "06:00"),),
    "museum": (("10:00", "20:00"),),
    "shopping": (("10:00", "21:00"),),
    "attraction": (("09:00", "21:00"),),
    "park": (("07:00", "22:00"),),
}
MAX_LEG_MIN = {"walk": 45, "transit": 60, "drive": 45}
SEPARATION_M = 90.0
WAIT_PENALTY, FREE_PENALTY, FREE_FROM_MIN = 0.8, 0.15, 45
SAME_CATEGORY_S, SCORE_S, MEAL_BONUS_S, MEAL_LEAD_MIN = 900.0, 30.0, 2400.0, 30
MEAL_WINDOWS = ((13 * 60, 15 * 60 + 30), (20 * 60, 22 * 60 + 30))
MEALS = ("restaurant",)
LODGING = ("hotel",)
TAG_BOOST = 0.35
POOL_OVERSAMPLE, POOL_MIN = 4, 24
SHORTLIST_MULTIPLE, COMPACTNESS_PER_KM = 2, 4.0
