"""Closed vocabularies, their order, and the constants of the scores."""

from __future__ import annotations

# Names, order and weights define the results.
BIASES = ["far-left", "left", "lean-left", "center", "lean-right", "right", "far-right"]
LEFT, RIGHT = BIASES[:3], BIASES[4:]
FACTUALITY = ["very-low", "low", "mixed", "high", "very-high"]
FACTUALITY_WEIGHTS = {"very-low": 0.5, "low": 0.75, "mixed": 1.0, "high": 1.25, "very-high": 1.5}
OWNERSHIP = ["independent", "corporate", "private-equity", "state-funded", "telecom", "government", "non-profit", "other"]
OWNER_TYPES = ["public_company", "private_company", "cooperative", "public_broadcaster", "trust", "individual", "state_adjacent", "nonprofit"]
TOPICS = ["politics", "world", "technology", "business", "science", "health", "culture", "sports", "environment"]
REGIONS = ["us", "international", "uk", "canada", "europe"]
MILESTONES = [5, 10, 25, 50, 100]
PERSPECTIVES = {"all": BIASES, "left": LEFT, "center": ["center"], "right": RIGHT}

# Keywords by group, tried in this order.
TOPIC_KEYWORDS = {
    "technology": ["ai", "artificial intelligence", "technology", "tech", "software", "chip", "cyber", "startup"],
    "business": ["market", "stocks", "stock", "economy", "economic", "trade", "inflation", "bank", "earnings", "tariff"],
    "science": ["research", "scientists", "science", "space", "nasa", "physics", "laboratory"],
    "health": ["health", "hospital", "medical", "medicine", "vaccine", "disease", "public health"],
    "culture": ["music", "film", "movie", "television", "tv", "festival", "book", "celebrity"],
    "sports": ["sport", "sports", "tournament", "season", "match", "playoff", "nba", "nfl", "mlb", "soccer", "olympic"],
    "environment": ["climate", "wildfire", "storm", "hurricane", "flood", "emissions", "environment", "earthquake"],
    "world": ["war", "summit", "diplomat", "diplomatic", "foreign", "global", "international", "united nations"],
}
REGION_KEYWORDS = {
    "uk": [" uk ", "britain", "british", "england", "scotland", "wales", "london", "parliament", "westminster"],
    "canada": ["canada", "canadian", "ottawa", "trudeau", "toronto", "vancouver"],
    "europe": ["europe", "european", "eu ", "brussels", "france", "germany", "italy", "spain"],
    "international": ["g20", "g7", "nato", "united nations", "u.n.", "global", "world leaders", "summit"],
}
FEED_CATEGORY_TOPICS = {
    "technology": ["technology", "tech", "ai", "artificial intelligence", "software", "cybersecurity", "gadgets"],
    "business": ["business", "markets", "market", "economy", "economics", "finance", "money"],
    "science": ["science", "space", "physics", "biology", "chemistry"],
    "health": ["health", "medicine", "medical", "wellness"],
    "culture": ["culture", "entertainment", "arts", "film", "music", "lifestyle", "books"],
    "sports": ["sports", "sport"],
    "environment": ["environment", "climate", "weather", "energy"],
    "world": ["world", "international", "global"],
    "politics": ["politics", "political", "policy", "government"],
}
FEED_CATEGORY_REGIONS = {"uk": ["uk", "britain", "england", "scotland", "wales"], "canada": ["canada"], "europe": ["europe"], "international": ["international", "world"]}
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid"]
FALLBACK_SUMMARY_MARKS = ["AI summary generation failed. Manual review needed.", "Analysis unavailable.", "Analysis pending.", "[single-source-fallback]"]
NEGATIONS = ["no", "not", "never", "none", "nothing", "neither"]
POLARITY = {
    "approved": ["rejected", "defeated", "blocked", "opposed", "killed", "failed", "refused", "vetoed"],
    "passed": ["rejected", "defeated", "blocked", "failed", "stalled"],
    "supported": ["opposed", "rejected"],
    "endorsed": ["opposed", "rejected"],
    "accepted": ["rejected", "refused"],
    "won": ["lost"],
    "increased": ["decreased", "fell", "dropped"],
    "rose": ["fell", "dropped"],
    "confirmed": ["denied", "rejected"],
}
