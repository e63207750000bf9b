"""Fixed word lists."""

from __future__ import annotations

# Stop words of the review-term index.
REVIEW_STOPWORDS = (
    "about after again all also amazon are but because been brand can cant could does doesn for good great had has have her him "
    "his how into its item just like love much nice only order out product products really review reviews she that them then "
    "these they this use very was what when will with would you your"
).split()

# Stop words of the user profile.
PROFILE_STOPWORDS = (
    "and the for with that this was were very really from they their would could about based did does like likes liked who good "
    "great bad okay item product place"
).split()

# Stop words of aspect evidence.
ASPECT_STOPWORDS = "about after amazon and are based because but for from item items like liked product review that the this was with".split()

# Keywords of each aspect.
ASPECTS = {
    "price_value": "affordable cheap cost discount expensive price pricey value worth".split(),
    "quality_reliability": "broken durable flimsy quality reliable solid sturdy weak works".split(),
    "service_speed": "delay delayed fast late quick service slow staff wait".split(),
    "ambience_context": "busy calm comfortable conversation crowded loud noisy quiet".split(),
    "taste_food": "fresh pepper spicy stale sweet taste tasty".split(),
    "beauty_fit": "beauty cream face hair makeup moisturizer nail serum shampoo skin wig".split(),
    "music_media": "album artist music playlist song songs sound".split(),
    "gift_fit": "card gift present recipient voucher".split(),
}

# Retrieval sources with family and priority, and the confidence of each family.
SOURCES = {
    "neural_vector": ("neural_semantic_vector", 0.90),
    "context_intent_profile": ("lexical_review_term", 0.885),
    "context_intent_category": ("aspect_evidence", 0.875),
    "implicit_item_item": ("collaborative_co_engagement", 0.865),
    "category_aspect_graph": ("aspect_evidence", 0.855),
    "sequential_transition": ("collaborative_co_engagement", 0.845),
    "aspect_evidence_graph": ("aspect_evidence", 0.835),
    "category_affinity_popular": ("popularity_fallback", 0.83),
    "category_transition": ("collaborative_co_engagement", 0.825),
    "review_term_profile": ("lexical_review_term", 0.82),
    "category_popular": ("popularity_fallback", 0.81),
    "lexical_item_neighbor": ("lexical_review_term", 0.81),
    "aspect_profile": ("aspect_evidence", 0.80),
    "bm25_profile": ("lexical_review_term", 0.78),
    "sparse_category_tail": ("popularity_fallback", 0.77),
    "global_popular": ("popularity_fallback", 0.76),
    "vector_profile": ("semantic_vector", 0.74),
    "user_neighbor": ("collaborative_co_engagement", 0.72),
    "co_visitation": ("collaborative_co_engagement", 0.70),
}
FAMILY_CONFIDENCE = {
    "collaborative_co_engagement": 1.00,
    "aspect_evidence": 0.86,
    "lexical_review_term": 0.68,
    "semantic_vector": 0.45,
    "neural_semantic_vector": 0.45,
    "popularity_fallback": 0.38,
    "other": 0.30,
}
