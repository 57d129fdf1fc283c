"""Word lists, thresholds and templates.

Everything in the block marked FIXED VALUES must stay equal to the reference
application's values, because the scoring and enrichment rules are defined by
them (same words, same category order, same thresholds, same texts).  They are
plain data: every operator takes them as arguments with these as defaults.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference application's values)
# ---------------------------------------------------------------------------

CLASSES = ("Negative", "Neutral", "Positive")  # label index 0, 1, 2

STOPWORDS = tuple("""a about after all also am an and any are as at be because been but by can
could did do does for from get got had has have he her him his how i if in into is it its
just like me my no not of on or our out she so some than that the their them then there
they this to up us was we were what when which who will with would you your http user
""".split())

# Emotion lexicon; the declared order breaks ties.
EMOTION_LEXICON = (
    ("Anger", ("angry", "furious", "outraged", "unacceptable", "disgusted", "worst",
               "hate", "scam", "ripoff", "horrible", "awful", "terrible", "disaster",
               "rude")),
    ("Frustration", ("frustrating", "frustrated", "annoying", "annoyed", "useless",
                     "waste", "impossible", "confusing", "slow", "stuck", "nightmare")),
    ("Disappointment", ("disappointed", "disappointing", "expected", "mediocre",
                        "unfortunately", "poor", "sadly", "letdown", "subpar")),
    ("Joy", ("love", "amazing", "fantastic", "excellent", "awesome", "delighted",
             "happy", "best", "wonderful", "incredible", "perfect", "breathtaking",
             "great", "outstanding", "brilliant")),
    ("Gratitude", ("thank", "thanks", "grateful", "appreciate", "helpful", "recommend",
                   "impressed")),
)
NEGATIVE_EMOTIONS = ("Anger", "Frustration", "Disappointment")
POSITIVE_EMOTIONS = ("Joy", "Gratitude")
# Emotion when no candidate word is present, per sentiment (else: Calm).
DEFAULT_EMOTION = (("Negative", "Displeasure"), ("Positive", "Satisfaction"))
NEUTRAL_DEFAULT_EMOTION = "Calm"
FALLBACK_HIGH_RISK_EMOTION = "Anger"

INTENSIFIERS = ("very", "extremely", "absolutely", "totally", "completely", "never",
                "always", "utterly", "incredibly", "beyond")

# Intensity = min(100, base + 14*hits + 8*intensifiers + 6*'!' + 6*CAPS words),
# base = 45*confidence, or 15*confidence for Neutral.
INTENSITY_BASE = 45
INTENSITY_BASE_NEUTRAL = 15
INTENSITY_PER_HIT = 14
INTENSITY_PER_INTENSIFIER = 8
INTENSITY_PER_EXCLAIM = 6
INTENSITY_PER_CAPS = 6
INTENSITY_MAX = 100

# Risk: Negative and (intensity >= 65 or confidence >= 0.90) -> High.
RISK_INTENSITY = 65
RISK_CONFIDENCE = 0.90

# Business-aspect lexicon; the declared order breaks ties.
ASPECTS = (
    ("Delivery & Shipping", ("delivery", "shipping", "arrived", "late", "package",
                             "courier", "tracking", "dispatch", "shipment")),
    ("Product Quality", ("quality", "broken", "damaged", "defective", "durable",
                         "material", "broke", "sturdy", "flimsy")),
    ("Customer Support", ("support", "service", "staff", "response", "reply",
                          "agent", "rude", "helpful", "helpdesk", "resolution")),
    ("Pricing & Value", ("price", "expensive", "cheap", "value", "cost", "refund",
                         "charge", "charged", "overpriced", "worth")),
    ("Website & App", ("website", "app", "checkout", "login", "page", "navigation",
                       "crash", "slow", "interface", "loading")),
    ("Food & Experience", ("food", "meal", "taste", "delicious", "restaurant",
                           "menu", "fresh", "hotel", "stay", "experience")),
)
DEFAULT_DRIVER = "General Experience"
DEFAULT_TOPIC = "your experience"

# Confidence bands: (lower bound, band, explanation), first match wins.
CONFIDENCE_BANDS = (
    (0.85, "High", "The model is very sure about this classification — safe to act on it automatically."),
    (0.60, "Moderate", "The model is reasonably sure — worth a quick human glance if the decision matters."),
    (0.00, "Low", "The model is uncertain — this item should be reviewed by a person before acting."),
)

WHAT_IT_MEANS = (
    ("Negative", "This feedback expresses dissatisfaction — a complaint, a frustration or an "
                 "unmet expectation. Left unaddressed, feedback like this correlates with churn "
                 "and negative word of mouth."),
    ("Neutral", "This feedback is informational rather than emotional — often a question, a "
                "factual statement or mixed/mild opinion. Neutral items frequently contain "
                "pre-purchase questions and feature requests worth routing to sales or product."),
    ("Positive", "This feedback expresses satisfaction or delight. Positive feedback identifies "
                 "what to amplify in marketing, and its authors are candidates for testimonials, "
                 "reviews and referral programmes."),
)

RECOMMENDED_ACTION = (
    ("Negative", "Route to the support queue and respond within 24 hours — a fast, personal "
                 "reply converts a surprising share of complainers into loyal customers. Tag "
                 "the root cause so recurring themes surface in the History page."),
    ("Neutral", "Check whether it contains a question or feature request; route questions to "
                "sales/support and log requests for the product backlog."),
    ("Positive", "Thank the customer and invite them to leave a public review or testimonial. "
                 "Note what they praised — it's a proven strength to feature in marketing."),
)

RESPONSE_TEMPLATES = (
    ("Negative", "Hi {name},\n\nThank you for telling us about your experience with "
                 "{topic} — and I'm genuinely sorry we let you down. This isn't the "
                 "standard we hold ourselves to.\n\nI've flagged your case to our team "
                 "as a priority, and we'll follow up within 24 hours with a concrete "
                 "resolution. In the meantime, if there's anything urgent, reply "
                 "directly to this message.\n\nThank you for giving us the chance to "
                 "make this right.\n\n— The Customer Care Team"),
    ("Neutral", "Hi {name},\n\nThanks for reaching out about {topic}. Happy to help — "
                "here's what you need to know: [answer their question / share the "
                "requested information].\n\nIf anything is unclear or you'd like more "
                "detail, just reply to this message.\n\n— The Customer Care Team"),
    ("Positive", "Hi {name},\n\nThank you so much for the kind words about {topic} — "
                 "feedback like yours genuinely makes our day, and I've shared it with "
                 "the team.\n\nIf you have a moment, we'd be thrilled if you left a "
                 "public review — it helps others find us.\n\n— The Customer Care Team"),
)
DEFAULT_CUSTOMER_NAME = "[Customer Name]"

# Deterministic rule scorer: substring tests on lower-cased text.
RULE_POSITIVE_WORDS = ("love", "great", "excellent", "amazing")
RULE_NEGATIVE_WORDS = ("hate", "terrible", "awful", "broken")
RULE_POSITIVE_SCORE = 0.98
RULE_NEGATIVE_SCORE = 0.97
RULE_NEUTRAL_SCORE = 0.90
RULE_MODEL_NAME = "rules (deterministic)"

# Raw model label spellings -> class.
LABEL_MAP = (
    ("negative", "Negative"), ("neutral", "Neutral"), ("positive", "Positive"),
    ("label_0", "Negative"), ("label_1", "Neutral"), ("label_2", "Positive"),
)

# Limits of the single-item path.
MAX_TEXT_CHARS = 2000
MAX_SOURCE_CHARS = 50
DEFAULT_SOURCE = "api"
# Channels the demo seeder picks from, and its confidence range and age span.
SEED_SOURCES = ("web_form", "app_review", "email", "twitter", "survey")
SEED_CONFIDENCE = (0.72, 0.99)
SEED_MAX_AGE_DAYS = 30
BULK_LIMIT = 1000
PAGE_LIMIT_MIN, PAGE_LIMIT_MAX, PAGE_LIMIT_DEFAULT = 1, 1000, 100

# Upload column detection: needles in lower-cased column names.
TEXT_COLUMN_NEEDLES = ("text", "feedback", "review", "comment", "message")
METADATA_COLUMNS = (
    ("created_at", ("date", "timestamp", "created", "datetime")),
    ("channel", ("source", "channel", "platform")),
    ("segment", ("location", "segment", "tier", "region", "country", "city")),
)

# Report thresholds.
REVIEW_THRESHOLD = 0.60
HIGH_CONFIDENCE = 0.85
URGENT_CONFIDENCE = 0.70
NET_STRONG, NET_LEANS, NET_SPLIT = 40, 10, -10
NEUTRAL_LARGE_PCT = 25
NEGATIVE_PRIORITY_PCT = 30
LOW_CONFIDENCE_QUEUE_PCT = 15
HISTORY_DEAD_BAND = 5
VELOCITY_DAY_HOURS = 48
TREND_DAY_SPAN_DAYS = 3
CLOUD_MIN_CHARS = 30

# Account e-mail hygiene.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
COMMON_DOMAINS = ("gmail.com", "yahoo.com", "outlook.com", "hotmail.com",
                  "icloud.com", "aol.com", "protonmail.com", "proton.me",
                  "live.com", "msn.com", "googlemail.com")
REAL_LOOKALIKE_DOMAINS = ("mail.com", "ymail.com")

# Model figures shown where no evaluation is stored.
DEFAULT_MODEL_FIGURES = {"accuracy": "68%", "test_size": "12,284", "train_size": "12,000"}

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

POSITIVE_SIGNAL_WORDS = tuple(w for name, ws in EMOTION_LEXICON
                              if name in POSITIVE_EMOTIONS for w in ws)
NEGATIVE_SIGNAL_WORDS = tuple(w for name, ws in EMOTION_LEXICON
                              if name in NEGATIVE_EMOTIONS for w in ws)


def lexicon_frame(spark, lexicon=EMOTION_LEXICON, kind="emotion"):
    """Lexicon as rows (kind, category, cat_rank, word) for join-based matching."""
    rows = [(kind, cat, rank, w) for rank, (cat, words) in enumerate(lexicon)
            for w in words]
    return spark.createDataFrame(
        rows, "kind string, category string, cat_rank int, word string")
