"""Word lists, thresholds and labels that results depend on."""

# ---- fixed values -------------------------------------------------------------------

AVERAGE_ORDER_VALUE = 150.0
CHURN_MULTIPLIER = 5
VERIFIED_BOOST = 1.2

KILLER_MIN_STAR = 4
CONFIRMED_BAD_MAX_STAR = 2
KILLER_PERCENTILE = 0.10
POOLED_MIN_ROWS = 10
POOLED_DEFAULT = 0.5
REPORT_PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}

FREQUENCY_THRESHOLD = 5.0
INTENSITY_THRESHOLD = 0.40
ROI_TARGET_SENTIMENT = 0.50

ACTIVE_EMOTIONS = ("anger", "sadness", "joy")
EMOTION_DISPLAY = {"anger": "Anger", "sadness": "Disappointment", "joy": "Joy"}
DISCARDED_EMOTIONS = ("disgust", "fear", "surprise", "neutral")

ASPECT_RULES = [
    ("Battery & Charging", ["battery", "charge", "charging", "life", "power", "dead"]),
    ("Sound Quality", ["sound", "bass", "audio", "quality", "noise", "volume"]),
    ("Comfort & Fit", ["comfort", "fit", "ear", "wear", "pain", "tight"]),
    ("Connectivity", ["connect", "bluetooth", "pair", "wireless", "drop"]),
    ("Build Quality", ["build", "durable", "material", "plastic", "broke"]),
]
ASPECT_OVERRIDES = {
    "Aspect 1": "Sound Quality",
    "Aspect 2": "Connectivity & Peripherals",
    "Aspect 3": "Battery & Charging",
    "Aspect 4": "Cameras & Visual",
    "Aspect 5": "Build Quality",
}
OUTLIER_TOPIC = -1
OUTLIER_LABEL = "Outlier"

TECHNICAL_ASPECTS = (
    "Battery & Charging", "Connectivity", "Sound Quality", "Build Quality", "Microphone & Calls",
)
INSTRUCTIONAL_ASPECTS = ("Value for Money", "Comfort & Fit")

# Product-type words for choosing rivals (singular forms) ...
RIVAL_TYPE_KEYWORDS = [
    "earbuds", "earphone", "headphone", "headset", "speaker", "soundbar",
    "webcam", "keyboard", "mouse", "monitor", "charger", "cable", "hub",
    "router", "smartwatch", "tablet", "laptop", "camera", "microphone",
    "projector", "power bank", "adapter",
]
# ... and for readable fallback titles (plural forms).
TITLE_TYPE_KEYWORDS = [
    "earbuds", "earphones", "headphones", "headset", "speaker", "soundbar",
    "webcam", "keyboard", "mouse", "monitor", "charger", "cable", "hub",
    "router", "smartwatch", "tablet", "laptop", "camera", "microphone",
    "projector", "power bank", "adapter",
]

# Capitalised words that never name the product's own brand (compared in lower case).
BRAND_STOP_WORDS = [
    "i", "the", "this", "these", "they", "it", "but", "and", "so", "we",
    "my", "if", "when", "after", "before", "once", "now", "overall",
    "also", "however", "then", "there", "that", "for", "in", "on", "at",
    "as", "not", "no", "yes", "ok", "okay", "great", "good", "bad",
    "update", "amazon", "bluetooth", "usb", "led", "anc", "usa", "tv",
    "pc", "mac", "windows", "skype", "youtube", "google", "wi", "fi",
    "apple", "iphone", "ipad", "ipod", "android", "samsung", "sony",
    "bose", "beats", "jbl", "skullcandy", "anker", "soundcore", "jabra",
    "christmas", "first", "second", "five", "star", "stars", "one", "two",
]
BRAND_MIN_SHARE = 0.02

# A capitalised word that neither starts the text nor follows sentence-ending punctuation.
MID_SENTENCE_NAME = r"(?U)(?<![.!?\n]\s)(?<!^)\b([A-Z][a-z]{2,15})\b"
EMBEDDED_DATE = r"([A-Z][a-z]+ \d{1,2}, \d{4})"

FLAGSHIP_CAP = 5_000
RIVAL_CAP = 1_500
RIVAL_COUNT = 4
CANDIDATE_COUNT = 50

TRANSLATE_MAX_CHARS = 1_500
SUMMARY_MAX_CHARS = 3_000
SUMMARY_MAX_REVIEWS = 40
SUMMARY_OVERALL_REVIEWS = 60
SUMMARY_MIN_WORDS = 20

CHURN_FEATURES = (
    "helpful_votes", "verified_purchase", "emo_anger", "emo_sadness", "emo_joy", "review_length",
)
# Columns the silent-killer label is made from: none may become a feature.
LABEL_FORMULA_COLUMNS = (
    "star_rating", "prob_negative", "prob_positive", "prob_neutral", "sentiment_score",
    "star_normalized", "star_gap", "revenue_at_risk", "is_silent_killer",
)

# Header names seen in published review dumps, per standard name, first match wins.
COLUMN_ALIASES = {
    "review_text": ["review_text", "text", "reviewText", "content"],
    "review_summary": ["review_summary", "title", "summary"],
    "star_rating": ["star_rating", "rating", "overall"],
    "unix_time": ["unix_time", "timestamp", "unixReviewTime"],
    "product_id": ["product_id", "parent_asin", "asin"],
    "helpful_votes": ["helpful_votes", "helpful_vote"],
    "reviewer_id": ["reviewer_id", "author"],
    "sentiment_score": ["sentiment_score", "roberta_score"],
}

# ---- default word lists for the dependency-free scorers (ours) ------------------------

SENTIMENT_LEXICON = {
    "positive": [
        "good", "great", "love", "excellent", "amazing", "perfect", "best", "happy", "nice",
        "awesome", "comfortable", "clear", "recommend", "works", "easy", "fantastic",
    ],
    "negative": [
        "bad", "poor", "terrible", "awful", "broke", "broken", "hate", "worst", "dies", "dead",
        "disappointed", "disappointing", "useless", "refund", "return", "returned", "stopped", "fails",
    ],
}
EMOTION_LEXICON = {
    "anger": ["angry", "furious", "hate", "scam", "ridiculous", "unacceptable", "outrageous"],
    "sadness": ["disappointed", "disappointing", "sad", "unfortunately", "regret", "letdown", "sorry"],
    "joy": ["love", "happy", "great", "amazing", "delighted", "awesome", "perfect"],
    "disgust": ["gross", "disgusting", "nasty", "filthy", "smell"],
    "fear": ["afraid", "scared", "worried", "danger", "dangerous", "unsafe"],
    "surprise": ["surprised", "wow", "unexpected", "suddenly", "shocked"],
    "neutral": ["okay", "average", "fine", "normal", "standard"],
}
LANGUAGE_STOP_WORDS = {
    "en": ["the", "of", "and", "to", "is"],
    "de": ["der", "die", "und", "den", "das"],
    "es": ["el", "los", "las", "del", "con"],
    "fr": ["le", "et", "les", "des", "dans"],
}
