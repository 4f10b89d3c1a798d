"""Declared table schemas and the fixed values that the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# A result only agrees with published numbers if these agree.
# ---------------------------------------------------------------------------

# Aspects in their canonical order; the order decides ties and output order.
DEFAULT_ASPECTS = ["food", "service", "ambience", "price", "hygiene", "menu", "portion"]

# Exact synonyms of each aspect.
DEFAULT_SYNONYMS = {
    "food": ["food", "taste", "flavor", "flavour", "dish", "meal", "quality"],
    "service": ["service", "staff", "waiter", "waitress", "server"],
    "ambience": ["ambience", "ambiance", "atmosphere", "decor", "vibe"],
    "price": ["price", "cost", "value", "money", "budget"],
    "hygiene": ["hygiene", "cleanliness", "clean"],
    "menu": ["menu", "options", "variety"],
    "portion": ["portion", "quantity", "size"],
}

SIMILARITY_THRESHOLD = 0.5
LABEL_NAMES = {0: "Negative", 1: "Neutral", 2: "Positive"}
SPLIT_SEED = 42
TEST_SHARE = 0.2
VALIDATION_SHARE = 0.1
MAX_FEATURES = 20_000
MAX_ITERATIONS = 1_000
SCORING_BATCH = 16
MAX_TOKENS = 128
INVALID_RATING = "Like"
NOT_DETECTED = "NotDetected"
NO_ASPECTS_MESSAGE = "No aspects detected in this review."

# Cell contents that a ratings file uses for "missing".
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# English stop words: the public list behind pyspark.ml's StopWordsRemover.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll "
    "they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()

# ---------------------------------------------------------------------------
# Sizes. The first two are proven where a table is broadcast or handed to every row, and are
# parameters of the public functions; the others choose between plans that give the same rows.
# ---------------------------------------------------------------------------

MAX_CLASSES = 1_000              # labels of one classification task
MAX_ASPECTS = 1_000              # aspects of one lexicon
MAX_INROW_LEXICON = 100_000      # characters of a lexicon that is matched inside the row
MAX_INROW_WORDS = 3              # words of its longest term
MAX_INROW_BYTES = 2 << 20        # bytes of a stored table of weights that is looked up inside the row
BLOCK_BYTES = 32 << 20           # bytes of training vectors in a partition
BLOCK_TOKENS = 1 << 19           # tokens of the texts that look up a large table of weights together

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

RATINGS_FILE = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("Review", T.StringType()),
    T.StructField("Rating", T.StringType()),
])

GOLD_FILE = T.StructType([
    T.StructField("review", T.StringType()),
    T.StructField("aspect", T.StringType()),
    T.StructField("true_label", T.StringType()),
])

LEXICON = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("aspect", T.StringType()),
    T.StructField("ord", T.IntegerType()),
])
