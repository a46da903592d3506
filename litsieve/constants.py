"""Fixed values.

These values must equal the screening rules of the application this engine re-expresses, so
that results agree; they are stated here together, in natural order.
"""

# Labels
UNCATEGORIZED = "Uncategorized"
UNKNOWN = "Unknown"
LABEL_SEPARATOR = ", "
PAIR_SEPARATOR = " + "

# Duplicate handling
KEEP_OPTIONS = ("first", "last", "none")
FUZZY_PRESETS = {"conservative": 95, "balanced": 90, "aggressive": 85}
FUZZY_THRESHOLD_RANGE = (70, 100)
NEAR_THRESHOLD = 0.85
COMBINED_FUZZY_THRESHOLD = 90
NUM_PERM = 128

# Sources
MAX_RESULTS_RANGE = (1, 1000)
DEFAULT_MAX_RESULTS = 100
ARXIV_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Exports: characters not allowed in a sheet / partition name, and its maximum length
UNSAFE_NAME_CHARS = r"[\\/*?:\[\]]"
NAME_MAX_LENGTH = 31

# Keyword matching
DEFAULT_MIN_SCORE = 0.5

# Clustering and classification
CLUSTER_RANGE = (2, 20)
DEFAULT_CLUSTERS = 5
TEST_PCT_RANGE = (10, 40)
DEFAULT_TEST_PCT = 20
TREES_RANGE = (50, 500)
DEFAULT_TREES = 100
RANDOM_SEED = 42

# Previews
PREVIEW_ROWS = 5
