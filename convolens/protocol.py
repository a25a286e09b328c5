"""Constants of the evaluation protocol."""

# Results are only comparable when every one of these is unchanged.
SEED = 20260723
TEMPERATURE = 0.0
MAX_NEW_TOKENS = 512
TRANSCRIPT_WORDS = 4500
CHUNK_WORDS = 900
SPAN_WORDS = 3000
HOSTED_PROMPT_WORDS = 40000
JUDGE_SAMPLE = 60
JUDGE_MAX_TOKENS = 1024
BOOTSTRAP_DRAWS = 10000
CHARS_PER_TOKEN = 4.0
ENQUEUE_SAFETY = 0.85
DEFAULT_ENQUEUE_CAP = 900_000
SWEEP_BUDGETS = (2000, 3000, 4000)

# Fixed text: the summarisation prompt, as (before query, before transcript, after transcript).
PROMPT_HEAD = (
    "You are given a meeting transcript and a query. Answer the query with a "
    "concise summary based only on the transcript.\n\nQuery: "
)
PROMPT_MIDDLE = "\n\nTranscript:\n"
PROMPT_TAIL = "\n\nSummary:"

# Fixed thresholds of the controls.
DEGENERATE_REPEAT = 0.20
DEGENERATE_SHARE = 0.05
REPEAT_FLOOR = 0.005
LENGTH_GAIN = 1.15
MIN_GAP = 0.02
MAX_CONTROL_SPREAD = 0.5
MIN_MEAN_SIM = 0.20
MIN_MEAN_PERCENTILE = 0.90
MIN_TOP1_LIFT = 10.0
MIN_MARGIN = 1.25
ROUGE1_TOLERANCE = 3.0
GOLD_CONTROL_FLOOR = 0.85
LENGTH_TOLERANCE = 5
SEED_SPREAD_CHECKPOINT = 1.7
SEED_SPREAD_FLOOR = 0.9
DRIFT_TOLERANCE = 1e-9
SUBSAMPLE_THRESHOLDS = (0.300, 0.318, 0.335, 0.342)

# Fixed labels.
RECALL_BUCKETS = ("miss (0.0)", "partial (0-0.5)", "most (0.5-1.0)", "hit (1.0)")
VERACITY_LABELS = ("SUPPORTED_FULL", "SUPPORTED_PARTIAL", "CONTRADICTED", "NOT_IN_TRANSCRIPT")
VERACITY_TRUE = ("SUPPORTED_FULL", "SUPPORTED_PARTIAL")
GOLD_SOURCE = "GOLD-REFERENCE"
