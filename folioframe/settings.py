"""Default limits and thresholds (fixed values; every operator takes them as arguments)."""

# lexical and dense recall
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
LEXICAL_TOP_K = 20
DENSE_TOP_K = 20

# fusion and reranking
RRF_K = 60.0
RRF_TOP_K = 30
RERANK_CANDIDATES = 12
RERANK_MIN_SCORE = 0.35
RERANK_MARGIN = 0.20
FINAL_TOP_K = 5

# chunking
PARENT_CHARS = 1200
PARENT_OVERLAP = 120
CHILD_CHARS = 500
CHILD_OVERLAP = 80
CHILD_MIN_CHARS = 80
SPAN_MAX_CHARS = 420
SPAN_MIN_CHARS = 8

# context budgets
CONTEXT_BUDGET = 3000
CONTEXT_WINDOW = 16_000
MEMORY_MAX_HISTORY = 20
MEMORY_SUMMARY_THRESHOLD = 10
MEMORY_CONTEXT_BUDGET = 3000
MEMORY_SUMMARY_BUDGET = 600
MEMORY_SUMMARY_TRIGGER = 4000
MEMORY_SUMMARY_INPUT = 6000
SESSION_TTL_HOURS = 24

# evidence gate and grading
EVIDENCE_MIN_SCORE = 0.35
EVIDENCE_MIN_SOURCES = 1
GRADE_UPPER = 0.7
GRADE_LOWER = 0.3
GRADE_RECOVERY_MIN = 0.1
FAST_PATH_MAX_CHARS = 160
FAST_PATH_MIN_SCORE = 0.75
FAST_PATH_MIN_SOURCES = 1

# model-call budgets
MAX_OUTPUT_TOKENS = 1024
RESPONSE_OUTPUT_TOKENS = 1024

# research
RESEARCH_MAX_QUERIES = 2
RESEARCH_MAX_SOURCES = 5
RESEARCH_MAX_CHARS = 12_000

RUN_TIMEOUT_SECONDS = 180
PENDING_ACTION_HOURS = 1

# decimals at which scores are compared, so that ties break on the id
SCORE_DECIMALS = 6
