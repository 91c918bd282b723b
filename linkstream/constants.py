"""Fixed values.

These must equal the values of the system we reproduce for results to
match; they are stated plainly here and nowhere else.
"""

# --- fixed values (must match the original system) -------------------------
BASE62_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CODE_LENGTH = 11
FEISTEL_ROUNDS = 4
FEISTEL_ROUND_KEY = 0xDEADBEEF
FEISTEL_MUL_1 = 0x85EBCA6B
FEISTEL_SHIFT_1 = 13
FEISTEL_MUL_2 = 0xC2B2AE35
FEISTEL_SHIFT_2 = 16
SNOWFLAKE_EPOCH_MS = 1767225600000  # 2026-01-01T00:00:00Z
SNOWFLAKE_NODE_BITS = 10
SNOWFLAKE_SEQ_BITS = 12
ID_BLOCK_SIZE = 1_000_000
CODE_PATTERN = "^[A-Za-z0-9_-]+$"
DEFAULT_COUNTRY = "Unknown"
CLICK_WATERMARK = "5 seconds"
CACHE_TTL = "1 hour"
STALE_READ = "15 seconds"
TOP_LINKS_N = 10
BOT_THRESHOLD = 100
WRITE_LIMIT_PER_S = 500
READ_LIMIT_PER_S = 5000
WRITE_EDGE_BUCKET_PER_S = 100
READ_EDGE_BUCKET_PER_S = 1000
SINK_BATCH_ROWS = 1000
SINK_FLUSH_MS = 200
SINK_MAX_RETRIES = 5
DASHBOARD_REFRESH = "5 seconds"
# Redirect outcome labels (source of the answer / reason of the miss).
OUTCOME_GUARD_MISS = "url_not_found_bloom"
OUTCOME_CACHE_HIT = "redis"
OUTCOME_TABLE_HIT = "db_stale"
OUTCOME_TABLE_MISS = "url_not_found_db"
OUTCOME_EMPTY_CODE = "missing_short_code"
CACHE_MISS_ERROR = "redis_get_error"
# Shorten request reasons.
REASON_BAD_BODY = "invalid_request_body"
REASON_MISSING_URL = "missing_long_url"
REASON_UNAUTHORIZED = "unauthorized"
# --- end of fixed values -----------------------------------------------------

MASK32 = 0xFFFFFFFF
TWO32 = 1 << 32
