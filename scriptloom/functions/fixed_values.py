"""Fixed values that results depend on. Changing any of them changes results."""

# Default sizes of the splitters.
BLOCK_DELIMITER = "/"
MAX_CHUNK_CHARS = 1200
LINES_PER_CHUNK = 100
SMALL_FRAGMENT_CHARS = 180
BATCH_FLUSH_CHARS = 300
MAX_LINES_PER_CHUNK = 400

# Words that open a block, in procedural SQL.
CREATED_OBJECTS = ["FUNCTION", "PROCEDURE", "PACKAGE", "TRIGGER"]
BLOCK_OPENERS = ["CREATE", "DECLARE", "BEGIN"]

# Block types.
HEADER_TYPES = ["PROCEDURE", "FUNCTION", "PACKAGE BODY", "PACKAGE", "TRIGGER"]
ANONYMOUS_BLOCK = "ANONYMOUS_BLOCK"
UNKNOWN_BLOCK = "UNKNOWN"

# Chunk identifier format.
CHUNK_ID_FORMAT = "blk_%03d"

# Substrings and patterns the static checks look for.
SESSION_MARKERS = ["spark.read", "SparkSession"]
DATAFRAME_MARKERS = [".select", ".withColumn", ".filter", ".groupBy"]
LEGACY_MARKERS = ["SQLContext", ".rdd"]

# Texts of the static checks.
MSG_NO_SESSION = "# ⚠️ No SparkSession usage detected. Did you forget to initialize Spark?"
MSG_NO_DATAFRAME = (
    "# ⚠️ No DataFrame API patterns found. Ensure you are using DataFrame operations."
)
MSG_LEGACY = (
    "# ⚠️ SQLContext or RDD usage detected. Prefer DataFrame API for better optimization."
)
MSG_PARENS = "# ⚠️ Unmatched parentheses detected."
MSG_NO_IMPORT = "# ⚠️ No PySpark import detected. Add necessary imports."
MSG_PASSED = "# ✅ PySpark code passed static validation."

# Prefixes that mark a failed conversion inside the converted text.
ERROR_PREFIXES = ["# Gemini Error:", "# OpenAI Error:"]

# Characters that count as white space (Unicode white space and the
# four ASCII separators), as characters and as a regular-expression class body.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_IN_LINE = (
    r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Fixed value: what an import looks like; the class is WS.
IMPORT_PATTERN = rf"import[{WS}]+spark|from[{WS}]+pyspark"

# Line boundaries of the structured path.
LINE_BOUNDARY = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
RARE_LINE_BOUNDARIES = ["\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
