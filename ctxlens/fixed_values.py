"""Fixed values.

Word lists, lookup tables, constants and patterns that results depend on. They
are data, not logic, and are kept together so that a reader can check them.
"""

# --- code files -------------------------------------------------------------

CODE_EXTENSIONS = [
    ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".rb",
    ".java", ".cpp", ".c", ".h", ".hpp", ".cs", ".php", ".swift",
    ".kt", ".scala", ".sh", ".bash", ".zsh", ".sql", ".yaml", ".yml",
    ".toml", ".json", ".xml", ".html", ".css", ".scss", ".less",
]

EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".jsx": "javascript",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".java": "java",
    ".cpp": "cpp",
    ".c": "c",
    ".h": "c",
    ".hpp": "cpp",
}

PYTHON_NAMES = ["python", "py", ""]

BRACE_LANGUAGES = [
    "javascript", "js", "typescript", "ts", "tsx", "jsx",
    "go", "rust", "rs", "c", "cpp", "cxx", "h", "hpp",
    "java", "cs", "csharp", "kotlin", "kt", "swift",
    "scala", "php",
]

# --- signatures of brace languages (Python re syntax, tried in this order) ---

GO_SIGNATURE = (
    r"(\s*(?:func\s+(?:\([^)]*\)\s+)?[A-Za-z_0-9]+\s*\([^)]*\)"
    r"(?:\s*[A-Za-z_0-9\[\]\*\s]+)?))\s*\{"
)
RUST_SIGNATURE = (
    r"(\s*(?:pub\s+)?fn\s+[A-Za-z_0-9]+\s*\([^)]*\)(?:\s*->\s*[^{]+)?)\s*\{"
)
GENERIC_SIGNATURE = (
    r"(\s*)"
    r"((?:export\s+|default\s+|public\s+|private\s+|protected\s+|static\s+"
    r"|async\s+|func\s+|fn\s+|def\s+|var\s+|const\s+|let\s+)*"
    r"[A-Za-z_0-9\[\]\*\.<>\?\s]+"
    r"[A-Za-z_0-9]+\s*\([^)]*\)"
    r"(?:\s*:\s*[A-Za-z_0-9\[\]\*\.<>\?\s]+)?"
    r"(?:\s*->\s*[A-Za-z_0-9\[\]\*\.<>\?\s]+)?"
    r")(\s*\{)"
)
BODY_PLACEHOLDER = " ... "

# --- tool calls ---------------------------------------------------------------

TOOL_PATH_KEYS = [
    "file_path", "filepath", "path", "filename", "file",
    "target_file", "absolute_path",
]
TOOL_ROLES = ["tool", "function"]
UNTOUCHED_ROLES = ["tool", "function", "tool_use", "tool_result"]
TOOL_PART_TYPES = ["tool_use", "tool_result"]
RESPONSES_SKIPPED_TYPES = [
    "function_call", "function_call_output", "tool_call", "tool_result",
    "reasoning",
]

# --- prompt cache ---------------------------------------------------------------

MAX_MARKERS = 4
MIN_MESSAGES_TO_CACHE = 3
TRAILING_MESSAGES = 2
SESSION_GAP_SECONDS = 300
TAGGABLE_TYPES = ["text", "tool_use", "tool_result", "document"]
MARKER_JSON = '{"type":"ephemeral"}'
LONG_TTL = "1h"
FINGERPRINT_MESSAGES = 2
FINGERPRINT_CHARS = 512
FINGERPRINT_BLOCKS = 3
FINGERPRINT_BLOCK_CHARS = 256
FINGERPRINT_HEX = 16

# --- tokens and prices -----------------------------------------------------------

CHARS_PER_TOKEN = 4
TOKENS_PER_MESSAGE = 4
TOKENS_PER_REPLY = 3
DEFAULT_PRICE = (3.00, 15.00)
PRICING_ROWS = [
    ("gpt-4o", 2.50, 10.00),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-4-turbo", 10.00, 30.00),
    ("gpt-3.5-turbo", 0.50, 1.50),
    ("claude-3-5-sonnet-20241022", 3.00, 15.00),
    ("claude-3-opus-20240229", 15.00, 75.00),
    ("claude-3-haiku-20240307", 0.25, 1.25),
    ("claude-sonnet-4-20250514", 3.00, 15.00),
    ("default", 3.00, 15.00),
]
DEFAULT_ENCODING = "cl100k_base"
DEFAULT_MODEL = {
    "chat": "gpt-4o",
    "messages": "claude-sonnet-4-20250514",
    "responses": "gpt-4o",
}
RECENT_REQUESTS = 50

# --- endpoints and headers --------------------------------------------------------

ENDPOINT_API = {
    "/v1/chat/completions": "chat",
    "/v1/messages": "messages",
    "/v1/responses": "responses",
}
SUBSCRIPTION_HEADER = "chatgpt-account-id"
DROPPED_HEADERS = [
    "host", "content-length", "connection", "keep-alive",
    "transfer-encoding", "upgrade", "proxy-authorization",
    "proxy-connection", "te", "trailer", "accept-encoding",
    "content-encoding", "content-type",
]
SECRET_HEADERS = ["authorization", "x-api-key"]
ANTHROPIC_VERSION = "2023-06-01"
JSON_CONTENT_TYPE = "application/json"

# --- ranking ---------------------------------------------------------------------

SUMMARY_CHARS = 2048
SUMMARY_LINES = 20
HALF_LIFE_DAYS = 30.0
RANK_WEIGHTS = (0.4, 0.4, 0.2)
RANK_TOP_K = 5
BOOST_THRESHOLD = 0.5
TARGET_SCORE = 1.0
DEPENDENCY_SCORE = 0.8
DEPENDENT_SCORE = 0.5
