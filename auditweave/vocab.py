"""Vocabularies, limits and table schemas shared by every operator."""

from pyspark.sql import types as T

# Accepted names, their ranks and the limits of a review.
VULN_CLASSES = (
    "IDOR", "AUTH_BYPASS", "PRIVILEGE_ESC", "MASS_ASSIGN",
    "JWT_ISSUE", "LOGIC_FLAW", "DATA_EXPOSURE",
)
ACCEPTED_CLASSES = VULN_CLASSES + ("SAFE",)
SEVERITY_RANKS = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}
CONFIDENCE_RANKS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
SARIF_LEVELS = {
    "CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note",
}
MAX_FILE_BYTES = 500_000
MIN_CHANGE_BYTES = 50
MAX_FILE_LINES = 2000
MIN_FILE_LINES = 10
CHUNK_TOKENS = 8000
CHUNK_OVERLAP = 200
SAMPLE_FILES = 100
CONTEXT_TOKENS = 2000
MAX_ATTEMPTS = 3
DEBOUNCE = "800 milliseconds"
DEFAULT_SEVERITY = "LOW"
DEFAULT_CONFIDENCE = "MEDIUM"
DEFAULT_GATE = "HIGH"

# Code suffixes, their languages, and directories that are never reviewed (fixed values).
CODE_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript",
    ".jsx": "javascript", ".tsx": "typescript", ".go": "go",
    ".rb": "ruby", ".php": "php", ".java": "java",
    ".cs": "csharp", ".rs": "rust", ".vue": "vue", ".svelte": "svelte",
}
SKIPPED_DIRS = (
    "node_modules", ".git", "__pycache__", "venv", ".venv",
    "env", ".env", "dist", "build", ".next", ".nuxt",
    "vendor", "target", "bin", "obj", ".tox", ".mypy_cache",
    ".pytest_cache", "egg-info", ".eggs",
)
ROOT_MARKERS = (".git", "pyproject.toml", "package.json")

FINDING_TEXTS = ("title", "description", "impact", "reproduction", "fix")

FILES = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("content", T.StringType()),
])
RESPONSES = T.StructType([
    T.StructField("prompt_id", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("response", T.StringType()),
    T.StructField("error", T.StringType()),
])
FINDING_FIELDS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "vuln_class", "severity", "confidence", "file")]
    + [T.StructField(n, T.LongType()) for n in ("line_start", "line_end")]
    + [T.StructField(n, T.StringType()) for n in FINDING_TEXTS]
)
REPORT = T.StructType([
    T.StructField("summary", T.StructType([
        T.StructField(n, T.LongType())
        for n in ("files_scanned", "total_findings", "critical", "high", "medium", "low", "info")
    ])),
    T.StructField("findings", T.ArrayType(FINDING_FIELDS)),
    T.StructField("errors", T.ArrayType(T.StringType())),
])
CHANGES = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("is_directory", T.BooleanType()),
])
