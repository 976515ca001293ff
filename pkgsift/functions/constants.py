"""Fixed values.

Everything in the first block must stay exactly as written: the results
(class rows, scores, texts) depend on these literal values, so they are kept
verbatim, in their natural order, in one place. All column expressions in
the package are generated from these lists; nothing else hard-codes them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the analysed tool's behaviour)
# ---------------------------------------------------------------------------

# Directory names never descended into while looking for sources.
PRUNED_DIRS = [".git", "target", "build", ".idea", "out"]

# Source-file suffix (case sensitive).
SOURCE_SUFFIX = ".java"

# Java keywords removed from extracted field names.
JAVA_KEYWORDS = [
    "abstract", "assert", "boolean", "break", "byte", "case", "catch",
    "char", "class", "const", "continue", "default", "do", "double",
    "else", "enum", "extends", "final", "finally", "float", "for",
    "goto", "if", "implements", "import", "instanceof", "int",
    "interface", "long", "native", "new", "package", "private",
    "protected", "public", "return", "short", "static", "strictfp",
    "super", "switch", "synchronized", "this", "throw", "throws",
    "transient", "try", "void", "volatile", "while",
]

# Extraction patterns (Java regex syntax, identical in RE2 for these).
PACKAGE_RX = r"package\s+([a-zA-Z0-9_.]+)\s*;"
IMPORT_RX = r"import\s+([a-zA-Z0-9_.]+)\s*;"
CLASS_RX = (r"(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?"
            r"(?:class|interface|enum)\s+([A-Za-z_][A-Za-z0-9_]*)")
METHOD_RX = (r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?"
             r"[A-Za-z0-9_<>\[\],\s]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\([^)]*\)")
FIELD_RX = (r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?"
            r"[A-Za-z0-9_<>\[\],\s]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*[;=]")
ANNOTATION_RX = r"@([A-Za-z_][A-Za-z0-9_]*)"
EXTENDS_RX = r"extends\s+([A-Za-z_][A-Za-z0-9_]*)"
IMPLEMENTS_RX = r"implements\s+([A-Za-z0-9_,\s]+)"
PREVIEW_CHARS = 500

# Placement rules, in rule order (ties go to the earlier type).
# Name patterns are regexes of the form ".*Suffix$"; they are applied
# lower-cased to the lower-cased class name.
PLACEMENT_RULES = [
    ("model", {
        "keywords": ["entity", "model", "dto", "pojo", "bean", "data", "domain"],
        "patterns": [r".*Entity$", r".*Model$", r".*DTO$", r".*Bean$"],
        "methods": ["get", "set", "equals", "hashCode", "toString"],
        "annotations": ["Entity", "Table", "Column", "Id", "Data", "NoArgsConstructor"],
    }),
    ("service", {
        "keywords": ["service", "business", "logic", "processor", "handler", "manager"],
        "patterns": [r".*Service$", r".*Manager$", r".*Handler$", r".*Processor$"],
        "methods": ["process", "handle", "execute", "perform", "calculate", "validate"],
        "annotations": ["Service", "Component", "Transactional"],
    }),
    ("controller", {
        "keywords": ["controller", "rest", "api", "endpoint", "web", "resource"],
        "patterns": [r".*Controller$", r".*Resource$", r".*Endpoint$"],
        "methods": ["get", "post", "put", "delete", "create", "update", "find"],
        "annotations": ["RestController", "Controller", "RequestMapping", "GetMapping", "PostMapping"],
    }),
    ("repository", {
        "keywords": ["repository", "dao", "persistence", "data"],
        "patterns": [r".*Repository$", r".*DAO$", r".*Dao$"],
        "methods": ["find", "save", "delete", "exists", "count", "query"],
        "annotations": ["Repository", "Component"],
    }),
    ("util", {
        "keywords": ["util", "helper", "utility", "common", "tools", "constants"],
        "patterns": [r".*Util$", r".*Helper$", r".*Utils$", r".*Constants$"],
        "methods": ["static", "helper", "convert", "format", "parse"],
        "annotations": ["Component", "Utility"],
    }),
    ("config", {
        "keywords": ["config", "configuration", "settings", "properties"],
        "patterns": [r".*Config$", r".*Configuration$", r".*Settings$"],
        "methods": ["configure", "setup", "initialize"],
        "annotations": ["Configuration", "ConfigurationProperties", "Bean"],
    }),
    ("exception", {
        "keywords": ["exception", "error", "fault", "failure"],
        "patterns": [r".*Exception$", r".*Error$", r".*Fault$"],
        "methods": ["getMessage", "getCause"],
        "annotations": ["ResponseStatus"],
    }),
]

# Score weights and limits.
PATTERN_WEIGHT = 0.4
KEYWORD_WEIGHT = 0.2
METHOD_WEIGHT = 0.1
METHOD_CAP = 0.3
ANNOTATION_WEIGHT = 0.15
ANNOTATION_CAP = 0.3
RULE_CAP = 1.0
RULE_MIX = 0.4
EMBEDDING_MIX = 0.4
DEPENDENCY_MIX = 0.2
MISPLACED_THRESHOLD = 0.6
CONFIDENCE_CAP = 0.95
CLI_CONFIDENCE_DEFAULT = 0.6
REASON_METHODS_SCANNED = 5
EVIDENCE_METHODS_SCANNED = 10
METHODS_SHOWN = 3
UNKNOWN_TYPE = "unknown"

# Keywords used to describe each package type to the text encoder
# (a second list, different from the placement rules).
TYPE_DESCRIPTION_KEYWORDS = [
    ("model", ["entity", "data", "domain", "pojo", "bean", "dto"]),
    ("service", ["service", "business", "logic", "manager", "handler"]),
    ("controller", ["controller", "rest", "api", "endpoint", "web"]),
    ("repository", ["repository", "dao", "data", "persistence", "database"]),
    ("util", ["util", "helper", "common", "utility", "tools"]),
    ("config", ["config", "configuration", "settings", "properties"]),
    ("exception", ["exception", "error", "fault", "failure"]),
]
TYPE_DESCRIPTION_TEMPLATE = "{type} package containing {keywords} related classes"

# Semantic text layout of a class.
SEMANTIC_METHODS = 10
SEMANTIC_FIELDS = 10

# Fixed result texts.
METHOD_USED_SUGGESTION = "rule-based + semantic analysis"
METHOD_USED_DEFAULT = "llm+embedding"
DEFAULT_REASONING = "Class appears to be correctly placed"
DEFAULT_EVIDENCE = "No misplacement indicators found"
DEFAULT_CONFIDENCE = 0.95
REASON_NAME = "Class name '{name}' suggests {type} functionality"
REASON_ANNOTATIONS = "Contains {type}-specific annotations: {items}"
REASON_METHODS = "Contains {type}-typical methods: {items}"
REASON_FALLBACK = "Semantic analysis suggests better fit in {type} package"
EVIDENCE_PATTERN = "Name matches {type} pattern"
EVIDENCE_ANNOTATIONS = "Annotations: {items}"
EVIDENCE_METHODS = "Methods: {items}"
EVIDENCE_FALLBACK = "Semantic similarity analysis"

# Metrics.
HIGH_CONFIDENCE = 0.8
MEDIUM_CONFIDENCE = 0.6
REASONING_WORDS_FULL = 10
REASONING_BONUS = 0.2
REASONING_KEYWORDS = ["annotation", "method", "pattern", "naming"]
TOP_RECOMMENDATIONS = 5
TOP_REASON_CHARS = 80
FIRST_MISPLACED_REASON_CHARS = 100
TOP_PACKAGES = 5

# Clustering.
KMEANS_MIN_K = 2
KMEANS_MAX_K = 10
KMEANS_RESTARTS = 10
KMEANS_SEED = 42

# Demo classifier (quick rule) texts and confidences.
DEMO_CONTROLLER_PACKAGE = "com.example.controller"
DEMO_SERVICE_PACKAGE = "com.example.service"
DEMO_CONTROLLER_REASON = "Class name and annotations indicate REST controller functionality"
DEMO_SERVICE_REASON = "Contains data processing and export functionality"
DEMO_ENTITY_REASON = "Entity annotation indicates correct model placement"
DEMO_DEFAULT_REASON = "No clear misplacement indicators"
DEMO_CONFIDENCES = (0.92, 0.87, 0.95, 0.80)

# ---------------------------------------------------------------------------
# Derived helpers (not fixed values)
# ---------------------------------------------------------------------------

TYPE_NAMES = [t for t, _ in PLACEMENT_RULES]


def pattern_suffix(pattern: str) -> str:
    """'.*Entity$' -> 'entity': the lower-cased literal a name must end with."""
    assert pattern.startswith(".*") and pattern.endswith("$"), pattern
    return pattern[2:-1].lower()
