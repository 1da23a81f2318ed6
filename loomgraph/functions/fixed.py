"""Fixed values that results depend on; each is part of the behaviour to match."""

# Extensions of source code, documents, papers, images, audio and video, as the file scan classifies them.
CODE_FILES = (
    ".py", ".ts", ".js", ".jsx", ".tsx", ".go", ".rs", ".java", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".rb",
    ".swift", ".kt", ".kts", ".cs", ".scala", ".php", ".lua", ".toc", ".zig", ".ps1", ".ex", ".exs", ".m", ".mm",
    ".jl", ".dart", ".vue", ".svelte",
)
DOCUMENT_FILES = (".md", ".txt", ".rst")
PAPER_FILES = (".pdf",)
IMAGE_FILES = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg")
MEDIA_FILES = (".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v", ".mp3", ".wav", ".m4a", ".ogg")
#: Of languages with an extractor that the scan doesn't know; an option adds them.
MORE_CODE_FILES = (".r", ".hs", ".elm")

# Extensions by category, as the analyses see a file.
CATEGORY_CODE = (
    ".py", ".go", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".hpp", ".rb", ".cs", ".kt", ".scala",
    ".php", ".swift", ".ex", ".exs", ".m", ".mm", ".lua", ".zig", ".jl", ".r", ".rmd", ".ps1", ".sh", ".bash", ".zsh",
    ".rs", ".hs", ".clj", ".erl", ".elm",
)
CATEGORY_PAPER = (".pdf", ".tex", ".bib", ".md")
CATEGORY_IMAGE = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")

# Directories that the scan leaves out, and folders of app assets.
NOISE_DIRS = (
    "venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out",
    "site-packages", "lib64", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".eggs",
)
ASSET_DIRS = (".imageset", ".xcassets", ".appiconset", ".colorset", ".launchimage")

# Names of files that may hold secrets (globs on the base name, case counts).
SENSITIVE_NAMES = (
    ".env", ".envrc", "*.pem", "*.key", "*.p12", "*.pfx", "*.cert", "*.crt", "*.der", "*.p8", "*credential*",
    "*secret*", "*passwd*", "*password*", "*token*", "*private_key*", "id_rsa", "*id_dsa*", "*id_ecdsa*",
    "*id_ed25519*", ".netrc", ".pgpass", ".htpasswd", "*aws_credentials*", "*gcloud_credentials*",
    "*service.account*",
)

# Strings that a paper has (lower case), numbered citations, and bytes that are looked at.
PAPER_SIGNALS = ("arxiv", "doi:", "abstract", "proceedings", "journal", "preprint", "\\cite{", "eq.", "equation", "we propose", "literature")
CITATIONS = ("[1]", "[23]")
PAPER_BYTES, PAPER_HITS = 3000, 3

# Words from which a corpus is worth a graph, words and files from which it is large.
WORDS_FOR_GRAPH, WORDS_LARGE, FILES_LARGE = 50_000, 500_000, 200

# Words that a question is stripped of.
STOPWORDS = ("the", "a", "an", "is", "are", "how", "what", "does", "do", "in", "to", "of", "and", "or", "with", "for", "this", "that", "from", "by")

# Directories and platform files that are not the project's own sources.
TEST_DIRS = ("test", "tests", "testing", "benchmark", "benchmarks", "integration_test", "example", "examples")
PLATFORM_FILES = (".swift", ".m", ".kt", ".java", ".cpp", ".h", ".cs")
TOP_DIRS = ("lib", "src", "pkg", "app")

# What design patterns are recognised by, in order of preference.
COMMAND_VERBS = ("execute", "run", "handle")
FACTORY_PREFIXES = ("create", "build", "make")
OBSERVER_PREFIXES = ("addlistener", "removelistener", "notify", "addreaction", "subscribe", "unsubscribe", "addobserver", "removeobserver", "on", "emit")

# Vocabularies of extraction records and their required fields.
FILE_TYPES = ("code", "document", "paper", "image", "rationale")
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
NODE_FIELDS = ("id", "label", "file_type", "source_file")
EDGE_FIELDS = ("source", "target", "relation", "confidence", "source_file")

# Fixed value: how the evidence of a Command names those that share its verb.
COMMAND_EVIDENCE = "inherit and override it"

# Relations that only say where something is written.
STRUCTURAL = ("imports", "imports_from", "contains", "method", "case_of")

# Points of a label as the name of a community, and prefixes of test helpers.
LABEL_POINTS = {"class": 100, "mixin": 100, "extension": 100, "enum": 90, "function": 50, "method": 30, "variable": 10, "file": -50}
HELPER_PREFIXES = ("_wrap", "_make", "_build", "_ctx", "_doc")

# Colours of communities in the viewer, by number modulo 10.
PALETTE = ("#1b6ca8", "#d1495b", "#3c9d5d", "#edae49", "#7d5ba6", "#00798c", "#a05a2c", "#5c6b73", "#b83280", "#8a9a2b")
