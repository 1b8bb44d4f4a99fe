"""Record layouts shared by every operator."""

from pyspark.sql import types as T

# The closed sets of entity and relation kinds.
FILE = "File"
PACKAGE = "Package"
CLASS = "Class"
INTERFACE = "Interface"
FUNCTION = "Function"
CONSTRUCTOR = "Constructor"
BRANCH = "ConditionalBranch"
RETURN = "ReturnStatement"
UNRESOLVED = "Unresolved"
NODE_TYPES = (FILE, PACKAGE, CLASS, INTERFACE, FUNCTION, CONSTRUCTOR, BRANCH, RETURN)

CONTAINS = "contains"
CALLS = "calls"
IMPORTS = "imports"
IMPLEMENTS = "implements"
EXTENDS = "extends"
RETURNS = "returns"
HAS_BRANCH = "has_branch"
EDGE_TYPES = (CONTAINS, CALLS, IMPORTS, IMPLEMENTS, EXTENDS, RETURNS, HAS_BRANCH)

UNRESOLVED_PREFIX = "unresolved:"
IMPORT_PREFIX = "import:"

# Source languages by lower-cased file suffix.
LANGUAGES = {".java": "java", ".py": "python"}

# Directories left out when a tree is scanned.
SCAN_SKIP_DIRS = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv",
    ".idea", ".vscode", ".settings", "target", "build", "out", "bin",
)

# Path parts left out when file changes are followed.
CHANGE_SKIP_PARTS = (".git", "target", "build", "node_modules", ".idea", ".vscode")


def _fields(*specs):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in specs])


_S, _I = T.StringType(), T.IntegerType()

NODE = _fields(
    ("uid", _S, False), ("name", _S, True), ("qualified_name", _S, True),
    ("node_type", _S, False), ("filepath", _S, True),
    ("start_line", _I, True), ("end_line", _I, True),
    ("docstring", _S, True), ("signature", _S, True), ("file_hash", _S, True),
)

# raw_target keeps the text a target had before resolution, so that names can
# be resolved again after every update.
EDGE = _fields(
    ("source_uid", _S, False), ("target_uid", _S, False), ("edge_type", _S, False),
    ("filepath", _S, True), ("line", _I, True), ("raw_target", _S, True),
)

ERROR = _fields(("filepath", _S, True), ("message", _S, False))

RESULT = T.StructType([
    T.StructField("filepath", _S),
    T.StructField("nodes", T.ArrayType(NODE)),
    T.StructField("edges", T.ArrayType(EDGE)),
    T.StructField("errors", T.ArrayType(_S)),
])

FILES = _fields(
    ("filepath", _S, False), ("name", _S, True), ("ext", _S, True),
    ("language", _S, True), ("content", T.BinaryType(), True),
    ("file_hash", _S, True), ("n_lines", _I, True),
)

CHANGE = _fields(
    ("ts", T.TimestampType(), True), ("event_type", _S, True), ("src_path", _S, True),
    ("dest_path", _S, True), ("is_directory", T.BooleanType(), True),
)

DOMAIN = _fields(("uid", _S, False), ("name", _S, True), ("summary", _S, True),
                 ("member_count", T.LongType(), True))
MEMBERSHIP = _fields(("uid", _S, False), ("domain_uid", _S, False))

NODE_COLS = NODE.fieldNames()
EDGE_COLS = EDGE.fieldNames()
NODE_KEY = ["node_type", "uid"]
EDGE_KEY = ["source_uid", "edge_type", "target_uid"]
