"""Fixed dimensions: rules, line patterns, severities, risky packages, guidance texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------------------
# Fixed values. Rule identity, labels, categories, severities, confidences and tags, in
# reporting order; patterns of the line rules; weights; limits.
# ---------------------------------------------------------------------------------------

# (rule_id, issue_type, category, severity, confidence, tags)
RULES = [
    ("HARDCODED_SECRET", "Hardcoded Secret", "security", "critical", 95.0, ["secret", "credential", "security"]),
    ("SQL_INJECTION_STRING_BUILD", "Possible SQL Injection", "security", "high", 89.0, ["injection", "sql", "security"]),
    ("COMMAND_INJECTION", "Command Injection Risk", "security", "critical", 88.0, ["command-exec", "injection", "security"]),
    ("EVAL_USAGE", "Dynamic Code Execution", "security", "high", 92.0, ["rce", "dynamic-code", "security"]),
    ("INSECURE_HASH", "Weak Cryptographic Hash", "security", "high", 90.0, ["crypto", "hash", "security"]),
    ("INSECURE_HTTP", "Insecure Transport", "security", "medium", 82.0, ["transport", "network"]),
    ("INSECURE_AUTH_LOGIC", "Insecure Authentication Logic", "security", "high", 87.0, ["auth", "identity"]),
    ("UNSAFE_FILE_HANDLING", "Unsafe File Handling", "security", "medium", 76.0, ["file-io", "path-traversal"]),
    ("BROAD_EXCEPTION", "Broad Exception Handling", "reliability", "medium", 79.0, ["exceptions", "reliability"]),
    ("EMPTY_EXCEPTION_HANDLER", "Swallowed Exception", "reliability", "high", 84.0, ["exceptions", "observability"]),
    ("MISSING_INPUT_VALIDATION_HINT", "Potential Missing Input Validation", "security", "medium", 62.0, ["input-validation", "security"]),
    ("TODO_HACK_MARKER", "Code Smell Marker", "maintainability", "low", 73.0, ["debt", "maintainability"]),
    ("LONG_FUNCTION", "Long Function", "quality", "medium", 87.0, ["code-smell", "maintainability"]),
    ("TOO_MANY_PARAMETERS", "Too Many Parameters", "quality", "medium", 81.0, ["code-smell", "readability"]),
    ("DEEP_NESTING", "Deep Nesting", "maintainability", "medium", 79.0, ["nesting", "complexity"]),
    ("MAGIC_NUMBERS", "Magic Numbers", "quality", "low", 75.0, ["code-smell", "readability"]),
    ("POOR_NAMING_CONVENTION", "Poor Naming Convention", "quality", "low", 73.0, ["naming", "maintainability"]),
    ("MISSING_EXCEPTION_HANDLING", "Missing Exception Handling", "reliability", "high", 85.0, ["exceptions", "reliability"]),
    ("UNUSED_IMPORT", "Unused Import", "quality", "low", 88.0, ["cleanup", "quality"]),
    ("DEAD_CODE_FUNCTION", "Potential Dead Code", "quality", "low", 70.0, ["dead-code", "cleanup"]),
    ("LONG_FUNCTION_JS", "Long Function", "quality", "medium", 83.0, ["code-smell", "javascript"]),
    ("TOO_MANY_PARAMETERS_JS", "Too Many Parameters", "quality", "medium", 78.0, ["code-smell", "javascript"]),
    ("HIGH_COMPLEXITY_JS", "High Cyclomatic Complexity", "maintainability", "high", 80.0, ["complexity", "javascript"]),
    ("DEEP_NESTING_JS", "Deep Nesting", "maintainability", "medium", 76.0, ["nesting", "javascript"]),
    ("MAGIC_NUMBERS_JS", "Magic Numbers", "quality", "low", 72.0, ["code-smell", "javascript"]),
    ("POOR_NAMING_JS", "Poor Naming Convention", "quality", "low", 69.0, ["naming", "javascript"]),
    ("MISSING_EXCEPTION_HANDLING_JS", "Missing Exception Handling", "reliability", "high", 82.0, ["exceptions", "javascript"]),
    ("DEAD_CODE_JS", "Potential Dead Code", "quality", "low", 66.0, ["dead-code", "javascript"]),
    ("UNUSED_IMPORT_JS", "Unused Import", "quality", "low", 79.0, ["cleanup", "javascript"]),
    ("HIGH_COMPLEXITY_FILE", "High Cyclomatic Complexity", "maintainability", "high", 78.0, ["complexity", "maintainability"]),
    ("MODERATE_COMPLEXITY_FILE", "Elevated Complexity", "maintainability", "medium", 72.0, ["complexity"]),
    ("LOW_MAINTAINABILITY", "Low Maintainability Index", "maintainability", "medium", 74.0, ["maintainability", "quality"]),
    ("DUPLICATION_BLOCK", "Duplicated Code Block", "quality", "medium", 86.0, ["duplication", "maintainability"]),
    ("DUPLICATE_FUNCTION_SIMILARITY", "Duplicate Function Similarity", "quality", "medium", 95.0, ["duplication", "refactor", "similarity"]),
    ("UNPINNED_PY_DEPENDENCY", "Unpinned Dependency", "dependency", "low", 68.0, ["dependency", "supply-chain"]),
    ("OUTDATED_RISKY_DEPENDENCY", "Potential Risky Dependency Version", "dependency", "medium", 84.0, ["dependency", "version-risk"]),
    ("JS_DEPENDENCY_RISK", "Potential Risky Dependency Version", "dependency", "medium", 80.0, ["dependency", "supply-chain"]),
    ("NO_AUTH_LAYER_DETECTED", "Missing Authentication Layer", "security", "high", 72.0, ["architecture", "auth"]),
    ("INSECURE_CORS_WILDCARD", "Insecure CORS Configuration", "security", "high", 90.0, ["cors", "security"]),
    ("DEBUG_MODE_ENABLED", "Debug Mode Enabled", "security", "medium", 84.0, ["debug", "hardening"]),
    ("MISSING_INPUT_VALIDATION_ARCH", "Missing Input Validation", "security", "medium", 65.0, ["validation", "architecture"]),
]
RULE_SEQ = {rule[0]: seq for seq, rule in enumerate(RULES)}

# All are matched without regard to case.
LINE_PATTERNS = {
    "HARDCODED_SECRET": r"\b(api[_-]?key|secret|token|password|passwd|private[_-]?key)\b\s*[:=]\s*['\"][^'\"]{6,}['\"]",
    "SQL_INJECTION_STRING_BUILD": r"(select|insert|update|delete).*(\+|%s|f['\"]).*(from|where)",
    "COMMAND_INJECTION": r"\b(os\.system|subprocess\.(run|popen|call))\s*\(",
    "EVAL_USAGE": r"\b(eval|exec|new Function)\s*\(",
    "INSECURE_HASH": r"\b(hashlib\.)?(md5|sha1)\s*\(",
    "INSECURE_HTTP": r"http://[a-z0-9]",
    "INSECURE_AUTH_LOGIC": r"(password\s*==|if\s+user\s*==\s*['\"].+['\"])",
    "UNSAFE_FILE_HANDLING": r"\bopen\s*\([^)]*['\"]w\+?['\"]\)|\bFileWriter\s*\(",
    "BROAD_EXCEPTION": r"except\s*:\s*$|except\s+Exception",
    "EMPTY_EXCEPTION_HANDLER": r"except[^\n]*:\s*(pass|return\s+None|continue)\b",
    "MISSING_INPUT_VALIDATION_HINT": r"(request\.(args|json|form)|input\()",
    "TODO_HACK_MARKER": r"\b(TODO|FIXME|HACK|XXX)\b",
}

# Lower-case texts a line must hold before its pattern can match: one of each group. They only save
# time; the pattern decides.
LINE_TRIGGERS = {
    "HARDCODED_SECRET": [["key", "secret", "token", "passw"], ["'", '"']],
    "SQL_INJECTION_STRING_BUILD": [["select", "insert", "update", "delete"], ["from", "where"]],
    "COMMAND_INJECTION": [["os.system", "subprocess."]],
    "EVAL_USAGE": [["eval", "exec", "new function"], ["("]],
    "INSECURE_HASH": [["md5", "sha1"], ["("]],
    "INSECURE_HTTP": [["http://"]],
    "INSECURE_AUTH_LOGIC": [["=="]],
    "UNSAFE_FILE_HANDLING": [["open", "filewriter"], ["("]],
    "BROAD_EXCEPTION": [["except"]],
    "EMPTY_EXCEPTION_HANDLER": [["except"], [":"]],
    "MISSING_INPUT_VALIDATION_HINT": [["request.", "input("]],
    "TODO_HACK_MARKER": [["todo", "fixme", "hack", "xxx"]],
}

RISK_WEIGHT = {"critical": 10, "high": 7, "medium": 4, "low": 1}
SECURITY_WEIGHT = {"critical": 12, "high": 8, "medium": 4, "low": 1}
DEPENDENCY_WEIGHT = {"critical": 14, "high": 10, "medium": 5, "low": 2}
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITIES = ["critical", "high", "medium", "low"]
CATEGORIES = ["security", "reliability", "quality", "maintainability", "dependency"]

# package -> (lowest safe version, severity)
DEPENDENCY_RISKS = {
    "lodash": ("4.17.21", "high"),
    "minimist": ("1.2.8", "high"),
    "axios": ("1.6.0", "medium"),
    "flask": ("2.0.0", "medium"),
    "django": ("3.2.0", "high"),
    "requests": ("2.31.0", "medium"),
    "pyyaml": ("6.0.0", "medium"),
}

DEFAULT_EXTENSIONS = [
    ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rb", ".php", ".cs", ".cpp", ".c",
    ".json", ".yaml", ".yml", ".toml", ".ini", ".env", ".sql",
]

# Limits a caller may ask for; none is applied unless it is passed on.
USUAL_SCAN_FILES = 2500
USUAL_READ_BYTES = 512 * 1024
USUAL_ARCHIVE_BYTES = 25 * 1024 * 1024

AUTH_TOKENS = ["verify_id_token", "jwt", "oauth", "authentication", "authorize", "firebase_admin.auth"]
CORS_WILDCARDS = ["allow_origins=['*']", 'allow_origins=["*"]']
DEBUG_PATTERN = r"\bdebug\s*=\s*true\b"
INPUT_PATTERN = r"(request\.(args|json|form)|input\()"
VALIDATION_PATTERN = r"(pydantic|validator|validate|schema|marshmallow|zod|joi|typedict|BaseModel)"
# what these two patterns of plain texts stand for
INPUT_SIGNS = ["request.args", "request.json", "request.form", "input("]
VALIDATION_SIGNS = VALIDATION_PATTERN.strip("()").split("|")
TEST_SIGNS, LOGGING_SIGNS = ["pytest", "unittest"], ["logging", "logger"]
README_NAMES = ["README.md", "readme.md", "Readme.md"]
LICENSE_NAMES = ["LICENSE", "LICENSE.md", "COPYING"]

SCORES = ["security_score", "trust_score", "reliability_score", "quality_score", "improvement_potential"]

# Keys of an enrichment answer, in prompt order.
ANSWER_KEYS = [
    "issue_type", "severity", "risk_explanation", "real_world_attack_scenario", "why_this_is_dangerous",
    "secure_fix_explanation", "refactored_code", "best_practice_reference", "performance_impact", "confidence_score",
]
GUIDANCE_KEYS = ANSWER_KEYS[2:]
# alias column -> column it repeats
ALIASES = {
    "why_dangerous": "why_this_is_dangerous",
    "best_practice": "best_practice_reference",
    "suggested_code": "secure_fix_explanation",
    "refactored_example": "refactored_code",
    "before_code": "code_snippet",
    "after_code": "refactored_code",
    "improvement_reasoning": "secure_fix_explanation",
}

# ---------------------------------------------------------------------------------------
# Wording of this package.
# ---------------------------------------------------------------------------------------

MESSAGES = {
    "HARDCODED_SECRET": "A credential is written into the source text.",
    "SQL_INJECTION_STRING_BUILD": "A query text is put together from parts at run time.",
    "COMMAND_INJECTION": "An operating system command is started here; check where its input comes from.",
    "EVAL_USAGE": "Text is executed as code.",
    "INSECURE_HASH": "This hash can be broken; use SHA-256 or better.",
    "INSECURE_HTTP": "An address without transport encryption is used.",
    "INSECURE_AUTH_LOGIC": "An identity is checked by plain comparison.",
    "UNSAFE_FILE_HANDLING": "A file is opened for writing; check its path.",
    "BROAD_EXCEPTION": "Every failure is caught here, also unexpected ones.",
    "EMPTY_EXCEPTION_HANDLER": "A failure is dropped without a trace.",
    "MISSING_INPUT_VALIDATION_HINT": "User input is read here; validate it first.",
    "TODO_HACK_MARKER": "A note about unfinished work is left in the source.",
    "NO_AUTH_LAYER_DETECTED": "No file of this project checks who is calling.",
    "INSECURE_CORS_WILDCARD": "Calls from every origin are allowed.",
    "DEBUG_MODE_ENABLED": "Debug mode is switched on.",
    "MISSING_INPUT_VALIDATION_ARCH": "This file reads input and shows no sign of validation.",
}

# rule_id -> texts in the order of GUIDANCE_KEYS; the last one is a fixed value
DEFAULT_GUIDANCE = [
    "The pattern found here often goes together with faults; whether it does in this place needs a look.",
    "No scenario is on file for this rule.",
    "How bad it is depends on what the surrounding code guards.",
    "Read the place, decide whether the pattern is wanted, and note the decision next to it.",
    "",
    "Project conventions",
    "Unknown until measured.",
    "78%",
]
GUIDANCE = {
    "HARDCODED_SECRET": [
        "Source text is copied, cached, indexed and backed up, and each copy keeps the value for good.",
        "Years later someone greps an old clone or a container layer and finds a value that still works.",
        "Nobody can tell who used the value, and changing it means a release.",
        "Revoke the value first. Then let the deployment hand it over as a file or a mounted secret, and add a commit hook that looks for such values.",
        "with open('/run/secrets/billing') as handle:\n    billing_token = handle.read().strip()",
        "CWE-798; twelve-factor configuration",
        "One small file read at start.",
        "95%",
    ],
    "SQL_INJECTION_STRING_BUILD": [
        "The database cannot tell which part of the text the programmer wrote and which part a visitor typed.",
        "A search box accepts a quote mark, and from there on the visitor writes the rest of the statement.",
        "The statement runs with the rights of the application, which are usually those of the owner of all tables.",
        "Keep the statement constant and hand values over apart from it, or build it with a query builder that does so.",
        "query = select(orders).where(orders.c.customer == bindparam('customer'))\nrows = connection.execute(query, {'customer': customer})",
        "CWE-89",
        "A constant statement is parsed and planned once.",
        "91%",
    ],
    "COMMAND_INJECTION": [
        "A shell gives meaning to spaces, quotes, semicolons and dollar signs that the author of the line did not plan for.",
        "An upload is named so that its name holds a second command, and a nightly job passes the name on.",
        "The added command runs as the service account, with its files, network and keys.",
        "Ask whether a library does the same without another program. If not, choose the program from a fixed table and check each argument against a narrow pattern.",
        "archive = tarfile.open(name)\narchive.extractall(target, filter='data')",
        "CWE-78; CWE-88",
        "A library call saves a process for each use.",
        "92%",
    ],
    "MISSING_EXCEPTION_HANDLING": [
        "Files vanish, peers hang up and documents are cut short; this function treats none of it as possible.",
        "A disk fills up during the night, the first write raises, and the rest of the batch is never looked at.",
        "The trouble surfaces far from its cause, in a caller that cannot know what was half done.",
        "Decide what each failure means to the caller, and turn it into a result of its own, a retry with a limit, or an error that names the input.",
        "def load(path):\n    try:\n        return Loaded(path.read_text())\n    except FileNotFoundError:\n        return Missing(path)",
        "CWE-755",
        "A try block costs nothing until something is raised.",
        "86%",
    ],
    "DUPLICATION_BLOCK": [
        "A reader has to compare the copies to learn whether their differences are meant.",
        "A limit is raised in the copy that a test covers; the other one goes on refusing.",
        "Each further change costs as many edits as there are copies, and reviews grow with them.",
        "Write a test that runs through all copies, then replace them one by one by a call, with what differs as arguments.",
        "total = priced(basket, rate=STANDARD)\nrefund = priced(returned, rate=STANDARD)",
        "CWE-1041",
        "A call in place of a copy is not measurable.",
        "85%",
    ],
}
DEAD_CODE_GUIDANCE = [
    "A function without callers is kept in step with its surroundings by nobody.",
    "Someone finds it by its name, takes it for current and builds on it.",
    "It shows up in searches, in type checks and in every rename.",
    "Search the repository and its configuration for the name, since frameworks may call it by reflection; if nothing turns up, delete it. Version control keeps it.",
    "git log -S function_name --oneline",
    "CWE-561",
    "Less to load, to lint and to read.",
    "72%",
]

RECOMMENDATIONS = {
    "secret": "Rotate every value found in the sources, and have the deployment supply it.",
    "injection": "Separate code from data wherever a statement or a command is put together.",
    "exceptions": "Name the failures that outside resources can cause, and give each a defined outcome.",
    "duplication": "Pick the largest repeated block, cover it with a test and reduce it to one place.",
    "quality": "Begin with the functions that several structure rules name at once.",
    "security": "Go through who may call what from where, and what is checked on the way in.",
    "tests": "Start a test run in the build, first for the files with most findings.",
    "maturity": "Tell newcomers what the project is, how it is laid out and on which terms it may be used.",
    "none": "The rules have nothing to say about this project today.",
}

RULE_SCHEMA = (
    "rule_seq int, rule_id string, issue_type string, category string, severity string, "
    "confidence double, tags array<string>, message string"
)


def rule_rows(extra_rules=()) -> list[tuple]:
    rows = [(seq, *rule, MESSAGES.get(rule[0], "")) for seq, rule in enumerate(RULES)]
    return rows + [(len(RULES) + i, *rule[:6], rule[7]) for i, rule in enumerate(extra_rules)]


def rules(spark: SparkSession, extra_rules=()) -> DataFrame:
    """The rule catalogue; its size is the length of the lists above, so it may be broadcast."""
    return spark.createDataFrame(rule_rows(extra_rules), RULE_SCHEMA)


def dependency_risks(spark: SparkSession) -> DataFrame:
    rows = [(name, safe, severity) for name, (safe, severity) in DEPENDENCY_RISKS.items()]
    return spark.createDataFrame(rows, "package string, safe_version string, risk_severity string")


def guidance(spark: SparkSession) -> DataFrame:
    rows = [(rule_id, *texts) for rule_id, texts in GUIDANCE.items()]
    columns = ", ".join(f"g_{key} string" for key in GUIDANCE_KEYS)
    return spark.createDataFrame(rows, f"rule_id string, {columns}")
