"""Rule tables: the built-in rules, and the form a user's own rules take.

A rule names a rule set, its place in that set's list, a literal to look for,
and what to report.  Rules are configuration, so they are read on the driver;
``load_rules`` refuses a table above ``MAX_RULES`` rows, which is what lets the
scan broadcast it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame

SEVERITIES = ("High", "Medium", "Low")

# The scan orders a line's rules by rule_ord and puts the heuristics after them.
MAX_RULE_ORD = 1000


class Rule(NamedTuple):
    rule_set: str
    rule_ord: int
    pattern: str
    severity: str
    description: str
    score: float


# --- Fixed values -----------------------------------------------------------
# Languages, rules and heuristics below are facts of the detection semantics;
# findings are only right if these texts and numbers stay as they are.

EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".h": "cpp",
    ".go": "go",
    ".php": "php",
    ".cs": "csharp",
    ".rs": "rust",
}
UNKNOWN_LANGUAGE = "unknown"

LANGUAGE_RULE_SET = {
    "python": "python",
    "javascript": "javascript",
    "typescript": "javascript",
    "java": "java",
    "c": "c",
    "cpp": "c",
}
FALLBACK_RULE_SET = "python"
RULE_SETS = ("python", "javascript", "java", "c")

BUILTIN_RULES = (
    Rule("python", 1, "eval(", "High", "Code injection vulnerability: eval() executes arbitrary code", 0.95),
    Rule("python", 2, "exec(", "High", "Code injection vulnerability: exec() executes arbitrary code", 0.92),
    Rule("python", 3, "shell=True", "High", "Command injection vulnerability: subprocess with shell=True", 0.88),
    Rule("python", 4, "pickle.load", "High", "Unsafe deserialization: pickle can execute arbitrary code", 0.90),
    Rule("python", 5, "yaml.load(", "High", "Unsafe deserialization: yaml.load() without safe loader", 0.85),
    Rule("python", 6, ".md5(", "Medium", "Cryptographic weakness: MD5 is broken hash function", 0.75),
    Rule("python", 7, ".sha1(", "Medium", "Cryptographic weakness: SHA1 is vulnerable hash function", 0.75),
    Rule("python", 8, "random.random()", "Medium", "Weak randomness: not cryptographically secure", 0.65),
    Rule("python", 9, "request.args.get", "Medium", "Potential XSS: unsanitized user input", 0.60),
    Rule("python", 10, "os.system(", "High", "Command injection: os.system() executes shell commands", 0.93),
    Rule("javascript", 1, "eval(", "High", "Code injection vulnerability: eval() executes arbitrary JavaScript code", 0.95),
    Rule("javascript", 2, "Function(", "High", "Code injection vulnerability: Function() constructor executes arbitrary code", 0.90),
    Rule("javascript", 3, "innerHTML", "High", "XSS vulnerability: innerHTML can execute malicious scripts", 0.85),
    Rule("javascript", 4, "dangerouslySetInnerHTML", "High", "XSS vulnerability: dangerouslySetInnerHTML bypasses React's XSS protection", 0.90),
    Rule("javascript", 5, "document.write(", "High", "XSS vulnerability: document.write() can inject malicious content", 0.80),
    Rule("javascript", 6, "setTimeout(", "Medium", "Code injection risk: setTimeout with string parameter executes code", 0.70),
    Rule("javascript", 7, "setInterval(", "Medium", "Code injection risk: setInterval with string parameter executes code", 0.70),
    Rule("javascript", 8, "localStorage.setItem", "Low", "Data exposure risk: sensitive data stored in localStorage", 0.50),
    Rule("javascript", 9, "Math.random()", "Medium", "Weak randomness: Math.random() is not cryptographically secure", 0.65),
    Rule("javascript", 10, "exec(", "High", "Command injection vulnerability: child_process.exec() executes shell commands", 0.92),
    Rule("java", 1, "Runtime.getRuntime().exec(", "High", "Command injection vulnerability: Runtime.exec() executes system commands", 0.95),
    Rule("java", 2, "ProcessBuilder(", "High", "Command injection risk: ProcessBuilder can execute system commands", 0.85),
    Rule("java", 3, "ObjectInputStream", "High", "Unsafe deserialization: ObjectInputStream can execute arbitrary code", 0.90),
    Rule("java", 4, "Math.random()", "Medium", "Weak randomness: Math.random() is not cryptographically secure", 0.65),
    Rule("java", 5, 'MessageDigest.getInstance("MD5")', "Medium", "Cryptographic weakness: MD5 is a broken hash function", 0.75),
    Rule("java", 6, 'MessageDigest.getInstance("SHA1")', "Medium", "Cryptographic weakness: SHA1 is vulnerable hash function", 0.75),
    Rule("java", 7, "Class.forName(", "Medium", "Reflection risk: Class.forName() can load arbitrary classes", 0.70),
    Rule("java", 8, "executeQuery(", "High", "SQL injection risk: dynamic query construction detected", 0.80),
    Rule("c", 1, "strcpy(", "High", "Buffer overflow vulnerability: strcpy() doesn't check buffer bounds", 0.95),
    Rule("c", 2, "strcat(", "High", "Buffer overflow vulnerability: strcat() doesn't check buffer bounds", 0.90),
    Rule("c", 3, "sprintf(", "High", "Buffer overflow vulnerability: sprintf() doesn't check buffer bounds", 0.88),
    Rule("c", 4, "gets(", "High", "Buffer overflow vulnerability: gets() has no bounds checking", 0.98),
    Rule("c", 5, "scanf(", "High", "Buffer overflow vulnerability: scanf() can overflow buffers", 0.85),
    Rule("c", 6, "printf(", "Medium", "Format string vulnerability: printf() with user-controlled format string", 0.75),
    Rule("c", 7, "system(", "High", "Command injection vulnerability: system() executes shell commands", 0.93),
    Rule("c", 8, "malloc(", "Medium", "Memory management risk: malloc() without proper free() can cause leaks", 0.60),
    Rule("c", 9, "free(", "Medium", "Memory management risk: free() without proper null check can cause crashes", 0.65),
    Rule("c", 10, "memcpy(", "High", "Buffer overflow vulnerability: memcpy() doesn't validate buffer sizes", 0.80),
    Rule("c", 11, "rand(", "Medium", "Weak randomness: rand() is not cryptographically secure", 0.65),
)

# rule_ord, issue, severity
HEURISTIC_SQL = (1001, "SQL injection vulnerability: dynamic query construction detected (AI Analysis)", "High")
HEURISTIC_XSS = (1002, "XSS vulnerability: user input rendered without escaping (AI Analysis)", "Medium")
HEURISTIC_PATH = (1003, "Path traversal vulnerability: user-controlled file access (AI Analysis)", "High")
HEURISTIC_SECRET = (1004, "Hardcoded secret detected: potential credential leak (AI Analysis)", "High")

# The longer keywords api_key, access_key, secret_key and private_key all hold
# "key", so testing for them too cannot change an answer.
SECRET_KEYWORDS = ("password", "passwd", "pwd", "secret", "key", "token", "auth", "credential")
SECRET_OPERATORS = ("=", ":", "->")
SECRET_VALUE_EXCLUSIONS = ("input(", "os.environ")
SECRET_VALUE_MIN_BYTES = 8
SECRET_FORMATS = ("sk-", "pk-", "AIza", "AKIA", "ghp_", "gho_")
# --- End of fixed values ----------------------------------------------------

MAX_RULES = MAX_RULE_ORD * len(RULE_SETS)


def load_rules(rules: DataFrame | Iterable[Rule] | None = None) -> tuple[Rule, ...]:
    """The rule table to scan with: the built-in one, or a checked user table.

    A user table has the columns of ``Rule``.  ``(rule_set, rule_ord)`` must be
    unique and ``rule_ord`` between 1 and ``MAX_RULE_ORD``, so no valid table
    exceeds ``MAX_RULES`` rows.
    """
    if rules is None:
        return BUILTIN_RULES
    if isinstance(rules, DataFrame):
        rows = rules.select(*Rule._fields).limit(MAX_RULES + 1).collect()
        loaded = tuple(Rule(*row) for row in rows)
    else:
        loaded = tuple(Rule(*row) for row in rules)
    if len(loaded) > MAX_RULES:
        raise ValueError(f"a rule table holds at most {MAX_RULES} rules")
    for rule in loaded:
        if None in rule:
            raise ValueError(f"rule with a null field: {rule}")
        if rule.rule_set not in RULE_SETS:
            raise ValueError(f"rule_set must be one of {RULE_SETS}: {rule}")
        if not 1 <= rule.rule_ord <= MAX_RULE_ORD:
            raise ValueError(f"rule_ord must be 1..{MAX_RULE_ORD}: {rule}")
        if rule.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}: {rule}")
    places = Counter((rule.rule_set, rule.rule_ord) for rule in loaded)
    repeated = [place for place, n in places.items() if n > 1]
    if repeated:
        raise ValueError(f"(rule_set, rule_ord) must be unique; repeated: {repeated}")
    return tuple(sorted(loaded, key=lambda r: (r.rule_set, r.rule_ord)))
