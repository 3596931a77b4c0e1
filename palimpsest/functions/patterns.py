"""Rule tables of the library: patterns, word lists and constants, in the order in which they apply."""

# Classifier patterns by category, in class order.
STALE = [
    r"\b(?:we used to|previously|originally|at first) (?:use|had|went with)\b.{0,200}",
    r"\b(?:no longer|not anymore|deprecated|obsolete|outdated)\b[:：]?.{0,200}",
    r"\b(?:migrated|switched) (?:from|away from)\b.{0,200}",
]
DECISION = [
    r"\bwe (?:decided|decide|chose|choose|agreed|agree) (?:to |on |that )?(.{8,300})",
    r"\bdecision[:：]\s*(.{8,300})",
    r"\bwe'?ll (?:use|go with|pick) (.{8,300})",
    r"\b(?:i|we) (?:rejected|ruled out|won'?t use|decided against) (.{8,300})",
    r"\blet'?s (?:use|go with|stick with) (.{8,300})",
]
RESOLVED = [
    r"\b(?:fixed|resolved|solved|closed)\b[:：]?\s*(.{8,200})",
    r"\b(?:the )?(?:fix|solution) (?:was|is)[:：]?\s*(.{8,200})",
    r"\bthat (?:fixed|solved|resolved) (?:the |it|this)?(.{8,150})",
]
OPEN_ISSUE = [
    r"\b(?:the )?\w[\w\s]{2,40} (?:is|keeps|are) (?:broken|failing|crashing|not working|still broken|still open|still failing)\b.{0,150}",
    r"\bthere'?s (?:an? )?(?:bug|issue|problem|error)\b.{0,200}",
    r"\bthere is (?:an? )?(?:bug|issue|problem|error|open question)\b.{0,200}",
    r"\b(?:open issue|open question)\b[:：]?.{0,200}",
    r"\b(?:still|currently) (?:broken|failing|not working|crashing|open)\b.{0,200}",
    r"\bis still open\b.{0,200}",
    r"\b(?:todo|fixme|need to fix|needs fixing|haven'?t fixed|haven'?t decided)\b[:：]?.{0,200}",
]
CURRENT_TASK = [
    r"\b(?:currently|right now|now) (?:working on|implementing|building|fixing)\b(.{0,250})",
    r"\b(?:the goal|the task|the current task|objective) (?:is|here is)[:：]?\s*(.{8,250})",
    r"\b(?:i need to|we need to|next step is to)\b(.{10,250})",
]
PERMANENT = [
    r"\b(?:architecture|stack|tech stack)[:：]\s*(.{10,300})",
    r"\b(?:we|the project) (?:use|uses|runs on|is built (?:on|with))\b(.{10,300})",
    r"\b(?:constraint|requirement)[:：]\s*(.{10,300})",
    r"\b(?:database|backend|frontend|framework|language)[:：]?\s+(?:is|are)\s+(.{5,200})",
    r"\b(?:database|backend|frontend|framework|language)[:：]\s*(.{5,200})",
    r"\bthe (?:\w+ )?(?:architecture|service architecture)[:：]?\s*(.{10,300})",
    r"\b(?:the project is|this project is|we'?re building|the project is a)\b(.{5,300})",
    r"\bthe constraint is\b[:：]?\s*(.{8,300})",
]
# Category, patterns, confidence, importance, status, memory type.
CATEGORIES = [
    ("stale_info", STALE, 0.7, 0.65, "stale", "stale"),
    ("decision", DECISION, 0.75, 0.9, "active", "permanent"),
    ("resolved_issue", RESOLVED, 0.7, 0.5, "resolved", "resolved"),
    ("open_issue", OPEN_ISSUE, 0.65, 0.8, "active", "task"),
    ("current_task", CURRENT_TASK, 0.7, 0.85, "active", "task"),
    ("permanent_knowledge", PERMANENT, 0.7, 0.85, "active", "permanent"),
]
REJECTED = r"\b(?:rejected|ruled out|decided against|won'?t use)\b"
CHATTER = [
    r"^(?:hi|hello|hey|thanks|thank you|ok|okay|great|perfect|sounds good|got it|cool|nice|awesome|yes|no|sure|bye|good morning|good evening)[\s!.]*$",
    r"^i'?ll (?:do that|look into it|check)[\s!.]*$",
    r"^(?:let me know if|hope this helps|does that make sense)[\s!.?]*",
]
HINTS = (
    r"\b(?:architecture|database|schema|migration|deploy|production|auth|security|password|secret|token|api key|endpoint|model|"
    r"constraint|requirement|decided|decision|bug|error|crash|fail|broken|performance|deadline|must|never|always)\b"
)
# What the patterns of a category need: without one of these (in lower case) none of them matches. Looking for them is cheap.
STEMS = {
    "stale_info": ["used to", "previously", "originally", "at first", "no longer", "not anymore", "deprecated", "obsolete", "outdated", "migrated", "switched"],
    "decision": ["we decide", "we chose", "we choose", "we agree", "decision", "we'll ", "well ", "rejected", "ruled out", "won't use", "wont use", "decided against", "let's ", "lets "],
    "resolved_issue": ["fixed", "resolved", "solved", "closed", "fix was", "fix is", "solution was", "solution is"],
    "open_issue": ["broken", "failing", "crashing", "not working", " open", "there's ", "theres ", "there is ", "open issue", "open question", "todo", "fixme", "need to fix", "needs fixing", "haven't ", "havent "],
    "current_task": ["working on", "implementing", "building", "fixing", "the goal", "the task", "the current task", "objective", "i need to", "we need to", "next step is to"],
    "permanent_knowledge": ["architecture", "stack", " use", "runs on", "is built", "constraint", "requirement", "database", "backend", "frontend", "framework", "language", "project is", "we're building", "were building"],
    "rejected": ["rejected", "ruled out", "decided against", "won't use", "wont use"],
}
# Roles as written, and what they stand for.
ROLES = {
    "user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "chatgpt": "assistant",
    "claude": "assistant", "gpt": "assistant", "cursor": "assistant", "copilot": "assistant", "system": "system",
}
# Words that queries and contents are not matched by. Two lists of them share the first part.
COMMON_WORDS = """the a an and or but in on at to for of with by is are was were be been being have has had do does did
will would could should may might must can this that these those""".split()
STOP_WORDS = [*COMMON_WORDS, *"""it its i we you they he she me my our your what how why when where which who whom there
here so if then than too very just about fix bug issue error problem add implement build create make update change
remove delete get set""".split()]  # fmt: skip
# A query's word, and the categories that it raises (or, below 1, names).
INTENT_BOOSTS = {
    "fix": {"open_issue": 1.4, "decision": 1.2, "current_task": 1.2, "resolved_issue": 0.3, "stale_info": 0.4},
    "bug": {"open_issue": 1.4, "decision": 1.2, "current_task": 1.2, "resolved_issue": 0.3, "stale_info": 0.4},
    "error": {"open_issue": 1.4, "decision": 1.2, "current_task": 1.2, "stale_info": 0.4},
    "broken": {"open_issue": 1.4, "decision": 1.2, "current_task": 1.2, "stale_info": 0.4},
    "decided": {"decision": 1.5, "permanent_knowledge": 1.1},
    "decision": {"decision": 1.5, "permanent_knowledge": 1.1},
    "why": {"decision": 1.4, "permanent_knowledge": 1.2},
    "architecture": {"permanent_knowledge": 1.5, "decision": 1.2},
    "stack": {"permanent_knowledge": 1.5, "decision": 1.2},
    "currently": {"current_task": 1.5, "open_issue": 1.2},
    "working": {"current_task": 1.5, "open_issue": 1.2},
    "implement": {"current_task": 1.3, "permanent_knowledge": 1.2, "decision": 1.1},
    "add": {"current_task": 1.3, "permanent_knowledge": 1.2, "decision": 1.1},
    "old": {"stale_info": 1.5, "resolved_issue": 1.1},
    "previous": {"stale_info": 1.5, "resolved_issue": 1.1},
}
# Task types by the first list with a word in the task.
TASK_TYPES = [
    ("troubleshooting", ["fix", "bug", "error", "issue", "problem"]),
    ("development", ["build", "create", "implement", "add"]),
    ("learning", ["explain", "understand", "learn", "what"]),
    ("review", ["review", "check", "audit", "inspect"]),
]
HARD = ["complex", "difficult", "hard", "challenging"]
EASY = ["simple", "easy", "straightforward"]
NEEDED_KNOWLEDGE = [
    ("architecture", ["how", "architecture", "structure", "design"]),
    ("decision", ["decision", "chose", "selected", "approach"]),
    ("issue", ["bug", "issue", "problem", "error"]),
    ("preference", ["prefer", "like", "want", "need"]),
    ("project_identity", ["what is", "define", "meaning"]),
]
# A context's gaps: missing type, message, number of items from which it is no gap.
GAPS = [
    ("open_issue", "no open-issue knowledge found — if this is a bug task, ingest the conversation where it was reported", None),
    ("decision", "no prior decisions found — context may miss rationale", 4),
    ("permanent_knowledge", "no architecture/permanent knowledge found — consider indexing the project", 4),
]
# Knowledge types, their weight and patterns; words that add weight.
KNOWLEDGE = [
    ("project_identity", 0.8, [r"(?i)project\s*name\s*[:=]\s*([^\n]+)", r"(?i)this\s*project\s+is\s+([^\n]+)", r"(?i)we\s*are\s+building\s+([^\n]+)"]),
    ("architecture", 0.85, [r"(?i)architecture\s*[:=]\s*([^\n]+)", r"(?i)we\s*use\s+([^\n]+)\s+for\s+([^\n]+)", r"(?i)stack\s*[:=]\s*([^\n]+)"]),
    ("decision", 0.9, [r"(?i)we\s*decided\s+to\s+([^\n]+)", r"(?i)decision\s*[:=]\s*([^\n]+)", r"(?i)chosen\s+approach\s*[:=]\s*([^\n]+)"]),
    ("issue", 0.75, [r"(?i)problem\s*[:=]\s*([^\n]+)", r"(?i)issue\s*[:=]\s*([^\n]+)", r"(?i)bug\s*[:=]\s*([^\n]+)"]),
    ("preference", 0.6, [r"(?i)prefer\s+([^\n]+)", r"(?i)like\s+to\s+([^\n]+)", r"(?i)want\s+([^\n]+)"]),
]
WEIGHTY = ["critical", "important", "must", "required", "essential", "key", "core", "main", "primary"]
CONSTRAINTS = [r"(?i)must\s+([^\n]+)", r"(?i)should\s+([^\n]+)", r"(?i)cannot\s+([^\n]+)", r"(?i)limited\s+to\s+([^\n]+)", r"(?i)requirement\s*[:=]\s*([^\n]+)", r"(?i)constraint\s*[:=]\s*([^\n]+)"]
# What a source tree's index takes in and leaves out.
EXTENSIONS = """.ts .tsx .js .jsx .py .dart .java .json .yaml .yml .md .txt .xml .html .css .sql .toml .ini .cfg .env.example
.go .rs .rb .php .c .h .cpp .cs .vue .svelte .graphql .prisma .sh""".split()
SKIPPED_FOLDERS = """node_modules .git __pycache__ .venv venv env dist build .next .expo coverage .cache Pods .gradle .idea
.vscode target vendor DerivedData .dart_tool""".split()
CONFIG_NAMES = """package.json tsconfig.json pyproject.toml setup.py setup.cfg requirements.txt Cargo.toml go.mod pubspec.yaml
pom.xml build.gradle composer.json Gemfile .env.example docker-compose.yml Dockerfile Makefile webpack.config.js
vite.config.ts next.config.js schema.prisma app.json eas.json""".split()
CONFIG_SUFFIXES = [".json", ".yaml", ".yml", ".toml", ".ini", ".xml"]
MOST_BYTES, MOST_FILES = 1_000_000, 5000
# Symbol, import and export patterns; they stand at the start of a line. The blanks before one are those of
# its own line: names are the same as if blank lines before it counted, and long runs of these take no time.
# Imports have a pattern of their own for each group that holds the name, as Spark extracts one group.
_AT = r"^[^\S\n]*"
SYMBOLS = [
    ("function", rf"{_AT}(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    ("function", rf"{_AT}(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\("),
    ("function", rf"{_AT}(?:export\s+)?(?:async\s+)?def\s+([A-Za-z_][\w]*)"),
    ("function", rf"{_AT}(?:(?:public|private|protected|static)[^\S\n]*)*[\w<>\[\]]+\s+([a-z][\w]*)\s*\([^)]*\)\s*(?:\{{|throws)"),
    ("function", rf"{_AT}func\s+(?:\(\w+\s+[\w\[\]*]+\)\s+)?([A-Za-z_][\w]*)\s*\("),
    ("class", rf"{_AT}(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("interface", rf"{_AT}(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    ("interface", rf"{_AT}(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*="),
    ("struct", rf"{_AT}(?:pub\s+)?struct\s+([A-Za-z_][\w]*)"),
    ("enum", rf"{_AT}(?:export\s+)?enum\s+([A-Za-z_$][\w$]*)"),
]
IMPORTS = [
    rf"{_AT}import\s+(?:[\w*{{}}\s,]+\s+from\s+)?['\"]([^'\"]+)['\"]",
    rf"{_AT}from\s+([\w.]+)\s+import",
    rf"{_AT}import\s+([\w.]+)",
    rf"{_AT}#include\s+[<\"]([^>\"]+)[>\"]",
    rf"{_AT}use\s+([\w:]+)",
    rf"{_AT}require\s*\(\s*['\"]([^'\"]+)['\"]",
]
EXPORTED = rf"{_AT}export\s+(?:default\s+)?(?:class|function|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)"
EXPORT_LIST = rf"{_AT}export\s*\{{([^}}]+)\}}"
