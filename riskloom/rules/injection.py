"""Rules for injection."""

from .spec import RuleSpec

GUIDE = "guides/04-input-validation.md"

# Ids, names, severities, taxonomy ids, extensions and patterns.
RULES = [
    RuleSpec(
        "INJ001", "SQL injection via string formatting", "CRITICAL",
        "A query is put together from strings, so input can change it.",
        "Bind values as parameters.",
        GUIDE, "A03:2021", None, "CWE-89", "medium", extensions=(".py", ".js", ".ts", ".rb", ".php"),
        patterns=(
            r'(?:execute|cursor\.execute|query)\s*\(\s*f["\']',
            r'(?:SELECT|INSERT|UPDATE|DELETE|DROP)\s+.*\%s.*\%\s*\(',
            r'(?:SELECT|INSERT|UPDATE|DELETE|DROP)\s+.*\.format\s*\(',
            r'(?:SELECT|INSERT|UPDATE|DELETE|DROP)\s+.*\+\s*(?:request|req|params|input)',
            r'\.raw\s*\(\s*["\'].*\+',
            r'\.raw\s*\(\s*f["\']',
            r'execute\s*\(\s*["\'].*["\']?\s*\+',
            r'=\s*f["\'](?:SELECT|INSERT|UPDATE|DELETE|DROP)\s+',
        ),
        needs="(+=", guards=("execute", "query", "SELECT", "INSERT", "UPDATE", "DELETE", "DROP", ".raw"),
    ),
    RuleSpec(
        "INJ002", "NoSQL injection", "HIGH",
        "Request data reaches a document query and may carry operators.",
        "Cast values to the expected types and refuse keys that start with a dollar sign.",
        GUIDE, "A03:2021", None, "CWE-943", "medium", extensions=(".py", ".js", ".ts"),
        patterns=(
            r'\$(?:where|regex|gt|lt|ne|in|nin|or|and|not)\b.*(?:request|req|params|body|input)',
            r'(?:find|findOne|aggregate|updateOne|deleteOne)\s*\(.*(?:request|req|params|body)\b',
        ),
        also=("req", "params", "body", "input"),
        needs="$(", guards=("$", "find", "aggregate", "updateOne", "deleteOne"),
    ),
    RuleSpec(
        "INJ003", "Command injection", "CRITICAL",
        "A command goes through a shell.",
        "Pass an argument list and no shell.",
        GUIDE, "A03:2021", None, "CWE-78", "medium",
        patterns=(
            r'os\.system\s*\(',
            r'subprocess\.(?:call|run|Popen)\s*\(.*shell\s*=\s*True',
            r'child_process\.exec\s*\(',
            r'child_process\.execSync\s*\(',
        ),
        needs="(", guards=("os.system", "subprocess.", "child_process.exec"),
    ),
    RuleSpec(
        "INJ004", "Path traversal", "HIGH",
        "A path is taken from the request, so it may leave its folder.",
        "Resolve the path and check that it stays in the folder.",
        GUIDE, "A01:2021", None, "CWE-22", "medium",
        patterns=(
            r'open\s*\(.*(?:request|req|params|input|args)\b',
            r'os\.path\.join\s*\(.*(?:request|req|params|input)\b',
            r'send_file\s*\(.*(?:request|req|params|input)\b',
            r'res\.sendFile\s*\(.*(?:req\.|params)',
        ),
        also=("req", "params", "input", "args"),
        needs="(", guards=("open", "os.path.join", "send_file", "res.sendFile"),
    ),
    RuleSpec(
        "INJ005", "Cross-site scripting (XSS)", "HIGH",
        "Text is inserted into the page as HTML.",
        "Insert text as text, and sanitise where HTML is needed.",
        GUIDE, "A03:2021", None, "CWE-79", "low", extensions=(".js", ".jsx", ".ts", ".tsx", ".vue", ".html"),
        patterns=(
            r'\.innerHTML\s*=',
            r'dangerouslySetInnerHTML',
            r'v-html\s*=',
            r'document\.write\s*\(',
            r'\[innerHTML\]\s*=',
        ),
        guards=(".innerHTML", "dangerouslySetInnerHTML", "v-html", "document.write", "[innerHTML]"),
    ),
    RuleSpec(
        "INJ006", "Template injection", "HIGH",
        "Request data is used as a template and may run directives.",
        "Keep templates in files and pass data as context.",
        GUIDE, "A03:2021", None, "CWE-94", "medium", extensions=(".py", ".js", ".ts", ".rb"),
        patterns=(
            r'render_template_string\s*\(.*(?:request|input|params)',
            r'Template\s*\(.*(?:request|input|params)',
            r'Jinja2.*from_string',
            r'eval\s*\(.*(?:request|req|params|body|input)\b',
        ),
        needs="(_", guards=("render_template_string", "Template", "Jinja2", "eval"),
    ),
    RuleSpec(
        "INJ007", "Unsafe YAML loading", "HIGH",
        "The full YAML loader can build any object the text asks for.",
        "Use the safe loader.",
        GUIDE, "A08:2021", None, "CWE-502", "medium", extensions=(".py",),
        patterns=(r'yaml\.unsafe_load\s*\(', r'yaml\.load\s*\('), needs="(", guards=("yaml.",),
    ),
]
