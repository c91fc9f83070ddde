"""Rules for weak cryptography and dangerous calls."""

from .spec import RuleSpec

GUIDE = "guides/00-before-you-deploy.md"
JS = (".js", ".ts", ".jsx", ".tsx")
PY = (".py",)

# Ids, names, severities, taxonomy ids, extensions, patterns and vetoes.
RULES = [
    RuleSpec(
        "CRY001", "TLS verification disabled (Python)", "CRITICAL",
        "Certificates are not checked, so the connection can be intercepted.",
        "Drop the flag or point it at a CA bundle.",
        GUIDE, "A02:2021", None, "CWE-295", "high", extensions=PY,
        patterns=(r"verify\s*=\s*False",), needs="=", guards=("verify",),
    ),
    RuleSpec(
        "CRY002", "TLS verification disabled (Node.js)", "CRITICAL",
        "Certificates are not checked, so the connection can be intercepted.",
        "Keep rejection on and pass a custom CA where one is needed.",
        GUIDE, "A02:2021", None, "CWE-295", "high", extensions=JS,
        patterns=(r"rejectUnauthorized\s*:\s*false", r"NODE_TLS_REJECT_UNAUTHORIZED.*0"),
        needs=":_", guards=("rejectUnauthorized", "NODE_TLS_REJECT_UNAUTHORIZED"),
    ),
    RuleSpec(
        "CRY003", "MD5 hashing used", "HIGH",
        "MD5 is broken and unfit for any security purpose.",
        "Use a password hash for passwords and SHA-256 for integrity.",
        GUIDE, "A02:2021", None, "CWE-328", "high", extensions=PY,
        patterns=(r"hashlib\.md5\(",), needs="(", guards=("hashlib.md5(",),
    ),
    RuleSpec(
        "CRY004", "SHA1 hashing used", "HIGH",
        "SHA-1 is weak and unfit for any security purpose.",
        "Use a password hash for passwords and SHA-256 for integrity.",
        GUIDE, "A02:2021", None, "CWE-328", "high", extensions=PY,
        patterns=(r"hashlib\.sha1\(",), needs="(", guards=("hashlib.sha1(",),
    ),
    RuleSpec(
        "CRY005", "Math.random() used", "HIGH",
        "This generator is predictable and must not make tokens or ids.",
        "Use the platform's cryptographic generator.",
        GUIDE, "A02:2021", None, "CWE-330", "medium", extensions=JS,
        patterns=(r"Math\.random\(\)",), needs="(", guards=("Math.random()",),
    ),
    RuleSpec(
        "CRY006", "Insecure random (Python)", "MEDIUM",
        "The random module is predictable and must not make tokens or passwords.",
        "Use the secrets module.",
        GUIDE, "A02:2021", None, "CWE-330", "medium", extensions=PY,
        patterns=(r"random\.(choice|choices|randint|random|sample|shuffle)\(",), needs="(", guards=("random.",),
        honours_marker=False, vetoes=("secrets.", "SystemRandom"),
    ),
    RuleSpec(
        "CRY007", "eval() usage", "CRITICAL",
        "eval runs whatever text it is given.",
        "Parse data with a data parser instead.",
        GUIDE, "A03:2021", None, "CWE-95", "medium",
        patterns=(r"\beval\s*\(",), needs="(", guards=("eval",),
    ),
    RuleSpec(
        "CRY008", "exec() usage", "HIGH",
        "exec runs whatever code it is given.",
        "Dispatch through a table of functions or read a settings file.",
        GUIDE, "A03:2021", None, "CWE-95", "medium", extensions=PY,
        patterns=(r"\bexec\s*\(",), needs="(", guards=("exec",),
    ),
    RuleSpec(
        "CRY009", "Pickle deserialization", "HIGH",
        "Loading a pickle can run code that its author chose.",
        "Exchange data in a plain format, and sign pickles you must keep.",
        GUIDE, "A03:2021", None, "CWE-502", "medium", extensions=PY,
        patterns=(r"pickle\.(loads|load)\(",), needs="(", guards=("pickle.",),
    ),
]
