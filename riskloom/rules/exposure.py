"""Rules for data that leaks through logs and replies."""

from .spec import RuleSpec

GUIDE = "guides/00-before-you-deploy.md"
JS = (".js", ".ts", ".jsx", ".tsx")

# Ids, names, severities, taxonomy ids, extensions and patterns.
RULES = [
    RuleSpec(
        "DAT001", "Credentials in logs", "HIGH",
        "A log or print call names a credential.",
        "Log that an event took place, never the secret itself.",
        GUIDE, "A04:2021", None, "CWE-532", "medium",
        patterns=(
            r"(log|logging|logger|print|console\.log)\s*\(.*"
            r"\b(password|passwd|secret|token|api_key|apikey|"
            r"auth_token|private_key|access_key|secret_key)\b",
        ),
        also=("log", "print"),
        needs="(", guards=("password", "passwd", "secret", "token", "api_key", "apikey", "private_key", "access_key"),
        ignore_case=True, honours_marker=False,
    ),
    RuleSpec(
        "DAT002", "Stack trace in response", "MEDIUM",
        "A formatted stack trace may reach the client.",
        "Log traces on the server and answer with a short message.",
        GUIDE, "A04:2021", None, "CWE-209", "medium", extensions=(".py",),
        patterns=(r"traceback\.(format_exc|print_exc|format_exception)\(",), needs="(", guards=("traceback.",),
    ),
    RuleSpec(
        "DAT003", "Verbose error in response", "MEDIUM",
        "A reply carries trace details.",
        "Answer with a short message and log the details.",
        GUIDE, "A04:2021", None, "CWE-209", "medium",
        patterns=(r"(jsonify|json\.dumps|return).*traceback", r'"traceback"\s*:'), guards=("traceback",),
    ),
    RuleSpec(
        "DAT004", "Secrets in console.log", "HIGH",
        "A console message names a credential and anyone can open the console.",
        "Remove the message or log through a masking logger.",
        GUIDE, "A04:2021", None, "CWE-532", "medium", extensions=JS,
        patterns=(r"console\.log\(.*\b(password|token|secret|api_key|apikey|key|credential)\b",),
        also=("password", "token", "secret", "api_key", "apikey", "key", "credential"),
        needs="(", guards=("console.log(",),
    ),
]
