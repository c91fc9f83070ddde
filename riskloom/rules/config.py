"""Rules for unsafe settings."""

from .spec import RuleSpec

GUIDE = "guides/00-before-you-deploy.md"
JS = (".js", ".ts", ".jsx", ".tsx")

# Ids, names, severities, taxonomy ids, extensions and patterns.
RULES = [
    RuleSpec(
        "CFG001", "Debug mode enabled", "HIGH",
        "Debug mode is on and shows internals to every visitor.",
        "Drive the debug flag from the environment and default it to off.",
        GUIDE, "A05:2021", None, "CWE-489", "high", extensions=(".py",),
        patterns=(r"DEBUG\s*=\s*True",), needs="=", guards=("DEBUG",),
    ),
    RuleSpec(
        "CFG002", "Node development mode", "MEDIUM",
        "The Node environment is fixed to development.",
        "Set the environment at deployment, not in the source.",
        GUIDE, "A05:2021", None, "CWE-489", "medium", extensions=JS,
        patterns=(r"NODE_ENV.*development", r"""['"]development['"]"""), needs="_\"'", guards=("development",),
    ),
    RuleSpec(
        "CFG003", "CORS wildcard origin", "HIGH",
        "Any origin may call this service from a browser.",
        "List the origins that are allowed.",
        GUIDE, "A05:2021", None, "CWE-942", "high",
        patterns=(r"Access-Control-Allow-Origin.*\*", r"""origin:\s*['"]?\*""", r"cors\(\s*\)"),
        needs="*:(", guards=("Access-Control-Allow-Origin", "origin:", "cors("),
    ),
    RuleSpec(
        "CFG004", "Verbose error configuration", "MEDIUM",
        "Errors are passed on to the client with their details.",
        "Turn error propagation off in production.",
        GUIDE, "A05:2021", None, "CWE-209", "medium",
        patterns=(
            r"PROPAGATE_EXCEPTIONS\s*=\s*True",
            r"TRAP_HTTP_EXCEPTIONS\s*=\s*True",
            r"app\.config\[.DEBUG.\]\s*=\s*True",
        ),
        needs="=", guards=("PROPAGATE_EXCEPTIONS", "TRAP_HTTP_EXCEPTIONS", "app.config["),
    ),
    RuleSpec(
        "CFG005", "ALLOWED_HOSTS wildcard", "HIGH",
        "Every host name is accepted, so the host header is not checked.",
        "List the host names this service answers to.",
        GUIDE, "A05:2021", None, "CWE-644", "high", extensions=(".py",),
        patterns=(r"ALLOWED_HOSTS\s*=\s*\[.*\*.*\]",), needs="=", guards=("ALLOWED_HOSTS",),
    ),
]
