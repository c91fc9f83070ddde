"""Rules for ignore files and committed environment files."""

from .spec import RuleSpec

GUIDE = "guides/08-git-hygiene.md"

# The entries that count as an ignore of each thing.
ACCEPTED_ENTRIES = {
    "GIT002": (".env", ".env*", ".env.*", ".env.local", ".env.production"),
    "GIT003": ("node_modules", "node_modules/", "node_modules/*"),
    "GIT004": ("__pycache__", "__pycache__/", "__pycache__/*"),
    "GIT005": (".DS_Store", ".DS_Store?"),
}


def _missing(rule_id: str, name: str, severity: str, why: str, fix: str) -> RuleSpec:
    return RuleSpec(
        rule_id, name, severity, why, fix, GUIDE, "A05:2021", None, "CWE-538", "high",
        kind="missing_entry", extensions=(".gitignore",), honours_marker=False, redactor="head",
    )


# Ids, names, severities, taxonomy ids and extensions.
RULES = [
    _missing("GIT002", "Missing .env in .gitignore", "CRITICAL",
             "Environment files are not ignored and will be committed.", "Add .env and .env.* to the file."),
    _missing("GIT003", "Missing node_modules in .gitignore", "HIGH",
             "Installed Node packages are not ignored.", "Add node_modules/ to the file."),
    _missing("GIT004", "Missing __pycache__ in .gitignore", "MEDIUM",
             "Python bytecode folders are not ignored.", "Add __pycache__/ to the file."),
    _missing("GIT005", "Missing .DS_Store in .gitignore", "LOW",
             "macOS folder files are not ignored.", "Add .DS_Store to the file."),
    RuleSpec(
        "GIT006", "Environment file in project", "CRITICAL",
        "An environment file with settings is part of the project.",
        "Ignore the file, remove it from version control and rotate what it held.",
        GUIDE, "A05:2021", None, "CWE-312", "high",
        kind="env_file", extensions=(".env",), guards=("=",), honours_marker=False, redactor="constant",
    ),
]
