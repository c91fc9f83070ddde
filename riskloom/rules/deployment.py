"""Rules for containers, routes, ports and headers."""

from .spec import RuleSpec

GUIDE = "guides/06-deployment-hardening.md"

# Ids, names, severities, taxonomy ids, extensions and patterns.
RULES = [
    RuleSpec(
        "DEP001", "Dockerfile running as root", "HIGH",
        "The image never switches user, so its processes run as root.",
        "Create a user in the image and switch to it before the start command.",
        GUIDE, "A05:2021", None, "CWE-250", "high", kind="missing_user", gate="dockerfile",
        patterns=(r"^USER\s+\S+",), honours_marker=False, redactor="constant",
    ),
    RuleSpec(
        "DEP002", "Exposed debug/admin routes", "HIGH",
        "An admin or debug route is registered in the open.",
        "Put such routes behind authentication or leave them out of production.",
        GUIDE, "A01:2021", None, "CWE-489", "medium",
        patterns=(
            r'(?:route|app\.get|app\.post|router\.get|router\.post|path)\s*\(\s*["\']\/(?:admin|debug|phpmyadmin|swagger|graphql|actuator)["\']',
            r"urlpatterns.*(?:admin|debug)/",
        ),
        needs="(/", guards=("/admin", "/debug", "/phpmyadmin", "/swagger", "/graphql", "/actuator", "urlpatterns"),
    ),
    RuleSpec(
        "DEP003", "Build secrets in Dockerfile", "CRITICAL",
        "A secret is set in an image layer and stays in its history.",
        "Use build secrets at build time and injected settings at run time.",
        GUIDE, "A07:2021", None, "CWE-200", "high", gate="dockerfile",
        patterns=(r"^(?:ENV|ARG)\s+(?:.*(?:PASSWORD|SECRET|TOKEN|API_KEY|PRIVATE_KEY|CREDENTIALS))",),
        guards=("PASSWORD", "SECRET", "TOKEN", "API_KEY", "PRIVATE_KEY", "CREDENTIALS"), redactor="env_value",
    ),
    RuleSpec(
        "DEP004", "Binding to all interfaces (0.0.0.0)", "MEDIUM",
        "The service listens on every network interface.",
        "Listen on the loopback address behind a reverse proxy.",
        GUIDE, "A05:2021", None, "CWE-200", "medium",
        patterns=(
            r'(?:host|bind|listen)\s*(?:=|:)\s*["\']0\.0\.0\.0["\']',
            r'\.listen\s*\(\s*(?:\d+\s*,\s*)?["\']0\.0\.0\.0["\']',
            r'app\.run\s*\(.*host\s*=\s*["\']0\.0\.0\.0["\']',
        ),
        needs="=:(", guards=("0.0.0.0",),
    ),
    RuleSpec(
        "DEP005", "Exposed source maps", "MEDIUM",
        "Source maps ship with the bundle and reveal the original code.",
        "Build without source maps or upload them to the error tracker only.",
        GUIDE, "A05:2021", None, "CWE-540", "medium", extensions=(".js", ".ts", ".json", ".vue"),
        patterns=(
            r"sourceMappingURL\s*=",
            r'devtool\s*:\s*["\'](?:source-map|eval-source-map|cheap-module-source-map)["\']',
            r"productionSourceMap\s*:\s*true",
            r"GENERATE_SOURCEMAP\s*=\s*true",
        ),
        needs="=:", guards=("sourceMappingURL", "devtool", "productionSourceMap", "GENERATE_SOURCEMAP"),
    ),
    RuleSpec(
        "DEP006", "Insecure security headers configuration", "MEDIUM",
        "A security header is set to a value that turns it off.",
        "Set the headers to their strict values.",
        GUIDE, "A05:2021", None, "CWE-693", "medium",
        patterns=(
            r"X-Frame-Options\s*:\s*[\"']?ALLOWALL",
            r"X-Content-Type-Options\s*:\s*[\"']?none",
            r"Strict-Transport-Security.*max-age\s*=\s*0",
            r"Content-Security-Policy.*unsafe-inline.*unsafe-eval",
        ),
        guards=("X-Frame-Options", "X-Content-Type-Options", "Strict-Transport-Security", "Content-Security-Policy"),
    ),
]
