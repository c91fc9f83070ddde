"""Rules for authentication and access control."""

from .spec import RuleSpec

GUIDE = "guides/02-authentication.md"

# Ids, names, severities, taxonomy ids and patterns.
RULES = [
    RuleSpec(
        "AUTH001", "Hardcoded password comparison", "CRITICAL",
        "A password is compared with a literal, so the password is in the source.",
        "Store a salted hash and verify against it.",
        GUIDE, "A07:2021", None, "CWE-798", "high",
        patterns=(
            r'(?:password|passwd|pwd)\s*(?:==|!=)\s*["\'][^"\']+["\']',
            r'["\'][^"\']+["\']\s*(?:==|!=)\s*(?:password|passwd|pwd)\b',
        ),
        needs="=", guards=("password", "passwd", "pwd"), redactor="quoted",
    ),
    RuleSpec(
        "AUTH002", "JWT with hardcoded secret", "CRITICAL",
        "Tokens are signed or checked with a literal, so anyone with the source can forge them.",
        "Load a long random signing secret from the environment.",
        GUIDE, "A02:2021", None, "CWE-321", "high",
        patterns=(
            r'jwt\.(?:encode|decode|sign|verify)\s*\([^)]*["\'][a-zA-Z0-9_\-]{8,}["\']',
            r'(?:JWT_SECRET|jwt_secret|JWT_SECRET_KEY)\s*=\s*["\'][^"\']{3,}["\']',
        ),
        needs="(=", guards=("jwt.", "JWT_SECRET", "jwt_secret"), redactor="word_in_match",
    ),
    RuleSpec(
        "AUTH003", "Insecure cookie/session configuration", "HIGH",
        "Session cookies lack the secure or the http-only flag.",
        "Turn on both cookie flags.",
        GUIDE, "A05:2021", None, "CWE-614", "high",
        patterns=(
            r'SESSION_COOKIE_SECURE\s*=\s*False',
            r'SESSION_COOKIE_HTTPONLY\s*=\s*False',
            r'httpOnly\s*:\s*false',
            r'cookie\(.*secure\s*:\s*false',
        ),
        needs="=:", guards=("SESSION_COOKIE_", "httpOnly", "cookie("),
    ),
    RuleSpec(
        "AUTH004", "Disabled CSRF protection", "HIGH",
        "Cross-site request forgery protection is switched off.",
        "Leave the framework's CSRF protection on.",
        GUIDE, "A01:2021", None, "CWE-352", "high",
        patterns=(
            r'@csrf_exempt',
            r'WTF_CSRF_ENABLED\s*=\s*False',
            r'csrf\s*:\s*false',
            r'CSRF_ENABLED\s*=\s*False',
        ),
        needs="@=:", guards=("csrf", "CSRF_ENABLED"),
    ),
    RuleSpec(
        "AUTH005", "Hardcoded auth credentials", "CRITICAL",
        "A user name and password pair or a Basic header is written into the source.",
        "Read credentials from the environment.",
        GUIDE, "A07:2021", None, "CWE-798", "high",
        patterns=(
            r'auth\s*=\s*\(\s*["\'][^"\']+["\']\s*,\s*["\'][^"\']+["\']\s*\)',
            r'["\']Authorization["\']\s*:\s*["\']Basic\s+[A-Za-z0-9+/=]+["\']',
        ),
        needs="=:", guards=("auth", "Authorization"), redactor="quoted_in_match",
    ),
    RuleSpec(
        "AUTH006", "Default/weak permission configuration", "MEDIUM",
        "The default permissions let unauthenticated users in.",
        "Require authentication by default and open single views on purpose.",
        "guides/03-authorization.md", "A01:2021", None, "CWE-862", "medium",
        patterns=(
            r'DEFAULT_PERMISSION_CLASSES\s*=\s*\[.*AllowAny',
            r'IsAuthenticated.*False',
            r'permission_classes\s*=\s*\[\s*\]',
            r'allow_anonymous\s*=\s*True',
        ),
        guards=("AllowAny", "IsAuthenticated", "permission_classes", "allow_anonymous"),
    ),
]
