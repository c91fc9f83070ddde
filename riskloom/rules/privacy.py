"""Rules for personal and health data."""

from .spec import RuleSpec

GUIDE = "guides/10-privacy.md"
CODE = (".py", ".js", ".ts", ".jsx", ".tsx")
SOURCE = CODE + (".java", ".go", ".rb")

# Ids, names, severities, taxonomy ids, extensions, patterns and vetoes.
RULES = [
    RuleSpec(
        "PRI001", "PII written to logs", "HIGH",
        "A log call names a field with personal data.",
        "Log an opaque id, or mask the field.",
        GUIDE, "A02:2021", None, "CWE-532", "medium", extensions=CODE,
        patterns=(
            r'(?:logger\.\w+|logging\.\w+|print)\s*\(.*\b(?:email|phone|ssn|password|passwd|dob|date_of_birth|credit_card|card_number|social_security)\b',
            r'console\.(?:log|warn|error|info)\s*\(.*\b(?:email|phone|ssn|password|dob|creditCard|cardNumber|socialSecurity)\b',
            r'(?:logger\.\w+|logging\.\w+|print)\s*\(\s*f["\'].*\{.*(?:email|phone|ssn|password|dob|credit_card)\b',
        ),
        also=(
            "email", "phone", "ssn", "passw", "dob", "date_of_birth",
            "credit_card", "card_number", "social_security", "creditCard", "cardNumber", "socialSecurity",
        ),
        needs="(", guards=("logger.", "logging.", "print", "console."), redactor="pii",
    ),
    RuleSpec(
        "PRI002", "Hardcoded SSN pattern", "CRITICAL",
        "A social security number is written into the source.",
        "Use an obviously invalid number in tests and encrypt real ones.",
        GUIDE, "A02:2021", extensions=SOURCE,
        patterns=(
            r'["\'][0-9]{3}-[0-9]{2}-[0-9]{4}["\']',
            r'\bssn\s*=\s*["\'][0-9]{3}-[0-9]{2}-[0-9]{4}["\']',
            r'(?:social_security|ssn_number)\s*=\s*["\'][0-9]{3}-[0-9]{2}-[0-9]{4}["\']',
        ),
        needs="\"'", guards=("-",), honours_marker=False, vetoes=("000-00-0000",), redactor="ssn",
    ),
    RuleSpec(
        "PRI003", "Health data (PHI) in logs", "HIGH",
        "A log call names a field with health data.",
        "Log an opaque record id only.",
        GUIDE, "A02:2021", extensions=CODE,
        patterns=(
            r'(?:logger\.\w+|logging\.\w+|print)\s*\(.*\b(?:diagnosis|medication|prescription|condition|treatment|patient_data|medical_record|health_record|icd_code|procedure_code)\b',
            r'console\.(?:log|warn|error|info)\s*\(.*\b(?:diagnosis|medication|prescription|condition|treatment|patientData|medicalRecord|healthRecord)\b',
        ),
        also=(
            "diagnosis", "medication", "prescription", "condition", "treatment", "patient_data",
            "medical_record", "health_record", "icd_code", "procedure_code", "patientData", "medicalRecord", "healthRecord",
        ),
        needs="(", guards=("logger.", "logging.", "print", "console."),
    ),
    RuleSpec(
        "PRI004", "Hardcoded email address", "LOW",
        "A real-looking address is written into the source.",
        "Move addresses into settings and use reserved domains in tests.",
        GUIDE, "A02:2021", extensions=SOURCE,
        patterns=(
            r'["\'][A-Za-z0-9._%+\-]{2,}@(?!example\.|test\.|localhost)[A-Za-z0-9.\-]{3,}\.[A-Za-z]{2,}["\']',
            r'\bemail\s*=\s*["\'][A-Za-z0-9._%+\-]{2,}@(?!example\.|test\.|localhost)[A-Za-z0-9.\-]{3,}\.[A-Za-z]{2,}["\']',
        ),
        needs="\"'", guards=("@",), redactor="email",
    ),
    RuleSpec(
        "PRI005", "Unencrypted PII storage", "HIGH",
        "Personal data is written to a plain file.",
        "Encrypt the data before it is written, or keep it in an encrypted store.",
        GUIDE, "A02:2021", extensions=(".py", ".js", ".ts"),
        patterns=(
            r'(?:csv\.writer|writer\.writerow|json\.dump|f\.write|file\.write|fs\.write)\s*\(.*\b(?:ssn|social_security|credit_card|card_number|passport|health_record|medical_record|diagnosis)\b',
            r'json\.dump\s*\(.*["\'](?:ssn|credit_card|card_number|passport|medical_record)["\']',
            r'(?:f|fh|file)\.write\s*\(.*\b(?:ssn|credit_card|passport_number|social_security)\b',
            r'\b(?:ssn_data|pii_data|credit_card_data|patient_records)\b.*\.to_(?:csv|json|excel)\s*\(',
        ),
        also=(
            "ssn", "social_security", "credit_card", "card_number", "passport",
            "health_record", "medical_record", "diagnosis", "pii_data", "patient_records",
        ),
        needs="(", guards=("csv.writer", "writer.writerow", "json.dump", ".write", ".to_"),
    ),
]
