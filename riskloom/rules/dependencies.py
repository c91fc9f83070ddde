"""Rules for the supply chain, and the package lists they use."""

from .spec import RuleSpec

GUIDE = "guides/07-dependency-safety.md"

# Known misspelt or invented package names and the package that was meant.
DENYLIST = {
    "colourama": "colorama",
    "djago": "django",
    "dajngo": "django",
    "diango": "django",
    "reqeusts": "requests",
    "requets": "requests",
    "request": "requests",
    "urllib4": "urllib3",
    "urlib3": "urllib3",
    "pillow_": "Pillow",
    "nump": "numpy",
    "numppy": "numpy",
    "nuumpy": "numpy",
    "scikitlearn": "scikit-learn",
    "flask_": "flask",
    "flaask": "flask",
    "flaskk": "flask",
    "beautifulsoupp": "beautifulsoup4",
    "panads": "pandas",
    "pandaas": "pandas",
    "matplotlibb": "matplotlib",
    "pycrpytodome": "pycryptodome",
    "pycryptodomex_": "pycryptodome",
    "cryptographyy": "cryptography",
    "crpytography": "cryptography",
    "openssl_": "pyOpenSSL",
    "langchainplus": "langchain",
    "langchain_plus": "langchain",
    "openai_tools": "openai",
    "anthropic_tools": "anthropic",
    "chatgpt": "openai",
    "gpt4": "openai",
    "huggingface": "huggingface-hub",
    "hugging_face": "huggingface-hub",
    "transformerss": "transformers",
    "pineconedb": "pinecone-client",
    "pinecone_client": "pinecone-client",
    "chromadb_": "chromadb",
    "weaviateclient": "weaviate-client",
    "python-nmap_": "python-nmap",
    "setup-tools": "setuptools",
    "py-yaml": "PyYAML",
    "pyyaml_": "PyYAML",
    "python_dotenv": "python-dotenv",
}

# Import names of well-known packages that are never reported.
ALIASES = ("pil", "cv2", "sklearn", "bs4", "yaml", "dotenv", "crypto", "google.cloud")

# Ids, names, severities, taxonomy ids, extensions and patterns.
RULES = [
    RuleSpec(
        "DEP101", "--extra-index-url supply chain risk", "HIGH",
        "A second package index lets a public package shadow a private one of the same name.",
        "Use a single index that proxies the public one.",
        GUIDE, "A08:2021", None, "CWE-829", "high", gate="pip_related",
        extensions=(".txt", ".cfg", ".ini", ".sh", ".bash", ".py", "dockerfile", ".dockerfile"),
        patterns=(
            r"--extra-index-url\s+\S+",
            r"extra[-_]index[-_]url\s*=\s*\S+",
            r"extra_index_url\s*=\s*\S+",
        ),
        guards=("index-url", "index_url"),
    ),
    RuleSpec(
        "DEP102", "Unpinned dependency", "MEDIUM",
        "A requirement has no version, so any release may be installed.",
        "Pin each requirement, best through a lock file.",
        GUIDE, "A08:2021", None, "CWE-1104", "medium", gate="requirements",
        patterns=(r"^([A-Za-z0-9][A-Za-z0-9_\-\.]+)\s*$",),
        kind="stripped_lines", honours_marker=False, redactor="stripped",
    ),
    # The repeat in the first pattern is possessive, so that a long list needs no stack.
    RuleSpec(
        "DEP103", "Wildcard / unbounded version specifier", "LOW",
        "A requirement has a lower bound and no upper bound.",
        "Pin the version or add an upper bound.",
        GUIDE, "A08:2021", None, "CWE-1104", "medium", gate="requirements_or_setup",
        patterns=(
            r"^[A-Za-z0-9][A-Za-z0-9_\-\.]+\s*(?:>=|~=)\s*[\d\.]+\s*(?:,\s*!=[\d\.]+\s*)*+$",
            r'["\'][A-Za-z0-9][A-Za-z0-9_\-\.]+\s*(?:>=|~=)\s*[\d\.]+["\']',
        ),
        # Patterns that veto a stripped line: an upper bound, a comment.
        vetoes=(r",\s*<[\d]", r"^#"),
        needs="=", guards=(">=", "~="), kind="stripped_lines", honours_marker=False, redactor="stripped",
    ),
    RuleSpec(
        "DEP104", "Unpinned install_requires in setup.py", "LOW",
        "A package lists a dependency without any version bound.",
        "Give each dependency a lower bound and the next major version as upper bound.",
        GUIDE, "A08:2021", kind="block_items", extensions=(".py", ".cfg", ".toml"),
        # The block of dependencies, then one bare name in it.
        patterns=(
            r'(?:install_requires|extras_require)\s*[=:]\s*[\[\{][^\]\}]*[\]\}]',
            r'["\']([A-Za-z][A-Za-z0-9_\-\.]+)["\']\s*[,\]]',
        ),
        needs="=:", guards=("install_requires", "extras_require"), honours_marker=False, redactor="stripped",
    ),
    RuleSpec(
        "DEP105", "Known typosquatted or hallucinated package", "HIGH",
        "A package name is a known misspelling or an invented name.",
        "Check the exact name on the package index and install the real package.",
        GUIDE, "A08:2021", kind="denylist", gate="denylist_files",
        # A requirement line: the name in front of a specifier or the end of the line.
        patterns=(r"^([A-Za-z][A-Za-z0-9_\-\.]*)\s*(?:[=<>!~]|$)",),
        ignore_case=True, honours_marker=False, redactor="stripped",
    ),
]
