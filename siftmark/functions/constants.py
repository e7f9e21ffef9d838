"""Names, word lists and formats that results depend on."""

# Ecosystem name, package-URL type, advisory-database spelling, GraphQL enum.
ECOSYSTEMS = [
    ("pypi", "pypi", "PyPI", "PIP"),
    ("npm", "npm", "npm", "NPM"),
    ("maven", "maven", "Maven", "MAVEN"),
    ("nuget", "nuget", "NuGet", "NUGET"),
]

ECOSYSTEM_NAMES = [row[0] for row in ECOSYSTEMS]

# Words in a description that point at a product, not a library.
PRODUCT_WORDS = [
    "server",
    "enterprise",
    "appliance",
    "console",
    "controller",
    "management",
    "plugin",
    "rsa archer",
]

# Outcome labels.
TP_EXACT = "TP_EXACT"
TP_RANGE = "TP_RANGE"
FN_EXACT = "FN_exact"
FN_RANGE = "FN_range"
FN_TRUE = "FN_true"
FP_CERTAIN = "FP-CERTAIN"
FP_LIKELY = "FP-LIKELY"
FP_UNCLEAR = "FP-UNCLEAR"

# Coverage buckets in order of precedence.
COVERAGE_BUCKETS = [
    "NO_CVE",
    "CVE_ABSENT",
    "NO_CPE_CONFIG",
    "PRODUCT_MISMATCH",
    "PRODUCT_MATCHED",
]

# Ecosystems a coverage report always shows, even at zero.
COVERAGE_ECOSYSTEMS = ["pypi", "npm", "maven"]

# Column order of the written ground-truth file.
GROUND_TRUTH_COLUMNS = [
    "ecosystem",
    "component_name",
    "component_version",
    "purl",
    "vulnerability_id",
    "cve",
    "vulnerability_description",
    "is_vulnerable",
]

# Metrics averaged over runs, and those that are counts.
RUN_METRICS = ["TP", "FP", "FN", "Recall", "Overlap"]
COUNT_METRICS = ["TP", "FP", "FN", "Components", "Vulnerabilities", "CVEs"]
