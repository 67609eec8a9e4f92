"""Settings as data: word lists, thresholds, route rules. The values are fixed by the behaviour to be matched."""

from __future__ import annotations

from dataclasses import dataclass

NOT_FOUND = "The answer was not found in the processed documents."
CONTENT_TYPES = ("text", "table", "ocr_text", "ocr_table", "plot_table")
ALL_DOCUMENTS, ALL_TYPES = "All documents", "All types"
EXTENSIONS = ("pdf", "docx", "txt", "csv", "xlsx", "png", "jpg", "jpeg", "tif", "tiff", "bmp")
MAX_FILE_BYTES = 100 * 1024 * 1024


@dataclass(frozen=True)
class Chunking:
    size: int = 1000
    overlap: int = 150


@dataclass(frozen=True)
class Rerank:
    candidate_multiplier: int = 6
    minimum_candidates: int = 20
    phrase: float = 0.12
    overlap: float = 0.16
    identifier: float = 0.10
    table_intent: float = 0.05
    key_value_intent: float = 0.03
    duplicate: float = 0.92


@dataclass(frozen=True)
class Tables:
    y_tolerance: float = 3
    x_tolerance: float = 10
    gap: float = 20
    min_rows: int = 2
    min_columns: int = 2
    header_gap: float = 25
    header_y_tolerance: float = 3


# Word lists.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to",
    "was", "what", "when", "where", "which", "who", "with",)
TABLE_INTENT = ("amount", "article", "audit", "batch", "compatible", "condition", "date", "description", "expiration", "field", "limit", "lot",
    "material", "method", "number", "part", "pressure", "result", "specification", "status", "temperature", "value", "weight",)
KEY_VALUE_INTENT = ("address", "audit", "date", "expiration", "lot", "manufacturer", "number", "pressure", "product", "reference", "revision", "status", "temperature", "weight",)
LABEL_TOKENS = ("address", "agreement", "article", "assessment", "audit", "certification", "code", "component", "date", "description", "dimensions",
    "drawing", "effective", "expiration", "lot", "manufacture", "manufacturer", "name", "number", "part", "pressure", "product", "qualification",
    "reference", "result", "revision", "shelf", "site", "status", "supplier", "temperature", "valid", "warehouse", "weight",)
FOCUS_IGNORED = ("a", "about", "above", "according", "after", "akta", "an", "and", "are", "at", "available", "be", "been", "before", "being", "below",
    "between", "but", "by", "can", "compare", "could", "describe", "did", "do", "document", "documents", "does", "during", "explain", "flow", "for",
    "from", "give", "had", "has", "have", "how", "if", "in", "information", "into", "is", "kit", "kits", "may", "might", "of", "on", "or",
    "processed", "product", "products", "provide", "ready", "should", "show", "tell", "than", "the", "then", "through", "to", "use", "used", "using",
    "was", "were", "what", "when", "where", "which", "who", "whom", "whose", "why", "with", "without", "would",)
ENTITY_IGNORED = ("a", "an", "and", "are", "at", "available", "by", "compare", "date", "dates", "expiration", "expiry", "for", "from", "how", "in",
    "information", "is", "lot", "material", "materials", "max", "maximum", "number", "numbers", "of", "on", "operating", "or", "part", "pressure",
    "temperature", "temperatures", "the", "to", "use", "used", "was", "were", "what", "when", "where", "which", "who", "with",)
PLOT_TERMS = ["baseline", "chart", "curve", "figure", "graph", "highest", "lowest", "neuropathy symptom score", "nss", "placebo", "plot", "series",
    "symptom score", "trajectory", "treatment", "treatment group", "trend", "week", "weeks"]
CHART_CONTEXT = ["baseline", "chart", "figure", "mean score", "over time", "over weeks", "plot", "symptom score", "trajectory", "trend", "trial duration", "week 12"]
COMPARISON_TERMS = ["compare", "comparison", "difference", "differences"]
SAFETY_TERMS = ["adverse event", "adverse-event", "discontinuation", "sae", "safety", "severe adverse"]
DESIGN_TERMS = ["alpha allocation", "alpha level", "estimand", "multiplicity", "p value", "randomization", "significance level"]
STRUCTURED_SUPPRESSED = ["compare", "describe", "difference", "differences", "explain", "how", "summarize", "summary", "why"]
LOWEST_TERMS = ["lowest", "minimum", "smallest", "best symptom relief", "greatest symptom relief"]
HIGHEST_TERMS = ["highest", "maximum", "largest"]
LABEL_FIELDS = ["description", "product", "product name", "component", "item", "name", "column 1"]
NEVER_LABELS = ["expiration date", "lot number", "material", "operating pressure", "operating temperature", "part number"]
MULTI_VALUE = [r"\bwhat are\b", r"\blist\b", r"\ball\b", r"\bwhich products\b", r"\bpart numbers?\b.*\btemperatures?\b"]
ANY_COMPARISON = ["compare", "difference", "differences", "both", "across documents"]

# Field names that records may use for a canonical field.
FIELD_NAMES = {
    "lot number": ["lot no", "lot", "batch number"],
    "expiration date": ["expiry date", "expiry", "expiration"],
    "part number": ["article number", "product article number", "catalog number", "catalogue number", "part no"],
    "operating temperature": ["operating temp", "temperature range"],
    "operating pressure": ["max operating pressure", "maximum operating pressure"],
    "material": ["packaging material", "component material"],
}
# How questions name a field, in the order in which fields are answered.
QUESTION_FIELDS = {
    "lot number": ["lot number", "lot no", "batch number"],
    "expiration date": ["expiration date", "expiry date", "expiry"],
    "part number": ["part number", "part numbers", "article number", "article numbers", "product article number"],
    "operating temperature": ["operating temperature", "operating temperatures", "temperature range"],
    "material": ["material", "materials"],
    "operating pressure": ["operating pressure", "maximum pressure", "max pressure"],
    "observed result": ["observed result"],
    "40 mg": ["40 mg", "40mg"],
}


@dataclass(frozen=True)
class Component:
    """A component of the materials route: words on the question's and the record's side, and the text fallback."""

    name: str
    asked: tuple[str, ...]
    recorded: tuple[str, ...]
    in_text: str


# Fixed values.
COMPONENTS = (
    Component("Housing", ("housing",), ("housing",), r"(?i)\bhousing\b\s*[:|\-]?\s*(polypropylene(?:\s*\(pp\))?)"),
    Component("Gaskets", ("gasket",), ("gasket",), r"(?i)\bgaskets?\b\s*[:|\-]?\s*(epdm(?:\s+rubber)?)"),
    Component("Pump tubing", ("pump tubing",), ("tubing",), r"(?i)\bpump\s+tubing\b\s*[:|\-]?\s*(platinum[\s\-–—]*cured\s+silicone)"),
    Component("Inlet fittings", ("inlet fitting",), ("inlet fitting",), r"(?i)\binlet\s+fittings?\b\s*[:|\-]?\s*(peek)"),
    Component("Mixing chamber", ("mixing chamber",), ("mixing chamber",), r"(?i)\bmixing\s+chamber\b\s*[:|\-]?\s*(borosilicate\s+glass)"),
)

# Document types with their conditions, first match wins. Terms are substrings of the lower-cased file
# name and sample; "all" and "any" name which must be there, "count" how many of `of`.
DOC_TYPES = (
    ("Clinical Trial Report", {"any": ["clinical trial summary report", "phase iii clinical trial", "phase 3 clinical trial"], "or_all": ["clinical trial", "methodology", "efficacy"]}),
    ("Regulatory / Supporting Documentation", {"any": ["supporting documentation", "regulatory supporting", "bse/tse statement", "origin of milk-statement", "pharmaceutical lactose", "compliance statement"]}),
    (
        "Specification",
        {
            "any": ["packaging component specification", "material description sheet", "product specification"],
            "count": (2, ["packaging component specification", "material description sheet", "product specification", "component specification", "materials of construction", "physical properties", "operating temperature", "operating pressure"]),
            "with": ("specification", ["operating temperature", "materials of construction", "component material"]),
        },
    ),
    ("Certificate of Analysis", {"any": ["certificate of analysis"], "word": "coa"}),
    ("Certificate of Quality", {"any": ["certificate of quality"]}),
    ("Safety Data Sheet", {"any": ["safety data sheet"], "word": "sds"}),
    ("Supplier Qualification Record", {"any": ["supplier qualification record"]}),
    ("Quality Agreement", {"any": ["quality agreement"]}),
    ("Declaration / Statement", {"any": ["declaration", "statement", "to whom it may concern"]}),
)
