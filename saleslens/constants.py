"""Fixed values of the sales data model.

Everything in this module is data that has to hold exactly for results to be right: names,
positions, word lists and messages. No logic lives here.
"""

# --- fixed values: dimensions -------------------------------------------------------------
BRANDS = [
    "FAW", "HINO", "ISUZU", "MERCEDES_BENZ",
    "SCANIA", "TATA_MOTORS", "TOYOTA", "UD_TRUCKS",
]

SALES_TYPES = ["wholesales", "retail_sales", "production_ckd", "import_cbu"]

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

MONTH_NAMES_ID = {
    "jan": "Januari", "feb": "Februari", "mar": "Maret", "apr": "April",
    "may": "Mei", "jun": "Juni", "jul": "Juli", "aug": "Agustus",
    "sep": "September", "oct": "Oktober", "nov": "November", "dec": "Desember",
}

ALL_MONTHS = "all"
TOTAL_LABEL = "TOTAL"

# --- fixed values: sheet layout -----------------------------------------------------------
# Zero-based cell positions of the identity and specification columns.
SHEET_POSITIONS = {
    "vr_id": 0, "no": 1, "segment": 2, "model": 3, "cc": 4, "transmission": 5, "fuel": 6,
    "fc_kml": 7, "co2": 9, "tank": 10, "gvw": 11, "gear": 12, "tyre_size": 13, "ps_hp": 14,
    "wheel": 15, "dimension": 16, "seater": 17, "system": 18, "speed": 20, "door": 21,
}

# Sales type -> (column prefix, block title, position of its January cell); the other eleven
# months follow January without a gap.
SALES_BLOCKS = {
    "wholesales": ("wholesale", "WHOLESALES", 22),
    "retail_sales": ("retail", "RETAIL SALES", 35),
    "production_ckd": ("ckd", "PRODUCTION (CKD)", 48),
    "import_cbu": ("cbu", "IMPORT (CBU)", 61),
}
SHEET_WIDTH = 73
TITLE_ROWS = 20
HEADER_MARK = "VR-ID"
DEFAULT_HEADER_ROW = 9
HEADER_WORDS = ["COMPANY", "BRAND", "DATA OF MONTH/YEAR", "VR-ID", "PIC"]
MIN_ID_LENGTH = 8
UNKNOWN = "Unknown"

# --- fixed values: column lists -----------------------------------------------------------
SPEC_COLUMNS = [
    "cc", "transmission", "fuel", "gvw", "ps_hp", "dimension", "seater",
    "wheel", "tank", "gear", "system", "speed", "door",
]
EXTRA_SPEC_COLUMNS = ["no", "fc_kml", "co2", "tyre_size"]
# Specification columns that a TOTAL row holds as '' (the others are null there).
TOTAL_BLANK_SPECS = [
    "cc", "transmission", "fuel", "gvw", "wheel", "ps_hp", "dimension", "seater",
]
SPECS_ONLY_COLUMNS = [
    "brand", "segment", "model", "year", "month", "vr_id", "cc", "transmission",
    "fuel", "gvw", "wheel", "ps_hp", "dimension", "seater",
]
SALES_ONLY_COLUMNS = [
    "brand", "segment", "model", "year", "month", "sales_type", "sales", "is_summary", "vr_id",
]
EXACT_TECH_FIELDS = ["fuel", "transmission", "wheel", "seater", "ff_fr", "model"]
TECH_SPEC_KEYS = [
    "brand", "segment", "fuel", "transmission", "wheel", "seater", "ff_fr", "vr_id", "cc", "tank",
]
DISTRIBUTION_COLUMNS = ["fuel", "transmission", "wheel", "seater", "ff_fr", "cc", "model"]
TABLE_NAMES = [
    "master", "summary", "detailed", "monthly", "brand_comparison", "specs_only", "sales_only",
]

# --- fixed values: word lists -------------------------------------------------------------
LANGUAGE_WORDS = {
    "id": ["berapa", "bandingkan", "buatkan", "tampilkan", "analisis", "grafik"],
    "ja": ["いくつ", "比較", "グラフ", "分析"],
    "de": ["wie viele", "vergleichen", "diagramm", "analyse"],
    "es": ["cuántos", "comparar", "gráfico", "análisis"],
}
DEFAULT_LANGUAGE = "en"

INTENT_WORDS = {
    "specification": [
        "model", "spesifikasi", "specification", "cc", "transmission", "fuel",
        "wheel", "seater", "gvw", "ps", "hp", "dimension", "tank", "gear",
        "system", "ff", "fr", "speed", "paling laris", "terlaris", "terjual",
        "popular", "best selling", "top model", "most sold",
    ],
    "sales": [
        "penjualan", "sales", "retail", "wholesale", "total", "sum", "average",
        "trend", "growth", "market share", "revenue", "profit", "comparison",
        "bandingkan", "compare", "vs", "versus", "berapa", "how many",
    ],
    "prediction": [
        "prediksi", "prediction", "forecast", "future", "akan", "will",
        "projected", "expected", "nasional", "national", "global",
    ],
}
SECOND_OPINION_WORDS = {
    "sales": ["sales", "penjualan", "retail", "wholesale", "total", "berapa"],
    "specification": ["model", "spesifikasi", "cc", "transmission", "fuel", "wheel"],
}
DEFAULT_INTENT = "general"

# --- fixed values: quality checks ---------------------------------------------------------
SOURCE_COLUMNS = {
    "master": ["model", "brand", "segment", "sales"],
    "detailed": ["model", "brand", "fuel", "transmission", "cc"],
    "summary": ["brand", "sales_type", "sales", "month"],
}
CHECK_ADVICE = {
    "data_source_consistency":
        "Consider reviewing data source selection logic for better accuracy",
    "cross_reference":
        "Implement stronger cross-referencing between sales and specifications data",
    "intent_accuracy":
        "Improve query intent classification with additional training examples",
    "result_completeness":
        "Add data validation checks to ensure result completeness",
}
# Advice by accuracy score: below the first bound, below the second bound.
BAND_ADVICE = [
    (0.7, "Consider implementing additional validation layers for critical queries"),
    (0.9, "Minor accuracy improvements recommended for optimal performance"),
]
HIGH_SCORE = 0.9
MEDIUM_SCORE = 0.7
# Words that an issue text must contain -> advice; the first rule that fits is taken.
ISSUE_ADVICE = [
    (["No", "data found"], "Consider expanding technical specification extraction rules"),
    (["Unusually high"], "Review sales data for outliers and anomalies"),
    (["Negative sales"], "Implement data validation to prevent negative sales values"),
    (["missing specs"], "Ensure all brands have corresponding specification data"),
    (["Empty model"], "Improve model name extraction from Excel files"),
    (["Separate data files not found"],
     "Run the data separation process to enable full validation"),
]
NO_ISSUE_ADVICE = "Data accuracy is within acceptable parameters"
# Response styles, from the widest to the default.
RESPONSE_STYLES = [
    "comprehensive_business_analysis",
    "technical_deep_dive",
    "focused_executive_summary",
    "competitive_market_analysis",
    "balanced_business_insights",
]
TECHNICAL_COLUMNS = ["cc", "transmission", "fuel", "wheel", "seater"]
RECORD_TOLERANCE = 0.05
NULL_SHARE_LIMIT = 0.3
