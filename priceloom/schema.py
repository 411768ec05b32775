"""Declared columns, vocabularies and value dictionaries of the pricing mart."""

from __future__ import annotations

from pyspark.sql import types as T

MISSING = "MISSING"
SENTINEL_DATE = "9999-12-31"
SENTINEL_DATE_TEXT = "31-12-9999"
MAX_REASONABLE_PRICE = 5000.0
MIN_PRICE = 0.5

# ---------------------------------------------------------------------------
# Column lists
# ---------------------------------------------------------------------------

KEEP_COLUMNS = [
    "binding_type", "height", "isbn10", "isbn13", "perf", "production_page", "security_label",
    "self_cover", "shrinkwrap", "status", "thickness", "three_hole_drill", "unit_price", "version",
    "weight", "width", "label_location", "label_type", "cover_finish_type", "text_color",
    "text_paper_type", "priority_level", "quantity", "quantity_min", "quantity_max", "siren",
    "coil_type", "cover_paper_type", "double_sided_cover", "cover_color", "cover_size",
    "insert_lamination", "insert_paper_type", "insert_color", "insert_size", "tab_page_number",
    "trim_size", "tab_color", "tab_lamination", "tab_size", "tab_paper_type", "case_finish_type",
    "case_paper_type", "cover_case_color", "back_cover_flat_size", "spine_type", "head_and_tail",
    "tva", "reception_date",
]

COUNT_FEATURES = ["quantity", "production_page"]
FLAG_FEATURES = [
    "security_label", "has_coil", "has_insert", "has_tab", "has_backcover", "perf",
    "double_sided_cover", "shrinkwrap", "three_hole_drill",
]
MEASURE_FEATURES = ["height", "thickness", "width"]
NUMERIC_FEATURES = ["quantity", "production_page", "height", "thickness", "width", *FLAG_FEATURES]
CATEGORY_FEATURES = [
    "text_paper_type", "text_color", "cover_finish_type", "cover_color", "cover_size",
    "cover_paper_type", "head_and_tail", "priority_level", "binding_type", "coil_type", "tab_color",
    "insert_paper_type", "case_finish_type", "spine_type", "label_type", "siren",
]
ALL_FEATURES = [*NUMERIC_FEATURES, *CATEGORY_FEATURES]

REQUIRED_CLEAN = ["binding_type", "unit_price"]
MANDATORY_RELATIONS = ["production_parts", "orders", "clients"]

CONSTANT_COLUMNS_TO_KEEP = [
    "has_coil", "has_insert", "has_tab", "has_backcover", "insert_paper_type", "unit_price", "tva",
]

FAMILIES = [
    "CASEBIND", "PERFECT", "COILHARD", "SS", "COILSOFT", "COILHARD-TAB", "CASEBIND-ES", "LOOSELEAF-NC",
]

FLAG_SOURCES = {
    "has_insert": ["insert_lamination", "insert_paper_type", "insert_color", "insert_size"],
    "has_tab": ["tab_page_number", "tab_color", "tab_lamination", "tab_size", "tab_paper_type"],
    "has_backcover": [
        "case_finish_type", "case_paper_type", "cover_case_color", "back_cover_flat_size", "spine_type",
    ],
    "has_coil": ["coil_type"],
}

# Columns the consolidation adds when they are absent, with their default.
CONSOLIDATION_DEFAULTS = {
    "insert_lamination": "NONE", "insert_paper_type": "NONE", "insert_color": "NONE",
    "insert_size": -1, "insert_active": 0, "tab_active": 0, "tab_page_number": -1, "trim_size": -1,
    "tab_color": "NONE", "tab_lamination": "NONE", "tab_size": -1, "tab_paper_type": "NONE",
    "coil_type": "NONE", "cover_paper_type": "NONE", "double_sided_cover": 0, "cover_color": "NONE",
    "head_and_tail": "NONE", "cover_size": "NONE", "case_finish_type": "NONE",
    "case_paper_type": "NONE", "cover_case_color": "NONE", "back_cover_flat_size": -1,
    "spine_type": "NONE", "has_coil": 0, "has_insert": 0, "has_tab": 0, "has_backcover": 0,
    "security_label": 0, "perf": 0, "shrinkwrap": 0, "three_hole_drill": 0,
}

CONSOLIDATION_STRINGS = [
    "insert_lamination", "insert_paper_type", "insert_color", "tab_color", "tab_lamination",
    "tab_paper_type", "coil_type", "cover_paper_type", "cover_color", "head_and_tail", "cover_size",
    "case_finish_type", "case_paper_type", "cover_case_color", "spine_type", "priority_level",
    "binding_type", "label_type", "siren",
]
CONSOLIDATION_NUMBERS = [
    "insert_size", "tab_page_number", "trim_size", "tab_size", "back_cover_flat_size",
    "security_label", "has_coil", "has_insert", "has_tab", "has_backcover", "perf",
    "double_sided_cover", "shrinkwrap", "three_hole_drill", "quantity", "production_page", "height",
    "thickness", "width", "quantity_min", "quantity_max", "insert_active", "tab_active",
]

# Typed fills of the first cleaning step.
FILL_ZERO = ["tva", "three_hole_drill", "perf", "double_sided_cover", "security_label", "shrinkwrap"]
FILL_MINUS_ONE = ["insert_size", "tab_size", "back_cover_flat_size", "trim_size"]
FILL_ONE = ["version"]
FILL_MISSING = [
    "cover_size", "cover_finish_type", "text_color", "text_paper_type", "case_paper_type",
    "spine_type", "coil_type", "author", "label_location", "label_type", "cover_paper_type",
    "cover_color", "insert_color", "case_finish_type", "tab_paper_type", "tab_lamination",
    "tab_color", "tab_page_number", "head_and_tail", "cover_case_color", "insert_lamination",
    "insert_paper_type", "delivery_date",
]
DATE_COLUMNS = ["expected_date", "delivery_date", "reception_date"]
ISBN_COLUMNS = ["isbn10", "isbn13"]

# ---------------------------------------------------------------------------
# Tokens and dictionaries
# ---------------------------------------------------------------------------

EMPTY_TOKENS = ["NAN", "NONE", "MISSING", "N/A", "", " ", "NaT", "<NA>", "NULL"]
DATE_EMPTY_TOKENS = ["", " ", "NAN", "NaN", "None", "NONE", "MISSING"]
TRUE_TOKENS = ["true", "1", "yes", "oui", "vrai"]
FALSE_TOKENS = ["false", "0", "no", "non", "faux", ""]

VALUE_MAPS = {
    "siren": {"TLG": "CENGAGE", "NGL": "CENGAGE", "CLM": "CENGAGE"},
    "text_color": {"1": "1/1", "1/C": "1/1", "1C": "1/1", "4": "4/4", "4/C": "4/4", "4C": "4/4"},
    "cover_finish_type": {
        "LGLOSS": "LAYFLAT-GLOSS",
        "LAYFLAT GLOSS": "LAYFLAT-GLOSS",
        "LMATT_SF": "LAYFLAT MATTE SCUFF-FREE",
        "LAYFLAT MATTE SCUFF-FREE": "LAYFLAT MATTE SCUFF-FREE",
        "LMATTE": "LAYFLAT-MATTE",
        "MATT": "MATT",
    },
    "cover_color": {"4/C": "4/4", "4C": "4/4", "40": "4/0", "41": "4/1", "0": "0/0", "00": "0/0"},
    "binding_type": {
        "LOOSELEAF_NO_COVER": "LOOSELEAF-NC",
        "CASEBOUND": "CASEBIND",
        "CASEBINDENDSHEET": "CASEBIND-ES",
        "CASEBOUND-ES": "CASEBIND-ES",
        "COILHARDTAB": "COILHARD-TAB",
        "CARD": "CARD",
        "PERFECT-NC": "PERFECT-NC",
        "SADDLESTITCH": "SS",
        "SADDLE STITCH": "SS",
    },
    "cover_paper_type": {
        "100_GLOSSTEXT": "100_GLOSS_TEXT",
        "100_GLOSS_TEXT": "100_GLOSS_TEXT",
        "80_GLOSS_TEXT": "80_GLOSS_TEXT",
        "80_GLOSSTEXT": "80_GLOSS_TEXT",
        "80_GLOSSCOVER": "80_GLOSS_COVER",
    },
    "head_and_tail": {
        "BLACK & WHITE": "BLACK & WHITE",
        "BLACK/WHITE": "BLACK & WHITE",
        "WHITE/WHITE": "WHITE",
        "WHITE": "WHITE",
        "NONE": "NONE",
    },
    "priority_level": {"HIGH": "HIGH1", "HIGH*": "HIGH1", "HIGH**": "HIGH2"},
    "status": {
        "NEW": "NEW",
        "ACCEPTED": "ACCEPTED",
        "PENDING": "PENDING",
        "PROOF OUT": "PROOF_OUT",
        "ONPROD": "ON_PROD",
        "READY": "READY",
        "DELIVERED": "DELIVERED",
        "PARTIAL DELIVERED": "PARTIAL DELIVERED",
        "INVOICED": "INVOICED",
        "COMPLETE": "COMPLETE",
        "CANCELLED": "CANCELLED",
        "CANCELED": "CANCELLED",
        "ONHOLD": "ON_HOLD",
    },
    "label_location": {
        "ES PAGE 2/BOTTOM/RIGHT": "OTHER",
        "NONE": "NONE",
        "SEE SAMPLE": "OTHER",
        "LABEL LOCATION MXTST": "OTHER",
    },
    "label_type": {
        "NONE": "NONE",
        "STANDARD": "STANDARD",
        "YES": "STANDARD",
        "ISBN": "ISBN",
        "ISBN-ST": "ISBN",
        "978-0-357-37403-0": "ISBN",
        "BAR CODE": "ISBN",
        "NO (IF BAR CODE LABEL)": "ISBN",
        "ADVANCE COPY (SILVER)": "OTHER",
        "FLORIDA": "OTHER",
        "RELX": "OTHER",
        "2": "OTHER",
        "GRADE 1": "OTHER",
        "GRADE 2": "OTHER",
        "GRADE 3": "OTHER",
        "GRADE 4": "OTHER",
        "GRADE 5": "OTHER",
        "GRADE K": "OTHER",
        "LABEL TYPE MXTST": "OTHER",
    },
    "case_finish_type": {
        "NONE": "NONE",
        "LAYFLAT-GLOSS": "LAYFLAT-GLOSS",
        "LAYFLAT MATTE": "LAYFLAT-MATTE",
        "LAYFLAT MATTE SCUFF-FREE": "LAYFLAT MATTE SCUFF-FREE",
        "GLOSS FILM": "GLOSS-FILM",
        "GLOSS-FILM": "GLOSS-FILM",
        "LAYFLAT GLOSS": "LAYFLAT-GLOSS",
    },
    "case_paper_type": {
        "NONE": "NONE",
        "100_GLOSSTEXT": "100_GLOSS_TEXT",
        "10PT_C1S": "10PT_C1S",
        "16PT_C1S": "16PT_C1S",
    },
    "coil_type": {
        "NONE": "NONE",
        "METAL": "METAL",
        "METAL WHITE": "METAL",
        "PLASTIC": "PLASTIC",
        "PLASTIC BLACK": "PLASTIC",
        "PLASTIC WHITE": "PLASTIC",
        "BLACK PLASTIC": "PLASTIC",
        "1/C": "PLASTIC",
        "4/C": "PLASTIC",
    },
    "tab_lamination": {
        "NONE": "NONE",
        "MYLAR": "MYLAR",
        "YES": "LAYFLAT-GLOSS",
        "NO": "NONE",
        "LAYFLAT-GLOSS": "LAYFLAT-GLOSS",
        "LAYFLAT GLOSS": "LAYFLAT-GLOSS",
        "GLOSS-FILM": "GLOSS-FILM",
    },
    "tab_paper_type": {
        "NONE": "NONE",
        "10PT_C2S": "10PT_C2S",
        "12PT_C2S": "12PT_C2S",
        "10PT_C1S": "10PT_C1S",
        "100_GLOSSTEXT": "100_GLOSS_TEXT",
    },
    "text_paper_type": {
        "NONE": "MISSING",
        "80_GLOSSTEXT": "80_GLOSS_TEXT",
        "80_GLOSS_TEXT": "80_GLOSS_TEXT",
        "80_GLOSSCOVER": "80_GLOSS_COVER",
        "10PT_C2S": "10PT_C2S",
        "12PT_C2S": "12PT_C2S",
        "PAP1SW_70": "PAP1_70",
        "PAP1_75": "PAP1_75",
        "LETSGO MATTE 115GSM": "LETSGO_MATTE_115",
        "LETSGO MATTE 90GSM": "LETSGO_MATTE_90",
        "FSC_MC_CVG_SILKHO_1.0_70": "FSC_MC_CVG_SILKHO_1.0_70",
        "FSC_MC_CVG_SILKHO_1.061": "FSC_MC_CVG_SILKHO_1.061",
        "FSC_MC_CVG_SILKHO_1.061_CB": "FSC_MC_CVG_SILKHO_1.061",
        "FSC_MC_CVG_SILKHO_1.0_70_CB": "FSC_MC_CVG_SILKHO_1.0_70",
        "FSC_MC_CVG_SILKHO_1.0_70_BW": "FSC_MC_CVG_SILKHO_1.0_70",
        "FSC_MC_CVG_SILKHO_1.061_CB_BW": "FSC_MC_CVG_SILKHO_1.061",
        "FSC_MC_DOM_VJT_1.21_75": "FSC_MC_DOM_VJT_1.21_75",
        "FSC_MC_DOM_VJT_1.21_75_BW": "FSC_MC_DOM_VJT_1.21_75",
        "FSC_MC_DOM_VJT_1.29_90": "FSC_MC_DOM_VJT_1.29_90",
        "FSC_MC_DOM_VJT_1.29_90_BW": "FSC_MC_DOM_VJT_1.29_90",
        "BIRCH_W40_TB": "BIRCH_W40_TB",
        "SFI_CVG_UCR_1.8_66": "SFI_CVG_66",
    },
}

KNOWN_CATEGORIES = {
    "text_paper_type": ["BIRCH_W40_TB", "80_GLOSS_TEXT", "70_OFFSET", "NONE", "MISSING", "UNKNOWN"],
    "text_color": ["4/4", "4/0", "1/1", "NONE", "MISSING", "UNKNOWN"],
    "cover_finish_type": ["LAYFLAT-GLOSS", "GLOSS", "MATTE", "NONE", "MISSING", "UNKNOWN"],
    "cover_color": ["4/0", "4/4", "1/0", "NONE", "MISSING", "UNKNOWN"],
    "cover_size": ["L", "M", "S", "XL", "NONE", "MISSING", "UNKNOWN"],
    "cover_paper_type": ["12PT_C1S", "100_GLOSS_TEXT", "80_GLOSS_TEXT", "NONE", "MISSING", "UNKNOWN"],
    "head_and_tail": ["NONE", "BLACK", "WHITE", "BLACK & WHITE", "MISSING", "UNKNOWN"],
    "priority_level": ["NORMAL", "HIGH1", "HIGH2", "LOW", "MISSING", "UNKNOWN"],
    "binding_type": ["SS", "CASEBIND", "PERFECT", "SPIRAL", "MISSING", "UNKNOWN"],
    "coil_type": ["NONE", "METAL", "PLASTIC", "MISSING", "UNKNOWN"],
    "tab_color": ["NONE", "WHITE", "COLOR", "MISSING", "UNKNOWN"],
    "insert_paper_type": ["NONE", "80_GLOSS_TEXT", "70_OFFSET", "MISSING", "UNKNOWN"],
    "case_finish_type": ["NONE", "LAYFLAT-GLOSS", "GLOSS", "MISSING", "UNKNOWN"],
    "spine_type": ["NONE", "ROUND", "SQUARE", "MISSING", "UNKNOWN"],
    "label_type": ["NONE", "STANDARD", "CUSTOM", "MISSING", "UNKNOWN"],
    "siren": ["SAV", "MISSING", "UNKNOWN"],
}

# Rules an incoming script must not match, with the message for each.
FORBIDDEN_PATTERNS = {
    r"\bDROP\s+DATABASE\b": "DROP DATABASE forbidden",
    r"\bDROP\s+USER\b": "DROP USER forbidden",
    r"\bGRANT\b": "GRANT forbidden",
    r"\bREVOKE\b": "REVOKE forbidden",
    r"\bLOAD\s+DATA\b": "LOAD DATA forbidden",
}

# Registry tag keys that may carry R2, in the order they are looked up.
R2_TAG_KEYS = [
    "r2_test", "r2", "test_r2", "cv_r2", "performance_r2", "r2_score", "R2", "R²", "r2_train",
]
ALGORITHM_TAG_KEYS = ["best_model", "algorithm", "model_algorithm"]
FORMULA_TAG = "linear_formula"
IMPORTANCE_TAG = "feature_importance"
SHAP_TAG = "shap_success"

# ---------------------------------------------------------------------------
# Declared schemas
# ---------------------------------------------------------------------------

CLIENT_FEATURES = T.StructType([
    T.StructField("siren", T.StringType()),
    T.StructField("client_nb_orders", T.LongType()),
    T.StructField("client_avg_price_ht", T.DoubleType()),
    T.StructField("client_price_std_ht", T.DoubleType()),
    T.StructField("client_avg_quantity", T.DoubleType()),
    T.StructField("client_price_volatility", T.DoubleType()),
    T.StructField("client_relative_price", T.DoubleType()),
    T.StructField("client_first_order", T.DateType()),
    T.StructField("client_last_order", T.DateType()),
    T.StructField("client_seniority_years", T.DoubleType()),
    T.StructField("client_recency_days", T.IntegerType()),
    T.StructField("client_price_elasticity", T.DoubleType()),
    T.StructField("elasticity_status", T.StringType()),
])

RUN_LEDGER = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("succeeded", T.BooleanType()),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("rows", T.LongType()),
    T.StructField("retries", T.LongType()),
    T.StructField("error", T.StringType()),
])
