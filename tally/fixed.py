"""Fixed values the results depend on: vocabularies, codes, scales and labels.

Everything here is data, stated plainly and in one place; the rules live in the
other modules and take these values as defaults.
"""

# --- scan ---------------------------------------------------------------------

# Text a CSV reader treats as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- text ---------------------------------------------------------------------

# Characters str.strip() removes, so padding rules agree with it.
WHITESPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Recoverable double encodings and the character they stand for.
MOJIBAKE = {
    "Ã©": "é",
    "Ã«": "ë",
    "Ã¼": "ü",
    "Ã¶": "ö",
    "Ã±": "ñ",
    "Ã§": "ç",
    "Ã¸": "ø",
    "â€™": "'",
}

# Marks left by an encoding loss that cannot be undone.
LOSSY_MARKS = ("?", "\ufffd")

# Placeholder words, compared trimmed and lower-cased.
PLACEHOLDERS = ("n/a", "na", "null", "-", "", "unknown", ".", "nan", "none")

# Characters that cannot be part of a name.
JUNK = "[]&#~!@$%^*{}|\\<>=+_/"

# --- values -------------------------------------------------------------------

# Numbers that mean "no score", in every spelling they arrive in.
SENTINELS = ("999", "999.0", "-1", "-1.0", "9999", "9999.0")

# Mark meaning "not attempted" in an item column.
NOT_ATTEMPTED = 9

# Code vocabularies, canonical form and its spellings.
CODES = {
    "gender": {
        "M": ("M", "m", "Male", "MALE", "1"),
        "F": ("F", "f", "Female", "FEMALE", "2"),
        "X": ("X", "Other", "Unspecified", "9"),
    },
    "participation": {
        "P": ("P", "Present", "PARTICIPATED"),
        "A": ("A", "Absent", "ABS"),
        "E": ("E", "Exempt"),
        "W": ("W", "Withdrawn"),
        "R": ("R", "Refused"),
        "X": ("X", "Not attempted"),
    },
    "domain": {
        "Reading": ("Reading", "reading", "READ", "RD"),
        "Numeracy": ("Numeracy", "numeracy", "NUM", "Maths"),
        "Spelling": ("Spelling", "spelling", "SPELL", "SP"),
        "Grammar and Punctuation": (
            "Grammar and Punctuation", "grammar_and_punctuation",
            "Grammar & Punctuation", "GANDP", "G&P",
        ),
        "Writing": ("Writing", "writing", "WRIT", "WR"),
    },
}

# --- test layout --------------------------------------------------------------

YEAR_LEVELS = (3, 5, 7, 9)

# Domain and its number of items (criteria for Writing).
DOMAIN_ITEMS = {
    "Reading": 8,
    "Numeracy": 8,
    "Spelling": 6,
    "Grammar and Punctuation": 6,
    "Writing": 10,
}

# Item header = prefix, level, Q, question number.
ITEM_HEADER = r"^([NRL])(\d+)Q(\d+)$"

# Header prefix, first and last question of each domain.
ITEM_BLOCKS = {
    "Numeracy": ("N", 0, None),
    "Reading": ("R", 0, None),
    "Spelling": ("L", 1, 6),
    "Grammar and Punctuation": ("L", 26, 31),
}

# Criterion columns of a writing feed.
WRITING_CRITERIA = (
    "wr_audience", "wr_text_structure", "wr_ideas", "wr_persuasive_devices",
    "wr_vocabulary", "wr_cohesion", "wr_paragraphing", "wr_sentence_structure",
    "wr_punctuation", "wr_spelling",
)

# --- scale --------------------------------------------------------------------

# Floor of the lowest level, its rise per level, span, steepness.
SCALE_BASE = 250.0
SCALE_BASE_LEVEL = 3
SCALE_STEP = 45.0
SCALE_SPAN = 260.0
SCALE_STEEPNESS = 6.0

# Points added to a domain's floor.
DOMAIN_OFFSETS = {
    "Reading": 15.0,
    "Numeracy": 35.0,
    "Spelling": 0.0,
    "Grammar and Punctuation": -10.0,
    "Writing": -30.0,
}

# Band and the points above the level's floor where it starts.
BANDS = {
    "Needs Additional Support": None,
    "Developing": 60.0,
    "Approaching Expectations": 110.0,
    "Strong": 165.0,
    "Exceeding": 215.0,
}

# --- schools ------------------------------------------------------------------

# Administrative codes and the home-schooling code, not schools.
NON_SCHOOL_IDS = ("00000", "99999", "REGION-A", "REGION-B", "unassigned", "88000")

# --- screening ----------------------------------------------------------------

# Words no read-only statement contains.
FORBIDDEN_WORDS = (
    "insert", "update", "delete", "drop", "create", "alter", "truncate",
    "merge", "grant", "revoke", "attach", "detach", "pragma",
    "copy", "install", "load", "export", "import", "call", "set",
)

# --- labels -------------------------------------------------------------------

# Abbreviations in column names and how they read.
LABEL_WORDS = {
    "avg": "Average",
    "num": "Numeracy",
    "n": "Count",
    "id": "ID",
    "dob": "Date of Birth",
    "pct": "Percent",
    "std": "Std. Dev.",
    "min": "Minimum",
    "max": "Maximum",
    "sd": "Std. Dev.",
}

# Rules shown as headline tiles, in this order.
HEADLINE_RULES = {
    "canonicalise_code": "Codes canonicalised",
    "recode_sentinels": "Score sentinels → null",
    "repair_mojibake": "Names repaired",
    "zero_refused_scores": "Refused scores zeroed",
    "drop_exact_duplicates": "Duplicate rows dropped",
    "parse_dates": "Dates parsed to ISO",
}
