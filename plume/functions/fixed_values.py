"""Fixed values.

These values must equal the reference's for the labels to come out the same.
They are stated here once, plainly and in their natural order; everything
else in the package derives from them.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference exactly; order is significant:
# category order decides ties, brand order decides the order of tags)
# ---------------------------------------------------------------------------

CATEGORY_KEYWORDS = {
    "makeup": [
        "makeup", "cosmetic", "foundation", "concealer", "primer", "blush", "bronzer",
        "highlighter", "powder", "setting spray", "lipstick", "lip gloss", "lip liner", "lip stain",
        "mascara", "eyeliner", "eyeshadow", "brow pencil", "fake lashes", "beauty blender",
    ],
    "skincare": [
        "skincare", "cleanser", "toner", "moisturizer", "lotion", "cream", "serum",
        "essence", "sunscreen", "sunblock", "spf", "sheet mask", "clay mask",
        "exfoliator", "peel", "retinol", "hyaluronic acid", "niacinamide", "vitamin c",
        "collagen", "peptide", "anti-aging", "acne", "blemish",
    ],
    "haircare": [
        "shampoo", "conditioner", "haircare", "hair mask", "hair oil", "hairspray",
        "mousse", "gel", "dry shampoo", "heat protectant", "keratin", "leave-in",
        "scalp treatment", "hair treatment",
    ],
    "haircolor": [
        "hair color", "hair dye", "dyeing", "bleach", "highlights", "roots", "box dye",
        "color-treated", "toner",
    ],
    "fragrance": [
        "fragrance", "perfume", "cologne", "eau de toilette", "scent",
    ],
}

BRANDS = [
    "loreal", "l'oréal", "maybelline", "garnier", "nyx", "lancôme",
    "kiehl's", "cerave", "infallible", "elvive",
]

NO_BRAND = "Brand Not Specified"
UNLABELED = "unlabeled"
NOT_APPLICABLE = "[Not Applicable]"
SENTIMENT_FILL = "others"
PRODUCT_RELATED = "Product Related"
NOT_PRODUCT_RELATED = "Not Product Related"
SENTIMENTS = ["positive", "neutral", "negative"]

# Engagement columns of the enriched comment table; a missing one is added as 0.
NUMERIC_COLUMNS = ["likeCount_comment", "likeCount_video", "favouriteCount", "commentCount"]

# CSV cells read as missing: pandas' documented default ``na_values``.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# Cards per list, tokens per encoded text.
TOP_K = 5
MAX_TOKENS = 128


# ---------------------------------------------------------------------------
# Derived views of the fixed values (not additional constants)
# ---------------------------------------------------------------------------

def lexicon_rows():
    """(kw_id, cat_rank, category, keyword) in listed order."""
    rows, kw_id = [], 0
    for cat_rank, (category, words) in enumerate(CATEGORY_KEYWORDS.items()):
        for word in words:
            rows.append((kw_id, cat_rank, category, word))
            kw_id += 1
    return rows


CATEGORIES = list(CATEGORY_KEYWORDS)
