"""Fixed values that must equal the original matcher's for equal results.

Everything in this module is data, written out plainly in the order the
original uses it. Derived forms (live keyword set, regex alternations) are
computed from these lists, never hand-edited.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (name normalisation patterns, applied case-insensitively)
# ---------------------------------------------------------------------------
SALUTATION_PATTERN = r"^(shree|shri|miss|smt|mrs|mr|ms|dr|master|hon|sir|madam|prof|capt|major|rev|fr|br)\s*"

PARENT_SPOUSE_PATTERN = (r"\s*(?:s/o|d/o|w/o|so|do|wo|daughter of|son of|wife of|husband of|"
                         r"daughter|son|child of)\s*[\w\s,.]*$")

MOHAMMAD_VARIANTS_PATTERN = (
    r"\b(mohammad|mohammed|muhamed|mohd|mohamed|mohamad|muhamad|muhammad|muhammed|muhammet|"
    r"mohamud|mohummad|mohummed|mouhamed|muhamaad|mohammod|mouhamad|mo|md|mahmood|mahmud|ahmad|"
    r"ahmed|hameed|hamid|hammed|mahd|mahmod|mohd|mouhammed|mohamad|muhmood|mohhammed|muhmamed|"
    r"mohmed|mohmat|muhmat|mu|m|shaikh|mo)\b")

AGARWAL_VARIANTS_PATTERN = r"\b(aggarwal|agrawal|agarwal|aggrawal|agarwalla|agarwal)\b"

SPECIAL_CHARS_CLASS = r"[-+.^:,_/\s]+"

# single-character phonetic map, applied one after the other
CHAR_MAP = [("e", "i"), ("j", "z"), ("v", "w"), ("q", "k")]

# two-character phonetic map, applied one after the other (order matters)
BIGRAM_MAP = [("ph", "f"), ("gh", "g"), ("th", "t"), ("kh", "k"), ("dh", "d"), ("ch", "c"),
              ("sh", "s"), ("au", "o"), ("bh", "b"), ("ks", "x"), ("ck", "k"), ("ah", "h"),
              ("wh", "w"), ("wr", "r")]

# an 'a' whose original predecessor is one of these is dropped
CONSONANTS = "bcdfghjklmnpqrstvwxyz"

# stop words, compared with the lower-cased word (mixed-case entries never match)
STOP_WORDS_BATCH = ["devi", "dei", "debi", "kumar", "kumaar", "kumari", "kumaari", "kmr", "kumr",
                    "bhai", "bhau", "bai", "ben", "singh", "kaur", "Md", "Mohd", "Mohammad",
                    "Mohamad", "alam", "shekh"]
STOP_WORDS_API = ["devi", "dei", "debi", "kmr", "kumr", "bhai", "bhau", "bai", "ben", "kaur", "Md",
                  "Mohd", "Mohammad", "Mohamad", "alam", "shekh", "sek"]

# ---------------------------------------------------------------------------
# FIXED VALUES (business keywords; a name "has a keyword" if any entry is a
# substring of the lower-cased name). Listed as the original evaluates its
# list: three pairs of adjacent literals without a comma fuse into one entry
# ("amalepoultry", "projectsupermart", "mobilebrokerage").
# ---------------------------------------------------------------------------
KEYWORDS = [
    "traders", "trading", "enterprise", "garments", "collection", "food", "clothes",
    "glass", "fittings", "digital", "kirana", "medical", "agency", "tex",
    "security", "systems", "badges", "hospitality", "jewellers", "lic", "agent",
    "ready-made", "store", "hospital", "restaurant", "auto", "center",
    "dairy", "home", "products", "services", "furniture", "hardware",
    "pharmacy", "stationery", "treatments", "nutrition", "wellness",
    "sweets", "resort", "kitchen", "clothing", "market", "workshop", "agency", "consumer",
    "amalepoultry", "seeds", "pesticides", "sales", "cafe", "clinic",
    "projectsupermart", "distributors", "automobiles", "electricity",
    "electronics", "general", "provision", "fertilizers", "agriculture",
    "beverages", "textiles", "plumbing", "supplies", "handicrafts",
    "construction", "medical", "bakery", "tissue", "cleaning",
    "appliances", "homecare", "kitchenware", "decor", "glass and fittings",
    "interiors", "shopping", "crafts", "tools", "wholesale",
    "retail", "outlet", "merchants", "trade", "distribution",
    "solutions", "innovation", "consultancy", "services", "equipment",
    "manufacturing", "exports", "imports", "packaging", "network",
    "consultants", "transport", "moving", "storage", "logistics",
    "construction", "real estate", "distributor", "wines", "hardware",
    "plywood", "company", "craft", "soda", "station",
    "mobilebrokerage", "management", "handloom", "co.", "tvs",
    "finance", "investment", "funding", "support", "technology",
    "software", "applications", "digital marketing", "advertising",
    "communication", "entertainment", "events", "tourism", "travel",
    "transportation", "automotive", "services", "supply chain",
    "fashion", "cosmetics", "beauty", "spa", "wellness", "glass and fitting",
    "personal care", "gifts", "custom", "specialty", "craftsmanship",
    "fashions", "motors", "enterprises", "garment", "cloth centre", "mart",
    "foods", "silk and readymade", "wool centre", "jewellery", "mill",
    "farms", "farm", "electrical", "egg centre", "centre",
    "vegetable and fruits", "vegetables", "fruits", "pvt", "pvt ltd",
    "limited", "solutions", "energies", "photo", "studio", "works",
    "associates", "medico", "agencies", "diagnosis", "cool drinks",
    "drinks", "care", "liquor", "automobiles", "materials", "diagnostics",
    "provision", "trader", "farms", "farm", "stations", "restaurant",
    "creations", "travels", "hardware", "printers", "graphics",
    "fertilisers", "house", "studio", "private", "appliances", "steels",
    "shop", "metals", "international", "jwellers", "corporation",
    "dresses", "industries", "electricals", "company", "lim", "colddrinks",
    "electron", "medicines", "llc", "computers", "hotel", "spa",
    "cosmetics", "telecom", "sarees", "petroleums", "bhandar", "store", "stores",
    "surgical", "wines", "constructions", "shoppy", "lab", "builders",
    "footwear", "wear", "shoe", "repair", "ventures", "paint", "depot", "cake", "chinies",
    "tent", "decorators", "communications", "pharmacy", "products", "textile", "CERAMIC",
    "Pharmaceuticals", "stores", "sons",
]

# ---------------------------------------------------------------------------
# FIXED VALUES (thresholds and layer-2 weights)
# ---------------------------------------------------------------------------
LAYER1_THRESHOLD_BATCH = 0.75
LAYER1_THRESHOLD_API = 0.80
LAYER2_THRESHOLD = 0.65
LAYER3_THRESHOLD = 0.75
LAYER2_WEIGHTS = {"embedding": 0.121630, "levenshtein": 0.205104, "phonetic": 0.022287,
                  "jaccard": 0.262775, "fuzzy": 0.388205}


#: Entries that the original list runs together, and the keywords they were meant to be.
FUSED_KEYWORDS = {
    "amalepoultry": ("amale", "poultry"),
    "projectsupermart": ("project", "supermart"),
    "mobilebrokerage": ("mobile", "brokerage"),
}


def live_keywords(fixed_keywords: bool = False) -> list[str]:
    """Keywords that can match a lower-cased name, minus those containing another.

    "Has any keyword as substring" is unchanged by dropping a keyword that
    contains a shorter live keyword, so the alternation stays small.
    """
    live = {k for k in KEYWORDS if k == k.lower()}
    if fixed_keywords:
        live = {part for k in live for part in FUSED_KEYWORDS.get(k, (k,))}
    return [k for k in sorted(live) if not any(o != k and o in k for o in live)]
