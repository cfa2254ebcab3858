"""Fixed reference values and their small lookup frames.

Everything here is bounded by the program text, so these are the only frames
the library marks for broadcast without looking at their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values ----------------------------------------------------------
EUR_RATE = 38.28
MIN_VALID_PRICE = 1000
OTA_MULTIPLIER = 3.5
NIGHTS_PER_MONTH = 30
REMOVED_AFTER_MISSING_SCANS = 3
MIN_SCAN_COVERAGE = 0.5
DETAIL_REFRESH_DAYS = 7
STUCK_AFTER_HOURS = 12
LOCAL_TZ = "Asia/Bangkok"
LAT_BOX = (5.0, 21.0)
LON_BOX = (97.0, 106.0)
FUZZ_MIN_M = 100
FUZZ_MAX_M = 300
METRES_PER_DEGREE = 111_320
PER_PAGE = 30
MAX_LIMIT = 500
MAX_OFFSET = 100_000
HASH_DISTANCE_THRESHOLD = 6
MIN_CLUSTER_SIZE = 3
WINDOW_SECONDS = 60
ANONYMOUS_MAX_PER_MINUTE = 60
AUTHENTICATED_MAX_PER_MINUTE = 300
LOGIN_WINDOW_SECONDS = 15 * 60
LOGIN_MAX_FAILURES = 5
POPUP_MAX_PHOTOS = 10
POPUP_MAX_CHIPS = 6
TEASER_MAX_CHIPS = 5
UTILITY_SLUGS = ("agreements", "contact", "privacy", "packages", "nearby-apartment", "nearby-short-term-rental")

PROVINCE_SLUGS = {
    "Amnat Charoen": "amnat-charoen", "Ang Thong": "angthong", "Bangkok": "bangkok",
    "Bueng Kan": "bueng-kan", "Buri Ram": "buri-ram", "Chachoengsao": "chachoengsao",
    "Chai Nat": "chainat", "Chaiyaphum": "chaiyaphum", "Chanthaburi": "chanthaburi",
    "Chiang Mai": "chiang-mai", "Chiang Rai": "chiang-rai", "Chonburi": "chonburi",
    "Chumphon": "chumphon", "Kalasin": "kalasin", "Kamphaeng Phet": "kamphaeng-phet",
    "Kanchanaburi": "kanchanaburi", "Khon Kaen": "khon-kaen", "Krabi": "krabi",
    "Lampang": "lamphang", "Lamphun": "lamphun", "Loei": "loei", "Lopburi": "lopburi",
    "Mae Hong Son": "mae-hong-son", "Maha Sarakham": "maha-sarakham", "Mukdahan": "mukdahan",
    "Nakhon Nayok": "nakhon-nayok", "Nakhon Pathom": "nakhon-pathom", "Nakhon Phanom": "nakhon-phanom",
    "Nakhon Ratchasima": "nakhon-ratchasima", "Nakhon Sawan": "nakhon-sawan",
    "Nakhon Si Thammarat": "nakhon-sri-thammarat", "Nan": "nan", "Narathiwat": "narathiwat",
    "Nong Bua Lam Phu": "nong-bua-lam-phu", "Nong Khai": "nongkai", "Nonthaburi": "nonthaburi",
    "Pathum Thani": "pathumthani", "Pattani": "pattani", "Phang Nga": "phangnga",
    "Phatthalung": "phatthalung", "Phayao": "phayao", "Phetchabun": "phetchabun",
    "Phetchaburi": "petchburi", "Phichit": "phichit", "Phitsanulok": "phitsanulok",
    "Phra Nakhon Si Ayutthaya": "phra-nakhon-sri-ayutthaya", "Phrae": "phrae", "Phuket": "phuket",
    "Prachin Buri": "prachinburi", "Prachuap Khiri Khan": "prachaubkirikhan", "Ranong": "ranong",
    "Ratchaburi": "ratchburi", "Rayong": "rayong", "Roi Et": "roi-et", "Sa Kaeo": "srakaeo",
    "Sakon Nakhon": "sakon-nakhon", "Samut Prakan": "samut-prakarn", "Samut Sakhon": "samut-sakhon",
    "Samut Songkhram": "samut-songkram", "Saraburi": "saraburi", "Satun": "satun",
    "Si Sa Ket": "si-sa-ket", "Sing Buri": "singburi", "Songkhla": "songkhla", "Sukhothai": "sukhothai",
    "Suphan Buri": "suphanburi", "Surat Thani": "surat-thani", "Surin": "surin", "Tak": "tak",
    "Trang": "trang", "Trat": "trat", "Ubon Ratchathani": "ubon-ratchathani", "Udon Thani": "udon-thani",
    "Uthai Thani": "uthai-thani", "Uttaradit": "uttaradit", "Yala": "yala", "Yasothon": "yasothon",
}

CITY_MERGE = {
    "Songkhla": "Surat Thani",
    "Nakhon Sri Thammarat": "Surat Thani",
    "Yala": "Surat Thani",
    "Krabi": "Phuket",
    "Ranong": "Phuket",
    "Prachaubkirikhan": "Ratchburi",
    "Petchburi": "Ratchburi",
    "Samut Songkram": "Samut Sakhon",
    "Suphanburi": "Nakhon Pathom",
    "Lopburi": "Phra Nakhon Sri Ayutthaya",
    "Saraburi": "Phra Nakhon Sri Ayutthaya",
    "Nakhon Nayok": "Pathumthani",
    "Prachinburi": "Chachoengsao",
    "Chonburi": "Pattaya",
    "Phitsanulok": "Lamphang",
    "Phrae": "Lamphang",
    "Lamphun": "Chiang Mai",
    "Udon Thani": "Khon Kaen",
    "Nong Bua Lam Phu": "Khon Kaen",
    "Maha Sarakham": "Khon Kaen",
    "Sakon Nakhon": "Khon Kaen",
    "Roi Et": "Khon Kaen",
    "Surin": "Nakhon Ratchasima",
    "Chaiyaphum": "Nakhon Ratchasima",
    "Buri Ram": "Nakhon Ratchasima",
    "Ubon Ratchathani": "Nakhon Ratchasima",
    "Yasothon": "Nakhon Ratchasima",
    "Amnat Charoen": "Nakhon Ratchasima",
}

DISTRICT_AS_CITY = {
    "Bang Lamung": "Pattaya",
    "Ko Samui": "Ko Samui",
    "Hua Hin": "Hua Hin",
    "Ko Phangan": "Ko Phangan",
}

CITY_REGION = {
    "Bangkok": "Centre",
    "Pathumthani": "Centre",
    "Samut Prakarn": "Centre",
    "Nonthaburi": "Centre",
    "Nakhon Pathom": "Centre",
    "Samut Sakhon": "Centre",
    "Phra Nakhon Sri Ayutthaya": "Centre",
    "Ratchburi": "Centre",
    "Hua Hin": "Centre",
    "Chiang Mai": "Nord",
    "Lamphang": "Nord",
    "Chiang Rai": "Nord",
    "Khon Kaen": "Nord-Est",
    "Nakhon Ratchasima": "Nord-Est",
    "Pattaya": "Est",
    "Rayong": "Est",
    "Chachoengsao": "Est",
    "Chanthaburi": "Est",
    "Phuket": "Sud",
    "Surat Thani": "Sud",
    "Ko Samui": "Sud",
    "Ko Phangan": "Sud",
}

FEATURED_CITIES = (
    "Bangkok", "Pattaya", "Chiang Mai", "Phuket", "Hua Hin",
    "Ko Samui", "Ko Phangan", "Udon Thani", "Krabi",
)

LOCATION_FILTERS = {
    "bangkok": ("province", "Bangkok"),
    "phuket": ("province", "Phuket"),
    "chiang_mai": ("province", "Chiang Mai"),
    "pattaya": ("district", "Bang Lamung"),
}

BUDGET_RANGES = {
    "under_10k": (None, 5742),
    "10k_20k": (5742, 11484),
    "20k_30k": (11484, 19140),
    "30k_plus": (19140, None),
}

DURATION_FIELDS = {
    "1 mois": "contract_monthly",
    "3 mois": "contract_3_month",
    "6 mois": "contract_6_month",
}

CARD_CATEGORIES = ("Desk", "In-room WIFI", "Smoking", "Pool", "Fitness", "Convenient Store")

LINE_ID_PLACEHOLDERS = (
    "unavailable", "n/a", "na", "none", "null", "no line", "nolineid",
    "-", "--", "---", ".", "x", "xx", "xxx", "ไม่มี",
)

LINE_ID_LABEL = r"(?i)^(?:line\s*id|line|phone|tel|โทร)\s*[:：]\s*|^(?:phone|tel|โทร)\s*(?=\d)"

# name -> (any of these, none of these), on lower-cased text
AMENITY_PATTERNS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Air Conditioner": (
        (r"air[\s-]*condition(?:er|ing)?", r"air[\s-]*con\b", r"\baircon\b", r"\bA/?C\b",
         r"แอร์", r"เครื่องปรับอากาศ"),
        (r"no\s*air[\s-]*condition", r"no\s*aircon", r"no\s*air[\s-]*con\b", r"without\s*air[\s-]*con",
         r"air[\s-]*condition(?:er|ing)?\s*:\s*no\b",
         r"ไม่มีแอร์", r"ไม่ติดแอร์", r"ไม่มีเครื่องปรับอากาศ"),
    ),
    "Furnished": ((r"furnished", r"fully\s*furnish"), (r"un-?furnished", r"not\s*furnished")),
    "Water Heater": ((r"water\s*heater",), (r"no\s*water\s*heater",)),
    "Fan": ((r"\bfan\b",), (r"no\s*fan\b",)),
    "Television": ((r"television", r"\btv\b"), (r"no\s*tv\b", r"no\s*television")),
    "Refrigerator": ((r"refrigerator", r"\bfridge\b"), (r"no\s*fridge", r"no\s*refrigerator")),
    "Sofa": ((r"\bsofa\b",), ()),
    "Desk": ((r"\bdesk\b",), ()),
    "Kitchen Stove": ((r"kitchen\s*stove", r"\bstove\b", r"induction\s*(?:cooker|stove)"), ()),
    "Phone": ((r"land\s*line", r"telephone"), ()),
    "In-room WIFI": ((r"wi-?fi",), (r"no\s*wi-?fi",)),
    "Cable TV": ((r"cable\s*tv",), ()),
    "Pets": ((r"\bpets?\b", r"pet[\s-]*friendly"), (r"no\s*pets?\b", r"pets?\s*not\s*allowed")),
    "Smoking": (
        (r"\bsmoking\b", r"\bsmoker\b"),
        (r"no[\s-]*smoking", r"non[\s-]*smoking", r"smoking\s*(?:is\s*)?not\s*(?:allowed|permitted)", r"🚭"),
    ),
    "Parking": ((r"\bparking\b", r"car\s*park"), (r"no\s*parking",)),
    "Bicycle Parking": ((r"bicycle\s*park", r"bike\s*park"), ()),
    "Lift": ((r"\blift\b", r"\belevator\b"), ()),
    "Pool": ((r"\bpool\b", r"swimming\s*pool"), (r"no\s*(?:swimming\s*)?pool", r"without\s*(?:a\s*)?pool")),
    "Fitness": ((r"fitness", r"\bgym\b"), ()),
    "Security keycard": ((r"key\s*card", r"keycard"), ()),
    "Security finger print": ((r"finger\s*print", r"fingerprint"), ()),
    "CCTV": ((r"\bcctv\b", r"security\s*camera"), ()),
    "Security": ((r"\bsecurity\b", r"security\s*guard"), ()),
    "Restaurant/Food Shop": ((r"restaurant", r"food\s*shop"), ()),
    "Convenient Store": (
        (r"convenient\s*store", r"convenience\s*store", r"mini\s*mart", r"7-?eleven"), (),
    ),
    "Laundry": ((r"laundry", r"washing\s*machine"), ()),
    "Beauty Salon in Building": ((r"beauty\s*salon",), ()),
    "EV Charger": ((r"ev\s*charger", r"electric\s*vehicle\s*charg"), ()),
}
# ---- end of fixed values ---------------------------------------------------

AMENITY_ORDER = tuple(AMENITY_PATTERNS)


def display_name(slug: str) -> str:
    """How a place is shown: the words of its slug, capitalised."""
    return " ".join(word.capitalize() for word in slug.split("-"))


# In texts the longest name that fits is the one meant.
PROVINCE_NAMES = tuple(sorted(map(display_name, PROVINCE_SLUGS.values()), key=lambda name: -len(name)))


def literal_map(mapping: dict[str, str]) -> Column:
    """A constant map column; folded once, looked up without a join."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def province_frame(spark: SparkSession) -> DataFrame:
    """The 77 provinces: official name, source slug, display name."""
    rows = [(official, slug, display_name(slug)) for official, slug in PROVINCE_SLUGS.items()]
    return spark.createDataFrame(rows, "official_name string, province_slug string, display_name string")


def budget_frame(spark: SparkSession) -> DataFrame:
    rows = [(k, lo, hi) for k, (lo, hi) in BUDGET_RANGES.items()]
    return spark.createDataFrame(rows, "budget string, budget_min bigint, budget_max bigint")


def location_frame(spark: SparkSession) -> DataFrame:
    rows = [(k, c, v) for k, (c, v) in LOCATION_FILTERS.items()]
    return spark.createDataFrame(rows, "location string, filter_column string, filter_value string")
