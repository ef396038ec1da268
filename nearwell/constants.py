"""Thresholds, vocabularies, formats and phrase lists that results depend on."""

# India bounding box (degrees) and Earth radius (km).
INDIA = {"lat": (6.0, 37.6), "lng": (68.0, 97.6)}
EARTH_KM = 6371.0

# Facility-type vocabulary of the source directory.
FACILITY_TYPES = ["hospital", "clinic", "dentist", "doctor", "pharmacy", "farmacy", "nursing_home"]

# Coordinate validation.
CITY_KM = 80.0
CITY_MIN_FACILITIES = 5
GEOCODE_KM = 15.0
GPS_KM = 40.0

# Hybrid score weights, capacity scales and search limits.
WEIGHT_SIMILARITY = 0.60
WEIGHT_DISTANCE = 0.25
WEIGHT_BEDS = 0.10
WEIGHT_DOCTORS = 0.05
BEDS_SCALE = 200.0
DOCTORS_SCALE = 30.0
MIN_SIMILARITY = 0.4
MAX_LIMIT = 50
OVERFETCH = 3
KM_PER_DEGREE = 111.0

# Evidence.
LEXICAL_MIN_SIMILARITY = 0.12
LEXICAL_TOP = 3
GROUNDING_TOP = 12
SEPARATOR = " • "
REASON_CHARS = 220
SUSPECT_NAMES = ["dental", "eye", "ophthal", "diagnostic", "pathology", "physiother"]
SUSPECT_TERMS = ["bypass", "transplant", "open heart", "neurosurg", "cardiac surg", "cancer surg"]

# Registry matching thresholds.
PIN_THRESHOLD = 0.40
CITY_THRESHOLD = 0.62

# Emergency vocabulary (patterns, matched case-insensitively).
EMERGENCY_WORDS = [
    "emergency", "heart attack", "cardiac arrest", "chest pain", "stroke", "unconscious",
    "not breathing", "can'?t breathe", "difficulty breathing", "severe bleeding",
    "bleeding heavily", "haemorrhage", "hemorrhage", "accident", "trauma", "seizure",
    "convulsion", "overdose", "poisoning", "snake ?bite", "choking", "drowning",
]
EMERGENCY_PHRASES = [
    "दिल का दौरा", "दौरा पड़", "साँस नहीं", "सांस नहीं", "बेहोश", "खून बह", "दुर्घटना",
    "आपातकाल", "হার্ট অ্যাটাক", "അത്യാഹിതം", "saans nahi", "behosh", "dil ka daura",
]

# Language code to speech locale.
SPEECH_LOCALES = {
    "hi": "hi-IN", "bn": "bn-IN", "ta": "ta-IN", "te": "te-IN", "mr": "mr-IN", "gu": "gu-IN",
    "kn": "kn-IN", "ml": "ml-IN", "pa": "pa-IN", "ur": "ur-IN", "en": "en-IN",
}

# Match label, link formats and reply texts.
RELATED_BELOW = 0.55
DIRECTIONS_TO_POINT = "https://www.google.com/maps/dir/?api=1&destination="
DIRECTIONS_BY_NAME = "https://www.google.com/maps/search/?api=1&query="
SHARE_LINK = "https://wa.me/?text="
ASK_SEARCH = "Tell me a care need and a place, e.g. 'dialysis near Patna' / 'पटना के पास डायलिसिस'."
ASK_CHAT = ('Which care need and where? e.g. "dialysis near Patna", a 6-digit PIN, '
            "or tap 📍 to use your location.")

# Prompts of the model request tables.
PARSE_PROMPT = (
    "You convert a patient's health-facility search message (in ANY language) into JSON.\n"
    'Output ONLY compact JSON: {"need":"<care need in English>","place":"<city/place name in '
    'English>","lang":"<ISO 639-1 code of the input language>"}.\n'
    "Translate and transliterate place names to their common English spelling.\n"
    "You may be given the PREVIOUS need/place as context — if the new message omits the need or "
    'the place (e.g. "what about Jaipur?" or "any cheaper options?"), inherit the missing value '
    "from the context.\n"
    'If no place is known, use "" for place. No prose, no markdown.'
)
GROUND_PROMPT = (
    "You check which of a facility's listed medical services genuinely support a patient's stated "
    "need.\nFor each facility id, return ONLY the listed services (verbatim from the input) that "
    "clearly support the need.\nBe strict: if none clearly support it, return an empty array — do "
    "not include loosely-related services.\nOutput ONLY compact JSON: "
    '{"<facility_id>": ["service", ...], ...}. No prose, no markdown.'
)
LOCALIZE_PROMPT = (
    "Translate the string values of the given JSON into the language given as "
    '"target=<ISO code>".\nKeep proper nouns (hospital names, place names) and all numbers '
    "unchanged. Output ONLY the same JSON shape, nothing else."
)

# Request parameter ranges, shortlist states, text cut-offs.
RADIUS_RANGE = (1.0, 500.0)
LIMIT_RANGE = (1, 50)
OPERATORS = ["public", "private"]
ITEM_STATUSES = ["candidate", "contacted", "referred", "rejected"]
NEED_CHARS = 120
PLACE_CHARS = 80

# Session, retention and price assumptions (USD).
IDLE_MINUTES = 30
RETENTION_DAYS = 90
PRICE_PER_MTOK = {"embed": 0.10, "llm": 1.50}
PRICE_PER_HOUR = {"database": 0.50, "app": 0.10}
HOURS_PER_MONTH = 730
DAYS_PER_MONTH = 30

# Registry documents and registry CSV layout.
LISTING_HREF_PREFIX = "https://cdnbbsr"
REGISTRY_COLUMNS = ["source", "registry_name", "city", "state", "pincode", "facility_type",
                    "services", "accredited"]
