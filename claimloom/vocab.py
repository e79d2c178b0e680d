"""Closed vocabularies and fixed values.

Everything here is a fixed value that results depend on: enum members, score tables,
thresholds, word lists and patterns.  Bengali strings are stored composed the way NFKC
leaves them, which is the form the tokeniser compares against.
"""

from __future__ import annotations

import unicodedata


def _nfc(words: str) -> tuple[str, ...]:
    return tuple(unicodedata.normalize("NFC", w) for w in words.split())


# ---- fixed values: enums -------------------------------------------------------------

SUBMISSION_TYPES = (
    "TEXT", "ARTICLE_URL", "SOCIAL_URL", "IMAGE", "SCREENSHOT",
    "IMAGE_WITH_CAPTION", "VIDEO", "VIDEO_WITH_CAPTION",
)
VERDICTS = (
    "VERIFIED", "LIKELY_TRUE", "PARTLY_TRUE", "MISLEADING", "UNVERIFIED",
    "LIKELY_FALSE", "FALSE", "SATIRE", "OPINION",
)
NEGATIVE_VERDICTS = ("FALSE", "LIKELY_FALSE", "MISLEADING")
POSITIVE_VERDICTS = ("VERIFIED", "LIKELY_TRUE")
CONFIDENCE_BANDS = ("LOW", "MEDIUM", "HIGH")
CLAIM_TYPES = (
    "EVENT", "STATISTIC", "QUOTE", "ATTRIBUTION", "CAUSAL", "EXISTENCE",
    "IDENTITY", "LOCATION", "TEMPORAL", "PREDICTION", "OPINION", "OTHER",
)
UNCHECKABLE_CLAIM_TYPES = ("OPINION", "PREDICTION")
CLAIM_ORIGINS = (
    "USER_TEXT", "USER_CAPTION", "ARTICLE_TEXT", "SOCIAL_POST_TEXT",
    "VIDEO_TRANSCRIPT", "ON_SCREEN_TEXT", "OCR_TEXT",
)
RELATIONSHIPS = ("SUPPORTS", "CONTRADICTS", "NEUTRAL", "INSUFFICIENT")
PROVIDERS = ("INDEXED_CORPUS", "GDELT", "RSS_CORPUS", "DIRECT_URL", "OFFICIAL_SOURCE")

STAGE_SEQUENCE = (
    "NORMALIZING", "EXTRACTING_CONTENT", "ANALYZING_MEDIA", "DETECTING_LANGUAGE",
    "EXTRACTING_CLAIMS", "GENERATING_QUERIES", "RETRIEVING_EVIDENCE",
    "FETCHING_DOCUMENTS", "EXTRACTING_EVIDENCE", "CLASSIFYING_EVIDENCE",
    "SCORING", "GENERATING_REPORT",
)
STAGE_LABELS = {
    "QUEUED": "Queued",
    "NORMALIZING": "Understanding content",
    "EXTRACTING_CONTENT": "Reading submission",
    "DETECTING_LANGUAGE": "Detecting language",
    "EXTRACTING_CLAIMS": "Extracting claims",
    "GENERATING_QUERIES": "Planning searches",
    "RETRIEVING_EVIDENCE": "Searching evidence",
    "FETCHING_DOCUMENTS": "Reading sources",
    "EXTRACTING_EVIDENCE": "Extracting evidence",
    "CLASSIFYING_EVIDENCE": "Cross-checking evidence",
    "ANALYZING_MEDIA": "Analyzing media",
    "SCORING": "Calculating result",
    "GENERATING_REPORT": "Preparing report",
    "COMPLETED": "Completed",
    "FAILED": "Failed",
}
FATAL_STAGES = ("NORMALIZING", "EXTRACTING_CLAIMS", "SCORING", "GENERATING_REPORT")
DONE_STAGE_STATUSES = ("COMPLETED", "SKIPPED", "DEGRADED")

# ---- fixed values: scoring -----------------------------------------------------------

SOURCE_FACTORS = {
    "OFFICIAL_GOVERNMENT": 1.30,
    "PRIMARY_DOCUMENT": 1.30,
    "SCIENTIFIC_SOURCE": 1.25,
    "OFFICIAL_COMPANY": 1.20,
    "NEWS_AGENCY": 1.15,
    "NEWS_ORGANIZATION": 1.00,
    "SPECIALIST_PUBLICATION": 1.00,
    "BLOG": 0.70,
    "SOCIAL_MEDIA": 0.60,
    "USER_PROVIDED": 0.55,
    "UNKNOWN": 0.50,
}
SOURCE_TYPES = tuple(SOURCE_FACTORS)
PRIMARY_BONUS = 0.15
FACTOR_FLOOR, FACTOR_CEILING = 0.50, 1.30
PENALTIES = {
    "NUMERIC_MISMATCH": 0.45,
    "DATE_MISMATCH": 0.35,
    "LOCATION_MISMATCH": 0.35,
    "ENTITY_MISMATCH": 0.30,
    "STALE_MEDIA": 0.40,
    "EXAGGERATION": 0.25,
}
CLUSTER_DAMPING = 0.15
TARGET_ORIGINS = 3
MIN_WEIGHT = 0.45
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.70, 0.40
IMPORTANT = 0.7

# ---- fixed values: retrieval caps ----------------------------------------------------

RELEVANCE_FLOOR = 0.08
CANDIDATE_MIN_SCORE = 0.12
TITLE_GATE = 0.12
PASSAGE_MIN_RELEVANCE = 0.15
CANDIDATES_PER_PROVIDER = 40
DOCUMENTS_PER_CLAIM = 6
PASSAGES_PER_DOCUMENT = 3
FEEDS_PER_QUERY = 20
ENTRIES_PER_FEED = 60
LINKS_PER_PAGE = 20
MIN_HEADLINE = 20
MAX_ARTICLE_CHARS = 12_000
EXCERPT_CHARS = 2000
PASSAGE_MIN, PASSAGE_MAX = 60, 600
MAX_SENTENCES, MIN_SENTENCE = 25, 15

# ---- fixed values: usage log ---------------------------------------------------------

OPERATION_LIMITS = {
    "TEXT_SUBMISSION": 20,
    "URL_SUBMISSION": 20,
    "IMAGE_SUBMISSION": 10,
    "VIDEO_SUBMISSION": 3,
    "STATUS_POLL": 1200,
    "SEARCH": 120,
}
USAGE_WINDOW_SECONDS = 3600
JOB_TTL_SECONDS = 900
MAX_ATTEMPTS = 3
FEED_TTL_SECONDS = 600

# ---- fixed values: word lists --------------------------------------------------------

STOP_WORDS_EN = _nfc(
    "a an the and or but if then than that this these those of in on at to for with by from as "
    "is are was were be been being has have had do does did will would could should may might "
    "can it its his her their our your my we they he she you i not no nor so such only own same "
    "too very just about after before over under again further once here there when where why "
    "how all any both each few more most other some what which who whom"
)
STOP_WORDS_BN = _nfc(
    "এই সেই ওই এবং বা কিন্তু যদি তবে যে যা এর তার তাদের আমাদের আপনার আমার করে করা হয় হয়েছে হবে "
    "ছিল আছে নেই থেকে জন্য সঙ্গে দিয়ে নিয়ে পর আগে মধ্যে সব কিছু একটি একটা এক দুই তিন করেন বলে "
    "বলেছেন জানান জানিয়েছে হিসেবে সম্পর্কে ও তবু যদিও কারণ"
)
BENGALI_SUFFIXES = _nfc(
    "েরই দেরকে গুলোর গুলোতে টিতে টির দের গুলো গুলি রা কে তে য়ে ের ার টি টা খানা খানি েই ও"
)
LOW_INFORMATION = _nfc(
    "বাংলাদেশ বাংলাদেশে বাংলাদেশের সরকার সরকারের দেশে ঢাকা ঢাকায় মানুষ প্রধান কর্মকর্তা বিষয়ে "
    "ক্ষেত্রে অনুষ্ঠিত জানানো সংবাদ প্রতিবেদন "
    "bangladesh government official officials people country national report reports news dhaka "
    "minister ministry president authority authorities"
)


def _phrases(text: str) -> tuple[str, ...]:
    return tuple(unicodedata.normalize("NFC", p.strip()) for p in text.split(","))


NEGATION_EN = _phrases(
    "denied, denies, false, untrue, no evidence, not true, debunked, misleading, rumour, rumor, "
    "hoax, fabricated, did not, does not, was not, were not, never happened, incorrect, "
    "inaccurate, refuted, contradicts, no such, baseless, unfounded, misinformation, "
    "disinformation"
)
NEGATION_BN = _phrases(
    "অস্বীকার, গুজব, ভুয়া, মিথ্যা, ভিত্তিহীন, সত্য নয়, হয়নি, নয়, না, অসত্য, বিভ্রান্তিকর, "
    "প্রমাণ নেই, খণ্ডন, অপপ্রচার"
)
CONFIRMATION_EN = _phrases(
    "confirmed, announced, said, reported, according to, stated, verified, official, issued, "
    "declared, approved"
)
CONFIRMATION_BN = _phrases(
    "নিশ্চিত, ঘোষণা, জানিয়েছে, বলেছেন, প্রকাশ, অনুযায়ী, সিদ্ধান্ত, অনুমোদন, জারি"
)
MARKER_PUNCTUATION = " .,;:!?()[]{}\"'‘’“”।–—-"

ABBREVIATIONS = (
    "mr. mrs. ms. dr. prof. sr. jr. st. vs. inc. ltd. co. corp. u.s. u.k. e.g. i.e. etc. approx. "
    "est. no. fig. a.m. p.m."
).split()

SCALES = {
    "thousand": 1_000,
    "k": 1_000,
    "million": 1_000_000,
    "mn": 1_000_000,
    "billion": 1_000_000_000,
    "bn": 1_000_000_000,
    "trillion": 1_000_000_000_000,
    "lakh": 100_000,
    "crore": 10_000_000,
}

BENGALI_DIGITS = "০১২৩৪৫৬৭৮৯"

# ---- fixed values: hosts, addresses, media -------------------------------------------

SOCIAL_HOSTS = (
    "facebook.com fb.com instagram.com twitter.com x.com tiktok.com youtube.com youtu.be "
    "reddit.com threads.net linkedin.com mastodon.social bsky.app"
).split()
BLOCKED_HOSTS = (
    "localhost localhost.localdomain ip6-localhost ip6-loopback metadata "
    "metadata.google.internal metadata.goog instance-data instance-data.ec2.internal kubernetes "
    "kubernetes.default kubernetes.default.svc host.docker.internal gateway.docker.internal "
    "docker.for.mac.localhost"
).split()
BLOCKED_SUFFIXES = (
    ".localhost .local .internal .intranet .localdomain .svc .svc.cluster.local .cluster.local "
    ".ec2.internal"
).split()
BLOCKED_IPV4 = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 "
    "192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 "
    "240.0.0.0/4"
).split()
MAX_URL, MAX_HOST = 2048, 253
ALLOWED_PORTS = (80, 443)

MIME_EXTENSIONS = {
    "image/jpeg": "jpg",
    "image/png": "png",
    "image/gif": "gif",
    "image/webp": "webp",
    "video/mp4": "mp4",
    "video/quicktime": "mov",
    "video/webm": "webm",
    "video/x-matroska": "mkv",
}
# (offset, signature in hex, type), tried in this order
SIGNATURES = (
    (0, "FFD8FF", "image/jpeg"),
    (0, "89504E470D0A1A0A", "image/png"),
    (0, "474946383761", "image/gif"),
    (0, "474946383961", "image/gif"),
    (0, "52494646", "image/webp"),
    (4, "667479706D7034", "video/mp4"),
    (4, "6674797069736F6D", "video/mp4"),
    (4, "6674797069736F32", "video/mp4"),
    (4, "6674797061766331", "video/mp4"),
    (4, "667479706D6D7034", "video/mp4"),
    (4, "667479704D3456", "video/mp4"),
    (4, "667479707174", "video/quicktime"),
    (0, "1A45DFA3", "video/webm"),
)
MARKUP_MARKERS = ("<html", "<script", "<?php", "<%", "<!doctype html", "<svg")
MAX_IMAGE_BYTES, MAX_VIDEO_BYTES = 15 * 1024 * 1024, 200 * 1024 * 1024

GENERATORS = (
    ("stable diffusion", "Stable Diffusion"),
    ("stablediffusion", "Stable Diffusion"),
    ("midjourney", "Midjourney"),
    ("dall-e", "DALL-E"),
    ("dalle", "DALL-E"),
    ("openai", "OpenAI"),
    ("firefly", "Adobe Firefly"),
    ("adobe firefly", "Adobe Firefly"),
    ("imagen", "Google Imagen"),
    ("gemini", "Google Gemini"),
    ("flux", "FLUX"),
    ("leonardo.ai", "Leonardo AI"),
    ("nightcafe", "NightCafe"),
    ("novelai", "NovelAI"),
    ("comfyui", "ComfyUI"),
    ("automatic1111", "AUTOMATIC1111"),
    ("invokeai", "InvokeAI"),
    ("craiyon", "Craiyon"),
    ("bing image creator", "Bing Image Creator"),
    ("grok", "Grok"),
)
EDITORS = (
    "photoshop", "lightroom", "gimp", "affinity", "capture one", "snapseed", "picsart", "canva",
    "figma", "pixlr",
)

# category, domain, name, source type
PRIMARY_SOURCES = (
    ("earthquake", "usgs.gov", "United States Geological Survey", "SCIENTIFIC_SOURCE"),
    ("earthquake", "emsc-csem.org", "European-Mediterranean Seismological Centre", "SCIENTIFIC_SOURCE"),
    ("weather", "bmd.gov.bd", "Bangladesh Meteorological Department", "OFFICIAL_GOVERNMENT"),
    ("government_bd", "bangladesh.gov.bd", "Government of Bangladesh", "OFFICIAL_GOVERNMENT"),
    ("government_bd", "pmo.gov.bd", "Prime Minister's Office", "OFFICIAL_GOVERNMENT"),
    ("government_bd", "mopa.gov.bd", "Ministry of Public Administration", "OFFICIAL_GOVERNMENT"),
    ("education_bd", "dshe.gov.bd", "Directorate of Secondary and Higher Education", "OFFICIAL_GOVERNMENT"),
    ("education_bd", "moedu.gov.bd", "Ministry of Education", "OFFICIAL_GOVERNMENT"),
    ("education_bd", "educationboard.gov.bd", "Bangladesh Education Board", "OFFICIAL_GOVERNMENT"),
    ("health", "who.int", "World Health Organization", "SCIENTIFIC_SOURCE"),
    ("health", "dghs.gov.bd", "Directorate General of Health Services", "OFFICIAL_GOVERNMENT"),
    ("economy_bd", "bb.org.bd", "Bangladesh Bank", "OFFICIAL_GOVERNMENT"),
    ("economy_bd", "bbs.gov.bd", "Bangladesh Bureau of Statistics", "OFFICIAL_GOVERNMENT"),
)
