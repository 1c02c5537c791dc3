"""Tunable constants of the opinion engine.

Every number or word list here is a fixed value: results are only comparable with
other installations of the same method when these agree, so they are written out as
plain data and not derived.
"""

from __future__ import annotations

# --- fixed values: source tiers and weights ---------------------------------
# First matching prefix wins.  A lower tier is more authoritative.
SOURCE_TIERS = (("arxiv", 1), ("news", 2), ("reddit", 3))
DEFAULT_TIER = 3
# Directional weight per tier.  Tier 1 contributes themes but no direction.
SOURCE_WEIGHTS = {1: 0.0, 2: 1.0, 3: 0.6}

RECENCY_HALF_LIFE_HOURS = 12.0
ENGAGEMENT_LOG_WEIGHT = 0.15

# --- fixed values: labels and confidence -------------------------------------
DAILY_NEUTRAL_BAND = 0.15       # on -1..+1
READING_NEUTRAL_BAND = 15       # on -100..+100
CONFLICT_STDDEV = 0.4
CONFIDENCE_HIGH_MAX = 0.20
CONFIDENCE_MEDIUM_MAX = 0.40
MIN_TICKER_MENTIONS = 2
TOP_THEMES = 10
TOP_SIGNALS = 10
SPLIT_DISPERSION = 40

# --- fixed values: corpus, readings -------------------------------------------
NORMALIZED_TEXT_CHARS = 500
THIN_CORPUS = 25
CITATIONS = 14
QUOTE_CHARS = 200
REPORT_LINE_CHARS = 280
READING_MAX_AGE_HOURS = 24.0
STALE_REFRESH_CAP = 40
SEARCH_K = 400
HISTORY_LIMIT = 90

# --- fixed values: scoring exchange --------------------------------------------
STANCE_TEXT_CHARS = 1500
MAX_ERROR_RATE = 0.25
# Response classes that can never succeed on a retry.
FATAL_ERROR_CLASSES = ("400", "401", "403", "404")

# --- fixed values: study --------------------------------------------------------
STUDY_MIN_ITEMS = {"month": 1, "week": 3}
STUDY_MIN_PERIODS = 4
BACKTEST_MIN_PERIODS = 3
BACKTEST_THIN_PERIODS = 6
SIGNAL_BAND = 0.05
SIGNAL_MIN_CALLS = 20
COVERAGE_RICH, COVERAGE_OK, COVERAGE_THIN = 40, 15, 1

# --- fixed values: request limits -------------------------------------------------
RATE_LIMIT = 20
RATE_WINDOW_S = 3600
DAILY_BUDGET = 100

# --- fixed values: notes and details stored with results -----------------------------
NOTE_TOO_FEW = "too few periods to backtest (need >= 3)"
NOTE_THIN = "thin — interpret with caution"
NOTE_PANEL = "did the informed crowd's mood lead, track, or lag the price?"
NO_BACKTEST = "no backtest available for this reading"
DETAIL_HOMELESS = "episode has neither a transcript nor audio"
DETAIL_NOT_NAMED = "no covered subject in metadata"
DETAIL_NO_TEXT = "no transcript available"

# --- fixed values: transcripts -----------------------------------------------------------
SEGMENT_MARK = r"^(\d{2}:\d{2}:\d{2})"
SEGMENT_SPEAKER = r"(?s)^(Speaker \d+|[A-Z][a-zA-Z .]{1,30}):\s*(.*)"

# --- fixed values: passages -----------------------------------------------------
TARGET_WORDS = 140
MIN_WORDS = 25
LIST_SUBJECT_LIMIT = 4
SUBSTANTIVE_MENTIONS = 2
CUE_WINDOW_CHARS = 220
EPISODE_DESCRIPTION_CHARS = 4000

# --- fixed values: alias word lists ------------------------------------------------
GENERIC_ALIASES = (
    "crypto", "chips", "chip", "stock", "stocks", "shares", "equity", "equities",
    "the market", "markets", "ai", "tech", "software", "hardware", "cloud",
    "digital gold", "coin", "token", "bank", "banks", "oil", "energy",
)
AMBIGUOUS_ALIASES = (
    "apple", "meta", "arm", "oracle", "amazon", "alphabet", "intel", "micron",
    "block", "square", "uranium", "target", "shell", "gap",
)
CONTEXT_CUES = (
    "stock", "stocks", "shares", "share", "earnings", "revenue", "valuation", "market",
    "markets", "cap", "investor", "investors", "buy", "sell", "sold", "bought",
    "bullish", "bearish", "quarter", "guidance", "ipo", "ticker", "trading",
    "trade", "price", "growth", "margin", "margins", "company", "ceo", "profit",
    "billion", "trillion", "percent", "%", "portfolio", "chips",
)
ASR_VARIANTS = {
    "NVDA": ["invidia", "nvidea", "in video"],
    "TSM": ["tsmc", "taiwan semi", "taiwan semiconductor"],
    "AVGO": ["broadcom"],
    "AMD": ["advanced micro devices"],
    "ETH-USD": ["etherium"],
    "SOL-USD": ["salana"],
}
CORPORATE_SUFFIXES = ("inc", "corp", "corporation", "plc", "ltd", "co")
DESCRIPTIVE_WORDS = ("competitor", "manufacturer", "industry", "maker", "stock")

# --- fixed values: feeds --------------------------------------------------------------
FORUM_SITE = "https://www.reddit.com"
SEARCH_ITEM_URL = "https://news.ycombinator.com/item?id="
EMBEDDING_DIM = 384

# --- limits of our own ------------------------------------------------------------------
# An alias dimension up to this many (subject, alias) rows (about 100 MB in a task) becomes an
# index; a larger one goes through the token equi-join in ``operators.mentions``.
MAX_INDEXED_ALIASES = 1_000_000
