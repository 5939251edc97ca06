"""Schemas, thresholds and the theme vocabulary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("language", T.StringType()),
    ]
)
REVIEW_COLUMNS = [f.name for f in REVIEW_SCHEMA.fields]

RUN_SCHEMA = T.StructType(
    [
        T.StructField("product_id", T.StringType()),
        T.StructField("week_key", T.StringType()),
        T.StructField("week_ending", T.DateType()),
        T.StructField("validation_ok", T.BooleanType()),
        T.StructField("insufficient_signal", T.BooleanType()),
        T.StructField("window_widened", T.BooleanType()),
        T.StructField("review_count", T.LongType()),
        T.StructField("top_3", T.ArrayType(T.StringType())),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("doc_url", T.StringType()),
        T.StructField("draft_id", T.StringType()),
        T.StructField("sent_id", T.StringType()),
        T.StructField("errors", T.ArrayType(T.StringType())),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("run_id", T.StringType()),
    ]
)

# Thresholds of the weekly report.
MIN_WEEKS = 8
MAX_WEEKS = 12
SPARSE_THRESHOLD = 30
MIN_WORDS = 8
MIN_QUOTE_WORDS = 12
MAX_QUOTE_RATING = 3
MAX_QUOTE_WORDS = 36
LOW_STAR = 2
NULL_RATING_SORT = 99.0
NULL_RATING_RANK = 5.0
SAMPLE_LIMIT = 12
MAX_PER_THEME = 40
MAX_CANDIDATES = 60
REVIEW_TEXT_CHARS = 350
MAX_LABEL_QUEUE = 40
LABEL_BATCH = 8
WORD_LIMIT = 250
WINDOW_SLACK_DAYS = 2
TOP_K = 3
ENGLISH_SIGNAL_FLOOR = 0.85


@dataclass(frozen=True)
class ThemeDef:
    theme_id: str
    label: str
    pattern: str
    default_action: str


@dataclass(frozen=True)
class Vocabulary:
    """An ordered set of themes with the order in which score ties are settled."""

    themes: tuple[ThemeDef, ...]
    preference: tuple[str, ...]
    default: str

    @property
    def ids(self) -> list[str]:
        return [t.theme_id for t in self.themes]

    def by_id(self, theme_id: str) -> ThemeDef:
        return next(t for t in self.themes if t.theme_id == theme_id)

    def as_array(self) -> Column:
        """The vocabulary as one literal array, so padding needs no join."""
        return F.array(
            *[
                F.struct(
                    F.lit(i).alias("ordinal"),
                    F.lit(t.theme_id).alias("theme_id"),
                    F.lit(t.label).alias("label"),
                    F.lit(t.default_action).alias("default_action"),
                )
                for i, t in enumerate(self.themes)
            ]
        )

    def label_of(self, theme_id: Column) -> Column:
        return _lookup(theme_id, {t.theme_id: t.label for t in self.themes})

    def action_of(self, theme_id: Column) -> Column:
        return _lookup(theme_id, {t.theme_id: t.default_action for t in self.themes})

    def contains(self, theme_id: Column) -> Column:
        return F.coalesce(theme_id.isin(self.ids), F.lit(False))


def _lookup(key: Column, mapping: dict[str, str]) -> Column:
    # A CASE over a handful of literals: fused into the stage, no join at all.
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


# Theme ids, labels, keyword alternatives and default actions.
VOCABULARY = Vocabulary(
    themes=(
        ThemeDef(
            "trading_orders",
            "Trading & order execution",
            r"buy|sell|stop[\s-]?loss|square[\s-]?off|order|ipo|f&o|fno|"
            r"futures?|options?|mandate|execute|execution|trade|trading|"
            r"limit\s+order|market\s+order|gtt|sl-m|intraday",
            "Trace sell / stop-loss / square-off failures end-to-end and ship "
            "regression tests for the top order-lifecycle breakages.",
        ),
        ThemeDef(
            "charts_market_data",
            "Charts & market / holdings data",
            r"chart|ohlc|candle|avg(?:erage)?\s*buy\s*price|holdings?|"
            r"portfolio\s+value|yield|market\s+data|price\s+(?:wrong|incorrect|mismatch)|"
            r"wrong\s+price|stale",
            "Audit chart OHLC, average buy-price, and holdings display accuracy "
            "against exchange feeds after recent UI updates.",
        ),
        ThemeDef(
            "customer_support",
            "Customer support",
            r"support|customer\s+care|call\s+cent(?:er|re)|ticket|no\s+response|"
            r"helpline|chat\s+support|agent|complaint|escalate|kyc|verification|"
            r"onboarding|sign[\s-]?up",
            "Reduce support dead-ends: publish ticket SLAs and route funding / "
            "trading escalations to a faster path.",
        ),
        ThemeDef(
            "app_reliability",
            "App reliability & updates",
            r"crash|lag|slow|freeze|not\s+working|doesn'?t\s+work|bug|glitch|"
            r"update|force\s+close|hang|loading|blank\s+screen|error|"
            r"uninstall|worst\s+app|useless",
            "Prioritize crash / freeze / post-update regressions from ≤2★ reviews "
            "and add release smoke checks for core screens.",
        ),
        ThemeDef(
            "fees_funding",
            "Fees, brokerage & funding",
            r"brokerage|fee|charge|charges|commission|upi|deposit|withdraw|"
            r"withdrawal|payment|fund(?:ing)?|bank\s+transfer|sip|mutual\s+fund|"
            r"amc|hidden\s+charge|expensive",
            "Clarify brokerage / F&O fee surfacing and fix UPI deposit–withdraw "
            "friction called out in low-rated funding reviews.",
        ),
    ),
    preference=(
        "trading_orders",
        "customer_support",
        "app_reliability",
        "charts_market_data",
        "fees_funding",
    ),
    default="app_reliability",
)

# Column names accepted in raw exports, in order of precedence.
RAW_FIELDS = {
    "package": ["Package Name", "packageName", "package", "appId", "app_id"],
    "text": ["text", "content", "Review Text", "review_text", "body"],
    "title": ["title", "Review Title", "review_title"],
    "date": [
        "date",
        "at",
        "Review Submit Date and Time",
        "reviewSubmitDateAndTime",
        "submitted_at",
        "created_at",
    ],
    "millis": [
        "Review Submit Millis Since Epoch",
        "reviewSubmitMillisSinceEpoch",
        "timestamp",
    ],
    "rating": ["rating", "score", "Star Rating", "star_rating", "stars"],
    "language": ["language", "Reviewer Language", "reviewerLanguage", "lang"],
}

# Columns that must never reach a cleaned table.
PII_COLUMNS = [
    "username",
    "user_name",
    "userName",
    "author",
    "author_name",
    "reviewer",
    "reviewer_name",
    "name",
    "email",
    "user_email",
    "phone",
    "phone_number",
    "device",
    "device_id",
    "deviceId",
    "advertising_id",
    "advertisingId",
    "gaid",
    "idfa",
    "user_image",
    "userImage",
    "avatar",
    "review_link",
    "reviewLink",
    "reply_content",
    "replyContent",
    "developer_reply",
    "thumbs_up_count",
    "thumbsUpCount",
]
