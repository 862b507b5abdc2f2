"""Reference extraction: one pattern per reference type, all matches of a text.

Spark runs Java patterns. ``\\b`` is written as ASCII look-arounds, and white space includes the Unicode
spaces, so that results do not depend on the JVM's reading of letters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions.predicates import EDGE_LEFT as LEFT, EDGE_RIGHT as RIGHT

SPACE = r"[\s\x{A0}\x{FEFF}\p{Z}]"
MENTION_TYPE = "user_mention"


@dataclass(frozen=True)
class Extractor:
    """``value`` maps the captured part to the normal form; group 0 is kept as ``raw``."""

    type: str
    pattern: str
    value: Callable[[Column], Column]


def _prefix(label: str) -> Callable[[Column], Column]:
    return lambda part: F.concat(F.lit(label), part)


def link_ts(digits: Column) -> Column:
    """``1234567890123456`` to ``1234567890.123456``; up to ten digits stay as they are."""
    return F.when(F.length(digits) > 10, F.concat(F.substring(digits, 1, 10), F.lit("."), F.substr(digits, F.lit(11)))).otherwise(digits)


# Link of a chat message, with channel and time stamp.
MESSAGE_LINK = r"(?i)https?://[\w-]+\.slack\.com/archives/([A-Z0-9]+)/p(\d+)(?:\?[^\s]*)?"

# Reference types, their patterns and the label of the normal form, in registry order.
EXTRACTORS = [
    Extractor("github_issue", r"(?:^|" + SPACE[:-1] + r"(\[])(?:[\w-]+/[\w-]+#|#)(\d+)" + RIGHT, _prefix("#")),
    Extractor("github_url", r"(?i)github\.com/[\w-]+/[\w-]+/(?:issues|pull)/(\d+)", _prefix("#")),
    Extractor("gitlab", r"(?i)gitlab\.com/[\w-]+(?:/[\w-]+)+/-/(?:issues|merge_requests)/(\d+)", _prefix("gitlab:")),
    Extractor("ticket", LEFT + r"([A-Z]{2,}[A-Z0-9]*-\d+)" + RIGHT, F.upper),
    Extractor("figma", r"(?i)figma\.com/(?:file|design|board)/([a-zA-Z0-9]+)", _prefix("figma:")),
    Extractor("notion", r"(?i)notion\.(?:so|site)/(?:[\w-]+/)*([a-f0-9]{32}|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12})",
              lambda part: F.concat(F.lit("notion:"), F.replace(part, F.lit("-"), F.lit("")))),
    Extractor("confluence", r"(?i)atlassian\.net/wiki/spaces/[\w-]+/pages/(\d+)", _prefix("confluence:")),
    Extractor("gdoc", r"(?i)docs\.google\.com/document/d/([\w-]+)", _prefix("gdoc:")),
    Extractor("gsheet", r"(?i)docs\.google\.com/spreadsheets/d/([\w-]+)", _prefix("gsheet:")),
    Extractor("gslide", r"(?i)docs\.google\.com/presentation/d/([\w-]+)", _prefix("gslide:")),
    Extractor("asana", r"(?i)app\.asana\.com/\d+/\d+/(\d+)", _prefix("asana:")),
    Extractor("clickup", r"(?i)app\.clickup\.com/t/([a-z0-9]+)", _prefix("clickup:")),
    Extractor("sentry", r"(?i)sentry\.io/(?:organizations/)?[\w-]+/issues/(\d+)", _prefix("sentry:")),
    Extractor("datadog", r"(?i)app\.datadoghq\.com/(?:dashboard|monitors|apm|logs)/([a-zA-Z0-9-]+)", _prefix("datadog:")),
    Extractor("pagerduty", r"(?i)[\w-]+\.pagerduty\.com/incidents/([A-Z0-9]+)", _prefix("pagerduty:")),
    Extractor("zendesk", r"(?i)[\w-]+\.zendesk\.com/agent/tickets/(\d+)", _prefix("zendesk:")),
    Extractor("salesforce", r"(?i)[\w-]+\.(?:(?:my\.)?salesforce|lightning\.force)\.com/.*?(?:Case|cases)/([a-zA-Z0-9]{15,18})",
              _prefix("sfdc:")),
    # A name ending in error or exception, and a status number: two disjoint patterns of linear cost.
    Extractor("error_pattern", r"(?i)" + LEFT + r"([a-z]{2,}(?:error|exception))" + RIGHT, F.lower),
    Extractor("error_pattern", r"(?i)" + LEFT + r"([45]\d{2})" + SPACE + r"+(?:error|status)" + RIGHT, F.lower),
    Extractor(MENTION_TYPE, r"<@(U[A-Z0-9]+)(?:\|[^>]+)?>", lambda part: part),
    Extractor("aws_log_group", r"(?i)cloudwatch[^#]*#[^/]*log-groups/log-group(?:/|%252F|\$252F)([a-zA-Z0-9_-]+)", F.lower),
    Extractor("service_name", r"(?i)" + LEFT + r"([a-z][a-z0-9]*-(?:auth|api|web|service|worker|backend|frontend|core|app))" + RIGHT, F.lower),
]


# Types whose pattern holds a slash.
LINK_TYPES = {e.type for e in EXTRACTORS} - {"github_issue", "ticket", "error_pattern", MENTION_TYPE, "service_name"}


def _matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def message_links(text: str = "text") -> Column:
    """Array of ``(channel, ts, raw)`` for every message link of a text, in text order."""
    column = F.coalesce(F.col(text), F.lit(""))
    zipped = F.arrays_zip(_matches(column, MESSAGE_LINK, 1).alias("channel"), _matches(column, MESSAGE_LINK, 2).alias("digits"),
                          _matches(column, MESSAGE_LINK, 0).alias("raw"))
    return F.transform(zipped, lambda m: F.struct(m["channel"].alias("link_channel"), link_ts(m["digits"]).alias("link_ts"),
                                                  m["raw"].alias("raw")))


def references(text: str = "text", raw: bool = True) -> Column:
    """Array of ``(type, value, raw)`` with every match of every type; ``raw=False`` skips the matched text.

    All link types contain a slash, so their patterns are tried only on texts that have one; the others have similar tests.
    """
    column = F.coalesce(F.col(text), F.lit(""))

    def entry(type_: str, value: Column, shown: Column | None) -> Column:
        fields = [F.lit(type_).alias("type"), value.alias("value")]
        return F.struct(*fields, F.trim(shown).alias("raw")) if shown is not None else F.struct(*fields)

    def found(e: Extractor) -> Column:
        parts = _matches(column, e.pattern, 1)
        if not raw:
            return F.transform(parts, lambda p: entry(e.type, e.value(p), None))
        zipped = F.arrays_zip(parts.alias("part"), _matches(column, e.pattern, 0).alias("raw"))
        return F.transform(zipped, lambda m: entry(e.type, e.value(m["part"]), m["raw"]))

    links = F.transform(message_links(text), lambda m: entry(
        "slack_message", F.concat(F.lit("slack:"), m["link_channel"], F.lit(":"), m["link_ts"]), m["raw"] if raw else None))
    nothing = F.slice(entry_type(raw), 1, 0)
    slashed = F.concat(*[found(e) for e in EXTRACTORS if e.type in LINK_TYPES], links)
    plain = [F.when(_may_hold(column, e.type), found(e)).otherwise(nothing) for e in EXTRACTORS if e.type not in LINK_TYPES]
    return F.concat(*plain, F.when(column.contains("/"), slashed).otherwise(nothing))


def _may_hold(text: Column, type_: str) -> Column:
    """Substring test that every match of a type passes; it spares most texts the pattern."""
    if type_ == "error_pattern":
        low = F.lower(text)
        return low.contains("error") | low.contains("exception") | low.contains("status")
    return text.contains({"github_issue": "#", MENTION_TYPE: "<@U"}.get(type_, "-"))


def entry_type(raw: bool) -> Column:
    """One empty entry, to give the empty array its type."""
    fields = ["type", "value", "raw"] if raw else ["type", "value"]
    return F.array(F.struct(*[F.lit("").alias(f) for f in fields]))


def extract(messages: DataFrame, *keep: str) -> DataFrame:
    """One row per reference of every message: ``(keep..., type, value, raw)``."""
    return messages.select(*keep, F.explode(references()).alias("_r")).select(*keep, "_r.type", "_r.value", "_r.raw")


def conversation_references(conv_msgs: DataFrame, ids: list[str]) -> DataFrame:
    """Distinct reference values per conversation; ``comparable`` is false for values that are only mentions."""
    values = conv_msgs.select(*ids, F.explode(references(raw=False)).alias("_r")).select(*ids, "_r.type", "_r.value")
    return values.groupBy(*ids, "value").agg(F.max(F.col("type") != MENTION_TYPE).alias("comparable"))
