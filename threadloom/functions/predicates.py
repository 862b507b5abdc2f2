"""Boolean tests on messages, channels and conversations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Word forms that mark a short message as real work.
WORK_WORDS = [
    "confirm(ed|ing)?", "verif(y|ied|ying)", "test(ed|ing)?", "check(ed|ing)?", "fix(ed|ing)?", "done",
    "complete[d]?", "approve[d]?", "review(ed|ing)?", "resolve[d]?", "merge[d]?", "deploy(ed|ing)?",
    "update[d]?", "ship(ped|ping)?", "launch(ed|ing)?", "release[d]?",
]
CONTEXT = "context_message"
MENTION_CONTEXT = "mention_context"
BOT_SUBTYPE = "bot_message"

# ASCII word edges; the JVM's \b also looks at non-ASCII letters.
EDGE_LEFT, EDGE_RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

TRIVIAL_MAX_MESSAGES = 2
TRIVIAL_MAX_CHARS = 100


def has_work_indicator(text: Column | str = "text", words: list[str] | None = None) -> Column:
    """Text holds one of the work words; the words are single, so testing message by message is exact."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.rlike(f"(?i){EDGE_LEFT}(?:{'|'.join(words or WORK_WORDS)}){EDGE_RIGHT}"), F.lit(False))


def is_bot_message(subtype: str = "subtype", user: str = "user_id", text: str = "text") -> Column:
    nameless = F.col(user).isNull() | (F.col(user) == "")
    has_text = F.coalesce(F.length(text), F.lit(0)) > 0
    return F.coalesce(F.col(subtype) == BOT_SUBTYPE, F.lit(False)) | (nameless & has_text)


def is_context_message(subtype: str = "subtype") -> Column:
    return F.coalesce(F.col(subtype).isin(CONTEXT, MENTION_CONTEXT), F.lit(False))


def is_direct_channel(channel: str = "channel") -> Column:
    return F.col(channel).startswith("D")


def is_trivial(messages: str = "message_count", chars: str = "chars", max_messages: int = TRIVIAL_MAX_MESSAGES,
               max_chars: int = TRIVIAL_MAX_CHARS) -> Column:
    return (F.col(messages) <= max_messages) & (F.col(chars) < max_chars)


def channel_type() -> Column:
    """Type of a channel record from its flags; a missing flag counts as false."""
    flag = {n: F.coalesce(F.col(n), F.lit(False)) for n in ("is_im", "is_mpim", "is_private", "is_group")}
    return (F.when(flag["is_im"], "im").when(flag["is_mpim"], "mpim")
            .when(flag["is_private"] | flag["is_group"], "private_channel").otherwise("public_channel"))


def mentioned_users(text: str = "text") -> Column:
    """Array of the user ids a text mentions, in order, repeats kept."""
    return F.regexp_extract_all(F.col(text), F.lit(r"<@([^|>]+)(?:\|[^>]+)?>"), F.lit(1))


def mentions_user(user: Column | str, text: str = "text") -> Column:
    """Text mentions one given user; an array test, so no pattern is built from data."""
    return F.array_contains(mentioned_users(text), F.lit(user) if isinstance(user, str) else user)
