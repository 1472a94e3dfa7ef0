"""Tables of a case and their columns."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from datetime import datetime

from pyspark.sql import DataFrame

# Event types, and which of them are navigation.
EVENT_TYPES = (
    "post.created", "comment.created", "reaction.created", "chat.message.sent", "login",
    "stream.viewed", "topic.viewed", "post.read", "search.performed",
)
NAVIGATION = ("stream.viewed", "topic.viewed")

#: Column types of the tables as files.
SCHEMAS = {
    "users": "user_id string, full_name string, username string, job_title string, department string, division string, country string, airport string, terminal string, employee_category string, shift_pattern string, age int, preferred_language string",
    "api_events": "event_id bigint, user_id string, timestamp timestamp_ntz, event_type string, normalised_path string, method string, client string, object_type string, object_id string",
    "posts": "post_id string, author_id string, stream_id string, created_at timestamp_ntz, has_video int, mention_count int, comment_count int, like_count int, comment_like_count int",
    "comments": "comment_id string, post_id string, author_id string, created_at timestamp_ntz, like_count int",
    "reactions": "reaction_id string, post_id string, user_id string, created_at timestamp_ntz, reaction_type string",
    "streams": "stream_id string, stream_name string, stream_type string, restricted int",
    "stream_permissions": "user_id string, stream_id string, can_access int",
    "group_memberships": "user_id string, group_id string, group_name string",
    "consent": "user_id string, jurisdiction string, consent int",
}


@dataclass(frozen=True)
class CaseTables:
    """The tables of one case, and its observation window."""

    users: DataFrame
    api_events: DataFrame
    posts: DataFrame
    comments: DataFrame
    reactions: DataFrame
    streams: DataFrame
    stream_permissions: DataFrame
    group_memberships: DataFrame
    consent: DataFrame | None = None
    period_start: datetime | None = None
    period_end: datetime | None = None
    user_id_col: str = "user_id"

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if isinstance(getattr(self, f.name), DataFrame)}

    def changed(self, **tables) -> CaseTables:
        return replace(self, **tables)

    def summary(self) -> dict[str, tuple[int, int]]:
        """Rows and columns of each table."""
        return {name: (t.count(), len(t.columns)) for name, t in self.tables().items()}
