from . import activity_queries, check_queries, cluster_queries, desk_queries, identity_queries, news_queries, rebuild_queries, story_queries, stream_queries, text_queries, wire_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
