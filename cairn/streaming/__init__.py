"""Structured Streaming: upload sessions, operation logs, derived statistics."""

from .oplog import apply_operations, live_stats, maintain_stats
from .uploads import deduplicated_parts, session_progress, valid_parts

__all__ = ["apply_operations", "deduplicated_parts", "live_stats", "maintain_stats", "session_progress", "valid_parts"]
