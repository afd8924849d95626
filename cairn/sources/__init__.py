"""Tables and files as objects, references, operation logs and upload parts."""

from .files import binary_files, read_wal, scan_segments
from .tables import documents_as_objects, events_as_log, lineitem_as_parts, pages_as_objects, table

__all__ = ["binary_files", "documents_as_objects", "events_as_log", "lineitem_as_parts", "pages_as_objects", "read_wal", "scan_segments", "table"]
