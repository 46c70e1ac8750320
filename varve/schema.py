"""The fixed schemas of a store: entries, file metadata, manifest edits."""

from __future__ import annotations

#: Largest sequence number: 56 bits.
MAX_SEQ = (1 << 56) - 1
DELETION, VALUE = 0, 1

ENTRY = "user_key binary, seq bigint, vtype int, value binary"
FILE_META = (
    "version_id bigint, level int, file_no bigint, file_size bigint, smallest_key binary, smallest_seq bigint, "
    "largest_key binary, largest_seq bigint, allowed_seeks bigint"
)
EDIT = (
    "edit_id bigint, comparator string, log_number bigint, prev_log_number bigint, next_file_number bigint, last_sequence bigint, "
    "compact_pointers array<struct<level:int,key:binary,seq:bigint>>, deleted_files array<struct<level:int,file_no:bigint>>, "
    "new_files array<struct<level:int,file_no:bigint,file_size:bigint,smallest_key:binary,smallest_seq:bigint,largest_key:binary,largest_seq:bigint>>"
)
