"""Table schemas. An entry is identified by ``entry_id``, unique in its frame.

Input order carries meaning (the first name of an object is its representative),
so ``entry_id`` ascending *is* inventory order.
"""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1
DIGEST_ALGORITHM = "sha2-256"


_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
}


def table(text: str) -> T.StructType:
    fields = [item.split() for item in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


_TYPES["file_id"] = table("volume long, index long")
_TYPES["cloud"] = table("provider string, residency string, retention string")
_TYPES["facts"] = table("logical_size long, modified_s long, content string")
_TYPES["reasons"] = T.ArrayType(table("reason string, objects long, bytes long"))

ENTRY = table(
    "machine string, entry_id long, path string, path_bytes binary, kind string, "
    "logical_size long, allocated_size long, created timestamp, modified timestamp, "
    "file_id file_id, link_count long, link_target string, cloud cloud"
)
UNREAD = table("machine string, path string, reason string, detail string")
CLOUD_ROOT = table("machine string, path string, provider string, account string, origin string")
CLOUD_LINK = table("machine string, link string, target string, provider string, verdict string")
SETTLED = table("machine string, entry_id long, kind string, fingerprint string")
GROUP = table(
    "group_id long, certainty string, digest string, logical_size long, objects long, names long, "
    "reclaimable_bytes long, settled_of_same_size long, first_entry long, unsettled reasons"
)
MEMBER = table(
    "group_id long, object_id long, machine string, entry_id long, first_name long, "
    "logical_size long, allocated_size long"
)
OPERATION = table(
    "position long, kind string, machine string, entry_id long, subject_path string, "
    "destination string, content string, logical_size long, modified_s long, "
    "because string, kept string, frees_bytes long, is_folder boolean"
)
EDIT = table("machine string, position long, kind string, entry_id long, path string, name string")
VERDICT = table(
    "operation long, machine string, grade string, rigour string, impediment string, "
    "detail string, expected facts, found facts"
)
STEP = table(
    "sequence long, attempt int, operation long, machine string, progress string, "
    "reason string, detail string, from_path string, to_path string, content string, at timestamp"
)
STEP_PRICED = T.StructType([*STEP.fields, T.StructField("frees_bytes", T.LongType())])
HEADER = table(
    "schema_version int, tool_version string, algorithm string, stage string, kind string, "
    "parents strings, machines strings, merged boolean, created_at timestamp, "
    "scope_digest string, content_digest string, path_encoding string"
)

KINDS = ("file", "directory", "symlink", "other")
RESIDENCIES = ("local", "remote", "partial", "not_synced", "unknown")
RETENTIONS = ("pinned", "unpinned", "unspecified")
UNREAD_REASONS = ("permission_denied", "would_require_download", "vanished", "other")
