"""Sentences shown for coded values. All texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORY_NAMES = {"system": "system files", "other": "everything else"}

UNREAD_REPORT = {
    "permission_denied": "the system refused access",
    "would_require_download": "cloud-only; reading would download it",
    "vanished": "it disappeared while scanning",
    "other": "reported by the system",
}
UNREAD_WINDOW = {
    "permission_denied": "this account is not allowed to read it",
    "would_require_download": "reading it would have downloaded it",
    "vanished": "it went away while the scan ran",
}
IMPEDIMENT_REPORT = {
    "source_missing": "the file is no longer where the plan found it",
    "source_changed": "the file changed after the plan was made",
    "destination_occupied": "something is already at the destination",
    "destination_unreachable": "the destination's folder does not exist",
    "permission_denied": "the system refused access",
    "content_not_present": "the content is in the cloud, not on this machine",
    "other": "the system reported a problem",
}
IMPEDIMENT_WINDOW = {
    "source_missing": "it is not there any more",
    "source_changed": "it is not the same file it was when the plan was made",
    "destination_occupied": "something is already where it would go",
    "destination_unreachable": "the folder it would go into does not exist",
    "permission_denied": "this account is not allowed to move it",
    "content_not_present": "its content is in the cloud, so the sync client has to move it, not us",
}
ROOT_ORIGIN = {
    "provider_mount": "the provider's own folder",
    "app_container": "an app's own cloud storage",
    "provider_trash": "the provider's deleted items",
    "home_redirect": "a home folder redirected into the cloud",
    "legacy_location": "an older location the provider still uses",
}
KEEP_RULE = {
    "oldest": "Keeping the copy modified longest ago.",
    "newest": "Keeping the copy modified most recently.",
    "shallowest": "Keeping the copy with the fewest directories above it.",
}
REFUSAL = {
    "no_such_entry": "that is not in this scan any more — scan again and try it",
    "occupied": "something is already there, and nothing is ever written over",
    "into_itself": "a folder cannot be put inside itself",
    "not_a_directory": "that destination is not a folder",
    "already_aside": "that has already been set aside",
    "folders_are_not_set_aside": "folders are not set aside — set aside the files inside it, "
    "which can be undone one at a time",
    "not_absolute": "that path does not say where it starts from",
}
MADE_FIRST = "somewhere has to exist first"
ASKED_MOVE = "you asked for it to go there"
ASKED = "you asked for it"


def lookup(table: dict[str, str], code: Column, otherwise: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, code)
    return found if otherwise is None else F.coalesce(found, otherwise)


def category_name(category: Column) -> Column:
    return lookup(CATEGORY_NAMES, category, category)


def unread_report(reason: Column) -> Column:
    return lookup(UNREAD_REPORT, reason)


def unread_window(reason: Column, detail: Column) -> Column:
    return lookup(UNREAD_WINDOW, reason, detail)


def impediment_report(impediment: Column) -> Column:
    return lookup(IMPEDIMENT_REPORT, impediment)


def impediment_window(impediment: Column, detail: Column) -> Column:
    return lookup(IMPEDIMENT_WINDOW, impediment, detail)


def root_origin(origin: Column) -> Column:
    return lookup(ROOT_ORIGIN, origin)


def keep_rule(rule: str, root: str | None = None) -> str:
    return f"Keeping the copy under {root}." if rule == "under" else KEEP_RULE[rule]


def refusal(reason: Column, detail: Column) -> Column:
    return lookup(REFUSAL, reason, detail)


def because(kind: Column, reason: Column, kept: Column) -> Column:
    redundant = F.concat(
        F.lit("exactly these bytes are also at "), kept, F.lit(", and that copy is being kept")
    )
    return (
        F.when(kind == "create_directory", F.lit(MADE_FIRST))
        .when(kind == "move", F.lit(ASKED_MOVE))
        .when(reason == "redundant_copy", redundant)
        .otherwise(F.lit(ASKED))
    )
