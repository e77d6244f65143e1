"""Path expressions. Paths are absolute, ``/``-separated, and compared by component."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(path: Column) -> Column:
    """Components with the root as an empty first element; ordering by this
    array is ordering by component (``/a/b`` before ``/a-b``)."""
    return F.split(path, "/")


def depth(path: Column) -> Column:
    """Number of components, the root counting as one: ``/D/t.pdf`` is 3."""
    return F.when(path == "/", F.lit(1)).otherwise(F.size(parts(path))).cast("long")


def _last(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The folder a path is in; null for the root itself."""
    cut = F.left(path, F.char_length(path) - F.char_length(_last(path)) - 1)
    return F.when(path == "/", F.lit(None)).when(cut == "", F.lit("/")).otherwise(cut)


def file_name(path: Column) -> Column:
    return F.nullif(_last(path), F.lit(""))


def extension(path: Column) -> Column:
    """After the last dot, lower-cased; null when a name only starts with a dot."""
    name = _last(path)
    found = F.substring_index(name, ".", -1)
    after_a_dot = F.char_length(name) - F.char_length(found) > 1
    return F.when(
        after_a_dot & (found != ""), F.translate(found, ascii_uppercase, ascii_lowercase)
    )


def ancestors(path: Column) -> Column:
    """Every folder above a path, excluding itself, down to ``/``."""
    pieces = parts(path)
    lengths = F.sequence(F.lit(1), F.size(pieces) - 1)
    above = F.transform(
        lengths,
        lambda n: F.when(n == 1, F.lit("/")).otherwise(
            F.array_join(F.slice(pieces, F.lit(1), n), "/")
        ),
    )
    return F.when(path == "/", F.array().cast("array<string>")).otherwise(above)


def self_and_ancestors(path: Column) -> Column:
    return F.array_append(ancestors(path), path)


def is_under(path: Column, root: Column) -> Column:
    """``path`` is ``root`` or lies below it, on component boundaries."""
    below = F.startswith(path, F.concat(root, F.lit("/")))
    return (path == root) | below | ((root == "/") & F.startswith(path, F.lit("/")))


def join(folder: Column, name: Column) -> Column:
    return F.when(folder == "/", F.concat(F.lit("/"), name)).otherwise(
        F.concat(folder, F.lit("/"), name)
    )


def rebase(path: Column, old: Column, new: Column) -> Column:
    """Replace the leading ``old`` of a path known to lie under it with ``new``."""
    rest = F.substring(path, F.length(old) + 1, F.length(path))
    return F.concat(new, rest)


def short_path(path: Column) -> Column:
    """The last two components, marked with an ellipsis when something was cut."""
    named = F.filter(parts(path), lambda p: p != "")
    tail = F.concat(F.lit("…/"), F.array_join(F.slice(named, -2, 2), "/"))
    return F.when(F.size(named) <= 2, path).otherwise(tail)


def quarantine_place(path: Column, root: Column) -> Column:
    """Where a file lands in quarantine: its own path rebuilt under ``root``."""
    normal = F.filter(parts(path), lambda p: ~p.isin("", ".", ".."))
    return F.concat(root, F.lit("/"), F.array_join(normal, "/"))


def exact_bytes(raw: Column) -> Column:
    """The raw bytes of a path, kept only where text cannot carry them."""
    return F.when(~F.is_valid_utf8(raw.cast("string")), raw)


def rendered(raw: Column) -> Column:
    """A readable, possibly lossy text of a path's bytes."""
    return F.make_valid_utf8(raw.cast("string"))


# The sentences a refused name is reported with.
NAME_EMPTY = "a name cannot be empty"
NAME_DOTS = "every folder already has those two names"
NAME_SEPARATOR = "a name cannot contain a path separator — to move something, move it"


def trimmed_name(name: Column) -> Column:
    """Without blanks at either end, in the sense of Unicode."""
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")


def name_trouble(name: Column) -> Column:
    """Why a text is not a single usable name; null when it is one."""
    text = trimmed_name(name)
    return (
        F.when(text == "", F.lit(NAME_EMPTY))
        .when(text.isin(".", ".."), F.lit(NAME_DOTS))
        .when(F.contains(text, F.lit("/")), F.lit(NAME_SEPARATOR))
    )
