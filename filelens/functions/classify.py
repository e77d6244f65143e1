"""What a file is, where its content is, and why something could not be read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from filelens.functions import paths

# Extension lists per category, in declaration order. The order is
# also the tie-break order of reports by kind.
EXTENSIONS = {
    "images": "jpg jpeg png gif bmp tif tiff webp heic heif avif svg raw cr2 cr3 nef arw dng "
    "orf rw2 psd ai eps ico icns",
    "video": "mp4 mov avi mkv wmv flv webm m4v mpg mpeg 3gp mts m2ts vob prproj fcpbundle",
    "audio": "mp3 wav flac aac m4a ogg opus wma aiff aif alac logicx band",
    "documents": "pdf doc docx odt rtf txt md pages xls xlsx ods numbers ppt pptx odp key epub "
    "mobi azw3 djvu tex",
    "code": "rs py js ts tsx jsx go java kt swift c h cpp hpp cs rb php sh zsh bash lua pl r "
    "scala dart vue html css scss sql ipynb",
    "data": "json xml yaml yml toml csv tsv db sqlite sqlite3 parquet log plist ndjson jsonl "
    "avro arrow feather pkl pickle npy npz h5 hdf5 mat bin msgpack gguf safetensors onnx pt pth "
    "ckpt pb tflite mlmodel mlpackage",
    "archives": "zip tar gz bz2 xz 7z rar tgz zst dmg iso pkg sparsebundle sparseimage",
    "applications": "app exe msi deb rpm appimage dll so dylib framework bundle jar wasm o a rlib",
    "system": "sys tmp temp cache lock pid swp ds_store localized download part crdownload",
}
CATEGORIES = (*EXTENSIONS, "other")

# Folder names whose contents belong to the machine.
MACHINE_PLACES = (
    "Library",
    "System",
    "Applications",
    "node_modules",
    "target",
    ".git",
    ".cache",
    "AppData",
    "ProgramData",
    "Windows",
    "Program Files",
    "__pycache__",
    ".venv",
    "vendor",
    "DerivedData",
)

# Platform flag bits and error numbers.
MAC_DATALESS = 0x40000000
WIN_RECALL_ON_DATA_ACCESS = 0x00400000
WIN_RECALL_ON_OPEN = 0x00040000
WIN_OFFLINE = 0x00001000
WIN_PINNED = 0x00080000
WIN_UNPINNED = 0x00100000
EDEADLK = 11
ETIMEDOUT = 60
BLOCK_BYTES = 512


def category_of(path: Column) -> Column:
    """Category by place first, then by name; one chain of set lookups."""
    places = F.array(*[F.lit(p) for p in MACHINE_PLACES])
    name = paths.file_name(path)
    found = paths.extension(path)
    only_dot_name = F.startswith(name, F.lit(".")) & ~F.contains(
        F.substr(name, F.lit(2)), F.lit(".")
    )
    chain = F.when(F.arrays_overlap(paths.parts(path), places), F.lit("system")).when(
        only_dot_name, F.lit("system")
    )
    chain = reduce(
        lambda acc, item: acc.when(found.isin(item[1].split()), F.lit(item[0])),
        EXTENSIONS.items(),
        chain,
    )
    return chain.otherwise(F.lit("other"))


def category_rank(category: Column) -> Column:
    """Declaration order, the tie-break of reports by kind."""
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category).cast("long")


def is_personal(category: Column) -> Column:
    return ~category.isin("system", "applications")


# "In the cloud" has four meanings; each has its own name.
def read_may_download(residency: Column) -> Column:
    """Reading content could cost a download; unknown counts as remote."""
    return residency.isin("remote", "partial", "unknown")


def survey_local(residency: Column) -> Column:
    """Counts as here in the space survey; unknown counts as here."""
    return ~residency.isin("remote", "partial")


def window_in_cloud(residency: Column) -> Column:
    return residency.isin("remote", "partial")


def scan_not_downloaded(residency: Column) -> Column:
    return residency == "remote"


def mac_residency(flags: Column, kind: Column, blocks: Column, size: Column) -> Column:
    hollow = (kind == "file") & (blocks == 0) & (size > 0)
    return F.when(
        (flags.bitwiseAND(F.lit(MAC_DATALESS)) != 0) | hollow, F.lit("remote")
    ).otherwise(F.lit("local"))


def _bits(attributes: Column, mask: int) -> Column:
    return attributes.bitwiseAND(F.lit(mask)) != 0


def windows_residency(attributes: Column) -> Column:
    """Virtual or offline is remote before partial is considered."""
    return (
        F.when(_bits(attributes, WIN_RECALL_ON_OPEN | WIN_OFFLINE), F.lit("remote"))
        .when(_bits(attributes, WIN_RECALL_ON_DATA_ACCESS), F.lit("partial"))
        .otherwise(F.lit("local"))
    )


def windows_retention(attributes: Column) -> Column:
    pinned, unpinned = _bits(attributes, WIN_PINNED), _bits(attributes, WIN_UNPINNED)
    return (
        F.when(pinned & ~unpinned, F.lit("pinned"))
        .when(unpinned & ~pinned, F.lit("unpinned"))
        .otherwise(F.lit("unspecified"))
    )


def mac_allocated(blocks: Column) -> Column:
    """Blocks are 512 bytes whatever the filesystem; null stays unavailable."""
    return (blocks * BLOCK_BYTES).cast("long")


def unread_reason(errno: Column, error_kind: Column) -> Column:
    return (
        F.when(errno.isin(EDEADLK, ETIMEDOUT), F.lit("would_require_download"))
        .when(error_kind == "permission_denied", F.lit("permission_denied"))
        .when(error_kind == "not_found", F.lit("vanished"))
        .otherwise(F.lit("other"))
    )


# The representable range of a recorded time, in seconds.
EARLIEST_SECOND = -377705023201
LATEST_SECOND = 253402207200


def whole_second(seconds: Column) -> Column:
    """A recorded time cut to whole seconds, sign kept; out of range is the epoch."""
    cut = F.when(seconds < 0, F.ceil(seconds)).otherwise(F.floor(seconds)).cast("long")
    return F.when(cut.between(EARLIEST_SECOND, LATEST_SECOND), cut).otherwise(F.lit(0).cast("long"))


def normal_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(whole_second(seconds))


# Directory-name prefixes of known providers.
PROVIDER_PREFIXES = {
    "GoogleDrive": "google_drive",
    "OneDrive": "one_drive",
    "Dropbox": "dropbox",
    "iCloudDrive": "icloud",
}


def provider_of_mount(name: Column) -> Column:
    """Provider of a ``Provider-Account`` folder; an unknown prefix stays verbatim."""
    prefix = F.regexp_extract(name, "^([^-]*)", 1)
    table = F.create_map(*[F.lit(x) for kv in PROVIDER_PREFIXES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, prefix), prefix)


def account_of_mount(name: Column) -> Column:
    """Everything after the first hyphen, if anything is there."""
    rest = F.regexp_extract(name, "(?s)^[^-]*-(.+)$", 1)
    return F.when(rest != "", rest)


def is_digest(text: Column) -> Column:
    return text.rlike("^[0-9a-fA-F]{64}$")
