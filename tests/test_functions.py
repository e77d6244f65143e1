from __future__ import annotations

from pyspark.sql import functions as F

from filelens.functions import classify, paths, sizes
from filelens.functions import content as digests
from tests.conftest import sha


def values(spark, texts, *columns):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [tuple(r)[1:] for r in frame.select("i", *columns).orderBy("i").collect()]


def test_parts_of_paths(spark):
    v = F.col("v")
    got = values(
        spark,
        ["/", "/D", "/D/t.PDF", "/D/.gitignore", "/D/a.", "/D/.tar.gz"],
        paths.depth(v),
        paths.parent(v),
        paths.file_name(v),
        paths.extension(v),
    )
    assert got == [
        (1, None, None, None),
        (2, "/", "D", None),
        (3, "/D", "t.PDF", "pdf"),
        (3, "/D", ".gitignore", None),
        (3, "/D", "a.", None),
        (3, "/D", ".tar.gz", "gz"),
    ]


def test_ancestors_run_down_to_the_root(spark):
    got = values(spark, ["/", "/a", "/a/b/c"], paths.ancestors(F.col("v")))
    assert got == [([],), (["/"],), (["/", "/a", "/a/b"],)]


def test_prefixes_end_at_components(spark):
    under = paths.is_under(F.col("v"), F.lit("/iCloud"))
    assert values(spark, ["/iCloud", "/iCloud/a", "/iCloudX", "/a"], under) == [
        (True,), (True,), (False,), (False,)
    ]
    assert values(spark, ["/", "/a"], paths.is_under(F.col("v"), F.lit("/"))) == [(True,), (True,)]


def test_paths_order_by_component(spark):
    frame = spark.createDataFrame([("/a-b",), ("/a/b",), ("/a",)], "v string")
    ordered = frame.orderBy(paths.parts(F.col("v"))).collect()
    assert [r.v for r in ordered] == ["/a", "/a/b", "/a-b"]


def test_short_paths_and_quarantine_places(spark):
    v = F.col("v")
    got = values(
        spark, ["/a/b", "/a/b/c", "/a/./../b"], paths.short_path(v),
        paths.quarantine_place(v, F.lit("/q")),
    )
    assert got == [("/a/b", "/q/a/b"), ("…/b/c", "/q/a/b/c"), ("…/../b", "/q/a/b")]


def test_names_are_names(spark):
    got = values(
        spark, ["ok", " ok ", "", "  ", ".", "..", "a/b", "...", "\u00a0", "\u2003x\u00a0"], paths.name_trouble(F.col("v"))
    )
    assert [g[0] for g in got] == [
        None, None, paths.NAME_EMPTY, paths.NAME_EMPTY, paths.NAME_DOTS, paths.NAME_DOTS,
        paths.NAME_SEPARATOR, None, paths.NAME_EMPTY, None,
    ]


def test_bytes_are_kept_only_where_text_is_lossy(spark):
    frame = spark.createDataFrame([(b"/a",), (b"/a\xff",)], "v binary")
    got = frame.select(paths.exact_bytes(F.col("v")), paths.rendered(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(None, "/a"), (b"/a\xff", "/a�")]


def test_place_decides_a_category_before_name(spark):
    got = values(
        spark,
        ["/u/Library/a.png", "/u/a.PNG", "/u/.gitignore", "/u/.a.png", "/u/a", "/u/Librarys/a.mov",
         "/node_modules", "/u/m.gguf"],
        classify.category_of(F.col("v")),
    )
    assert [g[0] for g in got] == [
        "system", "images", "system", "images", "other", "video", "system", "data"
    ]


def test_flags_become_residency_and_retention(spark):
    bits = [0, classify.WIN_RECALL_ON_DATA_ACCESS, classify.WIN_OFFLINE,
            classify.WIN_RECALL_ON_OPEN | classify.WIN_RECALL_ON_DATA_ACCESS, classify.WIN_PINNED,
            classify.WIN_UNPINNED, classify.WIN_PINNED | classify.WIN_UNPINNED]
    frame = spark.createDataFrame(list(enumerate(bits)), "i int, a int").orderBy("i")
    got = frame.select(classify.windows_residency(F.col("a")), classify.windows_retention(F.col("a")))
    assert [tuple(r) for r in got.collect()] == [
        ("local", "unspecified"), ("partial", "unspecified"), ("remote", "unspecified"),
        ("remote", "unspecified"), ("local", "pinned"), ("local", "unpinned"),
        ("local", "unspecified"),
    ]
    mac = spark.createDataFrame(
        [(0, "file", 0, 5), (0, "file", 0, 0), (0, "directory", 0, 64), (1 << 30, "file", 8, 5)],
        "f int, k string, b int, s int",
    )
    got = mac.select(classify.mac_residency(F.col("f"), F.col("k"), F.col("b"), F.col("s")))
    assert [r[0] for r in got.collect()] == ["remote", "local", "local", "remote"]


def test_times_keep_their_sign_and_fall_back_to_the_epoch(spark):
    frame = spark.createDataFrame([(1.9,), (-1.9,), (1e18,)], "v double")
    assert [r[0] for r in frame.select(classify.whole_second(F.col("v"))).collect()] == [1, -1, 0]


def test_mounts_split_on_the_first_hyphen(spark):
    v = F.col("v")
    got = values(
        spark, ["GoogleDrive-a-b", "OneDrive-", "Dropbox", "Box-x", "iCloudDrive"],
        classify.provider_of_mount(v), classify.account_of_mount(v),
    )
    assert got == [
        ("google_drive", "a-b"), ("one_drive", None), ("dropbox", None), ("Box", "x"),
        ("icloud", None),
    ]


def test_sizes_are_truncated_never_rounded(spark):
    sizes_in = [999, 1000, 1999, 9_990_000, 12_345_678, 999_999_999_999, 10**15, 2**62]
    frame = spark.createDataFrame(list(enumerate(sizes_in)), "i int, v long").orderBy("i")
    got = frame.select(sizes.human_bytes(F.col("v")), sizes.window_bytes(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [
        ("999 bytes", "999 bytes"), ("1.0 kB", "1 KB"), ("1.9 kB", "1.9 KB"),
        ("9.9 MB", "9.9 MB"), ("12.3 MB", "12 MB"), ("999.9 GB", "999 GB"),
        ("1000.0 TB", "1 PB"), ("4611686.0 TB", "4611 PB"),
    ]


def test_a_sample_covers_length_and_both_ends(spark):
    text = "ab" * 10
    got = values(
        spark, [text, text[:9] + "zz" + text[11:], "x" + text[1:], "short"],
        digests.sample_digest(F.col("v"), F.octet_length("v").cast("long"), 4),
    )
    assert got[0] == got[1] == (sha("20" + "abab" + "abab"),)
    assert got[2] != got[0]
    assert got[3] == (sha("short"),)


def test_digests_are_64_hex_characters(spark):
    got = values(spark, ["a" * 64, "A" * 64, "a" * 63, "g" * 64], classify.is_digest(F.col("v")))
    assert [g[0] for g in got] == [True, True, False, False]
