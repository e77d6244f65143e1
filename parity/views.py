"""The same tables and rules as DuckDB views, written as plain SQL.

Each entry is a common table expression; a query text names the ones it needs and
``compose`` puts those, and what they need, in front of it.
"""

from __future__ import annotations

import re

from filelens.functions import classify
from parity.tables import FIRST_DIRECTORY, FIRST_LINK, FIRST_MARKER, ROOTS

SAMPLE = 65536


def _ancestors(path: str) -> str:
    return (
        f"[CASE WHEN i = 1 THEN '/' ELSE array_to_string(string_split({path}, '/')[1:i], '/') END"
        f" FOR i IN range(1, len(string_split({path}, '/')))]"
    )


def parent(path: str) -> str:
    cut = f"regexp_extract({path}, '(?s)^(.*)/[^/]*$', 1)"
    return f"CASE WHEN {path} = '/' THEN NULL WHEN {cut} = '' THEN '/' ELSE {cut} END"


def name(path: str) -> str:
    return f"string_split({path}, '/')[-1]"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def category(path: str) -> str:
    ext = f"lower(regexp_extract({name(path)}, '(?s)^.+\\.([^.]*)$', 1))"
    lists = " ".join(
        f"WHEN {ext} IN ({quoted(text.split())}) THEN '{kind}'"
        for kind, text in classify.EXTENSIONS.items()
    )
    return (
        f"CASE WHEN list_has_any(string_split({path}, '/'), [{quoted(classify.MACHINE_PLACES)}]) "
        f"THEN 'system' WHEN regexp_matches({name(path)}, '(?s)^\\.[^.]*$') THEN 'system' "
        f"{lists} ELSE 'other' END"
    )


def weight(prefix: str = "") -> str:
    return (
        f"CASE WHEN {prefix}residency IN ('remote', 'partial') THEN {prefix}logical_size "
        f"ELSE coalesce({prefix}allocated_size, {prefix}logical_size) END"
    )


def sample_of(end: int) -> str:
    return (
        f"CASE WHEN strlen(text) <= {2 * end} THEN sha256(text) ELSE "
        f"sha256(encode(CAST(strlen(text) AS VARCHAR)) || encode(text)[1:{end}] || "
        f"encode(text)[-{end}:]) END"
    )


def settled(wanted: str, end: int, scope: str = "") -> str:
    """Fingerprints of wanted objects; ``scope`` adds a grouping column."""
    extra = f", {scope}" if scope else ""
    return f"""
    SELECT machine, first_name AS entry_id,
      CASE WHEN logical_size <= {2 * end} OR agree > 1 THEN 'content' ELSE 'sample' END AS kind,
      CASE WHEN logical_size <= {2 * end} OR agree > 1 THEN sha256(text) ELSE sample END AS fingerprint
    FROM (SELECT w.*, d.text, {sample_of(end)} AS sample,
            count(*) OVER (PARTITION BY logical_size, {sample_of(end)}{extra}) AS agree
          FROM {wanted} w JOIN documents d ON d.doc_id = w.first_name)"""


def kept(rule: str, under: str = "") -> str:
    key = {
        "oldest": "0, coalesce(modified_s, 9223372036854775807)",
        "newest": "0, coalesce(-modified_s, -9223372036854775808)",
        "shallowest": "0, len(string_split(path, '/'))",
        "under": f"CASE WHEN path = '{under}' OR starts_with(path, '{under}/') THEN 0 ELSE 1 END, "
        "len(string_split(path, '/'))",
    }[rule]
    return f"""
    SELECT group_id, entry_id AS kept_entry, path AS kept FROM (
      SELECT group_id, entry_id, path, row_number() OVER (PARTITION BY group_id
        ORDER BY {key}, string_split(path, '/'), entry_id) AS rank
      FROM v_exact_name WHERE entry_id = first_name) WHERE rank = 1"""


# Folder k of a machine in the edit log: /home/src{2k} on mac, /home/src{2k+1} on windows.
def folder(k: int, machine: str = "machine") -> str:
    return f"('/home/src' || CAST({2 * k} + CASE WHEN {machine} = 'windows' THEN 1 ELSE 0 END AS VARCHAR))"


def under(path: str, root: str) -> str:
    return f"({path} = {root} OR starts_with({path}, {root} || '/'))"


VIEWS = {
    "v_file": f"""
    SELECT doc_id AS entry_id, CASE WHEN doc_id % 2 = 0 THEN 'mac' ELSE 'windows' END AS machine,
      'file' AS kind,
      concat('/home/', source, CASE WHEN doc_id % 17 = 0 THEN '/node_modules/'
        WHEN doc_id % 13 = 0 THEN '/old/' ELSE '/' END, lang, '/doc', CAST(doc_id AS VARCHAR),
        CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.JPG' WHEN 2 THEN '.parquet' WHEN 3 THEN ''
          WHEN 4 THEN '.tar.gz' WHEN 5 THEN '.mov' ELSE '.pdf' END) AS path,
      CAST(strlen(text) AS BIGINT) AS logical_size,
      CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 29 = 0 THEN NULL
        ELSE CAST(ceil(strlen(text) / 4096.0) AS BIGINT) * 4096 END AS allocated_size,
      CASE WHEN doc_id % 37 = 0 THEN NULL ELSE (doc_id * 7919) % 100000 - 5000 END AS modified_s,
      1 AS volume,
      CASE WHEN doc_id % 3 = 0 THEN min(doc_id) OVER (PARTITION BY text, doc_id % 2)
        ELSE doc_id END AS file_index,
      CASE WHEN doc_id % 11 = 0 THEN 'remote' WHEN doc_id % 23 = 0 THEN 'unknown'
        WHEN doc_id % 3 = 0 THEN 'local' ELSE 'not_synced' END AS residency,
      CAST(NULL AS VARCHAR) AS link_target
    FROM documents""",
    "v_link": f"""
    SELECT page_id + {FIRST_LINK} AS entry_id,
      CASE WHEN page_id % 2 = 0 THEN 'mac' ELSE 'windows' END AS machine, 'symlink' AS kind,
      concat('/home/src', CAST(page_id % 20 AS VARCHAR), '/link', CAST(page_id AS VARCHAR)) AS path,
      CAST(strlen(target) AS BIGINT) AS logical_size, CAST(NULL AS BIGINT) AS allocated_size,
      CAST(NULL AS BIGINT) AS modified_s, CAST(NULL AS BIGINT) AS volume,
      CAST(NULL AS BIGINT) AS file_index, 'not_synced' AS residency, target AS link_target
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/home/src1/en'
        WHEN 1 THEN concat('/Volumes/ext', CAST(page_id % 5 AS VARCHAR))
        WHEN 2 THEN concat('shared/', CAST(page_id % 3 AS VARCHAR))
        ELSE concat('/home/src', CAST(page_id % 7 AS VARCHAR), '/old') END AS target FROM pages)""",
    "v_marker": f"""
    SELECT r_regionkey + {FIRST_MARKER} AS entry_id,
      CASE WHEN r_regionkey % 2 = 0 THEN 'mac' ELSE 'windows' END AS machine, 'directory' AS kind,
      concat('/Volumes/ext', CAST(r_regionkey AS VARCHAR), '/.dropbox.cache') AS path,
      4096 AS logical_size, 4096 AS allocated_size, CAST(NULL AS BIGINT) AS modified_s,
      CAST(NULL AS BIGINT) AS volume, CAST(NULL AS BIGINT) AS file_index, 'local' AS residency,
      CAST(NULL AS VARCHAR) AS link_target FROM region""",
    "v_leaf": "SELECT * FROM v_file UNION ALL SELECT * FROM v_link UNION ALL SELECT * FROM v_marker",
    "v_dir": f"""
    SELECT {FIRST_DIRECTORY} + row_number() OVER (ORDER BY machine, string_split(path, '/')) AS entry_id,
      machine, 'directory' AS kind, path, 4096 AS logical_size, 4096 AS allocated_size,
      CAST(NULL AS BIGINT) AS modified_s, CAST(NULL AS BIGINT) AS volume,
      CAST(NULL AS BIGINT) AS file_index, 'not_synced' AS residency,
      CAST(NULL AS VARCHAR) AS link_target
    FROM (SELECT DISTINCT machine, unnest({_ancestors('path')}) AS path FROM v_leaf) a
    WHERE NOT EXISTS (SELECT 1 FROM v_marker m WHERE m.machine = a.machine AND m.path = a.path)""",
    "v_entry": "SELECT * FROM v_leaf UNION ALL SELECT * FROM v_dir",
    "v_unread": """
    SELECT CASE WHEN event_id % 2 = 0 THEN 'mac' ELSE 'windows' END AS machine,
      concat('/home/src', CAST(user_id % 20 AS VARCHAR), '/event', CAST(event_id AS VARCHAR)) AS path,
      CASE event_type WHEN 'view' THEN 'permission_denied' WHEN 'click' THEN 'would_require_download'
        WHEN 'signup' THEN 'vanished' ELSE 'other' END AS reason,
      CASE WHEN event_type IN ('purchase', 'error') THEN concat(event_type, ' ', props) END AS detail
    FROM events""",
    "v_root": "SELECT * FROM (VALUES "
    + ", ".join(f"('{m}', '{p}', '{v}')" for m in ("mac", "windows") for p, v in ROOTS)
    + ") AS r(machine, path, provider)",
    "v_object": """
    SELECT g.machine, g.volume, g.file_index, g.first_name, g.names, f.logical_size,
      f.allocated_size, f.residency IN ('remote', 'partial', 'unknown') AS may_download
    FROM (SELECT machine, volume, file_index, min(entry_id) AS first_name, count(*) AS names
          FROM v_file WHERE logical_size > 0 GROUP BY ALL) g
    JOIN v_file f ON f.entry_id = g.first_name""",
    "v_name": """
    SELECT f.entry_id, o.first_name FROM v_file f JOIN v_object o
      ON o.machine = f.machine AND o.volume = f.volume AND o.file_index = f.file_index
    WHERE f.logical_size > 0""",
    "v_bucket": "SELECT logical_size, count(*) AS objects FROM v_object GROUP BY 1 HAVING count(*) > 1",
    "v_candidate": """
    SELECT * FROM v_object WHERE NOT may_download
      AND logical_size IN (SELECT logical_size FROM v_bucket)""",
    "v_thorough": "SELECT * FROM v_object WHERE NOT may_download",
    "v_settled": settled("v_candidate", SAMPLE),
    "v_settled_small": settled("v_candidate", 64),
    "v_settled_thorough": settled("v_thorough", SAMPLE, "machine"),
    "v_state": """
    SELECT o.*, s.kind AS state, s.fingerprint FROM v_object o
    LEFT JOIN v_settled s ON s.entry_id = o.first_name
    WHERE o.logical_size IN (SELECT logical_size FROM v_bucket)""",
    "v_group": """
    SELECT row_number() OVER (ORDER BY logical_size, tier, digest) - 1 AS group_id, * FROM (
      SELECT logical_size, 0 AS tier, fingerprint AS digest, count(*) AS objects, sum(names) AS names,
        min(first_name) AS first_entry,
        sum(coalesce(allocated_size, 0)) - arg_min(coalesce(allocated_size, 0), first_name)
          AS reclaimable_bytes, 0 AS settled_of_same_size, 0 AS download_objects,
        0 AS refused_objects, 0 AS bytes_to_settle
      FROM v_state WHERE state = 'content' GROUP BY 1, 3 HAVING count(*) > 1
      UNION ALL
      SELECT logical_size, 1, '', count(*) FILTER (state IS NULL),
        sum(names) FILTER (state IS NULL), min(first_name) FILTER (state IS NULL), 0,
        count(state), count(*) FILTER (state IS NULL AND may_download),
        count(*) FILTER (state IS NULL AND NOT may_download),
        coalesce(sum(logical_size) FILTER (state IS NULL AND may_download), 0)
      FROM v_state GROUP BY 1 HAVING count(*) FILTER (state IS NULL) > 0)""",
    "v_object_member": """
    SELECT g.group_id, s.first_name, s.machine, s.logical_size, s.allocated_size,
      row_number() OVER (PARTITION BY g.group_id ORDER BY s.first_name) - 1 AS object_id
    FROM v_state s JOIN v_group g ON g.logical_size = s.logical_size
      AND ((g.tier = 0 AND s.state = 'content' AND s.fingerprint = g.digest)
        OR (g.tier = 1 AND s.state IS NULL))""",
    "v_member": """
    SELECT m.group_id, m.object_id, m.machine, n.entry_id, m.first_name, m.logical_size,
      m.allocated_size FROM v_object_member m JOIN v_name n ON n.first_name = m.first_name""",
    "v_exact_name": """
    SELECT m.group_id, m.object_id, m.entry_id, m.first_name, g.digest AS content, f.machine,
      f.path, f.logical_size, f.allocated_size, f.modified_s
    FROM v_member m JOIN v_group g ON g.group_id = m.group_id AND g.tier = 0
    JOIN v_file f ON f.entry_id = m.entry_id""",
    "v_keep_oldest": kept("oldest"),
    "v_keep_newest": kept("newest"),
    "v_keep_shallowest": kept("shallowest"),
    "v_keep_under": kept("under", "/home/src1"),
    "v_quarantine": """
    SELECT n.*, k.kept, coalesce(n.allocated_size, 0) AS frees_bytes FROM v_exact_name n
    JOIN v_keep_oldest k ON k.group_id = n.group_id AND n.first_name <> k.kept_entry""",
    "v_machine": "SELECT * FROM (VALUES ('mac'), ('windows')) AS m(machine)",
    "v_first_file": f"""
    SELECT machine, max(CASE WHEN k = 2 THEN first END) AS moved,
      max(CASE WHEN k = 6 THEN first END) AS aside, max(CASE WHEN k = 9 THEN first END) AS renamed
    FROM (SELECT machine, k, min(entry_id) AS first FROM v_file,
            (SELECT unnest([2, 6, 9]) AS k) ks
          WHERE starts_with(path, '/home/src' || CAST(2 * k + CASE WHEN machine = 'windows'
            THEN 1 ELSE 0 END AS VARCHAR) || '/') GROUP BY 1, 2) GROUP BY 1""",
    "v_arranged": f"""
    SELECT e.*, CASE
      WHEN e.entry_id = f.aside THEN NULL
      WHEN e.entry_id = f.moved THEN '/home/two/' || {name('e.path')}
      WHEN e.entry_id = f.renamed THEN ({parent('e.path')}) || '/trimmed.txt'
      WHEN {under('e.path', folder(1, 'e.machine'))}
        THEN '/home/two' || substr(e.path, length({folder(1, 'e.machine')}) + 1)
      WHEN {under('e.path', folder(8, 'e.machine'))}
        THEN '/home/archive/nine' || substr(e.path, length({folder(8, 'e.machine')}) + 1)
      ELSE e.path END AS now_path,
      e.entry_id IN (f.aside, f.moved, f.renamed) OR e.path IN ({", ".join(
          folder(k, 'e.machine') for k in (1, 3, 4, 5, 7, 8))}) AS asked
    FROM v_entry e JOIN v_first_file f ON f.machine = e.machine""",
    "v_edit_operation": f"""
    SELECT 'create_directory' AS kind, machine, CAST(NULL AS BIGINT) AS entry_id,
      CAST(NULL AS VARCHAR) AS subject_path, path AS destination, CAST(NULL AS VARCHAR) AS content,
      CAST(NULL AS BIGINT) AS logical_size, CAST(NULL AS BIGINT) AS modified_s, 0 AS frees_bytes,
      CAST(NULL AS VARCHAR) AS because, CAST(NULL AS VARCHAR) AS kept, true AS is_folder
    FROM v_machine, (VALUES ('/home/archive'), ('/home/archive/sub')) AS d(path)
    UNION ALL
    SELECT CASE WHEN a.now_path IS NULL THEN 'quarantine' ELSE 'move' END, a.machine, a.entry_id,
      a.path, a.now_path, s.fingerprint, a.logical_size, a.modified_s,
      CASE WHEN a.now_path IS NULL THEN coalesce(a.allocated_size, 0) ELSE 0 END, 'requested',
      NULL, a.kind = 'directory'
    FROM v_arranged a LEFT JOIN v_settled s ON s.entry_id = a.entry_id AND s.kind = 'content'
    WHERE a.asked AND (a.now_path IS NULL OR a.now_path <> a.path)""",
    "v_plan": """
    SELECT row_number() OVER (ORDER BY CASE kind WHEN 'create_directory' THEN 1 WHEN 'move' THEN 2
        ELSE 3 END, string_split(coalesce(destination, subject_path), '/'), machine, entry_id) - 1
        AS position, * FROM (
      SELECT * FROM v_edit_operation
      UNION ALL
      SELECT 'quarantine', machine, entry_id, path, NULL, content, logical_size, modified_s,
        frees_bytes, 'redundant_copy', kept, false
      FROM v_quarantine q WHERE NOT EXISTS
        (SELECT 1 FROM v_edit_operation o WHERE o.entry_id = q.entry_id))""",
    "v_observed": """
    SELECT e.* REPLACE (e.logical_size + coalesce(l.toxic, 0) AS logical_size),
      CASE WHEN e.kind = 'file' AND starts_with(e.path, '/home/src9/fr/')
        THEN 'permission_denied' END AS refusal
    FROM v_entry e LEFT JOIN labels l ON l.doc_id = e.entry_id
    WHERE coalesce(l.quality, 1) <> 0""",
    "v_observed_digest": """
    SELECT doc_id AS entry_id, sha256(CASE WHEN lang = 'de' THEN 'x' || substr(text, 2) ELSE text END)
      AS actual FROM documents""",
    "v_looked": f"""
    SELECT p.*, s.entry_id AS s_entry, s.logical_size AS s_size, s.modified_s AS s_modified,
      s.refusal AS s_refusal, s.residency IN ('remote', 'partial', 'unknown') AS s_download,
      t.entry_id AS t_entry, t.kind AS t_kind, t.refusal AS t_refusal,
      p.logical_size <> s.logical_size OR p.modified_s IS NULL
        OR p.modified_s IS DISTINCT FROM s.modified_s AS differs,
      d.actual, p.destination IN (SELECT subject_path FROM v_plan v WHERE v.machine = p.machine
        AND subject_path IS NOT NULL) AS vacated,
      i.kind AS i_kind, i.refusal AS i_refusal, ({parent('p.destination')}) IN (SELECT destination
        FROM v_plan v WHERE v.machine = p.machine AND v.kind = 'create_directory') AS made
    FROM v_plan p LEFT JOIN v_observed s ON s.machine = p.machine AND s.path = p.subject_path
    LEFT JOIN v_observed t ON t.machine = p.machine AND t.path = p.destination
    LEFT JOIN v_observed i ON i.machine = p.machine AND i.path = ({parent('p.destination')})
    LEFT JOIN v_observed_digest d ON d.entry_id = s.entry_id""",
}


def _verdict(content: bool) -> str:
    checks = (
        """WHEN content IS NOT NULL AND actual IS NULL THEN 'fail:other'
           WHEN content IS NOT NULL AND actual <> content THEN 'hold:source_changed'"""
        if content
        else ""
    )
    return f"""
    SELECT *, split_part(outcome, ':', 1) AS grade, nullif(split_part(outcome, ':', 2), '') AS impediment
    FROM (SELECT *, CASE
      WHEN kind = 'create_directory' AND t_entry IS NULL THEN 'pass'
      WHEN kind = 'create_directory' AND t_refusal IS NOT NULL THEN 'fail:' || t_refusal
      WHEN kind = 'create_directory' AND t_kind = 'directory' THEN 'pass'
      WHEN kind = 'create_directory' THEN 'hold:destination_occupied'
      WHEN s_entry IS NULL THEN 'hold:source_missing'
      WHEN s_refusal IS NOT NULL THEN 'fail:' || s_refusal
      WHEN s_download THEN 'hold:content_not_present'
      WHEN differs THEN 'hold:source_changed'
      {checks}
      WHEN destination IS NOT NULL AND t_refusal IS NOT NULL THEN 'hold:' || t_refusal
      WHEN destination IS NOT NULL AND t_entry IS NOT NULL AND NOT vacated
        THEN 'hold:destination_occupied'
      WHEN destination IS NULL OR made THEN 'pass'
      WHEN i_refusal IS NOT NULL THEN 'hold:' || i_refusal
      WHEN i_kind IS NULL OR i_kind <> 'directory' THEN 'hold:destination_unreachable'
      ELSE 'pass' END AS outcome FROM v_looked)"""


VIEWS["v_verdict"] = _verdict(False)
VIEWS["v_verdict_content"] = _verdict(True)
VIEWS["v_attempt"] = """
    SELECT *, CASE WHEN kind = 'create_directory' THEN NULL WHEN s_entry IS NULL THEN 'source_missing'
      WHEN s_refusal IS NOT NULL THEN 'other' WHEN s_download THEN 'content_not_present'
      WHEN content IS NOT NULL AND actual <> content THEN 'source_changed' END AS own,
      CASE WHEN kind = 'quarantine' THEN '/quarantine' || subject_path ELSE destination END AS lands
    FROM v_verdict WHERE grade = 'pass'"""
VIEWS["v_step"] = """
    SELECT *, coalesce(own, CASE WHEN gone THEN 'source_missing' END) AS reason FROM (
      SELECT a.*, EXISTS (SELECT 1 FROM v_attempt j WHERE j.machine = a.machine AND j.is_folder
        AND j.kind = 'move' AND j.own IS NULL AND j.position < a.position
        AND starts_with(a.subject_path, j.subject_path || '/')) AS gone FROM v_attempt a)"""
VIEWS["v_after"] = """
    SELECT o.machine, o.entry_id, o.kind, coalesce(s.lands, f.lands || substr(o.path,
        length(f.subject_path) + 1), o.path) AS path
    FROM v_observed o
    LEFT JOIN v_step s ON s.machine = o.machine AND s.subject_path = o.path AND s.reason IS NULL
    LEFT JOIN v_step f ON f.machine = o.machine AND f.kind = 'move' AND f.is_folder
      AND f.reason IS NULL AND starts_with(o.path, f.subject_path || '/')
    UNION ALL
    SELECT machine, NULL, 'directory', destination FROM v_step
    WHERE kind = 'create_directory' AND t_entry IS NULL"""


def compose(text: str) -> str:
    """A query with the views it needs in front, in dependency order."""
    order: list[str] = []

    def need(sql: str) -> None:
        for view in re.findall(r"\bv_[a-z_]+\b", sql):
            if view in VIEWS and view not in order:
                need(VIEWS[view])
                if view not in order:
                    order.append(view)

    need(text)
    if not order:
        return text.strip()
    head = ",\n".join(f"{view} AS ({VIEWS[view]})" for view in order)
    return f"WITH {head}\n{text.strip()}"
