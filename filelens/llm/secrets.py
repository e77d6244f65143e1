"""Secrets in text, found through a trigram index. DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived
(``trigram_query``): every alternative of a mandatory literal must have all of its
trigrams. Postings hold, for the trigrams that any query names, the texts they occur
in; intersecting them leaves the candidates of each rule, and only those are
verified with the expression itself. A rule without mandatory trigrams scans
everything. Matches are leftmost and do not overlap within a rule; one whose checked
group is shorter than the rule's minimum is dropped after it has consumed its text.

Rows: null texts count as empty; empty texts give a row without spans; repeated rows
give a row each; null ids are kept; columns other than ``doc_id`` and ``text`` are
ignored by ``find_secrets`` and kept by ``redact``. Offsets count code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_STRINGS = 64  # beyond so many exact strings a part of a query is closed


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read alike by Java's and Python's engines; ``group`` is the
    part whose length must reach ``least``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x0A\x0D]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
)
BASE = ("assign", "access", "hex")


# --- queries from expressions -----------------------------------------------------


def _clause(strings: set[str]) -> list[frozenset[str]] | None:
    """Alternatives, each all trigrams of one string; None where one has no trigram."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if not sets or frozenset() in sets else sorted(sets, key=sorted)


def _walk(items, clauses: list) -> set[str] | None:
    """Exact strings that a sequence can match, or None; what had to be given up as
    exact is closed as a clause, as every match must still contain it."""
    exact: set[str] | None = {""}

    def close() -> None:
        nonlocal exact
        if exact is not None and (clause := _clause({s.lower() for s in exact})):
            clauses.append(clause)

    whole = True
    for code, value in items:
        if code is op.LITERAL:
            found = {chr(value)}
        elif code is op.SUBPATTERN:
            found = _walk(value[3], clauses)
        elif code is op.BRANCH:
            # Clauses of one branch alone are not mandatory: only exact branches count.
            branches = [_walk(branch, []) for branch in value[1]]
            found = None if None in branches else set().union(*branches)
        elif code is op.IN and all(c is op.LITERAL for c, _ in value) and len(value) <= 8:
            found = {chr(v) for _, v in value}
        elif code is op.MAX_REPEAT and value[:2] == (0, 1):
            found = _walk(value[2], [])
            found = None if found is None else found | {""}
        else:
            found = None
        if found is not None and exact is not None and len(exact) * len(found) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in found}
        else:
            close()
            whole = False
            exact = found if found is not None else {""}
    if not whole:
        close()
        return None
    return exact


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """The lower-case trigrams a match must have: all clauses, in each clause one of
    its alternatives, of that all trigrams. An empty list admits every text."""
    clauses: list[list[frozenset[str]]] = []
    exact = _walk(parser.parse(pattern), clauses)
    if exact is not None and (clause := _clause({s.lower() for s in exact})):
        clauses.append(clause)
    return clauses


# --- index and candidates ---------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """Two columns that stand for a row, nulls included."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns(
        {"_text": text, "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "_of": F.xxhash64(text)}
    )


def postings(docs: DataFrame, rules=RULES) -> DataFrame:
    """(trigram, _id, _of) for the trigrams that some rule's query names."""
    named = sorted({t for r in rules for c in trigram_query(r.pattern) for alt in c for t in alt})
    low = docs.select("_id", "_of", F.lower("_text").alias("_low"))
    found = [F.when(F.contains("_low", F.lit(t)), F.lit(t)) for t in named]
    return low.select("_id", "_of", F.explode(F.array_compact(F.array(*found))).alias("trigram"))


def _admits(rule: Rule, has: Column) -> Column:
    clauses = trigram_query(rule.pattern)
    if not clauses:
        return F.lit(True)
    every = lambda alt: reduce(Column.__and__, [F.array_contains(has, t) for t in sorted(alt)])
    return reduce(Column.__and__, [reduce(Column.__or__, [every(a) for a in c]) for c in clauses])


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """Texts with the indexed rules that may match them: postings intersected. A
    text has no more postings than the queries have trigrams."""
    sets = postings(docs, rules).groupBy("_id", "_of").agg(F.collect_set("trigram").alias("_has"))
    indexed = [r for r in rules if trigram_query(r.pattern)]
    flags = [_admits(r, F.col("_has")).alias(f"_may_{r.kind}") for r in indexed]
    admitted = sets.select("_id", "_of", *flags)
    return admitted.where(reduce(Column.__or__, [F.col(f"_may_{r.kind}") for r in indexed]))


def _with_candidates(keyed: DataFrame, rules) -> DataFrame:
    joined = keyed.join(candidates(keyed, rules), ["_id", "_of"], "left")
    flags = {}
    for rule in rules:
        pattern = F.col("_text").rlike(rule.pattern)
        may = F.coalesce(F.col(f"_may_{rule.kind}"), F.lit(False)) if trigram_query(rule.pattern) else F.lit(True)
        flags[f"_is_{rule.kind}"] = may & pattern
    return joined.withColumns(flags)


def _pieces(rule: Rule) -> tuple[Column, Column, Column]:
    """Texts between matches (one more than matches), matches, lengths of the
    checked group."""
    pattern = F.lit(rule.pattern)
    between = F.split("_text", rule.pattern, -1)
    matches = F.regexp_extract_all("_text", pattern, F.lit(0))
    checked = F.regexp_extract_all("_text", pattern, F.lit(rule.group)) if rule.group else matches
    return between, matches, F.transform(checked, F.length)


def _match_rows(rule: Rule, rank: int) -> Column:
    """An array with the text's matches, failing ones included."""
    between, matches, checked = _pieces(rule)
    sizes = F.zip_with(
        F.slice(between, F.lit(1), F.size(matches)),
        matches,
        lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("long")),
    )
    return F.zip_with(
        sizes,
        checked,
        lambda at, held: F.struct(
            F.lit(rank).alias("rank"), at["gap"].alias("gap"), at["long"].alias("long"), (held >= rule.least).alias("good")
        ),
    )


def _masked(rule: Rule) -> Column:
    """The text with good matches replaced."""
    between, matches, checked = _pieces(rule)
    masks = F.zip_with(matches, checked, lambda m, held: F.when(held >= rule.least, F.lit(f"[{rule.kind}]")).otherwise(m))
    rest = F.zip_with(masks, F.slice(between, F.lit(2), F.size(matches)), lambda m, gap: F.concat(m, gap))
    return F.concat(F.element_at(between, 1), F.array_join(rest, ""))


def spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """(_id, _of, kind, rank, start, end), one row per span and distinct row."""
    keyed = _with_candidates(_keyed(docs.select("doc_id", "text")), rules)
    found = []
    for rank, rule in enumerate(rules):
        found.append(F.when(F.col(f"_is_{rule.kind}"), _match_rows(rule, rank)))
    rows = keyed.where(reduce(Column.__or__, [F.col(f"_is_{r.kind}") for r in rules])).select(
        "_id", "_of", F.explode(F.array_compact(F.array(*found))).alias("_found")
    )
    rows = rows.select("_id", "_of", F.posexplode("_found").alias("at", "m")).select("_id", "_of", "at", "m.*")
    # One exchange: the rows of a text meet once, for repeated rows, sums and lists.
    rows = rows.repartition("_id", "_of").dropDuplicates(["_id", "_of", "rank", "at"])
    so_far = Window.partitionBy("_id", "_of", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("long")).cast("long")).over(so_far)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rank") + 1)
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("long"))
    return placed.where("good").select("_id", "_of", kind.alias("kind"), "rank", "start", "end")


def _listed(of: Column) -> Column:
    """kind:start:end by start, then rank."""
    return F.array_join(
        F.transform(F.sort_array(of), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, the digest of the base
    spans and all spans as text."""
    span = F.struct("start", "rank", "kind", "end")
    base = F.col("kind").isin(*BASE)
    per_text = spans(docs, rules).groupBy("_id", "_of").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.collect_list(F.when(base, span)).alias("_base"),
        F.collect_list(span).alias("_all"),
    )
    found = per_text.select(
        "_id", "_of", *[f"n_{k}" for k in BASE], _listed(F.col("_base")).alias("_base"), _listed(F.col("_all")).alias("spans")
    )
    rows = _keyed(docs.select("doc_id", "text")).select("doc_id", "_id", "_of")
    return rows.join(found, ["_id", "_of"], "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """Documents with every secret replaced by ``[kind]``, rule after rule, and
    ``n_chars`` (if there) counted anew for changed texts. Other columns and null
    texts stay as they are."""
    columns = docs.columns
    # The given columns travel as one, so that no helper can bear the name of one.
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    out = _with_candidates(_keyed(docs.select(row, "doc_id", "text")), rules)
    for rule in rules:
        out = out.withColumn("_text", F.when(F.col(f"_is_{rule.kind}"), _masked(rule)).otherwise(F.col("_text")))
    given = lambda c: F.col("_row").getField(c)
    changed = ~given("text").eqNullSafe(F.col("_text")) & given("text").isNotNull()
    made = {c: given(c) for c in columns}
    made["text"] = F.when(changed, F.col("_text")).otherwise(made["text"])
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        made["n_chars"] = F.when(changed, F.length("_text").cast(kind)).otherwise(made["n_chars"])
    return out.select(*[value.alias(c) for c, value in made.items()])
