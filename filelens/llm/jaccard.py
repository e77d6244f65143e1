"""Near-duplicate join on word shingles by a token-group matrix. Exact.

Texts with equal shingle sets become one class, stood for by its smallest document.
Classes are partitioned into groups of similar ones: those with one of their smallest
shingles in common, if their bottom sketches agree with the sketch of the first of
them; others stay alone. Large groups are cut into blocks. The matrix holds, for each
block, the union of the tokens of which its members must share several with
anything they link to (a prefix of each set in one order, frequent tokens last), with
the span of set sizes. Two blocks of which no members can reach the wanted overlap
share fewer such tokens or differ too much in size; only the other pairs of blocks
are opened, and their sets compared. An opened pair returns links that span its components, so
no group ever puts out all its pairs. Components follow from the links.

Which tokens count as frequent only decides which pairs are opened, never the result.

Rows: null and empty texts have an empty set and are linked with nothing; rows that
repeat a ``doc_id`` are one document with a row each; a null ``doc_id`` has a null
component; ties go to the smallest id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.llm import text as tx
from filelens.session import keep

LOCAL_FREQUENT = 3  # occurrences among LOCAL_TOKENS tokens from which a token is reported
LOCAL_TOKENS = 2_000_000
FREQUENT = 200_000  # most frequent reported tokens that are ordered last: 1.6 MB
SKETCH = 16
SIMILAR = 0.4  # agreement of sketches within a group
BLOCK_TOKENS = 150_000  # in the sets of a block, about
SHARED, SHARED_OF = 4, 32  # tokens that prefixes of linked sets share: so many, and one of so many more
KEYS = 4  # smallest tokens of a set by which it looks for a group


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    return np.unique(tx.window_hashes(tx.word_hashes(text or ""), width))


def least_overlap(size: int, percent: int) -> int:
    """What a set of this size shares at least with any set it links to."""
    return -(-percent * size // 100)


def shared_tokens(size, percent: int):
    """How many tokens two sets' prefixes share if they link and the smaller has this
    size (a number or a column). Never falls with the size."""
    if isinstance(size, int):
        return min(SHARED + size // SHARED_OF, least_overlap(size, percent))
    return F.least(SHARED + F.floor(size / SHARED_OF), F.ceil(percent * size / 100))


# --- one pass for frequent tokens, one for sets -------------------------------------


def frequent_tokens(docs: DataFrame, width: int, most: int = FREQUENT) -> np.ndarray:
    """Tokens in many texts, sorted. Each task counts all tokens of its texts and
    reports those it saw several times; of the sums the largest come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def report():
            tokens, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= LOCAL_FREQUENT
            return pa.record_batch([tx.signed(tokens[often]), pa.array(seen[often].astype(np.int64))], ["token", "seen"])

        for batch in batches:
            for text in tx.column(batch, "text"):
                held.append(shingles(text, width))
                if sum(map(len, held[-1:])) and len(held) % 64 == 0 and sum(map(len, held)) > LOCAL_TOKENS:
                    yield report()
                    held = []
        if held:
            yield report()
        held = []

    local = docs.select("text").mapInArrow(tx.giving_back(count), "token long, seen long")
    top = local.groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(most)
    return np.sort(np.array([r[0] for r in top.select("token").collect()], np.int64).view(np.uint64))


def sets(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Per row: set size, a digest of the set, its smallest tokens as keys and as a sketch, and its prefix in the order frequent last, then by hash."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, least, sketches, prefixes = [], [], [], [], [], []
            for text in tx.column(batch, "text"):
                own = shingles(text, width)
                n = len(own)
                sizes.append(n)
                digest = tx.mix(own + np.uint64(n))
                first.append(int(np.bitwise_xor.reduce(digest)) if n else 0)
                second.append(int(np.add.reduce(tx.mix(digest), dtype=np.uint64)) if n else 0)
                least.append(own[:KEYS].view(np.int64).tolist())
                sketches.append(own[:SKETCH].tobytes())
                if len(frequent) and n:
                    often = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
                    own = np.concatenate([own[~often], own[often]])
                need = least_overlap(n, percent)
                prefixes.append(own[: n - need + shared_tokens(n, percent)].tobytes())
            out = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64())]
            out += [tx.signed(np.array(x, np.uint64)) for x in (first, second)]
            out += [pa.array(least, pa.list_(pa.int64()))]
            out += [pa.array(x, pa.binary()) for x in (sketches, prefixes)]
            yield pa.record_batch(out, ["doc_id", "n", "d1", "d2", "least", "sketch", "prefix"])

    shape = "doc_id long, n long, d1 long, d2 long, least array<long>, sketch binary, prefix binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tx.giving_back(describe), shape)


# --- groups and their matrix --------------------------------------------------------


def _agreement(a: bytes, b: bytes) -> float:
    """Share of common tokens among the smallest of both sets together."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.union1d(x, y)[:SKETCH]
    return np.isin(both, np.intersect1d(x, y)).sum() / max(len(both), 1)


def blocks(classes: DataFrame) -> DataFrame:
    """(rep, n, block): similar classes (rep, n, least, sketch) together."""
    keyed = classes.select("rep", F.explode("least").alias("key"))
    shared = keep(
        keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("many")).where("many > 1")
    )
    # Both sides are shuffled, so that a hot key is split between tasks.
    offers = keep(keyed.join(shared, "key").where("rep <> leader").select("rep", "leader", "many"))
    sketches = classes.select("rep", "sketch")
    led = sketches.withColumnsRenamed({"rep": "leader", "sketch": "led"})
    met = offers.join(sketches, "rep").join(led, "leader").select("rep", "leader", "many", "sketch", "led")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(tx.column(batch, "sketch"), tx.column(batch, "led"), strict=True)
            good = pa.array([_agreement(own, led) >= SIMILAR for own, led in pairs], pa.bool_())
            yield batch.select(["rep", "leader", "many"]).filter(good)

    # The commonest key whose leader is similar; a leader follows its own offers too.
    chosen = (
        met.mapInArrow(tx.giving_back(agree), "rep long, leader long, many long")
        .groupBy("rep").agg(F.max(F.struct("many", (-F.col("leader")).alias("to"))).alias("_best"))
        .select("rep", (-F.col("_best.to")).alias("unit"))
    )
    placed = keep(
        classes.select("rep", "n").join(chosen, "rep", "left").withColumn("unit", F.coalesce("unit", "rep"))
    )
    # A block's number is that of its unit, or of a hash within a large unit.
    large = keep(
        placed.groupBy("unit").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_many"))
        .where((F.col("_n") > BLOCK_TOKENS) & (F.col("_many") > 1))
        .select("unit", F.ceil(F.col("_n") / BLOCK_TOKENS).alias("_parts"))
    )
    part = F.pmod(F.xxhash64("rep"), F.col("_parts"))
    block = F.when(F.col("_parts").isNull(), F.struct("unit", F.lit(0).cast("long").alias("part"))).otherwise(
        F.struct("unit", part.alias("part"))
    )
    return placed.join(large, "unit", "left").select("rep", "n", block.alias("block"))


def matrix(members: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(token, block, smallest and largest size, members): the union of the members'
    prefixes (rep, prefix), which are moved only here."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(p, np.uint64) for p in tx.column(batch, "prefix")]
            each = np.repeat(np.arange(len(prefixes)), [len(p) for p in prefixes])
            tokens = np.concatenate([*prefixes, np.zeros(0, np.uint64)])
            kept = {c: batch.column(batch.schema.get_field_index(c)).take(pa.array(each)) for c in ("unit", "part", "n")}
            for at in range(0, len(tokens), 200_000):
                yield pa.record_batch(
                    [tx.signed(tokens[at : at + 200_000]), *[c.slice(at, 200_000) for c in kept.values()]], ["token", *kept]
                )

    rows = members.join(prefixes, "rep").select("block.unit", "block.part", "n", "prefix").mapInArrow(
        explode, "token long, unit long, part long, n long"
    )
    # Dealt by token once: the union of each block and the meeting of blocks follow
    # without another exchange.
    return (
        rows.repartition("token").groupBy("token", "unit", "part")
        .agg(F.min("n").alias("small"), F.max("n").alias("large"), F.count(F.lit(1)).alias("many"))
    )


def qualifying(union: DataFrame, percent: int) -> DataFrame:
    """Pairs of blocks to open, each once: those whose unions share as many tokens
    as the prefixes of two members that link. (Sets of a and b tokens that have c in
    common have k of their first a - c + k and b - c + k tokens in common.)"""
    a, b = union.alias("a"), union.alias("b")
    one, other = F.struct("a.unit", "a.part"), F.struct("b.unit", "b.part")
    fits = (100 * F.col("a.large") >= percent * F.col("b.small")) & (100 * F.col("b.large") >= percent * F.col("a.small"))
    meet = (F.col("a.token") == F.col("b.token")) & fits & ((one < other) | ((one == other) & (F.col("a.many") > 1)))
    sizes = F.least("a.small", "b.small").alias("size")
    shared = a.join(b, meet).select(one.alias("one"), other.alias("other"), sizes).groupBy("one", "other").agg(
        F.count(F.lit(1)).alias("shared"), F.min("size").alias("size")
    )
    return shared.where(F.col("shared") >= shared_tokens(F.col("size"), percent)).select("one", "other")


# --- opening ------------------------------------------------------------------------


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def spanning_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Positions of linked sets, as many as span the components that links of left to
    right (or within left) make. Right positions follow the left ones."""
    others = left if right is None else right
    shift = 0 if right is None else len(left)
    sizes = np.array([len(s) for s in others])
    owner = np.repeat(np.arange(len(others)), sizes)
    tokens = np.concatenate([*others, np.zeros(0, np.uint64)])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    forest, links = _Forest(len(left) + (0 if right is None else len(right))), []
    for at, own in enumerate(left):
        low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        long = high - low
        ends = np.cumsum(long)
        picked = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - long), long)
        common = np.bincount(owner[picked], minlength=len(others))
        linked = np.flatnonzero(100 * common >= percent * (sizes + len(own) - common))
        for to in linked.tolist():
            if (right is not None or to > at) and forest.join(at, to + shift):
                links.append((at, to + shift))
    return links


def openings(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(home, chunk, side, rep): whose sets are compared with whose. The larger block
    of a pair is at home and meets the members of all smaller ones that it was paired
    with, in chunks of bounded size; chunk -1 is a block by itself."""
    sized = keep(members.groupBy("block").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    of = lambda side: sized.select(*[F.col(c).alias(f"{side}_{c}" if c != "block" else side) for c in sized.columns])
    both = pairs.where("one <> other").join(of("one"), "one").join(of("other"), "other")
    first = F.struct("one_docs", "one") >= F.struct("other_docs", F.col("other").alias("one"))
    met = keep(
        both.select(
            F.when(first, F.col("one")).otherwise(F.col("other")).alias("home"),
            F.when(first, F.col("other")).otherwise(F.col("one")).alias("guest"),
            F.when(first, F.col("other_tokens")).otherwise(F.col("one_tokens")).alias("tokens"),
        )
    )
    chunks = keep(met.groupBy("home").agg(F.ceil(F.sum("tokens") / BLOCK_TOKENS).alias("chunks")))
    chunk = F.pmod(F.xxhash64("guest"), "chunks").alias("chunk")
    guests = met.join(chunks, "home").select("home", chunk, F.lit(1).alias("side"), F.col("guest").alias("block"))
    alone = pairs.where("one = other").select(F.col("one").alias("home"), F.lit(-1).cast("long").alias("chunk"))
    homes = guests.select("home", "chunk").distinct().unionByName(alone)
    sides = guests.unionByName(homes.select("home", "chunk", F.lit(0).alias("side"), F.col("home").alias("block")))
    return sides.join(members.select("rep", "block"), "block").select("home", "chunk", "side", "rep")


def links(docs: DataFrame, members: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between classes that span the components of opened pairs."""
    wanted = keep(openings(members, pairs))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("rep").distinct(), "rep", "left_semi")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t, width).tobytes() for t in tx.column(batch, "text")]
            yield pa.record_batch([batch.column(batch.schema.get_field_index("rep")), pa.array(own, pa.binary())], ["rep", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, ([], [])

        def opened():
            (a, b) = held
            reps = [r for r, _ in a + b]
            found = spanning_links([t for _, t in a], [t for _, t in b] if b else None, percent)
            return [(reps[x], reps[y]) for x, y in found]

        for batch in batches:
            out = []
            at = [tx.column(batch, c) for c in ("unit", "part", "chunk", "side", "rep", "tokens")]
            for unit, part, chunk, side, rep, own in zip(*at, strict=True):
                if (unit, part, chunk) != key:
                    if key is not None:
                        out += opened()
                    key, held = (unit, part, chunk), ([], [])
                held[side].append((rep, np.frombuffer(own, np.uint64)))
            yield _pairs(out)
        if key is not None:
            yield _pairs(opened())
        held = ([], [])

    rows = wanted.join(keep(texts.mapInArrow(tx.giving_back(tokens), "rep long, tokens binary")), "rep").select(
        F.col("home.unit").alias("unit"), F.col("home.part").alias("part"), "chunk", "side", "rep", "tokens"
    )
    key = ["unit", "part", "chunk"]
    return rows.repartition(*key).sortWithinPartitions(*key, "side", "rep").mapInArrow(tx.giving_back(compare), "a long, b long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], ["a", "b"]
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes with an edge. Large
    and small stars in turn (Kiveris et al. 2014) until nothing changes; every round
    is written to the shared folder."""

    def star(now: DataFrame) -> DataFrame:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large.where("a <> b").distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return keep(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())

    def mark(now: DataFrame):
        return now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = keep(edges.where("a <> b").distinct())
    before, seen = None, mark(now)
    while seen != before:
        now = star(now)
        before, seen = seen, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: documents link when
    their sets' similarity is at least ``percent`` in a hundred."""
    described = keep(sets(docs, width, percent, frequent_tokens(docs, width)))
    filled = described.where("n > 0 AND doc_id IS NOT NULL")
    same = ["n", "d1", "d2"]
    classes = keep(filled.groupBy(*same).agg(F.min("doc_id").alias("rep")))
    own = F.col("doc_id").alias("rep")
    alone = filled.select(own, "n", "least", "sketch").join(classes.select("rep"), "rep", "left_semi")
    members = keep(blocks(keep(alone.dropDuplicates(["rep"]))))
    pairs = keep(qualifying(matrix(members, filled.select(own, "prefix")), percent))
    linked = components(links(docs, members, pairs, width, percent)).withColumnRenamed("node", "rep")
    of_class = keep(classes.join(linked, "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id")))
    rows = described.select("doc_id", *same).join(of_class, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents without those that are not the smallest of their component. Rows
    without an id stay."""
    found = near_duplicates(docs, width, percent)
    gone = keep(found.where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
