"""Near duplicates by MinHash with tensored banding: two small collections of hash groups, paired into table keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import WordIds, as_bytes, batches, discard, give_back, kept, mix64, packed, shingle_set, staged
from pointloom.llm.components import components

#: Hashes in a group, and groups in each of the two collections. A pair of similarity s shares a table if it agrees on a whole
#: group of either collection: at 0.8 it is missed with probability 2 * (1 - 0.8**3)**12 = 0.0004; 72 hashes make 144 tables
#: of six hashes each, where plain banding takes 864.
GROUP, GROUPS = 3, 12
#: Of a pair's 72 minima so many must agree in their low 8 bits for it to be looked at: at 0.8, 57.7 do, with a deviation of 3.4,
#: and fewer than 42 do with probability 0.000006.
AGREE = 42
#: Members that one verification task run holds against its representative.
RUN = 2000
#: Rows of one table, and documents of one family, that a task holds against as many others.
TABLE_BLOCK, FAMILY_BLOCK = 4000, 800
#: Bits for each id, and at most, of the filter by which texts are fetched: 16 megabytes.
FILTER_PER_ID, FILTER_BITS = 16, 1 << 27
#: Stands for a null id where texts are looked up, which goes by the text's hash as well.
NO_ID = -(1 << 62)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def minhashes(shingles: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n minima (of 32 bits) for each run of shingles that starts at an offset; every run has a shingle."""
    a, b = _constants(n)
    out = np.empty((len(offsets), n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((shingles * a[k] + b[k]) >> np.uint64(32), offsets)
    return out


def group_keys(mins: np.ndarray) -> np.ndarray:
    """One hash of each group of GROUP minima: (documents, 2 * GROUPS)."""
    acc = np.zeros((len(mins), mins.shape[1] // GROUP), np.uint64)
    for k in range(GROUP):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + mins[:, k::GROUP])
    return acc


def words_hash(data: bytes) -> np.ndarray:
    return kept("words", WordIds).array(data.lower().split())


SUMMARY = "doc_id long, th long, n_shingles long, h1 long, h2 long, keys binary, sig binary"


def summaries(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """One row per document: a hash of its text, the size of its set, a 128-bit hash of the set, its group keys, and its minima's
    low bytes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, rows=2048, megabytes=8):
            sets = [shingle_set(words_hash(t), width) for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            hashes = np.zeros((len(sets), 2), np.uint64)
            keys: list[bytes | None] = [None] * len(sets)
            sigs: list[bytes | None] = [None] * len(sets)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                offsets = np.cumsum(sizes[full]) - sizes[full]
                for k, salt in enumerate((0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C)):
                    hashes[full, k] = mix64(np.add.reduceat(mix64(flat ^ np.uint64(salt)), offsets) + sizes[full].astype(np.uint64))
                mins = minhashes(flat, offsets, 2 * GROUP * GROUPS)
                for i, key, sig in zip(full.tolist(), packed(group_keys(mins)), packed(mins.astype(np.uint8)), strict=True):
                    keys[i], sigs[i] = key, sig
            cols = [batch.column("doc_id"), batch.column("th"), pa.array(sizes), *(pa.array(hashes[:, k].astype(np.int64)) for k in range(2)), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SUMMARY.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(as_bytes(text)).alias("th"), as_bytes(text).alias("text")).mapInArrow(run, SUMMARY)


def table_rows(reps: DataFrame) -> DataFrame:
    """(key, id) for each representative and each pair of a group of the one collection and a group of the other."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                ids = batch.column("id").to_numpy()
                keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64).reshape(len(ids), 2 * GROUPS)
                at = np.arange(GROUPS * GROUPS, dtype=np.uint64).reshape(GROUPS, GROUPS)
                tensor = mix64(keys[:, :GROUPS, None] * np.uint64(3) + keys[:, None, GROUPS:] + at * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(tensor.reshape(-1).astype(np.int64)), pa.array(np.repeat(ids, GROUPS * GROUPS))], ["key", "id"])
        give_back()

    return reps.select("id", "keys").mapInArrow(run, "key long, id long")


def shared_tables(tables: DataFrame) -> DataFrame:
    """(key, a, b) for each class b of a table but its least, a. Rows stream by in order, so a table of any size is no burden."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in it:
            if not batch.num_rows:
                continue
            key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            first = np.concatenate(([True], key[1:] != key[:-1]))
            least = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
            if last is not None and last[0] == key[0]:  # the table began in the batch before
                first[0] = False
                least[: len(first) if first.sum() == 0 else int(first.argmax())] = last[1]
            last = key[-1], least[-1]
            rows = np.flatnonzero(least != ids)
            yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (key, least, ids)], ["key", "a", "b"])

    return tables.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, a long, b long")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures don't rule out."""
    for c in ("a", "b"):
        pairs = joined(pairs, classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")), c)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                same = (_signatures(batch.column("sig_a")) == _signatures(batch.column("sig_b"))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= AGREE))

    sized = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A sort-merge join: its sides stay on the executors, and adaptive execution splits a hot key."""
    return left.join(right.hint("merge"), on, how)


def linked_pairs(ids: np.ndarray, label: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the rows' links between what label sets apart; near(i, rows) are those of rows that i is linked with.

    What is joined is relabelled, and rows of one label aren't held against each other; so rows that hang together cost little
    more than one look at each."""
    found, label = [], label.copy()
    for i in range(len(ids) - 1):
        rest = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not len(rest):
            if (label == label[i]).all():
                break
            continue
        got = near(i, rest)
        if len(got):
            labels, first = np.unique(label[got], return_index=True)
            found += [(int(ids[i]), int(ids[j])) for j in got[first].tolist()]
            label[np.isin(label, labels)] = label[i]
    return found


def _pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])


def _groups(it: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in the named columns, as tables; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in it:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if keys[start] != now:
                    if held:
                        yield pa.Table.from_batches(held)
                    held, now = [], keys[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield pa.Table.from_batches(held)


def open_groups(rows: DataFrame, group: str, size: int) -> DataFrame:
    """(group, component, c, all, parts), staged, of groups that have several components: the rows of the component and of the group, and
    the blocks that its components of less than size rows share."""
    sizes = rows.groupBy(group, "component").agg(F.count("*").alias("c"))
    small = F.when(F.col("c") < size, F.col("c")).otherwise(0)
    totals = sizes.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.sum(small) / size)).alias("parts"), F.count("*").alias("components"), F.sum("c").alias("all"))
    return staged(joined(sizes, totals.where("components > 1").drop("components"), group), "open")


def in_blocks(rows: DataFrame, opened: DataFrame, group: str, size: int) -> DataFrame:
    """Rows (group, id, component, ...) of the groups that open_groups found, dealt out so that each two rows of other components
    meet: a row comes once for each two blocks of its group of which its own is one, named x <= y. Groups of up to size rows are one
    block, whose names are empty.

    Small components share blocks of about size rows. One of more rows has blocks of its own, which aren't held against each
    other; so its rows are copied as often as the others of the group have blocks. The blocks of a group follow from its components'
    sizes and come as rows, so no group is held anywhere."""
    shared = F.format_string("/%d", F.pmod(F.xxhash64("component"), "parts"))
    own = lambda k: F.format_string("%d/%d", "component", k)
    many = F.ceil(F.col("c") / size)
    every = opened.where(F.col("all") > size).select(group, F.explode(F.when(F.col("c") < size, F.array(shared)).otherwise(F.transform(F.sequence(F.lit(0), many - 1), own))).alias("other")).distinct()
    mine = F.when(F.col("c") < size, shared).otherwise(own(F.pmod(F.xxhash64("id"), many)))
    placed = joined(joined(rows, opened, [group, "component"]).withColumn("mine", mine), every, group, "left")
    one = lambda c: F.substring_index(c, "/", 1)
    apart = F.col("other").isNull() | (one("mine") != one("other")) | (one("mine") == "")
    named = {"x": F.coalesce(F.when(F.col("other").isNotNull(), F.least("mine", "other")), F.lit("")), "y": F.coalesce(F.when(F.col("other").isNotNull(), F.greatest("mine", "other")), F.lit(""))}
    return placed.where(apart).withColumns(named).select(*rows.columns, "x", "y")


def near_pairs(rows: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(a, b): pairs of a table that are near by size and signature, across components; rows (key, id, component, n, sig).

    Pairs are compared within a task and only a spanning forest is sent on, so what comes out is linear in the rows. Where whole is
    set, that forest is of the table's near pairs: the two rows of any such pair are in one tree. Else components count as one from
    the start: one pair stands for all that join the same ones, so it is quicker, but others of those may be links and this one not."""
    dealt = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(it, ["key", "x", "y"]):
            ids, component, n = (table.column(c).to_numpy() for c in ("id", "component", "n"))
            sig = _signatures(table.column("sig").combine_chunks())

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                rest = rest[component[rest] != component[i]]
                rest = rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])]
                return rest[(sig[rest] == sig[i]).sum(axis=1) >= AGREE]

            if found := linked_pairs(ids, np.arange(len(ids)) if whole else component, near):
                yield _pair_batch(found)
        give_back()

    return dealt.mapInArrow(run, "a long, b long")


def family_links(members: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(a, b): links by full sets that join, in each family, all that its links across components join; members (family, id,
    component, doc_id, th). Each two blocks of a family are a task's work; sets are compared as bits over the shingles that two
    of them have."""
    opened = open_groups(members, "family", FAMILY_BLOCK)
    paired = staged(in_blocks(members, opened, "family", FAMILY_BLOCK), "paired")
    discard(opened)
    rows = texts_of(paired, docs, doc_id, text)
    dealt = joined(paired, rows, ["doc_id", "th"]).select("family", "x", "y", "id", "component", "text")
    dealt = dealt.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches(it, megabytes=8), ["family", "x", "y"]):
            ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
            ids, first = np.unique(ids, return_index=True)  # rows may repeat a document
            component, texts = component[first], table.column("text").take(pa.array(first))
            sets = [shingle_set(words_hash(t), width) for t in texts.to_pylist()]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            every, counts = np.unique(np.concatenate(sets), return_counts=True)
            shared = every[counts > 1]
            bits = np.zeros((len(sets), (len(shared) + 63) // 64), np.uint64)
            for k, s in enumerate(sets):
                at = np.searchsorted(shared, s)
                at = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == s)] if len(shared) else at[:0]
                np.bitwise_or.at(bits[k], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                rest = rest[100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])]
                common = np.bitwise_count(bits[rest] & bits[i]).sum(axis=1, dtype=np.int64)
                return rest[100 * common >= percent * (n[rest] + n[i] - common)]

            if found := linked_pairs(ids, component, near):
                yield _pair_batch(found)

    return dealt.mapInArrow(run, "a long, b long")


def texts_of(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, text), once each, of a superset of the documents that wanted has: those whose bit in a filter is set. The filter
    goes to all executors. It has FILTER_PER_ID bits for each document wanted but no more than FILTER_BITS; with some ten millions
    and more of them it fills up, lets all rows through, and joins then shuffle all texts."""
    place = lambda bits: F.pmod(F.xxhash64("doc_id", "th"), F.lit(bits))
    size = 1 << min(max(16, (FILTER_PER_ID * wanted.count()).bit_length()), FILTER_BITS.bit_length() - 1)
    words = wanted.select(place(size).alias("p")).select(F.shiftright("p", 6).alias("at"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("word"))
    got = words.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.column("p").to_numpy()
            yield batch.select(["doc_id", "th", "text"]).filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(as_bytes(text)).alias("th"), as_bytes(text).alias("text"))
    return rows.withColumn("p", place(size)).mapInArrow(run, "doc_id long, th long, text binary")


def verified(pairs: DataFrame, named: DataFrame, docs: DataFrame, width: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union; named (id, doc_id, th) says where an
    id's text is.

    Texts come to the pairs, not sets. Rows are dealt out by a and a run number, so that a representative with any number of
    members is spread over tasks; a run streams past its representative's set, the one thing that is held."""
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    member = joined(pairs, runs, "a").select("a", F.pmod(F.xxhash64("b"), "runs").cast("int").alias("run"), F.col("b").alias("id"))
    head = runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("a").alias("id"))
    ends = staged(joined(member.unionByName(head), named, "id"), "ends")
    dealt = joined(ends, texts_of(ends, docs, doc_id, text), ["doc_id", "th"]).select("a", "run", "id", "text")
    dealt = dealt.repartition("a", "run").sortWithinPartitions("a", "run", (F.col("a") != F.col("id")))

    def check(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, np.empty(0, np.uint64)
        for batch in batches(it, megabytes=8):
            found: list[tuple[int, int]] = []
            for a, who, data in zip(batch.column("a").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if who == a:
                    if now != a:
                        now, base = a, shingle_set(words_hash(data), width)
                    continue
                mine = shingle_set(words_hash(data), width)
                if now != a or not len(mine) or not len(base):
                    continue
                both = np.searchsorted(base, mine)
                common = int((base[np.minimum(both, len(base) - 1)] == mine).sum())
                if 100 * common >= percent * (len(mine) + len(base) - common):
                    found.append((a, who))
            yield _pair_batch(found)

    edges = staged(dealt.mapInArrow(check, "a long, b long").distinct(), "links")
    discard(ends)
    return edges


def groups(docs: DataFrame, width: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, winner) for each row of docs: th is a hash of its text, winner (no_id, doc_id, th) the first row, by id
    (null ids last) and th, of all that links reach. How near_duplicates finds them is said there."""
    made = staged(summaries(docs, width, doc_id, text), "summaries")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    grouped = made.where("n_shingles > 0").groupBy("h1", "h2")
    classes = grouped.agg(F.first("keys").alias("keys"), F.first("sig").alias("sig"), F.max("n_shingles").alias("n"), F.min(own).alias("first"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    named = classes.select("id", F.coalesce("first.doc_id", F.lit(NO_ID)).alias("doc_id"), "first.th")
    shared = staged(shared_tables(table_rows(classes)), "tables")
    pairs = staged(likely(shared.select("a", "b").distinct(), classes, percent), "pairs")
    edges = verified(pairs, named, docs, width, percent, doc_id, text)
    found = components(edges)
    discard(pairs, edges)
    # tables where classes of several components meet: first one near pair for each two components, then, of what that leaves apart, all
    member = shared.select("key", F.col("b").alias("id")).unionAll(shared.select("key", F.col("a").alias("id")).distinct())
    for whole in (False, True):
        placed = joined(member, found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        rows = staged(placed, "placed")
        opened = open_groups(rows, "key", TABLE_BLOCK)
        near = staged(near_pairs(joined(in_blocks(rows, opened, "key", TABLE_BLOCK), classes.select("id", "n", "sig"), "id"), percent, whole).distinct(), "near")
        discard(rows, opened)
        if near.isEmpty():
            discard(near)
            break
        families = components(near)
        members = joined(families.withColumnRenamed("component", "family"), found, "id", "left").select("family", "id", F.coalesce("component", "id").alias("component"))
        members = staged(joined(members, named, "id"), "members")
        more = staged(family_links(members, docs, width, percent, doc_id, text), "links")
        if not more.isEmpty():
            joint = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
            discard(found)
            found = joint
        discard(near, families, members, more)
    discard(shared)
    labelled = joined(classes.select("h1", "h2", "id", "first"), found, "id", "left").withColumn("linked", F.col("component").isNotNull()).withColumn("component", F.coalesce("component", "id"))
    winners = labelled.where("linked").groupBy("component").agg(F.min("first").alias("least"))
    winner = joined(labelled, winners, "component", "left").select("h1", "h2", F.coalesce("least", "first").alias("winner"))
    names = ["doc_id", "th", "n_shingles", "winner"]
    return joined(made.where("n_shingles > 0"), winner, ["h1", "h2"]).select(names).unionByName(made.where("n_shingles = 0").withColumn("winner", own).select(names))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row, for links of similarity percent or more.

    Words are runs of non-space bytes with A-Z in lower case; with fewer words than width the whole sequence is one shingle.
    Null and empty texts and those without words have no shingles, are linked with nothing, and are kept. Each row is a document
    of its own, also where ids repeat: of rows (3, A), (5, A), (5, B) the last is apart from the others. component_id is the least id
    reached; rows with a null id are linked like others, and theirs is null if they reach no id. kept says whether a row's id is
    component_id. An empty table gives no rows.

    Equal sets are one class, found by a 128-bit hash of the set, so copies cost one row each. Classes that share a table are
    candidates. First each is held against the first class of the table. What then is in several components of one table and near
    by signature makes families, and in a family all pairs across components are compared: first with one near pair of a table for
    each two components that it joins, then, of what stays apart, with all. All links are by full sets. No bucket, group or partner
    is capped."""
    found = groups(docs, width, percent, doc_id, text).withColumn("component_id", F.col("winner.doc_id"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
