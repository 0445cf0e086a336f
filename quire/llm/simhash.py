"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where few bits differ.

Candidates come from an inverted index over byte positions. Two fingerprints with at most two differing bits share at
least six of their eight bytes. A list per single byte holds one row in 256 and so has quadratically many pairs; the
index therefore keys four byte positions at once (the six unions of two of four byte pairs), of which such a pair
shares at least one. The shared positional bytes of a pair are tallied, pairs with fewer than six go, and the rest
are verified by their differing bits.

A list of more than ``LIST`` fingerprints emits no pairs. There, each member is filed under itself and the 32 values
that differ from it in one bit of the bytes outside the key: members at distance two or less meet in at least one
file, all members of one file are that close, and a file holds at most 33 of them, so an edge from each to the least
keeps every connection with rows in proportion to the members.

``similar`` links by the similarity of whole sets of shingles. Two texts of Jaccard similarity 0.8 differ in 9.7 of 64
bits on average, which leaves no byte that they are sure to share, so its fingerprints are as wide as their index needs:
8,192 bits, the signs of as many random projections of the text's shingles. The index keys three byte positions at once
(341 keys), of which such a pair shares 6.6 on average. Shared keys are tallied; pairs with at least two, as 99 in 100
pairs at just 0.8 have and 9,999 in 10,000 at 0.85, go on, and chance pairs don't; the exact similarity verifies them.
Texts that share much but less than 0.8 have long lists, and their pairs grow with the square of their number. Classes
that lists of more than CROWD members connect are compared all with all, by a block's inverted index in place; what
leaves is a forest of links. Only lists of CROWD members or fewer form pairs as rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh, has_rows, joined_small, mixed, raw_texts, release, stored_bytes, text_of, without, word_hashes, written
from quire.llm.components import connected_components

SEED, WORDS, BITS = 42, 3, 2
#: Members of a posting list up to which its pairs are formed.
LIST = 32
#: Byte positions (0: lowest) of each key of the index, and the shared positional bytes that links guarantee.
KEYS = [(0, 1, 2, 3), (0, 1, 4, 5), (0, 1, 6, 7), (2, 3, 4, 5), (2, 3, 6, 7), (4, 5, 6, 7)]
SHARED = 6
#: Of similar texts: words of a shingle, per cent of all shingles that are shared, bits of a fingerprint (a square of 128 by 64), byte positions of a key, shared keys of a pair, texts sketched at once.
SHINGLE, PERCENT = 5, 80
ROWS, COLUMNS, KEY_BYTES, TALLY, BATCH = 128, 64, 3, 2, 64
#: Members of a list beyond which they are a crowd; members and shingles of a crowd's block.
CROWD, MEMBERS, HELD = 16, 1024, 1 << 20
#: Bytes up to which crowds and keys of lists are broadcast to the lists.
CROWDS_MOVED, KEYS_MOVED = 8 << 20, 1 << 20
_SPACES = bytes(32 if b in b"\t\n\v\f\r" else b for b in range(256))


def fingerprint_of(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned fingerprint of one text in UTF-8; 0 if it has no words."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[: len(parts) - words].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """The fingerprint of a text column as a signed long; null counts as empty."""

    @F.arrow_udf("long")
    def signed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(t, words, seed) for t in raw_texts(texts)), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return signed(text_of(text))


def _key(fp: Column, number: int) -> Column:
    mask = sum(0xFF << 8 * b for b in KEYS[number])
    mask -= (mask >> 63) << 64
    return F.struct(F.lit(number).cast("byte").alias("k"), fp.bitwiseAND(F.lit(mask)).alias("bits"))


def _bit(n: int) -> int:
    return (1 << n) - (1 << 64 if n == 63 else 0)


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): ids of (rep, fp) rows with distinct fp, such that their links' transitive closure is that of all pairs with at most ``bits`` (up to 2) differing bits."""
    if bits not in (1, 2):
        raise ValueError("the index guarantees pairs of one or two differing bits")
    member = F.struct("rep", "fp")
    filed = prints.select(member.alias("m"), F.explode(F.array(*[_key(F.col("fp"), k) for k in range(len(KEYS))])).alias("key"))
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    lists = written(filed.join(sizes, "key").select("key", "m", "n"), "postings")
    tally = sum(((F.shiftrightunsigned(F.col("a.fp").bitwiseXOR(F.col("b.fp")), 8 * i).bitwiseAND(F.lit(255))) == 0).cast("int") for i in range(8))
    few = lists.filter(F.col("n") <= LIST).groupBy("key").agg(F.array_sort(F.collect_list("m")).alias("l"))
    pairs = (
        few.select("l", F.posexplode("l").alias("i", "a"))
        .select("a", F.explode(F.slice("l", F.col("i") + 2, F.size("l"))).alias("b"))
        .filter(tally >= SHARED)
        .filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits)
        .select(F.col("a.rep").alias("u"), F.col("b.rep").alias("v"))
    )
    outside = [F.array(*[F.lit(0).cast("long"), *[F.lit(_bit(8 * b + i)) for b in range(8) if b not in key for i in range(8)]]) for key in KEYS]
    flips = F.element_at(F.array(*outside), F.col("key.k").cast("int") + 1)
    many = (
        lists.filter(F.col("n") > LIST)
        .select("key.k", "m", F.explode(flips).alias("flip"))
        .groupBy("k", F.col("m.fp").bitwiseXOR(F.col("flip")).alias("file"))
        .agg(F.collect_list("m").alias("l"))
        .filter(F.size("l") > 1)
    )
    if bits == 2:
        stars = many.select(F.array_min("l.rep").alias("u"), F.explode("l.rep").alias("v"))
    else:  # who is the file's own value, with those one bit away
        own = many.select("l", "file", F.explode("l").alias("a")).filter("a.fp = file")
        stars = own.select(F.col("a.rep").alias("u"), F.explode("l.rep").alias("v"))
    return pairs.unionByName(stars.filter("u <> v"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of docs.

    component_id is the smallest id reachable by links, the row's own included. A null text is an empty one; texts
    without words have fingerprint 0 and link like any other; a row with a null id keeps a null component of its own
    and takes no part; repeated rows are kept, each with the same component; an empty table gives no rows; other
    columns are not read. Texts are hashed whole, one at a time.
    """
    prints = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprint(F.col(text), words, seed).alias("fp")), "fingerprints")
    reps = written(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = connected_components(links(reps, bits))
    least = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    joined = prints.filter("doc_id is not null").join(least, "fp").select("doc_id", "fp", "component_id")
    return joined.unionByName(prints.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long").alias("component_id")))


def shingles_of(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    h = word_hashes(text.lower().translate(_SPACES))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, np.uint64(min(words, len(h))))
    for j in range(min(words, len(h))):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n])
    return np.unique(out)


@functools.lru_cache(maxsize=1)
def _rotation() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hadamard matrices for both sides of the square, and signs."""
    def hadamard(n: int) -> np.ndarray:
        i = np.arange(n)
        return np.where(np.bitwise_count(i[:, None] & i[None, :]) % 2, -1, 1).astype(np.float32)

    return hadamard(ROWS), hadamard(COLUMNS), np.where(np.random.default_rng(SEED).random((ROWS, COLUMNS)) < 0.5, -1, 1).astype(np.float32)


def keys_of(shingles: list[np.ndarray]) -> np.ndarray:
    """The index keys of each text: bytes of the signs of its shingles' projections. Shingles are summed with random signs into random places, which two rotations then spread."""
    size = ROWS * COLUMNS
    left, right, signs = _rotation()
    x = np.zeros((len(shingles), size), np.float32)
    for i, s in enumerate(shingles):
        x[i] = np.bincount((s & np.uint64(size - 1)).astype(np.int64), np.where(s >> np.uint64(40) & np.uint64(1), 1.0, -1.0), size)
    x = x.reshape(-1, ROWS, COLUMNS)
    x = left @ (left @ x @ right * signs) @ right
    found = np.packbits(x.reshape(-1, size) > 0, axis=1)
    n = found.shape[1] // KEY_BYTES
    parts = found[:, : n * KEY_BYTES].reshape(-1, n, KEY_BYTES).astype(np.int64)
    return (parts << 8 * np.arange(KEY_BYTES)).sum(2)


def _text_class(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED) - (1 << 63)


def text_class(text: Column) -> Column:
    """A 64-bit hash of a text's set of shingles: the same for all texts with that set."""

    @F.arrow_udf("long")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([_text_class(shingles_of(t)) for t in raw_texts(texts)], pa.int64())

    return made(text_of(text))


def _classes(text: Column, keys: bool) -> Column:
    """(node, keys or shingles) of a text: its class and its index keys (none without words), or its set."""

    @F.arrow_udf("struct<node:long,v:array<long>>")
    def made(texts: pa.Array) -> pa.Array:
        nodes, values, held = [], [], []

        def out() -> None:
            found = keys_of(held) if keys and held else held
            values.extend(k if len(s) else k[:0] for k, s in zip(found, held))
            held.clear()

        for t in raw_texts(texts):
            held.append(shingles_of(t))
            nodes.append(_text_class(held[-1]))
            if len(held) == BATCH:
                out()
        out()
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values).astype(np.uint64).view(np.int64) if values else np.zeros(0, np.int64)))
        release()
        return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), lists], ["node", "v"])

    return made(text)


def _lists(filed: DataFrame) -> DataFrame:
    """(key, head, node): the lists of the index with two members or more; head: the least. Sorted lists are read as a stream, so none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_head, last_single = -1, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.r_[keys[0] != last_key, keys[1:] != keys[:-1]]
            number = np.cumsum(first) - 1  # of the list in this batch; -1: the one before goes on
            heads = np.where(number >= 0, nodes[np.flatnonzero(first)][number] if first.any() else 0, last_head)
            size = np.bincount(number + 1, minlength=2)[number + 1] + ((number == -1) * 1)
            many = size > 1
            out = [keys[many], heads[many], nodes[many]]
            if number[0] == -1 and last_single:
                out = [np.r_[v, o] for v, o in zip((last_key, last_head, last_head), out)]
            carried = number[-1] == -1
            last_single = not carried and int((number == number[-1]).sum()) == 1
            last_key, last_head = int(keys[-1]), int(heads[-1])
            yield pa.RecordBatch.from_arrays([pa.array(o.astype(np.int64)) for o in out], ["key", "head", "node"])

    return filed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, head long, node long")


def _sets(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, s): the sets of shingles of the wanted classes (node), from rows (text)."""
    wanted = written(wanted.distinct(), "wanted")
    sets = rows.select(_classes(F.col("text"), keys=False).alias("s")).select("s.node", F.col("s.v").alias("s"))
    sets = sets.join(F.broadcast(wanted) if stored_bytes(wanted) <= 32 << 20 else wanted, "node", "left_semi")
    return written(sets.groupBy("node").agg(F.first("s").alias("s")), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (u, v) of classes whose shingles are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.withColumn("n", shared).filter(100 * F.col("n") >= PERCENT * (F.size("a") + F.size("b") - F.col("n"))).select("u", "v")


def forest_of(nodes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges (u, v), fewer than nodes, that connect what all similar pairs of a place in left with one in right connect.

    The shingles of the right are an inverted index, from which the shared ones of a left set with every right set are
    counted at once; pairs that are connected already make no edge.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    words, word = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
    posted = np.repeat(np.arange(len(right)), sizes[right])[np.argsort(word, kind="stable")]
    ends = np.cumsum(np.bincount(word, minlength=len(words)))
    starts = np.r_[0, ends[:-1]]
    label, edges = np.arange(len(sets)), []
    for i in left:
        if (label[right] == label[i]).all():
            continue
        at = np.minimum(np.searchsorted(words, sets[i]), len(words) - 1)
        at = at[words[at] == sets[i]]
        n = ends[at] - starts[at]
        lists = posted[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        shared = np.bincount(lists, minlength=len(right))
        like = right[100 * shared >= PERCENT * (sizes[i] + sizes[right] - shared)]
        labels, first = np.unique(label[like], return_index=True)
        joined = labels != label[i]
        edges += [(int(nodes[i]), int(nodes[like[j]])) for j in first[joined]]
        label[np.isin(label, labels[joined])] = label[i]
    return edges


def _crowd_edges(crowds: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) that connect what the similar pairs of each crowd (node, component) connect.

    A crowd's sets are dealt into blocks of bounded size, and each two blocks are compared in one place, so a crowd of
    one block moves each set once and gives fewer edges than it has members, however many of its pairs are similar.
    """
    there = crowds.join(sets, "node").select("component", "node", "s")
    blocks = written(there.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum(F.size("s")) / HELD)).alias("blocks")), "blocks")
    dealt = joined_small(there, blocks, "component", "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.select("component", "node", "s", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "s")

    def compared(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        lists, block = table["s"].combine_chunks(), table["block"].to_numpy()
        values, at = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        edges = forest_of(table["node"].to_numpy(), [values[a:b] for a, b in zip(at, at[1:])], left, right) if len(left) and len(right) else []
        release()
        return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())})

    return dealt.groupBy("component", "low", "high").applyInArrow(compared, "u long, v long")


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, copies, component) of each distinct id and set of shingles (node, a hash of it): how many rows have both, and the least node that links lead to.

    Links: shingles of SHINGLE words with a Jaccard similarity of PERCENT or more. A text of fewer words is one shingle;
    texts without words are one class, linked to no other; a null text is an empty one. Rows with a null id take no
    part; an empty table gives no rows. Texts are read whole. Classes that lists of more than CROWD members connect are
    a crowd, whose members are all compared with each other in place, so that no pair of them is a row.
    """
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    prints = written(rows.select("doc_id", _classes(F.col("text"), keys=True).alias("c")).select("doc_id", "c.node", F.col("c.v").alias("keys")), "sketches")
    reps = prints.groupBy("node").agg(F.first("keys").alias("keys"))
    filed = reps.select("node", F.posexplode("keys").alias("p", "k")).select((F.col("p").cast("long") * (1 << 8 * KEY_BYTES) + F.col("k")).alias("key"), "node")
    lists = written(_lists(filed), "lists")
    long_lists = written(lists.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("key"), "long")
    crowds = written(connected_components(lists.join(long_lists, "key").select(F.col("head").alias("u"), F.col("node").alias("v"))), "crowds")
    small = lambda df, most: F.broadcast(df) if stored_bytes(df) <= most else df  # noqa: E731  so that lists aren't moved again
    marked = lists.join(small(crowds, CROWDS_MOVED), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    mixed_lists = written(marked.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key"), "mixed")
    open_ = written(marked.join(small(mixed_lists, KEYS_MOVED), "key"), "open")
    a, b = open_.select("key", F.col("node").alias("u"), F.col("c").alias("cu")), open_.select("key", F.col("node").alias("v"), F.col("c").alias("cv"))
    tallied = a.join(b, "key").filter("u < v and cu <> cv").groupBy("u", "v").agg(F.count("*").alias("n"))
    pairs = written(tallied.filter(F.col("n") >= TALLY).select("u", "v"), "pairs")
    sets = _sets(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(crowds.select("node")), rows)
    edges = _verified(pairs, sets)
    if has_rows(crowds):
        edges = edges.unionByName(_crowd_edges(crowds, sets))
    found = connected_components(edges)
    each = prints.groupBy("doc_id", "node").agg(F.count("*").alias("copies"))
    return each.join(found, "node", "left").select("doc_id", "node", "copies", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of similar ones: that with the least id (ties: the least node); of equal rows of it, one.

    Groups are those of ``similar``, whose docstring has the cases; columns stay as they are; rows with a null id all
    stay; rows of one id whose texts differ are judged apart.
    """
    every = written(similar(docs, doc_id, text), "similar")
    groups = written(every.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("kept"), F.sum("copies").alias("n")).filter("n > 1").drop("n"), "groups")
    member = joined_small(every, groups, "component", "doc_id")
    chosen = F.struct("doc_id", "node") == F.col("kept")
    mark, key = fresh(docs.columns, "text_class"), fresh(docs.columns, "kept_id")
    gone = written(member.filter(~chosen).select(F.col("doc_id").alias(key), F.col("node").alias(mark)), "gone")
    own = {mark: text_class(F.col(text)), key: F.col(doc_id).cast("long")}
    there = without(docs.filter(F.col(doc_id).isNotNull()).withColumns(own), gone, [key, mark])
    if has_rows(every.filter("copies > 1")):
        there = there.dropDuplicates([key, mark])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return there.select(*columns).unionByName(docs.filter(F.col(doc_id).isNull()))
