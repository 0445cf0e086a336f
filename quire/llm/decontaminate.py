"""Benchmark decontamination: rare word pairs lead from documents to items, Smith-Waterman alignments of words score the passages.

The pairs of neighbouring words of all items are one table. A first pass counts in how many documents each stands; those
in none can lead nowhere and go. A copy that differs from an item of n words by replaced or left-out words, and still
scores enough, shares ``guaranteed(n)`` of its pairs, so the item's commonest pairs but for one less than that many are
not needed: the rest are its seeds, of which every such copy holds at least ``least_seeds(n)``. A second pass looks for
seeds; their places, without the texts, are joined with the items. Rows where enough seeds lie near one diagonal of an
item are written by a third pass, and aligned there. (Copies made by words put in between almost all others share no
pair and aren't found.)

All passes carry a bit table of at most ``BITS`` bits, whatever the size of the benchmark and of the corpus; what it
lets through by chance falls out of the join. Texts are never shuffled but those of such rows. A row is known by a hash
of its text, so each text is judged once, however many rows have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import fresh, joined_small, mixed, raw_texts, release, text_of, without, word_hashes, written

MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score from which a passage is a copy; words whose score is enough for a passage of a long item; words that must match (all, if the item has fewer); words of the least item.
THRESHOLD, RUN, LEAST, N = 0.4, 40, 8, 3
#: Bits of the table that a pass carries, at most; distinct pairs that a worker counts before it passes them on.
BITS, HELD = 1 << 28, 400_000
MATCHES = "array<struct<item_id:long,score:double,matched:int,start:int,end:int>>"
_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("matched", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_PLAIN = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_SIGNS = re.compile(r"[\W_]+")
#: Letters of scripts that write no spaces; each is a word.
_UNSPACED = re.compile("([฀-໿ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿])")


def plain(text: bytes) -> bytes:
    """A text in UTF-8 in lower case, with signs taken for spaces."""
    if text.isascii():
        return text.lower().translate(_PLAIN)
    return _UNSPACED.sub(r" \1 ", _SIGNS.sub(" ", text.decode("utf-8", "replace").lower())).encode()


def words_of(text: bytes) -> list[bytes]:
    return plain(text).split()


def hashes_of(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    return word_hashes(plain(text))


def pairs_of(words: np.ndarray) -> np.ndarray:
    """The hash of each pair of neighbouring words."""
    return mixed(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])


def least_score(n: int) -> float:
    """The score, in matched words, from which a passage is a copy of an item of n words."""
    return min(THRESHOLD * n, RUN)


def guaranteed(n: int) -> int:
    """Pairs that a copy of an item of n words shares with it, if words were only replaced or left out.

    With m words matched, e not, a score of 2m - e and at most e breaks, m - 1 - e pairs remain; the least of it is
    where m + e = n. Longer items than that formula serves have the value of those of RUN / THRESHOLD words.
    """
    n = min(n, int(RUN / THRESHOLD))
    m = max(min(LEAST, n), int(np.ceil((n + 2 * least_score(n)) / 3)))
    return max(1, m - 1 - min(n - m, int(2 * m - 2 * least_score(n))))


def least_seeds(n: int) -> int:
    return min(2, guaranteed(n))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matched words, start, end) of the best local alignment; start and end are places in passage.

    A row of the table is held at a time, with the start and the matched words of each cell's alignment, so memory
    grows with the passage alone.
    """
    m = len(passage)
    best = (0, 0, 0, 0)
    if not len(item) or not m:
        return best
    place = np.arange(m + 1)
    score, matched, start = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), place.copy()
    for word in item:
        same = passage == word
        diagonal, up = score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP
        straight = diagonal >= up
        now, hits, begun = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), place.copy()
        now[1:] = np.where(straight, diagonal, up)
        hits[1:] = np.where(straight, matched[:-1] + same, matched[1:])
        begun[1:] = np.where(straight, start[:-1], start[1:])
        low = now <= 0
        now[low], hits[low], begun[low] = 0, 0, place[low]
        level = now - GAP * place  # a gap of any length in one step
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == top, place, 0))
        score, matched, start = top + GAP * place, hits[source], begun[source]
        empty = score <= 0
        matched[empty], start[empty] = 0, place[empty]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(matched[j]), int(start[j]), j)
    return best


def spans_of(places: list[tuple[int, int]], n: int, need: int) -> list[tuple[int, int]]:
    """Where a text, whose words p have the pairs q of an item of n words, may hold a copy: around seeds that lie near one diagonal."""
    near = max(3, n // 4)
    groups: list[list[tuple[int, int]]] = []
    for d, p, q in sorted((p - q, p, q) for p, q in places):
        if groups and d - groups[-1][-1][0] <= near:
            groups[-1].append((d, q))
        else:
            groups.append([(d, q)])
    out: list[tuple[int, int]] = []
    for group in groups:
        if len({q for _, q in group}) < need:
            continue
        slack = n // 2 + N
        low, high = max(0, group[0][0] - slack), group[-1][0] + n + slack
        if out and low <= out[-1][1] and high - out[-1][0] <= 8 * n:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


class Bits:
    """A set of 64-bit hashes as two bits each of a table; it may hold more than it was given."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(8 * len(table) - 1)

    @staticmethod
    def of(hashes: DataFrame, column: str) -> "Bits":
        """Those of a column of longs. The driver gets the table's words that aren't zero."""
        count = hashes.count()
        bits = min(BITS, max(1 << 16, 1 << (64 * max(1, count) - 1).bit_length()))
        slots = F.explode(F.array(F.col(column), F.shiftrightunsigned(F.col(column), 32))).alias("h")
        slot = F.col("h").bitwiseAND(F.lit(bits - 1))
        words = hashes.select(slots).select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
        table = np.zeros(bits // 64, np.int64)
        found = words.groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
        table[found["at"].to_numpy()] = found["b"].to_numpy()
        return Bits(table.view(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for h in (hashes, hashes >> np.uint64(32)):
            slot = h & self.mask
            found &= (self.table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def items_of(benchmark: DataFrame, item_id: str = "item_id", item: str = "text") -> DataFrame:
    """(item, item_id, words): distinct items, each word a hash; those with fewer than N words can't be told from chance and take no part."""

    @F.arrow_udf("array<long>")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array([hashes_of(t).view(np.int64) for t in raw_texts(texts)], pa.list_(pa.int64()))

    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), text_of(item).alias("t")).select("item_id", hashed("t").alias("words")).distinct()
    return written(rows.filter(F.size("words") >= N).select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words"), "items")


def pair_table(items: DataFrame) -> DataFrame:
    """(pair, item, q, n): the pairs of all items, at their places."""

    @F.arrow_udf("array<long>")
    def paired(words: pa.Array) -> pa.Array:
        return pa.array([pairs_of(w.values.to_numpy().view(np.uint64)).view(np.int64) for w in words], pa.list_(pa.int64()))

    each = items.select("item", F.size("words").alias("n"), F.posexplode(paired("words")).alias("q", "pair"))
    return written(each.select("pair", "item", "q", "n"), "pairs")


def frequencies(docs: DataFrame, text: str, known: Bits) -> DataFrame:
    """(pair, df): in how many rows of docs each pair of the table stands, and some that it lets through."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n, pa.int64())], ["pair", "df"])

        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                pairs = pairs_of(hashes_of(raw))
                held.append(np.unique(pairs[known.has(pairs)]))
                size += len(held[-1])
                if size >= HELD:
                    yield out()
                    size = 0
        yield out()

    return docs.select(text_of(text).alias("t")).mapInArrow(count, "pair long, df long").groupBy("pair").agg(F.sum("df").alias("df"))


def choose_seeds(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """(pair, item, q, n, need): of each item, the rarest of its pairs that stand in documents (ties: the least hash, then the first)."""
    sizes = [(n, guaranteed(n) - least_seeds(n), least_seeds(n)) for n in range(N, int(RUN / THRESHOLD) + 1)]
    capped = F.least("n", F.lit(sizes[-1][0])) - F.lit(N)
    of = lambda i: F.get(F.array(*[F.lit(s[i]) for s in sizes]), capped)
    item = Window.partitionBy("item")
    ranked = pairs.join(df, "pair").withColumn("r", F.row_number().over(item.orderBy("df", "pair", "q"))).withColumn("seen", F.count("*").over(item))
    return written(ranked.filter(F.col("r") <= F.greatest(F.col("seen") - of(1), of(2))).select("pair", "item", "q", "n", of(2).alias("need")), "seeds")


def seeds_in(text: Column, known: Bits) -> Column:
    """(p, pair) of each place of a text where a pair stands that the table has."""

    @F.arrow_udf("array<struct<p:int,pair:long>>")
    def found(texts: pa.Array) -> pa.Array:
        rows, counts = [], [0]
        for raw in raw_texts(texts):
            pairs = pairs_of(hashes_of(raw))
            at = np.flatnonzero(known.has(pairs))
            rows.append((at, pairs[at]))
            counts.append(counts[-1] + len(at))
        places = np.concatenate([p for p, _ in rows]) if rows else np.zeros(0)
        values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0, np.uint64)
        release()
        struct = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(values.view(np.int64))], ["p", "pair"])
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), struct)

    return found(text)


def _row(text: str) -> Column:
    return F.xxhash64(text_of(text))


def wanted_spans(found: DataFrame, seeds: DataFrame, items: DataFrame) -> DataFrame:
    """(row, wanted): the items, with the spans of the text, that each row of found (row, p, pair) may hold a copy of."""

    @F.arrow_udf("array<struct<low:int,high:int>>")
    def spans(places: pa.Array, n: pa.Array, need: pa.Array) -> pa.Array:
        found = [spans_of([(x["p"], x["q"]) for x in pq], *s) for pq, *s in zip(places.to_pylist(), n.to_pylist(), need.to_pylist())]
        return pa.array([[{"low": a, "high": b} for a, b in s] for s in found], pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))

    placed = joined_small(found, seeds, "pair", "row").groupBy("row", "item", "n", "need").agg(F.collect_set(F.struct("p", "q")).alias("pq"))
    several = placed.filter(F.size("pq") >= F.col("need"))
    near = written(several.select("row", "item", spans("pq", "n", "need").alias("spans")), "spans").filter(F.size("spans") > 0)
    return written(joined_small(near, items, "item", "row").groupBy("row").agg(F.collect_list(F.struct("item_id", "words", "spans")).alias("wanted")), "wanted")


def aligned(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, m): the copies in those of rows (row, text) that have wanted items."""

    @F.arrow_udf(MATCHES)
    def matches(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for raw, each in zip(raw_texts(texts), wanted):
            words, found = hashes_of(raw), []
            for one in each:
                item = one["words"].values.to_numpy().view(np.uint64)
                best = (0, 0, 0, 0)
                for span in one["spans"]:
                    low, high = span["low"].as_py(), span["high"].as_py()
                    s, m, a, b = align(item, words[low:high])
                    best = max(best, (s, m, low + a, low + b), key=lambda x: (x[0], x[1], -x[2]))
                if best[0] >= MATCH * least_score(len(item)) and best[1] >= min(LEAST, len(item)):
                    found.append({"item_id": one["item_id"].as_py(), "score": best[0] / (MATCH * len(item)), "matched": best[1], "start": best[2], "end": best[3]})
            out.append(found)
        return pa.array(out, _MATCHES)

    each = rows.dropDuplicates(["row"]).join(wanted, "row").select("row", matches("text", "wanted").alias("m"))
    return written(each, "copies").filter(F.size("m") > 0)


def candidates(docs: DataFrame, benchmark: DataFrame, text: str, **names) -> tuple[DataFrame, Bits]:
    """(row, wanted) of the rows of docs that may hold copies, by counts over all of docs; and a bit table of these rows."""
    items = items_of(benchmark, **names)
    pairs = pair_table(items)
    seeds = choose_seeds(pairs, frequencies(docs, text, Bits.of(pairs.select("pair").distinct(), "pair")))
    found = docs.select(_row(text).alias("row"), F.explode(seeds_in(text_of(text), Bits.of(seeds.select("pair").distinct(), "pair"))).alias("s")).select("row", "s.p", "s.pair")
    wanted = wanted_spans(found, seeds, items)
    return wanted, Bits.of(wanted.select("row"), "row")


def _may(row: Column, known: Bits) -> Column:
    @F.arrow_udf("boolean")
    def there(rows: pa.Array) -> pa.Array:
        return pa.array(known.has(rows.to_numpy(zero_copy_only=False).view(np.uint64)))

    return there(row)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """(doc_id, item_id, score, matched, start, end) for each row of docs and item of which it holds a copy.

    score: the alignment's share of the item's own, of the best passage (ties: more words matched, then the first);
    start and end: places of words in the document. Copies score THRESHOLD of the item's own, or as RUN words in a long
    item. A null or empty text holds none; very long texts and items are read whole, alignments hold a row at a time;
    items with fewer than N words, or null, take no part; equal items are one; of seeds equally rare any serve;
    repeated rows of docs are each reported; a null doc_id is reported as null; other columns aren't read; an empty
    table on either side gives no rows.
    """
    wanted, known = candidates(docs, benchmark, text, **names)
    copies = aligned(docs.select(text_of(text).alias("text"), _row(text).alias("row")).filter(_may(F.col("row"), known)), wanted)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _row(text).alias("row")).filter(_may(F.col("row"), known))
    return joined_small(rows, copies, "row", "doc_id").select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names) -> DataFrame:
    """docs without rows that hold a copy of an item; columns stay as they are. Cases are as in ``contaminated``; only texts that may hold a copy are moved."""
    wanted, known = candidates(docs, benchmark, text, **names)
    copies = aligned(docs.select(text_of(text).alias("text"), _row(text).alias("row")).filter(_may(F.col("row"), known)), wanted)
    name = fresh(docs.columns, "text_hash")
    gone = written(copies.select(F.col("row").alias(name)), "gone")
    left = without(docs.withColumn(name, _row(text)), gone, [name])
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
