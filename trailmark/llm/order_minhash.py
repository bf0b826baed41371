"""Near-duplicates by order MinHash and banded alignment.

A text's k-mers are its runs of five words, each labelled with its occurrence number, so that none repeats.  Each of ``functions``
hash functions selects the ``per_function`` k-mers of least value and keeps them in text order; the hash of that sequence is one
entry of the sketch.  Texts that share an entry are candidates.  A banded alignment of their k-mer sequences (as labelled k-mers
are unique, the longest increasing run of common places within the band) verifies: texts are linked if the aligned k-mers are
``similarity`` or more of all k-mers of both.  The band is as wide as any such alignment can need.

A pair with c common k-mers of u shares one entry of 32 with probability 1 - (1 - C(c, 6) / C(u, 6))**32: at similarity 0.8, above 0.9998
where both texts have more than 30 k-mers.  Pairs with a text of at most ``SHORT`` = 30 are found for certain, by a prefix filter: as
they align a known share of their k-mers, the least three aligned ones (by hash) lie among the few least of each text.  All such
triples, in text order, are the entries of short texts, in place of the sketch; texts that are longer, but near enough in length to be
linked to a short one, have both.

Equal texts (equal words; of texts without words, equal bytes) collapse into one representative first.  In each bucket of a shared
entry all members are verified against its least member, the hub; connected components of these links are first classes.  A hub's
family that has members of several classes may hide further links among members that the hub isn't like.  These meet exactly.  First a
prefix filter in the family's own order, in which k-mers that the hub lacks come first, leaves only members that share a prefix
k-mer with a member of another class: texts that have no more than the hub's passage in common drop out.  Those left meet in units of
at most about ``block`` x ``block`` texts, each solved in one task: members outside the family's largest class against all; a unit
counts the common k-mers of its pairs, aligns those that have enough, and returns links that join two groups there.  Rows grow with
the texts and their lengths, but for this last step: its rows grow with the product of a family's two sides, counted in blocks,
and only for members that share a k-mer beyond the hub's while no hub links them.

A null text is a class alone; a text of fewer than five words has one k-mer, all of it.  Null doc_ids and repeated rows
are rows of their own; a repeated row is an exact copy.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, pick, written
from .components import components
from .wordhash import hash_words, mix, powers, rolling

K = 5
#: The filter of needed texts has 16 bits for each, within these powers of two (2 MB and 16 MB broadcast).
LEAST_BITS, MOST_BITS = 24, 27
#: Bytes of text that a task turns into k-mers at a time.
SLICE = 1 << 20
#: Pairs with a text of at most so many k-mers meet by a prefix filter, on so many common k-mers at a time.
SHORT, COMMON = 30, 3
_NO_ID = -(1 << 63)


def kmers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labelled k-mers of all rows, where each row's begin, and two 64-bit hashes of each row's words."""
    w = hash_words(column)
    n = w.counts()
    keys = []
    for base in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5):
        up, down = powers(base, max(1, len(w.hashes)))
        total = np.zeros(len(w.hashes) + 1, np.uint64)
        np.cumsum(w.hashes * up[: len(w.hashes)], out=total[1:])
        keys.append(mix((total[w.first[1:]] - total[w.first[:-1]]) * down[np.minimum(w.first[:-1], len(down) - 1)] + n.astype(np.uint64)))
    row, h = w.rows(), rolling(w.hashes, K)
    inside = np.flatnonzero(row[: len(h)] == row[K - 1 :]) if len(h) else np.zeros(0, np.int64)
    h, row = h[inside], row[inside]
    short = np.flatnonzero((n > 0) & (n < K))
    if len(short):
        at = np.searchsorted(row, short)
        h, row = np.insert(h, at, keys[0][short]), np.insert(row, at, short)
    order = np.argsort(h ^ mix(row.astype(np.uint64) + np.uint64(1 << 40)), kind="stable")
    s, r = h[order], row[order]
    same = np.concatenate([[False], (s[1:] == s[:-1]) & (r[1:] == r[:-1])])
    if same.any():
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(s))))
        label = np.zeros(len(h), np.uint64)
        label[order] = (np.arange(len(s)) - begin).astype(np.uint64)
        h = np.where(label > 0, mix(h + label * np.uint64(0x9E3779B97F4A7C15)), h)
    return h, np.searchsorted(row, np.arange(len(n) + 1)), keys[0], keys[1]


def sketch(h: np.ndarray, functions: int, per_function: int) -> np.ndarray:
    """The entries of one text's sketch; h: its labelled k-mers in text order."""
    a = mix(np.arange(1, functions + 1, dtype=np.uint64) + np.uint64(7 << 32)) | np.uint64(1)
    n, out = min(per_function, len(h)), []
    step = max(1, (1 << 18) // max(1, len(h)))
    up = powers(0x2545F4914F6CDD1D, per_function)[0]
    for lo in range(0, functions, step):
        part = a[lo : lo + step]
        values = ((h[None] * part[:, None]) >> np.uint64(32)).astype(np.uint32)
        at = np.argpartition(values, n - 1, axis=1)[:, :n] if n < len(h) else np.broadcast_to(np.arange(len(h)), (len(part), len(h)))
        chosen = h[np.sort(at, axis=1)]
        out.append(mix((chosen * up[:n]).sum(axis=1, dtype=np.uint64) + part))
    return np.concatenate(out)


@lru_cache(maxsize=256)
def _choices(n: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n), size)))


def short_entries(h: np.ndarray, least: float) -> np.ndarray:
    """Entries of which two texts that align to ``least`` or more share one for certain; h: labelled k-mers in text order.

    Both have need(n) aligned k-mers at least, so the ``size`` least of these are among the n - need(n) + size least k-mers of either."""
    need = lambda n: int(np.ceil(least * n - 1e-9))
    n, out = len(h), []
    order, up = np.argsort(h), powers(0x2545F4914F6CDD1D, COMMON)[0]
    for size in sorted({min(COMMON, need(m)) for m in range(need(n), n + 1)}):  # by the smaller text of a pair
        chosen = h[np.sort(order[: n - need(n) + size])]
        out.append(mix((chosen[_choices(len(chosen), size)] * up[:size]).sum(axis=1, dtype=np.uint64) + np.uint64(size + (9 << 32))))
    return np.concatenate(out)


def entries_of(h: np.ndarray, functions: int, per_function: int, least: float) -> np.ndarray:
    """All entries of one text: of the prefix filter, where a partner may be short, and of the sketch, where none need be."""
    out = [short_entries(h, least)] if len(h) * least <= SHORT + 1e-9 else []
    if len(h) > SHORT:
        out.append(sketch(h, functions, per_function))
    return np.concatenate(out)


def sketches(docs: DataFrame, functions: int, per_function: int, least: float) -> DataFrame:
    """doc_id, key1, key2 (null for null texts), sketch (null without words)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first, k1, k2 = kmers(batch.column("text"))
        rows = [entries_of(h[a:b], functions, per_function, least).view(np.int64) if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]
        for i in np.flatnonzero(first[1:] == first[:-1]):  # no words: the bytes stand for the text
            digest = hashlib.blake2b((batch.column("text")[int(i)].as_py() or "").encode("utf-8", "replace"), digest_size=16).digest()
            k1[i], k2[i] = np.frombuffer(digest, np.uint64)
        null = batch.column("text").is_null().to_numpy(zero_copy_only=False)
        return pa.record_batch([batch.column("doc_id"), pa.array(k1.view(np.int64), mask=null), pa.array(k2.view(np.int64), mask=null), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "key1", "key2", "sketch"])

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(in_slices(make, step=SLICE), "doc_id long, key1 long, key2 long, sketch array<long>")


def _slots(key: np.ndarray, doc_id: np.ndarray, bits: int) -> np.ndarray:
    return mix(key.astype(np.uint64) ^ (doc_id.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - bits)


def _filter_of(needed: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter over (key1, id), or-ed from at most eight parts.  What it lets through wrongly, the join after it settles."""

    def make(batches):
        found = np.zeros(1 << bits, bool)
        for b in batches:
            found[_slots(b.column("key1").to_numpy(), b.column("id").to_numpy(), bits)] = True
        yield pa.record_batch([pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    for part in needed.select("key1", "id").coalesce(8).mapInArrow(make, "bits binary").toLocalIterator():
        out |= np.frombuffer(part["bits"], np.uint8)
    return out


def fetch_kmers(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """node and its labelled k-mers (binary) for each needed (key1, key2, id, node): a second pass, without shuffling texts."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * needed.count()).bit_length()))
    keep = docs.sparkSession.sparkContext.broadcast(_filter_of(needed, bits))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, first, k1, k2 = kmers(batch.column("text"))
        ids = batch.column("id").to_numpy()
        slot = _slots(k1, ids, bits)
        hit = np.flatnonzero((keep.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (first[1:] > first[:-1]))
        return pa.record_batch([pa.array(ids[hit]), pa.array(k1[hit].view(np.int64)), pa.array(k2[hit].view(np.int64)), pa.array([h[first[i] : first[i + 1]].tobytes() for i in hit], pa.binary())], names=["id", "key1", "key2", "kmers"])

    rows = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.col("text").cast("string"))
    found = rows.mapInArrow(in_slices(make, step=SLICE), "id long, key1 long, key2 long, kmers binary")
    # grouped by the join's own keys too, so that a shuffled join isn't followed by another shuffle
    return found.join(needed, ["key1", "key2", "id"]).groupBy("key1", "key2", "id", "node").agg(F.first("kmers").alias("kmers")).select("node", "kmers")


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned k-mers over all k-mers of both, by a banded alignment; 0 where it is below ``least`` for certain."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (1 - least) / (1 + least) * (n + m) + 1
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    if len(i) < least / (1 + least) * (n + m) - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    if (np.diff(j) > 0).all():
        c = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            if at == len(tails):
                tails.append(x)
            else:
                tails[at] = x
        c = len(tails)
    return c / (n + m - c)


def common_counts(h: np.ndarray, keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of the k-mers ``h`` each of n texts has; keys: all their k-mers sorted, owner: the text of each."""
    lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
    width = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(int(width.sum()))
    return np.bincount(owner[at], minlength=n)


def link_unit(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links between left and right texts that join them into groups; pairs that links join already are left out."""
    parent: dict[int, int] = {x: x for x, _ in [*left, *right]}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(h) for _, h in right])
    keys, owner = np.concatenate([h for _, h in right]), np.repeat(np.arange(len(right)), size)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    out = []
    for x, h in left:
        enough = common_counts(h, keys, owner, len(right)) >= least / (1 + least) * (size + len(h)) - 1e-9
        for i in np.flatnonzero(enough):
            y, g = right[i]
            if x != y and find(x) != find(y) and aligned_similarity(h, g, least) >= least:
                parent[find(x)] = find(y)
                out.append((x, y))
    return out


def family_prefix(h: np.ndarray, hub: np.ndarray, least: float) -> np.ndarray:
    """The k-mers of which two linked texts of a hub's family share one for certain: the first ones, those that the hub lacks first.

    Linked texts have need = least x n common k-mers at least, so any n - need + 1 of a text's n k-mers, by an order that all share, hold one."""
    h = np.sort(h)
    known = np.isin(h, hub, assume_unique=True)
    return np.concatenate([h[~known], h[known]])[: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]


def near_duplicates(docs: DataFrame, similarity: float = 0.8, functions: int = 32, per_function: int = 6, block: int = 256) -> DataFrame:
    """For each row: doc_id and class_id, the least doc_id of its class."""
    marked = written(sketches(docs, functions, per_function, similarity).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # the sums by key are written, as then a join with them can be split where one key has many rows
    copies = marked.where("key1 IS NOT NULL").groupBy("key1", "key2").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "row")).alias("m")).select("key1", "key2", "m.id", F.col("m.row").alias("node"))
    placed = written(marked.select("row", "doc_id", "key1", "key2").join(written(copies, "texts"), ["key1", "key2"], "left").select("row", "doc_id", "key1", "key2", "id", F.coalesce("node", "row").alias("node")), "copies")
    texts = placed.where("row = node AND key1 IS NOT NULL").select("key1", "key2", "id", "node")
    entries = marked.join(texts.select(F.col("node").alias("row")), "row", "left_semi").select("row", F.explode("sketch").alias("entry"))
    hubs = entries.groupBy("entry").agg(F.min("row").alias("hub"), F.count("*").alias("n")).where("n > 1").select("entry", "hub")
    pairs = written(entries.join(written(hubs, "hubs"), "entry").where("row <> hub").select("hub", F.col("row").alias("node")).distinct(), "candidates")
    needed = texts.join(pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct(), "node", "left_semi").select("key1", "key2", "id", "node")
    known = written(fetch_kmers(docs, written(needed, "needed")), "kmers")

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok, prefix = [], []
        for a, b in zip(batch.column("mine").to_pylist(), batch.column("kmers").to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            ok.append(aligned_similarity(a, b, similarity) >= similarity)
            prefix.append(family_prefix(a, b, similarity).tobytes())
        return pa.record_batch([batch.column("hub"), batch.column("node"), pa.array(ok, pa.bool_()), pa.array(prefix, pa.binary())], names=["hub", "node", "ok", "prefix"])

    met = pairs.union(pairs.select("hub", F.col("hub").alias("node")).distinct())  # a hub is of its own family
    checked = written(_with_kmers(met, known).mapInArrow(in_slices(verify, "mine", SLICE), "hub long, node long, ok boolean, prefix binary"), "checked")
    links = checked.where("ok AND hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    roots = written(components(links), "roots")
    if not checked.where("NOT ok").isEmpty():
        # families of several classes: their members, by the k-mers of the family's prefix filter
        rooted = lambda df: df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = lambda df, key: df.groupBy(key).agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select(key)

        def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            n = np.array([len(x) for x in found], np.int64)
            hub = np.repeat(batch.column("hub").to_numpy(), n)
            key = mix(np.concatenate([np.zeros(0, np.uint64), *found]) ^ mix(hub.view(np.uint64)))
            return pa.record_batch([pa.array(hub), *[pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in ("node", "root")], pa.array(key.view(np.int64))], names=["hub", "node", "root", "key"])

        open_ = rooted(checked.join(written(several(rooted(checked.select("hub", "node")), "hub"), "several"), "hub")).select("hub", "node", "root", "prefix")
        prefixes = written(open_.mapInArrow(in_slices(keyed, "prefix", SLICE), "hub long, node long, root long, key long"), "prefixes")
        crowded = written(several(prefixes, "key"), "crowded")
        still = written(_likely(prefixes, crowded).join(crowded, "key").select("hub", "node", "root").distinct(), "open")
        roots = components(links.union(_among(still, known, similarity, block)))
    named = written(placed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")), "rooted")
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return named.join(written(least, "classes"), "root").select("doc_id", "class_id")


def _likely(prefixes: DataFrame, crowded: DataFrame) -> DataFrame:
    """The prefix rows whose key is in crowded, and some others: a filter of bounded size, so that not all of them are shuffled."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * crowded.count()).bit_length()))
    keep = prefixes.sparkSession.sparkContext.broadcast(_filter_of(crowded.select(F.col("key").alias("key1"), F.lit(0).cast("long").alias("id")), bits))

    def make(batches):
        for b in batches:
            key = b.column("key").to_numpy()
            slot = _slots(key, np.zeros(len(key), np.int64), bits)
            yield b.filter(pa.array((keep.value[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)))

    return prefixes.mapInArrow(make, prefixes.schema)


def _with_kmers(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """hub, node, mine (the node's k-mers), kmers (the hub's)."""
    mine, theirs = known.withColumnRenamed("kmers", "mine"), known.withColumnRenamed("node", "hub")
    return pairs.join(mine, "node").join(theirs, "hub").select("hub", "node", "mine", "kmers")


def _among(members: DataFrame, known: DataFrame, similarity: float, block: int) -> DataFrame:
    """members: hub, node, root.  Links (a, b) of members outside the family's largest class with all others, in units."""
    by_root = members.groupBy("hub", "root").agg(F.count("*").alias("n"))
    of_hub = by_root.groupBy("hub").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    shape = of_hub.select("hub", F.col("m.root").alias("largest"), F.ceil((F.col("all") - F.col("m.n")) / block).cast("int").alias("l"), F.ceil(F.col("all") / block).cast("int").alias("r")).where("l > 0")
    placed = members.join(shape, "hub").withColumn("h", F.xxhash64("node"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where("root <> largest").select("hub", "node", F.pmod("h", "l").cast("int").alias("i"), every("r").alias("j"), F.lit(True).alias("left"))
    right = placed.select("hub", "node", every("l").alias("i"), F.pmod("h", "r").cast("int").alias("j"), F.lit(False).alias("left"))
    units = left.unionByName(right).join(known, "node")

    def solve(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("node").to_pylist(), t.column("left").to_pylist(), t.column("kmers").to_pylist(), strict=True))
        sides = [[(x, np.frombuffer(h, np.uint64)) for x, side, h in rows if side is s] for s in (True, False)]
        links = link_unit(*sides, similarity) if all(sides) else []
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    return units.select("hub", "i", "j", "node", "left", "kmers").groupBy("hub", "i", "j").applyInArrow(solve, "a long, b long")
