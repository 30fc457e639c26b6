"""MinHash near-duplicate groups with min-max signatures and exact confirmation.

1. Each document becomes its set of shingle hashes. Each of `bands * rows / 2` permutations is evaluated
   once for each shingle and both its least and its greatest value are kept, so a signature of
   `bands * rows` values costs half the hash evaluations; the two are as good as independent. Bands of
   `rows` values are hashed.
2. Documents with one and the same set are one from here on (a map-side minimum for each set's
   128-bit hash, so a hot group of copies is one row for each task).
3. Documents that share a band form a bucket. Each bucket's pivot is its member with most company
   over all its bands (the text that a group was copied from, as a rule), and every member's set is
   compared with its pivot's: exact links of a star, not all pairs.
4. What a star leaves open: two members of a bucket that aren't both linked to the pivot. Each member is
   held as its difference from the pivot's set, D. As |a ^ b| = |D_a ^ D_b|, the exact similarity
   of two members follows from their short differences alone, and members linked to the pivot with
   |D_a| + |D_b| small need no look at all. Open members, those not linked to the pivot, meet all
   others in tiles of about `tile` members a side, so no task holds a whole group and linked members aren't copied about.
5. Connected components of the links by hooking and pointer jumping, written out each round.

Rows: a null text, or one without words, has an empty set and is linked with nothing. A null doc_id is
linked with nothing and kept. Rows that share a doc_id are answered each; their sets count as linked, through it, so all
take the component that any of them reaches. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm._stage import slots, staged
from framelake.llm._words import Words, chunks, grams, lean, mix


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts in a row, offsets); a text of fewer words is one shingle."""
    h = grams(w.hash, size)
    ok = w.full(size)
    n = w.counts
    text = w.text_of_word()[ok]
    h = h[ok]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = [grams(w.hash[w.first[t] : w.first[t + 1]], int(n[t]))[0] for t in short.tolist()]
        h, text = np.concatenate([h, np.array(extra, np.uint64)]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(n) + 1))


def min_max(h: np.ndarray, off: np.ndarray, permutations: int) -> np.ndarray:
    """Signatures of the non-empty sets: least and greatest value of each permutation, side by side."""
    at = off[:-1][np.diff(off) > 0]
    out = np.empty((len(at), 2 * permutations), np.uint32)
    rng = np.random.Generator(np.random.PCG64(11))
    mul = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)
    for i in range(permutations if len(at) else 0):
        v = ((h * mul[i] + add[i]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * i] = np.minimum.reduceat(v, at)
        out[:, 2 * i + 1] = np.maximum.reduceat(v, at)
    return out


def set_hashes(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two hashes of each whole set, 0 of the empty one."""
    out, full = np.zeros((2, len(off) - 1), np.uint64), np.flatnonzero(np.diff(off))
    if len(full):
        out[0, full] = np.add.reduceat(h, off[full])
        out[1, full] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), off[full])
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def signatures(rows: DataFrame, size: int, bands: int, per_band: int) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (hash of the whole set), bands (array of band hashes, empty without shingles)."""
    if bands * per_band % 2:
        raise ValueError("bands * rows must be even")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, off = shingle_sets(Words(b.column("text"), lower=True), size)
            n = np.diff(off)
            full = np.flatnonzero(n)
            sig = min_max(h, off, bands * per_band // 2).astype(np.uint64).reshape(len(full), bands, per_band)
            # A band mixes minima and maxima of different permutations: position i takes values i, i + bands, ...
            sig = np.stack([sig.reshape(len(full), -1)[:, i::bands] for i in range(bands)], axis=1) if len(full) else sig
            key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(full), axis=0)
            for j in range(per_band):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ sig[:, :, j])
            s = set_hashes(h, off)
            ends = np.zeros(len(n) + 1, np.int32)
            ends[1:] = np.cumsum((n > 0) * bands)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n.astype(np.int64)), _signed(s[0]), _signed(s[1]), pa.ListArray.from_arrays(pa.array(ends), _signed(key.ravel()))],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"],
            )

    return rows.mapInArrow(lean(scan), "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>")


def links(rows: DataFrame, heads: DataFrame, size: int, percent: int, tile: int) -> DataFrame:
    """a, b: links between the documents of `heads` (node, s1, s2, doc_id, bands), one for each distinct set; node is the set's number, and one doc_id may have several."""
    spark = rows.sparkSession
    band = heads.select("node", "doc_id", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count("*").alias("company")).filter("company > 1")
    members = staged(band.join(shared, "band"))
    company = members.groupBy("node").agg(F.sum("company").alias("company"))
    ranked = members.drop("company").join(company, "node")
    top = F.max(F.struct("company", (-F.col("doc_id")).alias("minus"), "node")).alias("top")
    pivots = ranked.groupBy("band").agg(top).select("band", F.col("top.node").alias("pivot"), (-F.col("top.minus")).alias("pivot_doc"))
    near = ranked.join(pivots, "band").select("pivot", "pivot_doc", "node").distinct()
    near = staged(near)
    # A pivot's members meet its set in shares of `tile`; the pivot's own set goes to every share.
    shares = near.groupBy("pivot").agg(F.count("*").alias("n")).select("pivot", F.ceil(F.col("n") / tile).cast("int").alias("shares"))
    wanted = near.join(shares, "pivot").join(heads.select("node", "doc_id", "s1", "s2"), "node").select(
        "doc_id",
        "node",
        "s1",
        "s2",
        "pivot",
        "pivot_doc",
        F.when(F.col("pivot") == F.col("node"), F.sequence(F.lit(0), F.col("shares") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))).alias("share"),
        "shares",
    )
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("node", "s1", "s2", "pivot", "pivot_doc", "share", "shares")).alias("to"))
    kept = ("pivot", "pivot_doc", "share", "shares", "member", "doc")
    longs = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    fields = "pivot bigint, pivot_doc bigint, share int, shares int, member bigint, doc bigint"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, off = shingle_sets(Words(b.column("text"), lower=True), size)
            s1, s2 = set_hashes(h, off).view(np.int64).tolist()
            out = []
            for i, (d, to) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("to").to_pylist(), strict=True)):
                blob = h[off[i] : off[i + 1]].tobytes()
                # A doc_id may stand in rows with other texts: a row answers for its own set alone.
                out += [(t["pivot"], t["pivot_doc"], s, t["shares"], t["node"], d, blob) for t in to if (t["s1"], t["s2"]) == (s1[i], s2[i]) for s in t["share"]]
            for a in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 2000], strict=True), [*longs, pa.binary()], strict=True)], names=[*kept, "shingles"])

    texts = rows.join(wanted.hint("merge"), "doc_id")
    sent = texts.mapInArrow(lean(sets), f"{fields}, shingles binary")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, pivot_doc, share, shares), group in _groups(batches, kept[:4], ("member", "doc", "shingles")):
            own = next((np.frombuffer(x, np.uint64) for node, _, x in group if node == pivot), None)
            out = []
            for node, doc, x in group:
                if node == pivot and share:
                    continue  # one share answers for the pivot itself
                a = np.frombuffer(x, np.uint64)
                diff = np.setxor1d(own, a, assume_unique=True)
                linked = _linked(len(own) + len(a), len(diff), percent)
                out.append((pivot, pivot_doc, share, shares, node, doc, len(a), linked, diff.tobytes()))
            cols = zip(*out, strict=True) if out else ([],) * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*longs, pa.int64(), pa.bool_(), pa.binary()], strict=True)], names=[*kept, "n", "linked", "diff"])

    parts = slots(spark)
    stars = staged(sent.repartition(parts, "pivot", "share").sortWithinPartitions("pivot", "share").mapInArrow(lean(star), f"{fields}, n bigint, linked boolean, diff binary"))
    found = stars.filter("linked and pivot != member").select(F.col("pivot_doc").alias("a"), F.col("doc").alias("b"))
    # Groups with open members, those that their pivot doesn't link. An open member meets all shares of its group's members; the linked ones
    # stay in their share, once for each `tile` open members of the group.
    opened = stars.filter("not linked").groupBy("pivot").agg(F.ceil(F.count("*") / tile).cast("int").alias("open_shares"), F.max("shares").alias("shares"))
    opened = opened.select("pivot", "open_shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    rest = stars.join(opened, ["pivot", "share"])  # a large group meets the number in as many places as it has shares
    deal = lambda salt, shares: F.pmod(F.xxhash64("member", F.lit(salt)), F.col(shares)).cast("int")
    every = lambda shares: F.explode(F.sequence(F.lit(0), F.col(shares) - 1))
    asked = rest.select("pivot", every("open_shares").alias("i"), deal(1, "shares").alias("j"), F.lit(False).alias("asks"), "member", "doc", "n", "diff")
    asking = rest.filter("not linked").select("pivot", deal(2, "open_shares").alias("i"), every("shares").alias("j"), F.lit(True).alias("asks"), "member", "doc", "n", "diff")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches, ("pivot", "i", "j"), ("asks", "member", "doc", "n", "diff")):
            a, b = _tile_links(group, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    tiles = asked.union(asking).repartition(parts, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    return found.union(tiles.mapInArrow(lean(cross), "a bigint, b bigint"))


def _linked(total: int, differing: int, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, from |a| + |b| and |a ^ b|."""
    return 100 * (total - differing) >= percent * (total + differing)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple, values: tuple = ("member", "shingles")) -> Iterator[tuple]:
    """Runs of rows with equal keys, from a sorted partition; a group is at most a tile's rows."""
    now, group = None, []
    for b in batches:
        cols = [b.column(k).to_pylist() for k in keys]
        vals = [b.column(v).to_pylist() for v in values]
        for key, row in zip(zip(*cols, strict=True), zip(*vals, strict=True), strict=True):
            if key != now:
                if group:
                    yield now, group
                now, group = key, []
            group.append(row)
    if group:
        yield now, group


def _tile_links(group: list[tuple], percent: int) -> tuple[list[int], list[int]]:
    """Links of a tile's open members (asks) with its other side, from their differences."""
    opens, other = ([r[1:] for r in group if r[0] == asks] for asks in (True, False))
    out_a, out_b = [], []
    if not opens or not other:
        return out_a, out_b
    # An inverted list of the other side's differences: shared shingles of one open member with all at once.
    sizes = np.array([len(r[3]) // 8 for r in other])
    element = np.frombuffer(b"".join(r[3] for r in other), np.uint64)
    order = np.argsort(element, kind="stable")
    holder = np.repeat(np.arange(len(other)), sizes)[order]
    element = element[order]
    ids, docs, n = (np.array([r[k] for r in other]) for k in range(3))
    for member, doc, size, diff in opens:
        d = np.frombuffer(diff, np.uint64)
        lo, hi = np.searchsorted(element, d), np.searchsorted(element, d, side="right")
        m = hi - lo
        at = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        shared = np.bincount(holder[at], minlength=len(other))
        differing, total = len(d) + sizes - 2 * shared, n + size
        hit = (100 * (total - differing) >= percent * (total + differing)) & (ids != member)
        out_a += [doc] * int(hit.sum())
        out_b += docs[hit].tolist()
    return out_a, out_b


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node that has an edge (a, b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct()
    both = staged(both)
    label = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).select(F.col("a").alias("node"), "c")
    label = staged(label)
    while True:
        # Hook: the least label among a node and its neighbours; jump: the label of one's label.
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        hooked = label.join(near, label["node"] == near["a"]).select("node", "c", F.least("c", "m").alias("m"))
        roots = hooked.groupBy("c").agg(F.min("m").alias("up"))  # a tree's root moves with the least of its nodes
        moved = hooked.join(roots, "c").select("node", F.col("c").alias("old"), F.least("m", "up").alias("c"))
        jump = staged(moved)
        over = jump.select(F.col("node").alias("c"), F.col("c").alias("next"))
        new = jump.join(over, "c", "left").select("node", "old", F.coalesce("next", "c").alias("c"))
        new = staged(new)
        if new.filter("c != old").isEmpty():
            return new.select("node", F.col("c").alias("component"))
        label = new.select("node", "c")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 24, rows: int = 5, tile: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document.

    size: words of a shingle. percent: documents are linked whose sets' common part is at least this share of
    both. bands, rows: at the default a pair of similarity 0.85 shares no band with probability 1e-6,
    one of 0.8 with 7e-5. tile: members of a group that a task compares at once.
    """
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = staged(signatures(text, size, bands, rows))
    named = sig.filter("n_shingles > 0 and doc_id is not null")
    heads = named.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("s1", "s2", "n_shingles", "x.doc_id", "x.bands")
    heads = staged(heads.withColumn("node", F.monotonically_increasing_id()))
    # A doc_id with several sets links their first documents: each with it.
    one = F.struct("s1", "s2", "n_shingles")
    several = named.groupBy("doc_id").agg(F.min(one).alias("low"), F.max(one).alias("high")).filter("low != high").select("doc_id")
    head = heads.select("s1", "s2", "n_shingles", F.col("doc_id").alias("head"))
    through = named.join(several, "doc_id").select("doc_id", "s1", "s2", "n_shingles").distinct().join(head, ["s1", "s2", "n_shingles"])
    found = links(text, heads, size, percent, tile).union(through.select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
    comp = components(found)
    of_set = head.join(comp, head["head"] == comp["node"], "left").select("s1", "s2", "n_shingles", F.coalesce("component", "head").alias("component_id"))
    out = sig.drop("bands").join(of_set, ["s1", "s2", "n_shingles"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
