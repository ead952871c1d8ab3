"""MinHash near-duplicate grouping.

One-permutation hashing with optimal densification gives each distinct shingle set a signature; banded
buckets propose candidates as stars around a bucket's centre, so a bucket of n members gives n - 1 pairs. The
centre is the member whose buckets are the fullest over all bands: the text that a family of near copies was made
from, or the one nearest to it, rather than any member. Every link is confirmed on the full shingle sets of the
whole texts.

A bucket whose members end up in several components may hide links between members other than the centre. If
it is small (at most SMALL members, so that pairs stay a fixed multiple of the members), all its pairs between
different components are confirmed too. Members of larger ones are hashed again with longer, more numerous
bands, which tell near from nearest, and go through the same two steps. What is still crowded then is joined
exactly: two sets that are linked share one of their rarest shingles, and how rare follows from their sizes.

Defined cases: a null or blank text has no shingles and is linked with nothing; fewer than SHINGLE words form
one shingle; rows that repeat a doc_id are one document and share its component; a row whose doc_id is null
keeps its place with a null component and is kept; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, map_arrow, mix64, runs_of, settle, small, text_bytes

SHINGLE = 5
BINS = 192
#: The chance that all bands of a level miss a link: (1 - similarity**rows)**bands.
MISSED = 1e-6
SMALL = 16
#: Ratio of the sizes in a class of the exact join, and the rows of a shingle there that stay in one task.
SIZE_CLASS, SALTED = 1.03, 512
#: Pairs of one text that are confirmed in one task.
STAR = 512
#: A link needs percent * union <= 100 * intersection; this is the query's.
PERCENT = 85
#: Bytes of text hashed at once: the working arrays of a run stay near the CPU's caches.
RUN_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, RUN_BYTES + 1)
        for name, p in (("up", int(_P)), ("down", pow(int(_P), -1, 1 << 64))):
            a = np.full(size, np.uint64(p))
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each lower-cased word of these documents, and where each document's words begin among them."""
    base = offsets[0]
    data, at = _LOWER[data[base : offsets[-1]]], offsets - base
    n = len(data)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | edge))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | edge))
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64) * _Q), np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each document's distinct shingles as a sorted array of 64-bit hashes."""
    with np.errstate(over="ignore"):
        words, first = _word_hashes(data, offsets)
        rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            rolled = rolled * _Q + words[k : k + len(rolled)]
        rolled = mix64(rolled + np.uint64(SHINGLE))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                s = np.sort(rolled[a : b - SHINGLE + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                h = np.uint64(0)
                for w in words[a:b]:
                    h = h * _Q + w
                out.append(mix64(np.array([h + np.uint64(b - a)])))
            else:
                out.append(words[:0])
    return out


def _probes() -> np.ndarray:
    """For each bin the bins to borrow from, in order: the 2-universal draws of optimal densification."""
    if "probes" not in _POWERS:
        a, b = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(1, 2049, dtype=np.uint64), indexing="ij")
        with np.errstate(over="ignore"):
            _POWERS["probes"] = ((mix64(a * _P + b * _Q) >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    return _POWERS["probes"]


def levels(percent: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """(bands, bins a band) of each level: the longest bands that miss a link with a chance below MISSED, then twice as long ones."""
    alike = percent / 100
    fit = [r for r in range(1, BINS // 2 + 1) if (1 - alike**r) ** (BINS // r) < MISSED] if 0 < percent < 100 else []
    if not fit:
        raise ValueError(f"no bands of {BINS} bins find a similarity of {percent} percent")
    rows = max(fit)
    more = math.ceil(math.log(MISSED) / math.log1p(-(alike ** (2 * rows))))
    return (BINS // rows, rows), (-(-more // 32) * 32, 2 * rows)


def band_keys(sets: list[np.ndarray], level: int, percent: int = PERCENT) -> np.ndarray:
    """A (documents, bands) array of bucket keys; all sets must have members."""
    bands, rows = levels(percent)[level]
    n, sizes = len(sets), np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    cell = np.repeat(np.arange(n), sizes) * BINS + ((everything >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    least = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))  # sets are sorted, so a bin's first is its minimum
    signature, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    signature[cell[least]], filled[cell[least]] = everything[least], True
    probes, empty = _probes(), np.flatnonzero(~filled)
    row, column = empty // BINS * BINS, empty % BINS
    out = signature.copy()
    for k in range(probes.shape[1]):
        if not len(empty):
            break
        source = row + probes[column, k]
        hit = filled[source]
        out[empty[hit]] = signature[source[hit]]
        empty, row, column = empty[~hit], row[~hit], column[~hit]
    for e, r in zip(empty.tolist(), row.tolist()):
        out[e] = signature[r : r + BINS][filled[r : r + BINS]][0]
    out = out.reshape(n, BINS)
    # The first level cuts the signature into bands; later ones draw bins, so that bands overlap.
    drawn = np.arange(bands * rows).reshape(bands, rows) if bands * rows <= BINS else np.random.default_rng(level).permuted(np.tile(np.arange(BINS), (bands, 1)), axis=1)[:, :rows]
    with np.errstate(over="ignore"):
        keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _P + np.uint64(level), (n, 1))
        for k in range(rows):
            keys = mix64(keys * _Q + out[:, drawn[:, k]])
    return keys


def _sketch(percent: int):
    def run(batches):
        names = ["doc_id", "n_shingles", "d1", "d2", "keys"]
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in runs_of(offsets, RUN_BYTES):
                sets = shingle_sets(data, offsets[a : b + 1])
                sizes = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(sizes)
                d = np.zeros((2, b - a), np.uint64)
                keys = np.zeros((0, levels(percent)[0][0]), np.uint64)
                if len(some):
                    filled = [sets[i] for i in some]
                    everything, at = np.concatenate(filled), np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                    with np.errstate(over="ignore"):
                        d[0, some] = np.add.reduceat(mix64(everything + _P), at)
                        d[1, some] = np.add.reduceat(mix64(everything ^ _Q), at)
                    keys = band_keys(filled, 0, percent)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((sizes > 0) * keys.shape[1]))), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), lists], names)

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets have so many percent of their union in common."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _distinct_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """shingle_sets(), worked out once for texts that repeat among these."""
    places: dict[bytes, int] = {}
    own = [places.setdefault(data[a:b].tobytes(), len(places)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in places])))
    sets = shingle_sets(np.frombuffer(b"".join(places), np.uint8), ends)
    return [sets[i] for i in own]


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            first, second, good = text_bytes(batch.column(2)), text_bytes(batch.column(3)), []
            for a, b in runs_of(first[1] + second[1], RUN_BYTES):
                left, right = (_distinct_sets(data, offsets[a : b + 1]) for data, offsets in (first, second))
                good += [linked(x, y, percent) for x, y in zip(left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "ok"])

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, ok) of the pairs (a, b), judged on the whole texts (doc_id, text).

    A text that more than STAR pairs need, a star's centre, goes to several tasks, each with its share of the pairs.
    """
    degrees = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")))
    parts = degrees.select("doc_id", F.ceil(F.col("n") / STAR).cast("int").alias("parts"))
    needed = texts.join(small(parts), "doc_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    centres = small(parts.where("parts > 1"))
    joined = pairs
    for end, other in (("a", "b"), ("b", "a")):
        dealt = joined.join(centres.withColumnRenamed("doc_id", end), end, "left").withColumn("part", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        joined = dealt.join(needed.select(F.col("doc_id").alias(end), "part", F.col("text").alias("t" + end)), [end, "part"]).drop("part")
    joined = joined.select("a", "b", "ta", "tb")
    return map_arrow(joined, _confirm(percent), "a long, b long, ok boolean").groupBy("a", "b").agg(F.max("ok").alias("ok"))


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every end of the links (a, b): the smallest id that can be reached.

    Labels spread along links and then jump to their label's label, so rounds grow with the logarithm of the
    longest chain; each round is a written table.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))))
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        after = settle(spread.join(up, "label", "left").select("id", F.least("label", "up").alias("label"), "was"))
        done = after.where("label <> was").limit(1).count() == 0
        discard(labels)
        labels = settle(after.select("id", "label")) if not done else after
        if done:
            discard(both)
            return after.select("id", "label")
        discard(after)


def _again(level: int, percent: int):
    """(id, n_shingles, keys) of a later level, for texts that have shingles."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in runs_of(offsets, RUN_BYTES):
                sets = shingle_sets(data, offsets[a : b + 1])
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                keys = band_keys([sets[i] for i in some], level, percent)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * keys.shape[1], pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(some)), pa.array([len(sets[i]) for i in some], pa.int64()), lists], ["id", "n_shingles", "keys"])

    return run


def _buckets(members: DataFrame) -> DataFrame:
    """(key, id, n_shingles, size, full) of buckets with more than one member; full: how full a member's buckets are."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    held = settle(members.join(sizes, "key"))
    out = settle(held.join(held.groupBy("id").agg(F.sum("size").alias("full")), "id").select("key", "id", "n_shingles", "size", "full"))
    discard(held)
    return out


def _near_size(percent: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _stars(buckets: DataFrame, percent: int) -> DataFrame:
    """(a, b, a < b) between each bucket's centre and its other members."""
    centre = buckets.groupBy("key").agg(F.max(F.struct("full", (-F.col("id")).alias("i"), F.col("n_shingles").alias("nb"))).alias("c")).select("key", (-F.col("c.i")).alias("c"), "c.nb")
    pairs = buckets.withColumnRenamed("n_shingles", "na").join(centre, "key").where((F.col("id") != F.col("c")) & _near_size(percent))
    return pairs.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their component, of the buckets that hold several components."""
    named = settle(buckets.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")))
    keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return settle(named.join(keys, "key").select("key", "id", "n_shingles", "size", "label"))


def _across(mixed: DataFrame, percent: int) -> DataFrame:
    """(a, b, a < b) of the pairs between components in small buckets."""
    few = mixed.where(F.col("size") <= SMALL)
    left = few.select("key", F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("label").alias("la"))
    right = few.select("key", F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("label").alias("lb"))
    return left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _near_size(percent)).select("a", "b").distinct()


def _sets(batches):
    """(id, n, s) of texts: their distinct shingles."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in runs_of(offsets, RUN_BYTES):
            sets = shingle_sets(data, offsets[a : b + 1])
            sizes = np.array([len(s) for s in sets], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), lists], ["id", "n", "s"])


def _rarest(texts: DataFrame, crowded: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, a < b) of all pairs between components of the crowded texts that can be linked: a prefix-filter join.

    Each text's shingles are ordered from the rarest on. The first that a pair has in common stands where what is left
    of either set can still hold the intersection that a link needs: (100 + percent) * common >= percent * (nx + ny). x,
    the smaller set, knows ny >= nx; y is listed for each class of sizes that x may have. Within a class, pairs inside
    the component that holds most rows of a shingle are never formed, and the x of common shingles are salted.
    """
    own = map_arrow(texts.join(small(crowded), "doc_id", "left_semi"), _sets, "id long, n long, s array<long>").withColumn("v", F.xxhash64("s")).dropDuplicates(["id", "v"])
    size = lambda n: F.floor(F.log(n) / math.log(SIZE_CLASS)).cast("int")
    own = settle(own.where("n > 0").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).withColumn("k", size(F.col("n"))))
    flat = settle(own.select("id", "v", "n", "label", "k", F.explode("s").alias("g")))
    shared = flat.groupBy("g").agg(F.count("*").alias("f")).where("f > 1")
    order = F.row_number().over(Window.partitionBy("id", "v").orderBy(F.coalesce("f", F.lit(1)), "g"))
    placed = flat.join(shared, "g", "left").withColumn("p", order).withColumn("rest", F.col("n") - F.col("p") + 1)
    placed = settle(placed.where(f"f > 1 and rest * 100 >= {percent} * n").select("g", "id", "v", "n", "label", "k", "p", "rest"))
    x = placed.where(f"rest * {100 + percent} >= {2 * percent} * n").select("g", "k", "id", "v", "n", "label", "p", F.lit(True).alias("x"))
    least = F.broadcast(own.groupBy("k").agg(F.min("n").alias("lo")))  # one row a class of sizes
    classes = F.explode(F.sequence(size(F.ceil(F.col("n") * percent / 100)), F.col("k")))
    y = placed.withColumn("k", classes).join(least, "k").where(f"rest * {100 + percent} >= {percent} * (n + lo)").select("g", "k", "id", "v", "n", "label", "p", F.lit(False).alias("x"))
    both = settle(x.union(y))
    counts = both.groupBy("g", "k", "label").agg(F.count_if("x").alias("xs"), F.count_if(~F.col("x")).alias("ys"))
    groups = counts.groupBy("g", "k").agg(F.max(F.struct(F.col("xs") + F.col("ys"), "label")).getField("label").alias("main"), F.count("*").alias("labels"), F.sum("xs").alias("xs"), F.sum("ys").alias("ys"))
    groups = groups.where("labels > 1 and xs > 0 and ys > 0").select("g", "k", "main", F.ceil(F.col("xs") / SALTED).cast("int").alias("salts"))
    named = settle(both.join(groups, ["g", "k"]).withColumn("most", F.col("label") == F.col("main")).drop("main"))
    # In "to_most" x isn't of the main component and y is; in the other side y isn't.
    side = lambda mine, other: F.explode(F.when(F.col("most"), F.array(F.lit(mine))).otherwise(F.array(*map(F.lit, other))))
    left = named.where("x").withColumn("to_most", side(False, (True, False))).withColumn("salt", F.pmod(F.xxhash64("id", "v"), F.col("salts")).cast("int"))
    right = named.where("not x").withColumn("to_most", side(True, (False,))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left = left.select("g", "k", "to_most", "salt", F.col("id").alias("xi"), F.col("v").alias("xv"), F.col("n").alias("nx"), F.col("label").alias("lx"), F.col("p").alias("px"))
    right = right.select("g", "k", "to_most", "salt", F.col("id").alias("yi"), F.col("v").alias("yv"), F.col("n").alias("ny"), F.col("label").alias("ly"), F.col("p").alias("py"))
    met = left.join(right, ["g", "k", "to_most", "salt"]).where(
        f"lx <> ly and (nx < ny or nx = ny and xi < yi) and nx * 100 >= ny * {percent} and (1 + least(nx - px, ny - py)) * {100 + percent} >= {percent} * (nx + ny)"
    )
    met = met.groupBy("xi", "xv", "yi", "yv", "nx", "ny").agg(F.count("*").alias("c"), F.max("px").alias("px"), F.max("py").alias("py"))
    # Whatever else they share stands after the last shingle that both lists have.
    met = met.where(f"(c + least(nx - px, ny - py)) * {100 + percent} >= {percent} * (nx + ny)")
    out = settle(met.select(F.least("xi", "yi").alias("a"), F.greatest("xi", "yi").alias("b")).distinct())
    discard(own, flat, placed, both, named)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = settle(map_arrow(texts, _sketch(percent), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"))
    some = sketches.where("n_shingles > 0 and doc_id is not null")
    sets = settle(some.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys")))
    members = sets.select("id", "n_shingles", F.explode("keys").alias("key"))
    tested = labels = None

    def test(pairs: DataFrame) -> None:
        nonlocal tested, labels
        pairs = settle(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti") if tested is not None else pairs)
        found = settle(confirm(pairs, texts, percent))
        discard(pairs)
        news = labels is None or found.where("ok").limit(1).count()
        tested = settle(tested.union(found)) if tested is not None else found
        if news:
            labels = components(tested.where("ok"))

    last = len(levels(percent)) - 1
    for level in range(last + 1):
        buckets = _buckets(members)
        test(_stars(buckets, percent))
        mixed = _mixed(buckets, labels)
        test(_across(mixed, percent))
        crowded = settle(mixed.where(F.col("size") > SMALL).select(F.col("id").alias("doc_id")).distinct())
        if not crowded.limit(1).count():
            break
        if level == last:
            test(_rarest(texts, crowded, labels, percent))
            break
        again = map_arrow(texts.join(small(crowded), "doc_id", "left_semi"), _again(level + 1, percent), "id long, n_shingles long, keys array<long>")
        members = settle(again.select("id", "n_shingles", F.explode("keys").alias("key")))
    of_sets = settle(sets.join(labels, "id", "left").select("n_shingles", "d1", "d2", F.coalesce("label", "id").alias("label")))
    out = sketches.drop("keys").join(of_sets, ["n_shingles", "d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("label"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep."""
    gone = small(settle(near_duplicates(docs, id_col, text_col, percent).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()))
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


ORACLE = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE} + 2), lambda i: array_to_string(w[i : i + {SHINGLE} - 1], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
