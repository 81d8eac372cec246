"""Exact Jaccard join of word n-gram sets, as classes of linked documents.

Equal sets are one set from the start. Every set is ordered by a sketch of how common its hashes are, rare ones first, and
enters the index lists of its prefix with its size and its position there. The prefix is longer by a few hashes than
sharing one would ask for, so that sets of the asked similarity share `meetings(size)` of them: sets that meet less often
by chance are never fetched. The lists are kept in order of size and dealt out by size ranges, so that blocks that are too
short, or stand too far back, are skipped without a look.

Answers are derived from those of similar sets. In a leader round a set is compared with one set of its lists, of some
that it meets there the nearest by parity bitmaps (which bound the difference of two sets from below), and if the two
link it takes over that set's class: what is in one class needs no comparison any more. Large groups of near copies so
fold in as many comparisons as they have members. After these rounds all pairs that are left, of different classes, which
meet often enough are compared, once each, by parity bitmaps and then exactly. No pair is dropped unseen, and no pairs
within a class are made.

Sets are dealt out by their ids once, as a bucketed table, so that a join moves the pairs and not all sets; steps that a
later one replaces are deleted.

Cases: null text and text without words have the empty set, linked with nothing; a text of fewer words than an n-gram has
is one n-gram; equal texts link; an empty table gives an empty result; rows of equal id and text count as one, and
rows of null id take part (their component is the smallest id of their class, null if none has one). A very long text is
hashed alone and has as many entries as others for its size, each of fixed width; its bitmap moves once a pair. Ties in
the order are broken by the hash. Extra columns are not read, and may have any names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.checkpoint import Steps, broadcast_if_small
from .graphs import members
from .shingles import set_ids, sets
from .tables import ship

#: The sketch: counters by hash, in slices that are unpacked one at a time. Its 16 MB (less when packed) are broadcast, at
#: any size of the corpus; hashes are counted so many at once.
SKETCH_BITS, SLICES, COUNTED = 22, 16, 1 << 21
#: Sketches that one task sums, round after round, until one is left.
SUMMED = 64
#: Rows of ids that may be broadcast (16 bytes each); beyond, the join is by shuffle.
BROADCAST_IDS = 250_000
LEADER_ROUNDS = 2
#: Hashes that sets must share in their prefixes, unless they are small.
SHARED = 4
#: Most bytes of a parity bitmap that an entry carries; the whole one of a larger set moves once a pair.
ENTRY_BYTES = 64
#: Entries of a list and size range that one task compares with all of it.
LIST_SHARE = 2048
#: Entries of a list that a leader round looks back at, and partners of a set that it weighs.
WINDOW, PARTNERS = 64, 3
#: Members of one leader that one task compares.
LEADER_SHARE = 512


def _least(n, percent: int):
    """The smallest size that can reach the similarity with size n."""
    return -(-n * percent // 100)


def _overlap(n, m, percent: int):
    """The overlap that sizes n and m need."""
    return -(-(n + m) * percent // (100 + percent))


def meetings(n, percent: int):
    """How many hashes a set of size n shares in its prefix, at least, with any set of its size or more that links to it."""
    return np.minimum(np.minimum(SHARED, 1 + n // 20), np.maximum(1, _least(n, percent)))


def _profile(df: DataFrame, width: int) -> DataFrame:
    """Of each row: key, n, sid; and of each task the slices of its sketch (key null, slice not)."""
    size = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, waiting = np.zeros(size, np.uint32), []

        def count() -> None:
            if waiting:
                cells, counts = np.unique(np.concatenate(waiting), return_counts=True)
                sketch[cells] += counts.astype(np.uint32)
                waiting.clear()

        for batch in batches:
            n, sid = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, hashes, counts in sets((x.as_py() for x in batch.column(1)), width):
                waiting.append((hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                if sum(map(len, waiting)) >= COUNTED:
                    count()
                n.append(counts)
                sid.append(set_ids(hashes, counts))
            rows, none = batch.num_rows, np.concatenate(n) == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(sid), mask=none), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                names=["key", "n", "sid", "slice", "counts"],
            )
        count()
        if sketch.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, SLICES)]
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(parts, pa.binary())], names=["key", "n", "sid", "slice", "counts"])

    return df.mapInArrow(run, "key long, n long, sid long, slice int, counts binary")


def _sum_slices(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(zlib.decompress(data.as_py()), np.uint32).astype(np.int64)
                total[i] = total[i] + counts if i in total else counts
        if total:
            parts = [zlib.compress(np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes(), 1) for x in total.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    return df.mapInArrow(run, "slice int, counts binary")


def _prefixes(df: DataFrame, sketch: bytes, width: int, percent: int) -> DataFrame:
    """The index entries (token, sid, n, pos) of each set's prefix."""
    shared = df.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(zlib.decompress(shared.value), np.uint32)
        seen: set[int] = set()
        for batch in batches:
            for _, hashes, counts in sets((x.as_py() for x in batch.column(0)), width):
                who = np.repeat(np.arange(len(counts)), counts)
                order = np.lexsort((hashes, common[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], who))
                first = np.cumsum(counts) - counts
                place = np.arange(len(hashes)) - np.repeat(first, counts)
                sid = set_ids(hashes, counts)
                new = np.zeros(len(counts), bool)
                new[np.unique(sid, return_index=True)[1]] = True
                new &= np.array([x not in seen for x in sid.tolist()], bool)
                if len(seen) < 1 << 16:  # copies met again by this task are left out; those of other tasks, when lists are sorted
                    seen.update(sid[new].tolist())
                keep = np.flatnonzero((place < (counts - _least(counts, percent) + meetings(counts, percent))[who]) & new[who])
                for at in np.array_split(keep, 1 + len(keep) // 100_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(hashes[order[at]].view(np.int64)), pa.array(sid[who[at]]), pa.array(counts[who[at]].astype(np.int32)), pa.array(place[at].astype(np.int32))],
                        names=["token", "sid", "n", "pos"],
                    )

    return df.mapInArrow(run, "token long, sid long, n int, pos int")


def _shared(entries: DataFrame, percent: int) -> DataFrame:
    """The entries that have a partner of fitting size in their list; copies of one entry count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, linked = [np.empty(0, np.int64)] * 4, False
        for batch in batches:
            token, sid, n, pos = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
            token, sid, n, pos = token[new], sid[new], n[new], pos[new]
            link = np.zeros(len(token) + 1, bool)
            link[0] = linked
            link[1:-1] = (token[1:] == token[:-1]) & (n[:-1] >= _least(n[1:].astype(np.int64), percent))
            keep = np.flatnonzero(link[:-1] | link[1:])
            keep = keep[keep < len(token) - 1]
            held, linked = [x[-1:] for x in (token, sid, n, pos)], bool(link[len(token) - 1])
            if len(keep):
                yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(sid[keep]), pa.array(n[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], names=["token", "sid", "n", "pos"])
        if linked:
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2].astype(np.int32)), pa.array(held[3].astype(np.int32))], names=["token", "sid", "n", "pos"])

    return entries.repartition("token").sortWithinPartitions("token", "n", "sid").mapInArrow(run, "token long, sid long, n int, pos int")


def _met_enough(entries: DataFrame, percent: int) -> DataFrame:
    """(sid, n) of the sets with as many entries as they share with any set that links to them."""
    least = F.ceil(F.col("n") * percent / 100)
    asked = F.least(F.lit(SHARED), 1 + F.floor(least / 20), F.greatest(F.lit(1), F.ceil(least * percent / 100)))
    return entries.groupBy("sid", "n").agg(F.count(F.lit(1)).alias("entries")).where(F.col("entries") >= asked).select("sid", "n")


def _range(percent: int):
    """The size range of a set: sets that may link are of one range or of neighbouring ones."""
    return F.floor(F.log(F.col("n")) / (np.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0)).cast("int")


def _fits(n: int, pos: int, m: int, at: int, percent: int) -> bool:
    """Whether sets of sizes n and m can reach the similarity if their first shared hash is at pos and at."""
    need = -(-(n + m) * percent // (100 + percent))
    return n - pos >= need and m - at >= need


def _leaders(entries: DataFrame, percent: int, round_: int) -> DataFrame:
    """For the sets of the lists (token, n, sid, pos, class) some partners of other classes that fit: (b, a). Each entry gets
    two at most, the first of its list and one out of a bounded window, which differs from list to list and round to round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, window, out_b, out_a = None, [], [], []
        for batch in batches:
            for t, block, n, sid, pos, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, block) != token:
                    token, window = (t, block), []
                least = -(-n * percent // 100)
                while window and window[0][0] < least:  # a block that is too short
                    window.pop(0)
                draw = (sid * 0x9E3779B1 ^ t ^ round_ * 0x85EBCA6B) & 0xFFFFFFF
                if window:
                    found = set()
                    for i in (0, *((draw + 7 * j) % len(window) for j in range(3))):
                        m, a, at, other = window[i]
                        if other != own and m >= least and a not in found and _fits(n, pos, m, at, percent):
                            found.add(a)
                            out_b.append(sid)
                            out_a.append(a)
                            if len(found) == 2:
                                break
                if len(window) < WINDOW:
                    window.append((n, sid, pos, own))
                else:
                    window[1 + draw % (WINDOW - 1)] = (n, sid, pos, own)
                if len(out_b) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_a, pa.int64())], names=["b", "a"])
                    out_b, out_a = [], []
        if out_b:
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_a, pa.int64())], names=["b", "a"])

    ranged = entries.withColumn("range", _range(percent))
    ordered = ranged.repartition("token", "range").sortWithinPartitions("token", "range", "n", "sid").select("token", "range", "n", "sid", "pos", "class")
    # Dealt out by b once, for the counts, the window and the join that follows.
    met = ordered.mapInArrow(run, "b long, a long").repartition("b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("met"))
    place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("met"), "a"))
    return met.withColumn("place", place).where(F.col("place") <= PARTNERS).select("b", "a")


def _all_pairs(entries: DataFrame, whole: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """All pairs (b, a) of sets of different classes that fit each other, whose bounded bitmaps allow the similarity, and that
    meet in as many lists as linked sets do. A list
    is dealt out by size ranges: an entry is compared with those before it in its own range and with all that fit of the
    range before. Where a list and range hold many entries, these are dealt to several tasks, each with all of the range."""

    def ranged(df: DataFrame) -> DataFrame:
        return df.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).withColumn("range", _range(percent) + F.col("up"))

    many = ranged(entries).groupBy("token", "range").agg(F.ceil(F.count(F.lit(1)) / LIST_SHARE).cast("int").alias("parts")).where("parts > 1")
    many = steps.put("many", many.select(F.col("token").alias("hot"), F.col("range").alias("hot_range"), "parts"))
    many = broadcast_if_small(many, BROADCAST_IDS)
    rows = ranged(entries.join(whole.select("sid", "brief"), "sid")).join(many, (F.col("token") == F.col("hot")) & (F.col("range") == F.col("hot_range")), "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asks = (F.col("up") == 0) & (F.pmod(F.xxhash64("sid"), F.col("parts")) == F.col("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, out = None, ([], [], [])
        classes: dict[int, tuple[list, list]] = {}  # the entries that a later one can still fit: sizes, and the rest
        for batch in batches:
            for t, block, part, n, sid, pos, own, asks, brief in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, block, part) != key:
                    key, classes = (t, block, part), {}
                least, spare, bits, size = -(-n * percent // 100), n - pos, int.from_bytes(brief, "little"), len(brief)
                if asks:
                    # The largest partner that leaves room at this position: spare + SHARED - 1 >= percent * (n + m) / (100 + percent).
                    most, short = (spare + SHARED - 1) * (100 + percent) // percent - n, []
                    for other, (sizes, held) in classes.items():
                        if other == own:
                            continue
                        if sizes[-1] < least:  # a block that is too short, for all that come
                            short.append(other)
                            continue
                        for i in range(bisect_left(sizes, least), bisect_right(sizes, most)):
                            m, (a, room, others, length) = sizes[i], held[i]
                            asked, need = int(meetings(m, percent)), -(-(n + m) * percent // (100 + percent))
                            if min(room, spare) > need - asked and _difference(bits, size, others, length) <= n + m - 2 * need:
                                for column, value in zip(out, (sid, a, asked)):
                                    column.append(value)
                    for other in short:
                        del classes[other]
                if spare + SHARED - 1 >= -(-2 * n * percent // (100 + percent)):  # else it stands too far back for any set of its size or more
                    sizes, held = classes.setdefault(own, ([], []))
                    sizes.append(n)
                    held.append((sid, spare, bits, size))
                if len(out[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["b", "a", "asked"])
                    out = ([], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["b", "a", "asked"])

    order = ("token", "range", "part", "n", "sid")
    ordered = rows.withColumn("asks", asks).repartition("token", "range", "part").sortWithinPartitions(*order)
    met = ordered.select(*order, "pos", "class", "asks", "brief").mapInArrow(run, "b long, a long, asked long")
    return met.groupBy("b", "a").agg(F.count(F.lit(1)).alias("met"), F.max("asked").alias("asked")).where("met >= asked").select("b", "a")


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, n, hashes, parity, brief) of the wanted (key, sid): each set once more from its text, with its parity bitmap, which
    brief is folded to at most ENTRY_BYTES."""
    few = wanted.count() <= BROADCAST_IDS
    rows = docs.join(F.broadcast(wanted) if few else wanted, docs["key"].eqNullSafe(wanted["wanted"])).select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted_sid = batch.column(0).to_numpy()
            for first, hashes, counts in sets((x.as_py() for x in batch.column(1)), width):
                sid, ends = set_ids(hashes, counts), np.cumsum(counts)
                out: tuple[list, ...] = ([], [], [], [], [])
                for i in np.flatnonzero(sid == wanted_sid[first : first + len(counts)]):
                    own = hashes[ends[i] - counts[i] : ends[i]]
                    bits = 1 << max(6, int(2 * counts[i] - 1).bit_length())
                    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                    few = odd.reshape(-1, min(bits, 8 * ENTRY_BYTES)).sum(axis=0) & 1
                    parity, brief = (np.packbits(x.astype(np.uint8), bitorder="little").tobytes() for x in (odd, few))
                    for column, value in zip(out, (int(sid[i]), int(counts[i]), own.tobytes(), parity, brief)):
                        column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["sid", "n", "hashes", "parity", "brief"])

    return rows.mapInArrow(run, "sid long, n int, hashes binary, parity binary, brief binary")


def _difference(a: int, n: int, b: int, m: int) -> int:
    """A lower bound of the symmetric difference, from two parity bitmaps of n and m bytes; the longer one is folded."""
    while n > m:
        n //= 2
        a = (a >> 8 * n) ^ (a & ((1 << 8 * n) - 1))
    while m > n:
        m //= 2
        b = (b >> 8 * m) ^ (b & ((1 << 8 * m) - 1))
    return (a ^ b).bit_count()


def _possible(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(b, a, far) of the pairs whose parity bitmaps allow the similarity; far: how far apart they look. A bitmap moves once a pair."""
    left = whole.select(F.col("sid").alias("b"), F.col("n").alias("bn"), F.col("parity").alias("bp"))
    right = whole.select(F.col("sid").alias("a"), F.col("n").alias("an"), F.col("parity").alias("ap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, bn, bp, a, an, ap = (c.to_pylist() for c in batch.columns)
            far = [_difference(int.from_bytes(x, "little"), len(x), int.from_bytes(y, "little"), len(y)) for x, y in zip(bp, ap)]
            keep = [i for i, d in enumerate(far) if d <= bn[i] + an[i] - 2 * _overlap(bn[i], an[i], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in keep], pa.int64()) for x in (b, a, far)], names=["b", "a", "far"])

    return pairs.join(left, "b").join(right, "a").select("b", "bn", "bp", "a", "an", "ap").mapInArrow(run, "b long, a long, far long")


def _links(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs (b, a) that link. Sets travel once a pair, to the task of their partner a; a partner of many sets is dealt
    out over as many tasks as its number asks for."""
    tasks = pairs.groupBy("a").agg((F.ceil(F.count(F.lit(1)) / LEADER_SHARE)).cast("int").alias("tasks"))
    dealt = pairs.join(tasks, "a").withColumn("task", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int"))
    members = dealt.join(whole.select(F.col("sid").alias("b"), "n", "hashes"), "b").select("a", "task", "b", "n", "hashes", F.lit(1).alias("kind"))
    heads = tasks.join(whole.select(F.col("sid").alias("a"), "n", "hashes"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), F.col("a").alias("b"), "n", "hashes", F.lit(0).alias("kind")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, base = None, np.empty(0, np.uint64)
        for batch in batches:
            out_b, out_a = [], []
            for a, b, hashes, kind in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4), batch.column(5).to_pylist()):
                own = np.frombuffer(hashes.as_py(), np.uint64)
                if kind == 0:
                    leader, base = a, own
                    continue
                assert leader == a, "a partner's set must come before its members"
                if min(len(own), len(base)) < _least(max(len(own), len(base)), percent):
                    continue
                at = np.minimum(np.searchsorted(base, own), len(base) - 1)
                common = int((base[at] == own).sum())
                if 100 * common >= percent * (len(own) + len(base) - common):
                    out_b.append(b)
                    out_a.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_a, pa.int64())], names=["b", "a"])

    rows = members.unionByName(heads).repartition("a", "task").sortWithinPartitions("a", "task", "kind")
    return rows.select("a", "task", "b", "n", "hashes", "kind").mapInArrow(run, "b long, a long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row: texts link when 100 * intersection >= percent * union of their sets of
    `width`-word shingles; component_id is the smallest key reachable by links."""
    ship(df.sparkSession)
    steps = Steps(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    profile = steps.put("profile", _profile(docs, width))
    rows = profile.where(F.col("slice").isNull()).select("key", "n", "sid")
    slices = profile.where(F.col("slice").isNotNull()).select("slice", "counts")
    slices = steps.put("slices", _sum_slices(slices))
    while (n := slices.count()) > SLICES:
        slices = steps.put("slices", _sum_slices(slices.coalesce(-(-n // (SLICES * SUMMED)))))
    parts = {r["slice"]: r["counts"] for r in slices.collect()}  # SLICES rows, the sketch's fixed size in all
    if not parts:
        return rows.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    sketch = zlib.compress(b"".join(zlib.decompress(bytes(parts[i])) for i in range(SLICES)), 1)
    del parts

    lists = steps.put("lists", _shared(_prefixes(docs.select("text"), sketch, width, percent), percent))
    live = steps.put("live", _met_enough(lists, percent))
    lists = steps.put("lists", lists.join(live, ["sid", "n"], "left_semi").select("token", "sid", "n", "pos"))
    wanted = live.select("sid").join(rows.groupBy("sid").agg(F.min("key").alias("wanted")), "sid").select("wanted", "sid")
    whole = steps.put_bucketed("sets", _whole_sets(docs, steps.put("wanted", wanted), width), "sid")
    labelled, classes = lists.withColumn("class", F.col("sid")), None
    for round_ in [*range(LEADER_ROUNDS), None]:
        if classes is not None and labelled.isEmpty():
            break  # all sets that share a list are of one class
        if round_ is not None:
            pairs = _possible(_leaders(labelled, percent, round_), whole, percent)
            pairs = pairs.groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select("b", F.col("best.a").alias("a"))
        else:
            pairs = _possible(_all_pairs(labelled, whole, percent, steps), whole, percent).select("b", "a")
        pairs = steps.put("pairs", pairs)
        links = steps.put("links", _links(pairs, whole, percent))
        if classes is not None:
            links = links.union(classes.select(F.col("node").alias("b"), F.col("component").alias("a")))
        classes = steps.put("classes", members(links, "b", "a"))
        if round_ is not None:
            of = classes.withColumnRenamed("node", "sid").withColumnRenamed("component", "of")
            now = steps.put("placed", lists.join(of, "sid", "left").withColumn("class", F.coalesce("of", "sid")).drop("of"))
            several = now.groupBy("token").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("token")
            labelled = steps.put("labelled", now.join(several, "token", "left_semi"))
    steps.drop("slices", "live", "wanted", "many", "lists", "placed", "labelled", "pairs", "links", "sets")

    # The smallest key of each set's class; sets of more than a thousandth of the rows, below a thousand, are looked up by broadcast.
    own = rows.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"))
    placed = own.join(classes.withColumnRenamed("node", "sid"), "sid", "left").withColumn("class", F.coalesce("component", "sid"))
    of = placed.groupBy("class").agg(F.min("least").alias("first"))
    found = steps.put("found", placed.join(of, "class").select("sid", "first", "copies"))
    hot = F.broadcast(found.where(F.col("copies") * 1000 > rows.count()).select("sid", F.col("first").alias("hot_first"), F.lit(True).alias("hot")))
    marked = rows.join(hot, "sid", "left")
    cold = marked.where(F.col("hot").isNull() & F.col("sid").isNotNull()).join(found.select("sid", "first"), "sid")
    out = cold.select("key", "n", "first").unionByName(marked.where(F.col("hot")).select("key", "n", F.col("hot_first").alias("first")))
    out = out.unionByName(rows.where(F.col("sid").isNull()).select("key", "n", F.col("key").alias("first")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("first", "key").alias("component_id"))
