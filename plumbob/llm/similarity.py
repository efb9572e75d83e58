"""Set-similarity joins: signatures nominate sets, whole sets are compared.

Both joins of this package (PartEnum and MinHash) run the same plan:

1. every text becomes its set of n-gram hashes; texts with equal sets form one
   *class*, known by ``set_id`` and represented by its smallest ``doc_id``, so
   exact copies cost 16 bytes each and no more work;
2. a function gives each set its signatures; rows ``(signature, set)`` of 8
   bytes are shuffled in lists and sorted, and each set of a bucket is linked to
   the bucket's smallest member.  A bucket of m sets gives m rows, not m*m.  A task
   signs a set that it meets again only once.  With *sketches*, sets that by
   theirs can't be similar part again before any n-grams travel;
3. linked sets meet in *blocks*.  Blocks whose members are also in another
   block are moved to it, so that a cluster's sets travel about once.  A block
   of more than ``PART_SETS`` sets or ``PART_GRAMS`` n-grams is cut into parts,
   and each pair of parts meets in a task of its own;
4. in a block all pairs of fitting sizes are compared exactly.  A pair that
   meets in several blocks counts in the least of them only, so counts need no
   list of pairs: a task gives a row for each set.

Nothing is dropped on the way: no cap on buckets, blocks or partners.

Rows whose ``doc_id`` or text is null take no part; texts without words have an
empty set, which is similar to nothing.  Very long texts are whole sets like
others.  A repeated row counts once; a ``doc_id`` that comes with different
texts counts once with each of its sets.  Only ``doc_id`` and ``text`` are read,
so columns of any other name don't matter.  An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbob.llm.common import components, each_words, gram_set, key_text, mix, shared_dir, trim, tuned

#: (set) -> its signatures
Signer = Callable[[np.ndarray], np.ndarray]
#: Sets and n-grams of a part of a block; a task compares two parts at most.
PART_SETS, PART_GRAMS = 2000, 1_000_000
#: Bits of a sketch, at least and at most; blocks of more sets aren't parted.
SKETCH_BITS, SKETCHED_SETS = (64, 1 << 14), 256
#: Signatures of a part that a task sorts, about, and of a batch that is sent.
PART_SIGS, SENT_SIGS = 1_000_000, 1 << 19
#: Numbers of the matrix that tells which sets have the n-grams of many sets.
DENSE = 2_000_000
#: Up to so many documents the list of those to compare is sent to the tasks
#: that scan the texts (8 bytes each); beyond it a shuffled semi-join finds them.
SENT_IDS = 2_000_000


def set_id(grams: np.ndarray) -> int:
    """An order-free 64-bit identifier of a set."""
    return int(mix(np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def sketch(grams: np.ndarray) -> bytes:
    """For each low part of a hash whether a set has an odd number of such
    n-grams.  Sets that differ in d n-grams differ in d bits at most.  About a
    bit for each n-gram; a sketch folds to a shorter one by exclusive or."""
    bits = min(max(1 << (len(grams) - 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parted(sets: list[int], sizes: list[int], sketches: list[bytes], threshold: float) -> list[int]:
    """For each set the least one that sketches and sizes connect it with; any
    two that are similar are connected."""
    order = sorted(range(len(sets)), key=sizes.__getitem__)
    bits = [8 * len(sketches[i]) for i in order]
    value = [int.from_bytes(sketches[i], "little") for i in order]
    size = [sizes[i] for i in order]
    differ = (1 - threshold) / (1 + threshold)
    root = list(range(len(order)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(order)):
        for j in range(i + 1, len(order)):
            if size[j] * threshold > size[i] + 1e-6:
                break
            a, b = find(i), find(j)
            if a == b:
                continue
            v, w = value[j], bits[j]
            while w > bits[i]:
                w >>= 1
                v = (v ^ (v >> w)) & ((1 << w) - 1)
            if (v ^ value[i]).bit_count() <= (size[i] + size[j]) * differ + 1e-6:
                root[b] = a
    least: dict[int, int] = {}
    top = [find(i) for i in range(len(order))]
    for r, i in zip(top, order):
        least[r] = min(sets[i], least.get(r, sets[i]))
    out = [0] * len(sets)
    for r, i in zip(top, order):
        out[i] = least[r]
    return out


def _parts(threshold: float):
    """Rows ``(block, set_id, size, sketch)``, sorted by block, to the
    ``(block, set_id)`` of the parts of two sets or more; a block of more than
    ``SKETCHED_SETS`` stays as it is.  A block may go on over many batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, whole = None, ([], [], []), False
        out: tuple[list[int], list[int]] = ([], [])

        def close() -> None:
            if len(rows[0]) > 1 and not whole:
                to = parted(*rows, threshold)
                many: dict[int, int] = {}
                for t in to:
                    many[t] = many.get(t, 0) + 1
                for t, x in zip(to, rows[0]):
                    if many[t] > 1:
                        out[0].append(t)
                        out[1].append(x)

        for b in batches:
            keys = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            columns = [b.column(k).to_pylist() for k in (1, 2, 3)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if keys[i] != block:
                    close()
                    block, rows, whole = int(keys[i]), ([], [], []), False
                for held, column in zip(rows, columns):
                    held.extend(column[i:j])
                if len(rows[0]) > SKETCHED_SETS or whole:
                    whole = True
                    out[0].extend([block] * len(rows[0]))
                    out[1].extend(rows[0])
                    rows = ([], [], [])
            if len(out[0]) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["block", "set_id"])
                out = ([], [])
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["block", "set_id"])

    return run


def _sets(n: int, sketched: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, size, sketches = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int32), [None] * b.num_rows
            for r, words in each_words(b.column("text")):
                if len(words):
                    grams = gram_set(words, n)
                    sets[r], size[r] = set_id(grams), len(grams)
                    if sketched:
                        sketches[r] = sketch(grams)
            yield pa.RecordBatch.from_arrays([pa.array(sets, mask=size == 0), b.column("doc_id"), pa.array(size), pa.array(sketches, pa.binary())], ["set_id", "doc_id", "size", "sketch"])
        trim()

    return run


def membership(docs: DataFrame, n: int, sketched: bool = False) -> DataFrame:
    """``(set_id, doc_id, size, sketch)`` of the documents with an id, without
    repetition; ``set_id`` is null where there is no text or no word, and
    ``sketch`` there and where none is asked for."""
    texts = key_text(docs, True)
    return texts.mapInArrow(_sets(n, sketched), "set_id long, doc_id long, size int, sketch binary").dropDuplicates(["set_id", "doc_id"])


def classes(member: DataFrame) -> DataFrame:
    """``(set_id, rep, weight, size, sketch)``: a class's smallest id, number of
    documents, number of n-grams and sketch."""
    return member.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.max("size").alias("size"), F.first("sketch").alias("sketch"))


def _cut(sigs: np.ndarray, parts: int) -> np.ndarray:
    """The part that each signature falls in, by its upper half."""
    return (sigs >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def _signatures(n: int, sign: Signer, parts: int):
    """Texts to rows ``(part, rows)``: of each signature its lower half and that
    of its set's id, 8 bytes together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()  # this task's; the same set of another task only repeats rows
        sigs, owners, held = [], [], 0

        def rows() -> pa.RecordBatch:
            s = np.concatenate(sigs)
            packed = s << np.uint64(32) | np.repeat(np.array(owners, np.int64).view(np.uint64), [len(x) for x in sigs]) & np.uint64(0xFFFFFFFF)
            part = _cut(s, parts)
            order = np.argsort(part, kind="stable")
            part, packed = part[order], packed[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            data = [packed[i:j].tobytes() for i, j in zip(first, [*first[1:], len(part)])]
            sigs.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(data, pa.binary())], ["part", "rows"])

        for b in batches:
            for _, words in each_words(b.column("text")):
                if not len(words):
                    continue
                grams = gram_set(words, n)
                own = set_id(grams)
                if own in signed:
                    continue
                signed.add(own)
                s = sign(grams)
                if len(s):
                    sigs.append(s)
                    owners.append(own)
                    held += len(s)
                if held > SENT_SIGS:
                    yield rows()
                    held = 0
        if held:
            yield rows()
        trim()

    return run


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(part, rows)`` of whole parts to sorted ``(sig, set_id)``, both of 32
    bits."""
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(part, []).append(data)
    for part in sorted(held):
        rows = np.frombuffer(b"".join(held.pop(part)), np.uint64).copy()
        rows.sort()
        sigs = (rows >> np.uint64(32)).astype(np.int64) | part << 32  # apart from other parts' ones
        for i in range(0, len(rows), PART_SIGS):
            yield pa.RecordBatch.from_arrays([pa.array(sigs[i : i + PART_SIGS]), pa.array((rows[i : i + PART_SIGS] & np.uint64(0xFFFFFFFF)).astype(np.int64))], ["sig", "set_id"])
    trim()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(sig, set_id)`` rows to ``(block, set_id)``: the block is the
    smallest set of the bucket.  A bucket may go on over many batches."""
    sig = low = None  # the bucket that is open: its signature and first set
    for b in batches:
        if not b.num_rows:
            continue
        s, x = b.column(0).to_numpy(), b.column(1).to_numpy()
        new = np.empty(len(s), bool)
        new[0] = sig is None or s[0] != sig
        np.not_equal(s[1:], s[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        if not new[0]:
            starts = np.concatenate([[0], starts])
        lengths = np.diff(np.append(starts, len(s)))
        firsts = x[starts]
        if not new[0]:
            firsts[0] = low
        head = np.repeat(firsts, lengths)
        other = x != head
        used = np.unique(np.concatenate([head[other]])) if other.any() else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate([head[other], used]), np.concatenate([x[other], used])]), axis=1)
        sig, low = s[-1], firsts[-1]
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["block", "set_id"])


def blocks(docs: DataFrame, known: DataFrame, n: int, threshold: float, sign: Signer, sketched: bool) -> DataFrame:
    """``(block, set_id)``: any two sets that share a signature share a block,
    unless their sketches tell that they aren't similar.

    A signature and its set take 8 bytes: of the 64 bits of either the upper
    ones of the signature tell the part that it is sent to, and 32 of each are
    sent.  Sets that agree in 32 bits stand for each other until they are joined
    with ``known`` again, so that both are nominated; like signatures that agree
    by chance, they are compared and found different.
    """
    some = known.agg(F.sum("weight").alias("docs"), F.sum(F.col("weight") * F.col("size")).alias("grams")).first()
    mean = max(1, -(-(some.grams or 0) // max(1, some.docs or 0)))
    parts = max(1, -(-(some.docs or 0) * len(sign(mix(np.arange(1, mean + 1, dtype=np.uint64)))) // PART_SIGS))
    rows = key_text(docs).mapInArrow(_signatures(n, sign, parts), "part int, rows binary")
    short = known.withColumn("short", F.col("set_id").bitwiseAND(F.lit(0xFFFFFFFF)))
    links = rows.repartitionById(parts, F.col("part")).mapInArrow(lambda batches: _links(_sorted_rows(batches)), "block long, set_id long").distinct()
    links = links.withColumnRenamed("set_id", "short").join(short, "short")
    if sketched:
        rows = links.select("block", "set_id", "size", "sketch")
        links = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_parts(threshold), "block long, set_id long").distinct()
    # written once, as it is read three times: it is far smaller than the signatures
    links = links.select("block", "set_id").checkpoint()
    # Move each block to the least block that one of its members is also in.
    least = links.groupBy("set_id").agg(F.min("block").alias("m"))
    to = links.join(least, "set_id").groupBy("block").agg(F.min("m").alias("to"))
    return links.join(to, "block").select(F.col("to").alias("block"), "set_id").distinct()


def _grams(n: int, wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if wanted is not None:
                keys = b.column("doc_id").to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(wanted, keys), max(len(wanted) - 1, 0))
                b = b.filter(pa.array(wanted[at] == keys)) if len(wanted) else b.slice(0, 0)
            ids, sets, data = [], [], []
            keys = b.column("doc_id").to_numpy(zero_copy_only=False)
            for r, words in each_words(b.column("text")):
                if len(words):
                    grams = gram_set(words, n)
                    ids.append(keys[r])
                    sets.append(set_id(grams))
                    data.append(grams.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "set_id", "grams"])
        trim()

    return run


def compare(grams: list[np.ndarray], threshold: float, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of sets of a Jaccard similarity of ``threshold`` at least:
    positions and similarity.  Exact.  With ``left``, a mask, only pairs of one
    set in it and one outside.

    N-grams of one set only can't be shared and are left out; those of many
    sets, of which near copies consist, are counted by a product of matrices,
    the others by lists of the sets that have them.
    """
    size = np.array([len(g) for g in grams], np.int64)
    order = np.argsort(size, kind="stable")
    rows = order if left is None else order[left[order]]
    cols = order if left is None else order[~left[order]]
    none = np.zeros(0, np.int64)
    if not len(rows) or not len(cols):
        return none, none, np.zeros(0)
    _, feature, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(grams)), size)
    often = np.flatnonzero(count > max(8, len(grams) // 64))
    often = often[np.argsort(-count[often], kind="stable")][: DENSE // len(grams)]  # most sets first, as many as memory allows
    place = np.full(len(count), -1, np.int32)
    place[often] = np.arange(len(often))
    at = place[feature]
    dense = np.zeros((len(grams), len(often)), np.float32)
    dense[owner[at >= 0], at[at >= 0]] = 1
    rare = (at < 0) & (count[feature] > 1)
    feature, owner = feature[rare], owner[rare]
    begin_of = np.searchsorted(owner, np.arange(len(grams) + 1))
    wide = size[cols]
    position = np.full(len(grams), -1, np.int64)
    position[cols] = np.arange(len(cols))
    post = position[owner]
    by_feature = np.argsort(np.where(post >= 0, feature, len(count)), kind="stable")[: int((post >= 0).sum())]
    listed, post = feature[by_feature], post[by_feature]  # which columns have an n-gram
    across = np.ascontiguousarray(dense[cols].T)
    a, b, j = [], [], []
    for k, r in enumerate(rows):
        if k % 256 == 0:
            product = dense[rows[k : k + 256]] @ across
        begin = k + 1 if left is None else int(np.searchsorted(wide, size[r] * threshold - 1e-9))
        end = int(np.searchsorted(wide, size[r] / threshold + 1e-9, side="right"))
        if end <= begin:
            continue
        shared = product[k % 256, begin:end].astype(np.int64)
        own = feature[begin_of[r] : begin_of[r + 1]]
        if len(own):
            low, high = np.searchsorted(listed, own), np.searchsorted(listed, own, side="right")
            many = high - low
            held = post[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())]
            shared += np.bincount(held, minlength=len(cols))[begin:end]
        sim = shared / (size[r] + wide[begin:end] - shared)
        hit = np.flatnonzero(sim >= threshold)
        if len(hit):
            a.append(np.full(len(hit), r))
            b.append(cols[begin + hit])
            j.append(sim[hit])
    if not a:
        return none, none, np.zeros(0)
    return np.concatenate(a), np.concatenate(b), np.concatenate(j)


def _forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each one of ``count`` is connected with."""
    root = np.arange(count)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _found(group: pa.Table, threshold: float):
    """Of a block, or of a pair of its parts: set ids, representatives, weights,
    and the similar pairs by position with which of them are this block's to
    count."""
    sets, first = np.unique(group.column("set_id").to_numpy(), return_index=True)
    group = group.take(pa.array(first))
    reps, weights = group.column("rep").to_numpy(), group.column("weight").to_numpy()
    grams = [np.frombuffer(d, np.uint64) for d in group.column("grams").to_pylist()]
    part = group.column("part").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    none = np.zeros(0, np.int64)
    if len(sets) < 2:
        return sets, reps, weights, none, none, np.zeros(0), np.zeros(0, bool)
    a, b, sim = compare(grams, threshold, None if i == j else part == i)
    block, several = group.column("block")[0].as_py(), group.column("blocks").to_pylist()
    many = np.array([len(x) > 1 for x in several])
    own = np.ones(len(a), bool)
    held = {}
    for k in np.flatnonzero(many[a] & many[b]).tolist():  # else this block is all that they share
        x, y = (held.get(p) or held.setdefault(p, frozenset(several[p])) for p in (int(a[k]), int(b[k])))
        own[k] = min(x & y) == block
    return sets, reps, weights, a, b, sim, own


def _counted(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        sets, reps, weights, a, b, _, own = _found(group, threshold)
        links = np.zeros(len(sets), np.int64)
        np.add.at(links, a[own], weights[b[own]])
        np.add.at(links, b[own], weights[a[own]])
        root = _forest(len(sets), a, b)
        if len(group) > 500:
            trim()
        keep = np.flatnonzero((links > 0) | (root != np.arange(len(sets))))
        # of the tree's edges both ends are sets, whose order is that of positions
        return pa.table({"set_id": pa.array(sets[keep]), "rep": pa.array(reps[keep]), "links": pa.array(links[keep]), "to": pa.array(reps[root[keep]])})

    return run


def _paired(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        sets, reps, _, a, b, sim, own = _found(group, threshold)
        a, b, sim = a[own], b[own], sim[own]
        swap = reps[a] > reps[b]
        x, y = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table({"set_a": pa.array(sets[x], pa.int64()), "set_b": pa.array(sets[y], pa.int64()), "a": pa.array(reps[x], pa.int64()), "b": pa.array(reps[y], pa.int64()), "jaccard": pa.array(sim, pa.float64())})

    return run


def _met(docs: DataFrame, known: DataFrame, n: int, threshold: float, sign: Signer, sketched: bool) -> DataFrame:
    """A row for each set of each block, or of each pair of parts of a block:
    ``(block, i, j, part, blocks, set_id, rep, weight, grams)``."""
    spark = tuned(docs.sparkSession)
    shared_dir(spark)
    place = blocks(docs, known, n, threshold, sign, sketched).checkpoint()
    several = place.groupBy("set_id").agg(F.collect_list("block").alias("blocks"))
    rows = place.join(several, "set_id").join(known.drop("sketch"), "set_id")
    parts = F.greatest(F.ceil(F.count("*") / F.lit(PART_SETS)), F.ceil(F.sum("size") / F.lit(PART_GRAMS))).cast("int").alias("cut")
    rows = rows.join(rows.groupBy("block").agg(parts).where("cut > 1"), "block", "left")
    parts = F.coalesce("cut", F.lit(1))
    rows = rows.select("block", "set_id", "rep", "weight", "blocks", parts.alias("parts"), F.pmod(F.xxhash64("set_id"), parts.cast("long")).cast("int").alias("part"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j"))))
    member = rows.withColumn("m", meets).select("block", "m.i", "m.j", "part", "blocks", "set_id", "rep", "weight").checkpoint()
    ids = member.select("rep").distinct()
    texts = key_text(docs)
    if ids.count() <= SENT_IDS:
        wanted = np.sort(ids.toPandas()["rep"].to_numpy(np.int64))
    else:
        wanted, texts = None, texts.join(ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(_grams(n, wanted), "rep long, set_id long, grams binary")
    return member.join(sets, ["rep", "set_id"]).select("block", "i", "j", "part", "blocks", "set_id", "rep", "weight", "grams")


def similar_classes(docs: DataFrame, n: int, threshold: float, sign: Signer, sketched: bool = False) -> tuple[DataFrame, DataFrame]:
    """The join as pairs between classes, and what belongs to them:
    ``(set_a, set_b, a, b, jaccard)`` with the representatives a < b, and
    ``(set_id, doc_id, size)``.  Documents of one class have equal sets."""
    shared_dir(docs.sparkSession)
    member = membership(docs, n, sketched).checkpoint()
    known = classes(member).checkpoint()
    found = _met(docs, known, n, threshold, sign, sketched).groupBy("block", "i", "j").applyInArrow(_paired(threshold), "set_a long, set_b long, a long, b long, jaccard double")
    return found, member.drop("sketch")


def linked(docs: DataFrame, n: int, threshold: float, sign: Signer, sketched: bool = False) -> DataFrame:
    """``(doc_id, class_id, links)``: a row for each document.

    ``links`` counts the other documents of a Jaccard similarity of at least
    ``threshold``, those of an equal set included.  ``class_id`` is the
    smallest id of the documents that links connect with this one; a document
    without links is its own class.  A document without words has no links.
    """
    shared_dir(docs.sparkSession)
    member = membership(docs, n, sketched).checkpoint()
    known = classes(member).checkpoint()
    found = _met(docs, known, n, threshold, sign, sketched).groupBy("block", "i", "j").applyInArrow(_counted(threshold), "set_id long, rep long, links long, to long").checkpoint()
    tree = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    result = known.join(counts, "set_id", "left").join(tree, known.rep == tree.node, "left")
    result = result.where("links IS NOT NULL OR weight > 1").select("set_id", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    some = member.where("set_id IS NOT NULL").join(result, "set_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    return some.union(member.where("set_id IS NULL").select("doc_id", "doc_id", F.lit(0).cast("long")))  # apart, as nulls would meet in one task


def copies(docs: DataFrame, n: int, threshold: float, sign: Signer, sketched: bool = False) -> DataFrame:
    """``doc_id`` of each document but the one with the smallest id of its
    class (see ``linked``)."""
    return linked(docs, n, threshold, sign, sketched).groupBy("doc_id").agg(F.min("class_id").alias("root")).where("doc_id <> root").select("doc_id")


def oracle(grams: str, threshold: float) -> str:
    """DuckDB SQL for the rows of ``linked``; ``grams`` makes the sorted list of
    n-grams of the words ``ws``."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+'), []) AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, {grams} AS gs FROM w),
g AS (SELECT gs, min(doc_id) AS rep, count(*) AS weight, len(gs) AS n FROM s WHERE len(gs) > 0 GROUP BY gs),
f AS (SELECT rep, n, weight, unnest(gs) AS x FROM g),
i AS (SELECT a.rep AS ra, b.rep AS rb, a.n + b.n - count(*) AS u, count(*) AS c, any_value(b.weight) AS weight FROM f a JOIN f b ON a.x = b.x AND a.rep <> b.rep AND least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) - 0.000001 GROUP BY a.rep, b.rep, a.n, b.n),
p AS (SELECT ra, rb, weight FROM i WHERE CAST(c AS DOUBLE) / CAST(u AS DOUBLE) >= {threshold}),
r AS (SELECT rep AS x, rep AS y FROM g UNION SELECT r.x, p.rb FROM r JOIN p ON r.y = p.ra),
root AS (SELECT x, min(y) AS root FROM r GROUP BY x),
near AS (SELECT ra, sum(weight) AS near FROM p GROUP BY ra)
SELECT s.doc_id, root.root AS class_id, CAST(g.weight - 1 + coalesce(near.near, 0) AS BIGINT) AS links FROM s JOIN g ON s.gs = g.gs JOIN root ON root.x = g.rep LEFT JOIN near ON near.ra = g.rep
UNION ALL
SELECT doc_id, doc_id, CAST(0 AS BIGINT) FROM s WHERE len(gs) = 0
"""
