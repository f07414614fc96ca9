"""Near-duplicate detection with Order MinHash.

A text is the sequence of its lower-cased words (runs of ASCII letters and digits and of non-ASCII
characters). Its k-mers are runs of five words, labelled by how often they occurred before. Each of
`sketches` random orders picks the `picks` least labelled k-mers and keeps them in the order of the
text; texts that agree in one such tuple become candidates. Two texts are linked if a banded alignment of their words
finds an edit similarity, 1 - distance / longer length, of 0.8 or more; nothing else decides. So a text whose parts were moved about is
no copy. Before an alignment, the q-gram lemma leaves out pairs that cannot reach it: texts of n words at most with e edits share n - 1 - 2 e of
their labelled pairs of neighbouring words and n - e of their labelled words, and their lengths differ by e at most. Classes are the connected components of the links.

Hot groups. Texts with equal words are one node from the first aggregation on. Buckets are never
expanded into pairs: a round compares every member with one leader of its bucket, which then
leaves it; components are found, and buckets that lie within one component are done. After `rounds` rounds, the members outside
a bucket's largest component are compared with all others of the bucket whose length allows it, in pairs of blocks of bounded
size, inside tasks that return one link for each merge. No bucket has a cap, no pair of different
components in a bucket is left out. Rows of one bucket, leader or class are dealt over many tasks wherever they are joined, and a leader's
words go once to each of its parts. Words of texts that share no bucket are not shuffled.

Defined cases: a null or empty text is a class of its own row's doc_id; a text without words is a
copy of equal texts only; texts shorter than five words have one k-mer; very long texts are read whole; of equal ids and texts that tie for a class's
first place any may stay, they are equal; repeated rows come back as
often as they stand in the input; a class whose ids are all null has a null class id; an empty
table gives an empty result; other columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, PARTS, as_text, attached, beside, components, discard, labelled, mix, shingle_hashes, slices, stored, text_bytes, tidy, word_hashes

K, SIMILARITY, SKETCHES, PICKS, ROUNDS = 5, 0.8, 40, 2, 2
#: Texts, and words of texts, in one side of a pair of blocks.
BLOCK, BLOCK_WORDS = 1024, 2_000_000
#: Bits, in cells of 64 that every executor gets, that tell texts in shared buckets from the others.
MOST_BITS = 1 << 26


def sketch(labels: np.ndarray, kmers: np.ndarray, odd: np.ndarray, picks: int) -> np.ndarray:
    """One hash per random order: the `picks` least labelled k-mers, in the order of the text."""
    take = min(picks, len(labels))
    out = np.empty(len(odd), np.uint64)
    step = max(1, (1 << 18) // len(labels))
    for i in range(0, len(odd), step):
        ranks = labels[None, :] * odd[i : i + step, None]
        rows, least = np.arange(len(ranks)), np.empty((len(ranks), take), np.int64)
        for j in range(take):
            least[:, j] = ranks.argmin(axis=1)
            ranks[rows, least[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least.sort(axis=1)
        key = np.full(len(ranks), take, np.uint64)
        for j in range(take):
            key = mix(key * np.uint64(3) + kmers[least[:, j]])
        # the order's number is in the hash, so that a bucket is named by it alone
        out[i : i + step] = mix(key + np.arange(i, i + len(ranks), dtype=np.uint64))
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits between two sequences, or most + 1 if there are more, by alignment in the band of diagonals that `most` edits can reach.

    A few edits are found by the furthest points on the diagonals, whose work grows with the square of the edits. Beyond, the band goes down column by
    column as bits of one number.
    """
    shorter = min(len(a), len(b))
    differ = np.flatnonzero(a[:shorter] != b[:shorter])
    head = int(differ[0]) if len(differ) else shorter
    differ = np.flatnonzero(a[head:][::-1][: shorter - head] != b[head:][::-1][: shorter - head])
    tail = int(differ[0]) if len(differ) else shorter - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not m:
        return min(n, most + 1)
    few = min(most, 2 + int(0.6 * m**0.5))
    found = furthest(a, b, few)
    return found if found <= few or few == most else banded(a.tolist(), b.tolist(), most)


def furthest(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """edit_distance by the furthest point on every diagonal for each number of edits."""
    n, m = len(a), len(b)
    x, y, goal = a.tolist(), b.tolist(), m - n

    def run(i: int, j: int) -> int:
        stop = min(n, m - (j - i))
        for _ in range(12):
            if i >= stop or x[i] != y[j]:
                return i
            i, j = i + 1, j + 1
        width = 32
        while i < stop:
            width = min(width, stop - i)
            off = np.flatnonzero(a[i : i + width] != b[j : j + width])
            if len(off):
                return i + int(off[0])
            i, j, width = i + width, j + width, width * 2
        return i

    reach = {0: run(0, 0)}
    if goal == 0 and reach[0] == n:
        return 0
    for e in range(1, most + 1):
        now = {}
        for d in range(-min(e, n), min(e, m) + 1):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -1), reach.get(d + 1, -2) + 1)
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            now[d] = i = run(i, i + d)
            if d == goal and i == n:
                return e
        reach = now
    return most + 1


def banded(a: list, b: list, most: int) -> int:
    """edit_distance of a and a b that is no longer, by bit vectors of the differences in a column.

    In column j, bit k stands for row j + k - most: the window of 2 * most + 1 rows moves down by one with each column.
    """
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    spots: dict = {}
    for i, x in enumerate(a):
        spots.setdefault(x, []).append(i)
    # where a symbol stands: all rows as one number if there are many, else the rows
    many = {x: sum(1 << i for i in own) for x, own in spots.items() if len(own) > 48}
    mask = (1 << (2 * most + 1)) - 1
    up, down, now = ((1 << (most + 1)) - 1) << most, 0, 0
    for j, x in enumerate(b):
        first = j - most
        if x in many:
            same = (many[x] >> first if first >= 0 else many[x] << -first) & mask
        else:
            same = 0
            for i in spots.get(x, ()):
                if 0 <= i - first <= 2 * most:
                    same |= 1 << (i - first)
        diagonal = ((((same & up) + up) ^ up) | same | down) & mask
        right, left = down | (~(diagonal | up) & mask), diagonal & up
        now += not diagonal >> most & 1
        diagonal >>= 1
        up, down = (left | ~(diagonal | right)) & mask, diagonal & right
    below = (1 << (n - m)) - 1
    now += (up >> most & below).bit_count() - (down >> most & below).bit_count()
    return min(now, most + 1)


#: Words of a text whose masks are kept for many alignments.
MASKED = 4096


def masks_of(words: list) -> dict:
    """Where each symbol stands, as bits of one number."""
    masks: dict = {}
    for i, x in enumerate(words):
        masks[x] = masks.get(x, 0) | 1 << i
    return masks


def within(masks: dict, n: int, b: list, most: int) -> bool:
    """Whether a sequence of n symbols, given by its masks, is `most` edits or fewer from b, by bit vectors of the differences in whole columns."""
    if not n:
        return len(b) <= most
    full, last = (1 << n) - 1, 1 << n - 1
    up, down, now, left = full, 0, n, len(b)
    for x in b:
        same = masks.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, fall = down | (full & ~(diagonal | up)), diagonal & up
        left -= 1
        if right & last:
            now += 1
        elif fall & last:
            now -= 1
        # a column takes one edit away at most
        if now - left > most:
            return False
        right = right << 1 | 1
        up, down = (fall << 1 | ~(diagonal | right)) & full, diagonal & right & full
    return now <= most


#: Words in the runs that the lemma counts.
PAIR = 2


def edits_of(longer: np.ndarray, least: float):
    """Edits that a pair may have."""
    return ((1 - least) * longer + 1e-9).astype(np.int64)


def possible(n: int, m: np.ndarray, shared: np.ndarray, least: float) -> np.ndarray:
    """Which texts of m words may be linked to one of n words with which they share so many labelled pairs of words."""
    longer = np.maximum(n, m)
    most = edits_of(longer, least)
    return (longer - np.minimum(n, m) <= most) & (shared >= longer + 1 - PAIR - PAIR * most)


def two_diagonals(a: np.ndarray, b: np.ndarray) -> int:
    """Edits of the best alignment along the first diagonal up to a place and the last one from there: never fewer than the distance."""
    n, gap = min(len(a), len(b)), abs(len(a) - len(b))
    begins, ends = a[:n] != b[:n], a[len(a) - n :] != b[len(b) - n :]
    upto = np.concatenate(([0], np.cumsum(begins)))
    after = np.concatenate((np.cumsum(ends[::-1])[::-1], [0]))
    return int((upto + after).min()) + gap


def linked(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """The definition of a link, on words. One gap and substitutions are seen at once; other pairs are aligned in the whole band."""
    most = int(edits_of(np.array(max(len(a), len(b))), least))
    return two_diagonals(a, b) <= most or edit_distance(a, b, most) <= most


def _fingerprints(k: int, sketches: int, picks: int, odd: np.ndarray):
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.binary()), ("words", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            whole = as_text(batch.column(1))
            for start, stop in slices(whole):
                texts = whole.slice(start, stop - start)
                raw, offsets = text_bytes(texts)
                words, at = word_hashes(texts)
                node, kept, keys = [], [], []
                for i in range(len(texts)):
                    own = words[at[i] : at[i + 1]]
                    if len(own):
                        node.append(blake2b(own.tobytes(), digest_size=16).digest())
                        kmers = shingle_hashes(own, k)
                        keys.append(sketch(labelled(kmers), kmers, odd, picks).view(np.int64))
                    else:
                        bare = raw[offsets[i] : offsets[i + 1]].tobytes()
                        node.append(blake2b(bare, digest_size=16, key=b"bare").digest() if bare else None)
                        keys.append(None)
                    kept.append((own >> np.uint64(32)).astype(np.uint32).tobytes())
                rows = pa.array(np.arange(uid, uid + stop - start))
                uid += stop - start
                yield pa.record_batch([rows, batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start), pa.array(node, pa.binary()), pa.array(kept, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return run


def _words(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Words, and their labelled pairs in order."""
    words = np.frombuffer(packed, np.uint32)
    return words, pairs_of(words)


def sorted_labels(hashes: np.ndarray) -> np.ndarray:
    """labelled() in order of the numbers."""
    out = np.sort(hashes)
    again = out[1:] == out[:-1]
    if again.any():
        at = np.arange(len(out))
        new = np.concatenate(([True], ~again))
        occurrence = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        out = np.sort(np.where(occurrence > 0, mix(out + occurrence * np.uint64(GOLDEN)), out))
    return out


def pairs_of(words: np.ndarray) -> np.ndarray:
    """A text's labelled pairs of neighbouring words, in order."""
    return sorted_labels(shingle_hashes(mix(words.astype(np.uint64)), PAIR))


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether labelled words, in order, of two texts allow a link: all but the edits of the longer stand in the other."""
    longer = max(len(a), len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) >= longer - int(edits_of(np.array(longer), least))


def _verify(least: float):
    """Rows (a, part, member, root, words) in order, a leader before its members: links between their roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = root = own = pairs = None
        for batch in batches:
            found = []
            for a, part, member, r, packed in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                words = np.frombuffer(packed, np.uint32)
                if not member:
                    leader, root, own, pairs = (a, part), r, words, None
                elif leader == (a, part):
                    if two_diagonals(own, words) > edits_of(np.array(max(len(own), len(words))), least):
                        pairs = pairs_of(own) if pairs is None else pairs
                        shared = len(np.intersect1d(pairs, pairs_of(words), assume_unique=True))
                        if not possible(len(own), np.array(len(words)), np.array(shared), least) or not alike(*(sorted_labels(w.astype(np.uint64)) for w in (own, words)), least) or not linked(own, words, least):
                            continue
                    found.append((root, r))
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["ra", "rb"])

    return run


class _Holders:
    """Labels of many texts, each with the texts that have it: tells at once how many labels a text shares with each of them."""

    def __init__(self, labels: list[np.ndarray]):
        flat = np.concatenate(labels)
        order = np.argsort(flat, kind="stable")
        self.texts = len(labels)
        self.holder = np.repeat(np.arange(self.texts), [len(x) for x in labels])[order]
        self.labels, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat))

    def shared(self, own: np.ndarray) -> np.ndarray:
        out = np.zeros(self.texts, np.int64)
        if not len(self.labels):
            return out
        at = np.searchsorted(self.labels, own)
        at[at == len(self.labels)] = 0
        at = at[self.labels[at] == own]
        many = self.starts[at + 1] - self.starts[at]
        # a bounded number of places at a time
        for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(many) >> 20)) + 1):
            n = many[cut]
            spots = np.repeat(self.starts[at[cut]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out += np.bincount(self.holder[spots], minlength=self.texts)
        return out


def _blocks(least: float):
    """Links between members of different components in one pair of blocks, one for each merge."""

    def run(table: pa.Table) -> pa.Table:
        side, root, packed = (table.column(c).to_pylist() for c in ("side", "root", "words"))
        found: list[tuple[int, int]] = []
        # of a bucket that is one block, members outside the largest component are on both sides
        left, right = ([i for i, s in enumerate(side) if s in w] for w in ((0, 2), (1, 2)))
        if left and right:  # a block may be empty, as texts are dealt by hash
            parent = {r: r for r in root}

            def top(r):
                while parent[r] != r:
                    parent[r] = r = parent[parent[r]]
                return r

            texts = [_words(p) for p in packed]
            sizes = np.array([len(texts[j][0]) for j in right])
            pairs, bags = _Holders([texts[j][1] for j in right]), None
            for i in left:
                words, own = texts[i]
                near = possible(len(words), sizes, both := pairs.shared(own), least)
                if not near.any():
                    continue
                bags = bags or _Holders([sorted_labels(texts[j][0].astype(np.uint64)) for j in right])
                longer = np.maximum(len(words), sizes)
                most = edits_of(longer, least)
                near = np.flatnonzero(near & (bags.shared(sorted_labels(words.astype(np.uint64))) >= longer - most))
                masks = None
                for n in near[np.argsort(-both[near], kind="stable")]:
                    j = right[n]
                    if top(root[i]) != top(root[j]):
                        if len(words) <= MASKED:
                            masks = masks or masks_of(words.tolist())
                            link = within(masks, len(words), texts[j][0].tolist(), int(most[n]))
                        else:
                            link = linked(words, texts[j][0], least)
                        if link:
                            parent[top(root[i])] = top(root[j])
                            found.append((root[i], root[j]))
        return pa.table({"ra": pa.array([a for a, _ in found], pa.int64()), "rb": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and class_size (rows of the class), a row per input row. Options: see classes()."""
    return classes(docs, **options).select("doc_id", "class_id", "class_size")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, similarity: float = SIMILARITY, sketches: int = SKETCHES, picks: int = PICKS, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """near_duplicates() with text_key (xxhash64 of the text) and kept_key: the row of a class that stays has its class_id and kept_key."""
    odd = np.random.default_rng(20190724).integers(0, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    prints = stored(docs.mapInArrow(tidy(_fingerprints(k, sketches, picks, odd)), "uid long, doc_id long, text_key long, node binary, words binary, keys array<bigint>"), "omh-prints")
    # texts with equal words are one node, named by the uid of one of them
    first = (F.min, "uid")
    worded = prints.where("node is not null")
    sized = worded.select("uid", "node", "keys", (F.octet_length("words") / 4).cast("int").alias("length"))
    ids = stored(beside(sized, ["node"], "uid", rep=first).select("uid", "rep", "length", F.when(F.col("uid") == F.col("rep"), F.col("keys")).alias("keys")), "omh-nodes")
    rows = ids.where("keys is not null").select(F.col("rep").alias("node"), "length", F.explode("keys").alias("bucket"))
    # most buckets have one text; adaptive execution splits the rows of a large one in this join
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    rows = stored(rows.join(shared, "bucket").select("bucket", "node", "length", F.col("node").alias("root")), "omh-buckets")
    nodes = stored(rows.select("node").distinct().withColumn("root", F.col("node")), "omh-roots")
    words = stored(_words_of(prints, nodes), "omh-words")
    # the rest needs neither texts nor sketches
    names = stored(ids.select("uid", "rep"), "omh-names")
    owners = stored(prints.select("uid", "doc_id", "text_key"), "omh-owners")
    discard(prints, ids)

    for r in range(rounds + 1):
        # a bucket within one component is done, and so is a leader that all others of its bucket were compared with
        chance = F.struct(F.xxhash64("node", F.lit(r)).alias("chance"), "node", "root", "length")
        mixed = stored(beside(rows, ["bucket"], "node", least=(F.min, "root"), most=(F.max, "root"), leader=(F.min, chance)).where("least <> most"), f"omh-mixed{r}")
        used = [mixed]
        if r < rounds:
            longer, shorter = F.greatest("length", "leader.length"), F.least("length", "leader.length")
            pairs = mixed.where((F.col("root") != F.col("leader.root")) & (longer - shorter <= (1 - similarity) * longer + 1e-9)).select(F.col("leader.node").alias("a"), F.col("node").alias("b"), F.col("leader.root").alias("ra"), F.col("root").alias("rb")).distinct()
            pairs = stored(pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int")), f"omh-pairs{r}")
            used.append(pairs)
            # each part of a leader's members gets its words once
            leaders = pairs.select("a", "part", F.col("ra").alias("root")).distinct().join(words.withColumnRenamed("node", "a"), "a")
            members = pairs.select("a", "part", F.col("rb").alias("root"), "b").join(words.withColumnRenamed("node", "b"), "b")
            both = leaders.select("a", "part", F.lit(0).alias("member"), "root", "words").unionAll(members.select("a", "part", F.lit(1).alias("member"), "root", "words"))
            links = both.repartition("a", "part").sortWithinPartitions("a", "part", "member").mapInArrow(tidy(_verify(similarity)), "ra long, rb long")
        else:
            links = _rest(mixed.select("bucket", "node", "root", "length"), words, similarity, block)
        # links are between roots, so each round's graph is that of the round before with its components shrunk to points
        found = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")), f"omh{r}")
        tops = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        old = [nodes, rows]
        nodes = stored(_renamed(nodes, tops), f"omh-roots{r}")
        if r < rounds:
            rows = stored(_renamed(mixed.where("node <> leader.node").select("bucket", "node", "length", "root"), tops), f"omh-rows{r}")
            discard(old[1])
        discard(old[0], found, *used)
    discard(words, rows)

    roots = nodes.select(F.col("node").alias("rep"), "root")
    grouped = names.join(roots, "rep", "left").select("uid", F.coalesce("root", "rep").alias("root"))
    whole = owners.join(grouped, "uid", "left")
    whole = whole.withColumn("root", F.coalesce("root", F.col("uid")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("class_id"), F.col("text_key").alias("kept_key"))
    found = beside(whole, ["root"], "uid", first=(F.min, order), class_size=(F.count, F.lit(1), F.sum))
    return found.select("doc_id", "text_key", "first.class_id", "first.kept_key", "class_size")


def _words_of(prints: DataFrame, nodes: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """node and words of all nodes, and of a few other texts whose hash falls on a marked bit. No text is shuffled.

    There are 16 to 32 bits for each node and `most_bits` in all: beyond that, more of the other texts stay, and no node is lost.
    """
    bits = min(1 << (16 * nodes.count()).bit_length(), most_bits)
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    cell = lambda c: F.shiftright(bit(c), 6)
    place = lambda c: (bit(c) % 64).cast("int")
    marked = nodes.groupBy(cell("node").alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place("node"))).alias("marks"))
    met = prints.select(F.col("uid").alias("node"), "words", cell("uid").alias("cell")).join(F.broadcast(marked), "cell")
    return met.where(F.getbit("marks", place("node")) == 1).select("node", "words")


def _renamed(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows with the tops of their roots; a root's rows are in many tasks."""
    part = F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int")
    dealt = rows.withColumn("part", part)
    met = dealt.select("root", "part").distinct().join(tops, "root")
    return dealt.join(met, ["root", "part"], "left").select(*(c for c in rows.columns if c != "root"), F.coalesce("top", "root").alias("root"))


def _rest(rows: DataFrame, words: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links between members outside their bucket's largest component and all others of the bucket, found in pairs of blocks.

    Members are also dealt by length: classes of lengths grow by 1 / similarity, so that a text can be linked only within its own and the two beside it.
    """
    rows = rows.withColumn("size", F.floor(F.log(1 / similarity, F.greatest(F.col("length"), F.lit(1)) + 1e-9)).cast("int"))
    counts = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("length").alias("w"))
    main = counts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), ((F.sum("n") <= block) & (F.sum("w") <= BLOCK_WORDS)).alias("small"))
    rows = attached(rows, ["bucket"], "node", main)
    whole = rows.where("small").select("bucket", F.lit(0).alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("root") == F.col("main"), 1).otherwise(2).alias("side"), "root", "node")
    rows = rows.where("not small")
    key = ["bucket", "band"]
    left = rows.where("root <> main").withColumn("band", F.col("size"))
    right = rows.withColumn("band", F.explode(F.array(*(F.col("size") + i for i in (-1, 0, 1)))))
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.greatest(F.count("*") / block, F.sum("length") / BLOCK_WORDS)).cast("int").alias(name))
    grid = blocks(left, "lb").join(blocks(right, "rb"), key)
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = attached(left, key, "node", grid).select(*key, part("lb").alias("i"), every("rb").alias("j"), F.lit(0).alias("side"), "root", "node")
    rights = attached(right, key, "node", grid).select(*key, every("lb").alias("i"), part("rb").alias("j"), F.lit(1).alias("side"), "root", "node")
    sides = whole.unionAll(lefts).unionAll(rights).join(words, "node")
    return sides.groupBy(*key, "i", "j").applyInArrow(_blocks(similarity), "ra long, rb long")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class: that with the least doc_id (of equal ids, the least text_key; a null id comes last).

    Columns and their order stay. Of repeated rows with equal id and text, one stays.
    """
    found = stored(classes(docs, **options), "omh-classes")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    drop = found.where("not (doc_id <=> class_id and text_key = kept_key)").select(F.col("doc_id").alias("drop_id"), F.col("text_key").alias("drop_key")).distinct()
    # the caller's columns in a struct, so that none clashes with ours
    keyed = docs.select(F.struct(*map(quoted, docs.columns)).alias("own"), quoted(id_col).cast("long").alias("k_id"), F.xxhash64(quoted(text_col).cast("string")).alias("k_key"))
    kept = keyed.join(drop, F.col("k_id").eqNullSafe(F.col("drop_id")) & (F.col("k_key") == F.col("drop_key")), "left_anti").select("own.*")
    twice = found.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count() > 0
    return kept.dropDuplicates([id_col, text_col]) if twice else kept
