"""Benchmark decontamination by the q-gram lemma.

Texts are lower-cased, and all that is no word (ASCII letters and digits, non-ASCII characters) becomes
one space. An item of w bytes found with at most e = floor(budget * w) edits shares w + 1 - q - q * e of its
q-grams with the document, on diagonals (place in the document minus place in the item) that differ by e at
most. So shared q-grams are counted in bands of diagonals, each twice as wide as e + 1 and overlapping the
next by half; bands with enough of them are regions, and a banded alignment of the whole item
against the region decides. No other limit is applied: every place of every text is looked up.

The benchmark is a query set: it is read in blocks of at most `block_bytes`, each is broadcast and
held against all documents. e is lowered for short items until the bound is 1 or more; items shorter
than q are searched for exactly, as whole words.

Defined cases: null, empty and wordless texts and items match nothing; items with equal texts are all
reported; repeated rows are judged alike; every exact place of an item is reported, and the best place of
a region without one (overlapping places count once, that with fewest edits, then the first); an empty benchmark flags nothing; a column with
the name of the result is replaced and others stay; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTE, as_text, free_name, text_bytes, with_struct

Q, BUDGET, BLOCK_BYTES, ROWS = 8, 0.1, 2 << 20, 256
#: Places of q-grams that are dealt to bands at a time.
CELLS = 1 << 20
#: Bytes from which on a text is searched in pieces.
PIECE = 1 << 19
_TABLE_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
HITS = "array<struct<item_id:long,start:int,end:int,edits:int,similarity:double>>"


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all normalised texts, each between two spaces; where each text starts; each byte's place and the lower-cased bytes."""
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    raw, offsets = text_bytes(pc.binary_join_element_wise(space, pc.utf8_lower(texts), space, none))
    inside = WORD_BYTE[raw]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    keep[offsets[:-1]] = True
    place = np.flatnonzero(keep)
    return np.where(inside, raw, np.uint8(32))[place], np.searchsorted(place, offsets), place, raw


@dataclass
class Index:
    ids: list
    texts: list[bytes]
    edits: np.ndarray
    needed: np.ndarray
    #: every different q-gram; those of number g are entries starts[g] to starts[g + 1] of the three arrays after it
    grams: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    #: how often the item has the q-gram, and a run of places that fall in the same bands as all of its places
    often: np.ndarray
    first: np.ndarray
    place: np.ndarray
    short: list[int]


def grams_of(data: np.ndarray, q: int) -> np.ndarray:
    """Every run of q bytes (8 at most) as a number, without copying the bytes."""
    if len(data) < 8:
        data = np.concatenate((data, np.zeros(8, np.uint8)))[: len(data) + 8]
    codes = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    return codes if q == 8 else codes & np.uint64((1 << 8 * q) - 1)


def build_index(rows: list, q: int, budget: float) -> Index:
    data, at, _, _ = normalised(as_text(pa.array([r[1] for r in rows], pa.string())))
    ids, texts = [], []
    for i, row in enumerate(rows):
        body = data[at[i] : at[i + 1]].tobytes().strip()
        if body:
            ids.append(row[0])
            texts.append(body)
    width = np.array([len(t) for t in texts], np.int64)
    edits = np.maximum(np.minimum(np.floor(budget * width), np.floor((width - q) / q)), 0).astype(np.int64)
    entries: list[tuple[int, int, list[int], int]] = []
    for i, t in enumerate(texts):
        if len(t) < q:
            continue
        own = grams_of(np.frombuffer(t + b"\0" * 8, np.uint8), q)[: len(t) - q + 1]
        order = np.argsort(own, kind="stable")
        codes, at = np.unique(own[order], return_index=True)
        for code, spots in zip(codes.tolist(), np.split(order, at[1:]), strict=True):
            entries.append((code, i, thinned(spots.tolist(), int(edits[i]) + 1), len(spots)))
    entries.sort(key=lambda e: e[:2])
    grams, starts = np.unique(np.array([e[0] for e in entries], np.uint64), return_index=True)
    first = np.cumsum([0, *(len(e[2]) for e in entries)])
    return Index(ids, texts, edits, width + 1 - q - q * edits, grams, np.append(starts, len(entries)), np.array([e[1] for e in entries], np.int64), np.array([e[3] for e in entries], np.int64), first, np.array([x for e in entries for x in e[2]], np.int64), [i for i, t in enumerate(texts) if len(t) < q])


def thinned(spots: list[int], step: int) -> list[int]:
    """Places, in order, of which none can be left out: cells of `step` diagonals that any place falls in have one of these.

    Of places with gaps of at most `step`, cells have one everywhere between the first and the last; so where a q-gram repeats,
    places about `step` apart stand for all.
    """
    out = spots[:1]
    for here, ahead in zip(spots[1:], [*spots[2:], None]):  # noqa: B905
        if ahead is None or ahead - out[-1] > step:
            out.append(here)
    return out


def align(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Fewest edits of the whole item to any part of text, with that part's start and end; None above `most`.

    Row i keeps only the places i .. i + band of the text, band = len(text) - len(item) + most.
    """
    n = len(item)
    band = max(0, len(text) - n) + 2 * most + 1
    one = np.int64(1) << 32
    padded = np.concatenate((np.full(most, 256), text.astype(np.int64), np.full(band + n, 256)))
    place = np.arange(band, dtype=np.int64)
    row = np.clip(place - most, 0, len(text))
    row[:most] += (most - place[:most]) * one
    slope, far, ahead = place * one, (most + 1) * one, np.full(band, np.int64(1) << 60)
    for i in range(n):
        ahead[:-1] = row[1:]
        row = np.minimum(row + (padded[i : i + band] != item[i]) * one, ahead + one)
        row = np.minimum.accumulate(row - slope) + slope
        if i & 7 == 7 and row.min() >= far:
            return None
    ends = np.arange(band) + n - most
    row[ends > len(text)] = np.int64(1) << 60
    best = int(row.argmin())
    edits, start = int(row[best] >> 32), int(row[best] & (one - 1))
    return (edits, start, int(ends[best])) if edits <= most else None


def _kernel(index: Index, q: int):
    bitmap_at = ((index.grams * _ODD) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
    n_items = len(index.texts)
    widths = np.array([len(t) for t in index.texts], np.int64)
    bitmap: list[np.ndarray] = []

    def regions(data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, first and last place of a region) wherever the bound is met."""
        if not len(index.grams) or len(data) < 8:
            return []
        if not bitmap:
            bitmap.append(np.zeros(1 << _TABLE_BITS, bool))
            bitmap[0][bitmap_at] = True
        codes = grams_of(np.concatenate((data, np.zeros(8, np.uint8))), q)[: len(data) - q + 1]
        hit = np.flatnonzero(bitmap[0][((codes * _ODD) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        found = np.searchsorted(index.grams, codes[hit])
        found[found == len(index.grams)] = 0
        same = index.grams[found] == codes[hit]
        hit, found = hit[same], found[same]
        doc = np.searchsorted(at, hit, "right") - 1
        same = hit + q <= at[doc + 1]
        hit, found, doc = hit[same], found[same], doc[same]
        # each q-gram of the text with each item that has it
        many = index.starts[found + 1] - index.starts[found]
        row = np.repeat(np.arange(len(hit)), many)
        entry = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + index.starts[found][row]
        # first without diagonals: most pairs of document and item share too few q-grams anywhere
        pair = doc[row] * n_items + index.item[entry]
        keys, inverse, counts = np.unique(pair, return_inverse=True, return_counts=True)
        good = (counts >= index.needed[keys % n_items])[inverse]
        pair, entry, spot = pair[good], entry[good], hit[row[good]]
        if not len(pair):
            return []
        shift = int(widths.max()) + 1
        span = (len(data) + 2 * shift) + 2
        bands: list[np.ndarray] = []
        # about CELLS places at a time, with the next q-grams of the pair that a band begun here can reach
        order = np.argsort(pair, kind="stable")
        pair, entry, spot = pair[order], entry[order], spot[order]
        load = np.cumsum(index.first[entry + 1] - index.first[entry])
        reach = (pair * span + spot) + (widths + 2 * index.edits + 2)[index.item[entry]]
        upto = np.searchsorted(pair * span + spot, np.minimum(reach, pair * span + span - 1), "right")
        begin = 0
        while begin < len(pair):
            end = max(begin + 1, int(np.searchsorted(load, (load[begin - 1] if begin else 0) + CELLS, "right")))
            n, h, p = (x[begin : upto[end - 1]] for x in (entry, spot, pair))
            begin = end
            many = index.first[n + 1] - index.first[n]
            row = np.repeat(np.arange(len(n)), many)
            at_item = index.place[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + index.first[n][row]]
            low = (h[row] - at_item + shift) // (index.edits[index.item[n]] + 1)[row]
            keys, which = np.unique(np.concatenate((p[row] * span + low, p[row] * span + low - 1)), return_inverse=True)
            # a q-gram of the text counts once in a band, and equal ones count as often as the item has them at most
            once = np.unique(which * len(n) + np.concatenate((row, row)))
            letters, counts = np.unique(once // len(n) * len(index.item) + n[once % len(n)], return_counts=True)
            shared = np.bincount(letters // len(index.item), np.minimum(counts, index.often[letters % len(index.item)]), len(keys))
            bands.append(keys[shared >= index.needed[keys // span % n_items]])
        band = np.unique(np.concatenate(bands))
        pair, low = band // span, band % span
        item, doc = pair % n_items, pair // n_items
        out: list[tuple[int, int, int, int]] = []
        for d, i, b in sorted(zip(doc.tolist(), item.tolist(), low.tolist(), strict=True)):
            e, w = int(index.edits[i]), int(widths[i])
            first = b * (e + 1) - shift
            start, stop = max(int(at[d]), first - e), min(int(at[d + 1]), first + 2 * (e + 1) + w + e)
            if out and out[-1][:2] == (d, i) and start <= out[-1][3] - w - 2 * e and out[-1][3] - out[-1][2] < 4 * w:
                out[-1] = (d, i, out[-1][2], max(stop, out[-1][3]))  # the next band of the same place
            else:
                out.append((d, i, start, stop))
        return out

    def places(texts: pa.Array, cut: bool) -> list[list[tuple]]:
        """(item, edits, start, end) of all hits of each text, in code points. cut: the text is a piece, whose ends bound no word."""
        data, at, place, raw = normalised(texts)
        found: list[list] = [[] for _ in range(len(texts))]
        here, done = None, 0
        for d, i, start, stop in regions(data, at):
            # what an exact place before covers is not looked at again
            if here != (d, i):
                here, done = (d, i), 0
            start = max(start, done)
            body, part = index.texts[i], data[start:stop]
            bare = part.tobytes()
            exact = bare.find(body)
            if exact < 0 and len(bare) >= len(body) - int(index.edits[i]) and (got := align(np.frombuffer(body, np.uint8).astype(np.int64), part, int(index.edits[i]))):
                found[d].append((i, got[0], start + got[1], start + got[2]))
            while exact >= 0:
                found[d].append((i, 0, start + exact, start + exact + len(body)))
                done = start + exact + len(body)
                exact = bare.find(body, exact + len(body))
        for i in index.short:
            whole, body = data.tobytes() if i == index.short[0] else whole, b" " + index.texts[i] + b" "  # noqa: F821
            p = whole.find(body)
            while p >= 0:
                d = int(np.searchsorted(at, p, "right")) - 1
                if p + len(body) <= at[d + 1] and not (cut and (p == at[d] or p + len(body) == at[d + 1])):
                    found[d].append((i, 0, p + 1, p + len(body) - 1))
                p = whole.find(body, p + 1)
        if any(found):
            letters = np.cumsum((raw & 0xC0) != 0x80)
        out = []
        for d, hits in enumerate(found):
            base = int(letters[place[at[d]]]) if hits else 0
            out.append([(i, e, int(letters[place[s]]) - base - 1, int(letters[place[t - 1]]) - base) for i, e, s, t in hits if t > s])
        return out

    def run(texts: pa.Array) -> list[pa.Array]:
        long = len(texts) == 1 and len(texts.buffers()[2] or b"") > PIECE and pc.binary_length(texts)[0].as_py() > PIECE
        found = [in_pieces(texts[0].as_py())] if long else places(texts, False)
        out = []
        for hits in found:
            kept: list = []
            places_of: dict[int, list] = {}
            for i, e, s, t in sorted(set(hits)):
                # by item, edits and place: of overlapping places the best stays
                own = places_of.setdefault(i, [])
                k = bisect(own, (s, t))
                if not (k and own[k - 1][1] > s or k < len(own) and own[k][0] < t):
                    own.insert(k, (s, t))
                    kept.append((i, e, s, t))
            out.append([{"item_id": index.ids[i], "start": s, "end": t, "edits": e, "similarity": 1 - e / len(index.texts[i])} for i, e, s, t in sorted(kept, key=lambda h: (h[2], h[0]))])
        return [pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32()), ("similarity", pa.float64())])))]

    def in_pieces(text: str) -> list[tuple]:
        """Hits of a long text from pieces that overlap by more than any hit's length and what lies between its words."""
        size = PIECE // 4
        found, begin = [], 0
        while begin < len(text):
            stop, whole = begin + size, 0
            # the overlap holds as many word characters as the longest hit
            while stop < len(text) and whole <= overlap:
                ahead = text[stop : stop + 2 * overlap]
                whole += int(WORD_BYTE[np.frombuffer(ahead.encode(errors="surrogatepass"), np.uint8)].sum())
                stop += len(ahead)
            found += [(i, e, begin + s, begin + t) for i, e, s, t in places(as_text(pa.array([text[begin:stop]])), True)[0]]
            begin += size
        return found

    overlap = int((widths + 2 * index.edits).max(initial=0)) + 2 * q

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks", keep: list[str] | None = None, q: int = Q, budget: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (or its columns `keep`) with `out`: the benchmark items in each text, with places in its lower-cased characters.

    Spans count code points of the text (start inclusive, end exclusive); lower-casing keeps their
    number except for the few characters whose lower case has another length.
    """
    if not 1 <= q <= 8:
        raise ValueError("q must be 1 to 8")
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    parts: list[str] = []
    done = docs
    text = text_col
    if blocks > 1 and text_col not in keep:
        keep = [*keep, text_col]
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        name = free_name(done, f"leaks{b}")
        done = with_struct(done, text, name, f"hits {HITS}", _kernel(build_index(rows, q, budget), q), keep=[*keep, *parts], rows=ROWS)
        parts.append(name)
    whole = reduce(lambda x, y: F.concat(x, y), [F.col(f"{p}.hits") for p in parts])
    return done.select(*("`" + c.replace("`", "``") + "`" for c in keep), whole.alias(out))
