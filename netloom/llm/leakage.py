"""Evaluation passages inside a training corpus, by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row

from netloom.llm.dialogue import dialogue, skeleton

#: Words of an item that must stand in a document, and how many of them, one in so many, may be wrong.
LEAST_WORDS, ONE_IN = 20, 10
#: Words of a seed; twenty words with two wrong hold at least SEEDS of them, with one more misread at least 5.
SEED, SEEDS = 4, 5
#: Words by which seeds of one passage may be out of line, for words left out or added.
SLACK = 4
#: Seeds that are compared at a time with those in reach.
ROWS = 256
#: Texts whose seeds are looked up together.
TEXTS = 256
#: Items of one index. More are taken in blocks of so many, each against all documents.
BLOCK_ITEMS = 20_000
_BASE = np.uint64(0x100000001B3)
KEPT_WORDS = 2_000_000


def greedy_tiles(a: list[int], b: list[int], least: int = 2, band: tuple[int, int] | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in a, place in b, length) of matches that overlap neither in a nor in b.

    The longest matches of unmarked words are marked first, and of equally long ones those nearest the middle of the band;
    matches of a length are found by a running Karp-Rabin hash, and the search length falls until ``least``. With ``band``,
    only matches whose places differ by so much (``place in a - place in b``) count.
    """
    free_a, free_b = [True] * len(a), [True] * len(b)
    tiles: list[tuple[int, int, int]] = []
    mask = (1 << 61) - 1
    low, high = band or (-len(b), len(a))
    middle = low + high if band else 0

    def windows(x: list[int], free: list[bool], n: int) -> Iterator[tuple[int, int]]:
        power, h, run = pow(1_000_003, n - 1, mask), 0, 0
        for i, w in enumerate(x):
            if not free[i] or not w:
                h, run = 0, 0
                continue
            if run == n:
                h = (h - x[i - n] * power) % mask
            else:
                run += 1
            h = (h * 1_000_003 + w) % mask
            if run == n:
                yield i - n + 1, h

    n = max(least, min(len(a), len(b)) // 2)
    while n >= least:
        places = defaultdict(list)
        for i, h in windows(a, free_a, n):
            places[h].append(i)
        found = []
        for j, h in windows(b, free_b, n):
            for i in places.get(h, ()):
                if low <= i - j <= high and a[i : i + n] == b[j : j + n]:
                    k = n
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and a[i + k] and free_a[i + k] and free_b[j + k]:
                        k += 1
                    found.append((-k, abs(2 * (i - j) - middle), i, j))
        marked = False
        for k, _, i, j in sorted(found):
            if all(free_a[i : i - k]) and all(free_b[j : j - k]):
                free_a[i : i - k] = free_b[j : j - k] = [False] * -k
                tiles.append((i, j, -k))
                marked = True
        if not marked:  # what a marked tile cut off may still be as long
            n = n - 1 if n <= 4 else max(4, n // 2)
    return sorted(tiles)


def covers_passage(tiles: list[tuple[int, int, int]], items: int) -> bool:
    """Whether tiles in the same order on both sides cover a passage: at least LEAST_WORDS consecutive words of the item's
    ``items``, of which at most one in ONE_IN is not covered or parted from its neighbour by added words.

    Between two tiles of a chain as many words are wrong as the longer side holds. For each tile the chain that ends in it
    with the most covered words, less the wrong ones, is followed back; then every stretch between two covered words of the
    chain is measured, words beyond it being wrong ones.
    """
    best: list[tuple[int, int]] = []  # words less errors, tile before
    for t, (i, j, k) in enumerate(tiles):
        got = (k, -1)
        for p, (i0, j0, k0) in enumerate(tiles[:t]):
            apart = i - i0 - k0, j - j0 - k0
            if min(apart) >= 0:
                got = max(got, (best[p][0] + k - max(apart), p))
        best.append(got)
    inner = {p for _, p in best}
    for t in range(len(tiles)):
        if t in inner:  # a longer chain holds this one
            continue
        chain = []
        while t >= 0:
            chain.append(tiles[t])
            t = best[t][1]
        place, wrong, errors, last = [], [], 0, None
        for i, j, k in reversed(chain):
            if last is not None:
                errors += max(i - last[0], j - last[1])
            place += range(i, i + k)
            wrong += [errors] * k
            last = i + k, j + k
        x, e = np.array(place), np.array(wrong)
        size, bad = x[None, :] - x[:, None] + 1, e[None, :] - e[:, None]
        for n in (np.maximum(size, LEAST_WORDS), np.maximum(-(-size // ONE_IN) * ONE_IN, LEAST_WORDS)):
            if ((size > 0) & (n <= items) & (bad + n - size <= n // ONE_IN)).any():
                return True
    return False


class ItemIndex:
    """Items as numbers of words, their seeds in order of hash, and how words of documents are numbered."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.near: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.words: list[list[int]] = []
        for _, text in items:
            row = []
            for raw in text.split():
                s = skeleton(raw)
                if s:
                    row.append(self.number.setdefault(s, len(self.number) + 1))
                    bare = skeleton("".join(c for c in raw if c.isascii() or c == "’"))  # accented letters lost
                    if bare and bare != s:
                        self.near.setdefault(bare, row[-1])
            self.words.append(row)
        for s, n in list(self.number.items()):
            if len(s) >= 6:
                for i in range(len(s)):
                    self.near.setdefault(s[:i] + "\0" + s[i + 1 :], n)
                    self.near.setdefault(s[:i] + s[i + 1 :], n)
        seeds = [(h, k, p) for k, row in enumerate(self.words) for p, h in enumerate(hashes(np.array(row, np.uint64)).tolist())]
        seeds.sort()
        self.hash = np.array([s[0] for s in seeds], np.uint64)
        self.item = np.array([s[1] for s in seeds], np.int64)
        self.place = np.array([s[2] for s in seeds], np.int64)
        self.known: dict[str, int] = {}

    def number_of(self, raw: str) -> int:
        """Number of the item word that a document's word is, whatever its damage; 0 for another word, -1 for none."""
        s = skeleton(raw)
        if not s:
            return -1
        n = self.number.get(s) or self.near.get(s, 0)
        if not n and len(s) >= 6:  # one more sign lost, added or misread
            for i in range(len(s)):
                n = self.near.get(s[:i] + "\0" + s[i + 1 :]) or self.number.get(s[:i] + s[i + 1 :], 0)
                if n:
                    break
        return n or 0

    def numbers(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.number_of(w)
        got = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return got[got >= 0]

    def leaked(self, texts: list[str]) -> list[tuple[int, int]]:
        """Place of a text and item, for each item of which the text holds a passage."""
        rows = [self.numbers(dialogue(t)) for t in texts]
        apart = np.zeros(4 * LEAST_WORDS, np.int64)  # texts lie on one line, farther apart than any passage reaches
        doc = np.concatenate([x for r in rows for x in (r, apart)]) if rows else apart
        starts = np.cumsum([0, *(len(r) + len(apart) for r in rows)])
        h = hashes(doc.astype(np.uint64))
        if not len(self.hash):
            return []
        h[np.lib.stride_tricks.sliding_window_view(doc == 0, SEED).any(axis=1)] = 0
        at = np.flatnonzero(h)
        lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
        n = hi - lo
        entry = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        at, item, place = np.repeat(at, n), self.item[entry], self.place[entry]
        order = np.lexsort((at, item))
        item, place, at = item[order], place[order], at[order]
        far = SEEDS - 1
        if len(at) <= far:
            return []
        dense = np.zeros(len(item), bool)  # SEEDS seeds of an item within the width of a passage
        dense[:-far] = (item[far:] == item[:-far]) & (at[far:] - at[:-far] <= LEAST_WORDS + SEED)
        near = dense.copy()
        for k in range(1, SEEDS):
            near[k:] |= dense[:-k]
        item, place, at = item[near], place[near], at[near]
        new = np.flatnonzero((np.diff(item) != 0) | (np.diff(at) > LEAST_WORDS)) + 1
        out = set()
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(item)], strict=True):
            if b - a >= SEEDS and self._holds(int(item[a]), doc, place[a:b], at[a:b]):
                out.add((int(np.searchsorted(starts, at[a], "right")) - 1, self.ids[int(item[a])]))
        return sorted(out)

    def _holds(self, item: int, doc: np.ndarray, place: np.ndarray, at: np.ndarray) -> bool:
        """Whether the passage lies in the region of these seeds: where enough seeds are in line, tiles along that line must cover it.

        Tiles lie in a band about the line, so that a copy elsewhere can't take words of the passage.
        """
        words = self.words[item]
        reach = len(words) + len(words) // ONE_IN + 2 * (LEAST_WORDS + SEED)  # a passage and its errors, whole
        if int(at[-1] - at[0]) > 4 * reach:  # stretches that overlap by so much
            for start in range(int(at[0]), int(at[-1]) + 1, 3 * reach):
                a, b = np.searchsorted(at, [start, start + 4 * reach])
                if b - a >= SEEDS and self._holds(item, doc, place[a:b], at[a:b]):
                    return True
            return False
        line = place - at
        lines: set[int] = set()
        ends = np.searchsorted(at, at + LEAST_WORDS + SEED, "right")
        for a in range(0, len(at), ROWS):  # a band of the seeds each ROWS seeds may be in line with
            rows, near = slice(a, a + ROWS), slice(np.searchsorted(at, at[a]), int(ends[min(a + ROWS, len(at)) - 1]))
            ahead = at[None, near] - at[rows, None]
            in_line = (ahead >= 0) & (ahead <= LEAST_WORDS + SEED) & (np.abs(line[None, near] - line[rows, None]) <= SLACK)
            lines.update(line[rows][in_line.sum(axis=1) >= SEEDS].tolist())
        i0, j0 = max(0, int(place.min()) - LEAST_WORDS), max(0, int(at[0]) - LEAST_WORDS)
        part, region = words[i0 : int(place.max()) + SEED + LEAST_WORDS], doc[j0 : int(at[-1]) + SEED + LEAST_WORDS].tolist()
        band: list[int] = []
        for x in [*sorted(lines), None]:
            if band and (x is None or x > band[1] + SLACK):
                if covers_passage(greedy_tiles(part, region, 1, (band[0] - SLACK - i0 + j0, band[1] + SLACK - i0 + j0)), len(part)):
                    return True
                band = []
            if x is not None:
                band = [band[0] if band else x, x]
        return False


def hashes(x: np.ndarray) -> np.ndarray:
    """Running hash of each SEED consecutive numbers."""
    if len(x) < SEED:
        return np.empty(0, np.uint64)
    h = np.zeros(len(x) - SEED + 1, np.uint64)
    for k in range(SEED):
        h = (h + x[k : len(x) - SEED + 1 + k]) * _BASE
        h ^= h >> np.uint64(29)
    return h


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", block: int = BLOCK_ITEMS) -> DataFrame:
    """``doc_key`` and ``item_key`` of each document whose dialogue holds a passage of an item.

    A passage is at least twenty consecutive words of the item, in order, with at most one word in ten changed, left out
    or added; what ``dialogue`` strips and ``skeleton`` levels are no changes. Items shorter than twenty words never leak;
    null or empty texts and rows with a null key are left out; repeated rows give one pair; an empty table gives none; other
    columns may have any name.

    Items are a small fixed set: they are indexed in blocks of ``block`` items, whose number is counted first, and each
    block, of bounded size, goes to the tasks that scan the corpus, whose texts are never shuffled. Shared seeds of four
    words name candidates, and a candidate is a leak if greedy tiles of its words cover a passage.
    """
    spark = documents.sparkSession
    rows = items.select(item_key, text).dropna().orderBy(item_key)
    n = rows.count()
    docs = documents.select(doc_key, text).dropna()
    schema = f"{doc_key} {dict(documents.dtypes)[doc_key]}, {item_key} long"
    out = None
    for k in range(max(1, -(-n // block))):
        part: list[Row] = rows.offset(k * block).limit(block).collect() if n > block else rows.collect()
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in part])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value)
            for b in batches:
                for start in range(0, b.num_rows, TEXTS):
                    part = b.slice(start, TEXTS)
                    found = index.leaked(part.column(1).to_pylist())
                    keys = part.column(0).take(pa.array([d for d, _ in found], pa.int64()))
                    yield pa.record_batch({doc_key: keys, item_key: pa.array([i for _, i in found], pa.int64())})

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out.dropDuplicates()
