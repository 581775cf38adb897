"""Test texts leaking into a corpus: one Aho-Corasick automaton over normalised test items.

The automaton holds every run of PIECE words of every item, as numbers of words. A document is folded (case, accents,
compatibility forms, invisible signs) and scanned once; runs that occur join into passages, passages in running order into
the share of the item that the document holds; word positions lead back to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.session import checkpointed

#: Words of a pattern: shorter runs of equal words count only between two longer ones.
PIECE = 4
#: Longest period of what is said over and over, of which only so many rounds count.
PERIOD = 8
#: Words of a run of equal words that says something though every piece of it stands in other items too.
LONG = 9
#: Cost of a word that differs inside a passage (an equal one in a run that says something is worth 1), most differing words in a row,
#: and least value of a passage; of an item with fewer than twice as many words the least value is half its words.
DIFFERENT, GAP, LEAST_VALUE = 3, 6, 9
#: Least share of the item's words in all passages.
SHARE = 1 / 3
#: Words of all items of one automaton (about 200 MB a worker); more items are taken in blocks, each against all documents.
BLOCK_WORDS = 400_000

OUTPUT = "doc_id bigint, item_id bigint, share double, n_words bigint, char_start bigint, char_end bigint"
PREPARED = "item_id bigint, words array<string>, whole string, prefixes array<struct<n:int,key:string>>"

#: Signs of scripts written without spaces (South East Asian, Japanese, Chinese), each a word of its own.
_SOLO = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ASCII_WORD = re.compile("[a-z0-9]+")
_WORD = re.compile(f"[a-z0-9]+|[{_SOLO}]|[^\\W_a-z0-9{_SOLO}]+")
_SENTENCE = re.compile("(?<=[.?!\u2026:\u3002\uff1f\uff01])\\s+|\n+|(?<=[\u3002\uff1f\uff01])")
#: Signs without width that may stand inside a word.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


#: Byte of each sign that UTF-8 bytes turn into when they are read as Latin-1 or Windows-1252.
_BYTE = {chr(b): b for b in range(128, 256)}
for _b in range(128, 160):
    try:
        _BYTE[bytes([_b]).decode("cp1252")] = _b
    except UnicodeDecodeError:
        pass
_TAIL = "[" + "".join(c for c, b in _BYTE.items() if b < 192) + "]"
_GARBLED = re.compile(f"[\xc2-\xdf]{_TAIL}|[\xe0-\xef]{_TAIL}{{2}}|[\xf0-\xf4]{_TAIL}{{3}}")


def plain(sign: str) -> str:
    """A sign outside ASCII without accents and compatibility forms; nothing if it is invisible."""
    return "" if sign in _INVISIBLE else "".join(c for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c)).lower()


def ungarbled(found: re.Match) -> str:
    try:
        return plain(bytes(_BYTE[c] for c in found.group()).decode())
    except UnicodeDecodeError:
        return found.group()


def folded(text: str) -> str:
    """Lower case without accents, compatibility forms, invisible signs and UTF-8 read as another charset."""
    if not text.isascii():
        text = _GARBLED.sub(ungarbled, text)
        text = text.translate({ord(c): plain(c) for c in set(text) if c > "\x7f"})
    return text.lower()


def words_of(low: str) -> list[str]:
    """Words of a folded text, of any script."""
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


def offsets(text: str, low: str) -> list[tuple[int, int]]:
    """Start and end in the original text of every word of its folded form."""
    spans = [m.span() for m in (_ASCII_WORD if low.isascii() else _WORD).finditer(low)]
    if text.isascii():
        return spans
    origin: list[int] = []
    at = 0
    pieces = [(m.start(), m.end(), ungarbled(m)) for m in _GARBLED.finditer(text)]
    for start, end, sign in [*pieces, (len(text), len(text), "")]:
        for i in range(at, start):
            origin += [i] * len((plain(text[i]) if text[i] > "\x7f" else text[i]).lower())
        origin += [start] * len("".join(plain(c) if c > "\x7f" else c for c in sign).lower())
        at = end
    return [(origin[a], origin[b - 1] + 1) for a, b in spans]


def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (item_id, item_text): folded words of the items that have any, with a digest of the whole and of
    the words up to the end of each of its sentences."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("item_text").to_pylist()):
            digest, prefixes, words = hashlib.md5(), [], []
            for sentence in _SENTENCE.split(text or ""):
                more = words_of(folded(sentence))
                if more:
                    words += more
                    digest.update(" ".join([*more, ""]).encode("utf-8", "replace"))
                    prefixes.append({"n": len(words), "key": digest.hexdigest()})
            if words:
                rows.append((item, words, prefixes[-1]["key"], prefixes))
        if rows:
            kinds = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.struct([("n", pa.int32()), ("key", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["item_id", "words", "whole", "prefixes"])


def compared(items: DataFrame) -> DataFrame:
    """(item_id, words, whole, opening, common) of items. opening: number of words of the leading sentences that
    a different item begins with as well, 0 where fewer than PIECE words would be left. common: places of the pieces that stand in a different item too."""
    ready = checkpointed(items.select(F.col("item_id").cast("bigint").alias("item_id"), "item_text").mapInArrow(prepared, PREPARED))
    once = ready.groupBy("whole").agg(F.first("words").alias("words"), F.first("prefixes").alias("prefixes"))

    def in_several(each: DataFrame) -> DataFrame:
        several = each.groupBy("key").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where(F.col("a") != F.col("b"))
        return each.join(several.select("key"), "key")

    prefixes = once.select("whole", F.size("words").alias("n_words"), F.inline("prefixes"))
    openings = in_several(prefixes).where(F.col("n") + PIECE <= F.col("n_words")).groupBy("whole").agg(F.max("n").alias("opening"))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (PIECE - 1))), lambda i: F.md5(F.array_join(F.slice("words", i, PIECE), " ")))
    common = in_several(once.select("whole", F.posexplode(pieces).alias("at", "key"))).groupBy("whole").agg(F.collect_list("at").alias("common"))
    both = ready.drop("prefixes").join(openings, "whole", "left").join(common, "whole", "left")
    return both.select("item_id", "words", "whole", F.coalesce("opening", F.lit(0)).alias("opening"), F.coalesce("common", F.array().cast("array<int>")).alias("common"))


class Items:
    """Test items, distinct by their words, ready for the scan."""

    def __init__(self, items: list[tuple[int, list[str], int, list[int]]], share: float):
        ids: dict[tuple[str, ...], list[int]] = {}
        about = {}
        for item, words, opening, common in items:
            ids.setdefault(tuple(words), []).append(item)
            about[tuple(words)] = opening, common
        self.ids = list(ids.values())
        self.number: dict[str, int] = {}
        number = lambda w: self.number.setdefault(w, len(self.number) + 1)
        self.words, self.rare, openings = [], [], []
        for words in ids:
            numbers, kept = few([number(w) for w in words])
            opening, common = about[words]
            n = min(PIECE, len(numbers))
            rare = np.ones(len(words), bool)
            rare[common] = False
            if kept is not None:
                rare, opening = rare[kept], int(np.searchsorted(kept, opening))
            self.words.append(np.array(numbers, np.int64))
            self.rare.append(np.r_[0, np.cumsum(rare[: len(numbers) - n + 1])])  # number of pieces before each place that no other item has
            openings.append(min(opening, len(numbers) - 1))
        self.opening = np.array(openings, np.int64)
        self.own = np.array([len(w) for w in self.words], np.int64) - self.opening
        self.need = np.maximum(1, np.ceil(share * self.own - 1e-9)).astype(np.int64)
        self.piece = np.array([min(PIECE, len(w)) for w in self.words], np.int64)
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            n, listed = int(self.piece[k]), words.tolist()
            for at in range(len(listed) - n + 1):
                places.setdefault(tuple(listed[at : at + n]), []).append((k, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE) if places else None
        self.start = np.zeros(len(places) + 1, np.int64)
        self.length = np.zeros(len(places), np.int64)
        flat: list[tuple[int, int]] = []
        for g, (piece, where) in enumerate(places.items()):
            self.automaton.add_word(piece, g)
            self.length[g] = len(piece)
            flat += where
            self.start[g + 1] = len(flat)
        self.flat = np.array(flat, np.int64).reshape(-1, 2)
        if places:
            self.automaton.make_automaton()

    def pieces(self, words: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that occur, and the word of the document where each begins."""
        found = list(self.automaton.iter(tuple(words))) if self.automaton is not None else []
        if not found:
            return (np.zeros(0, np.int64),) * 2
        end, piece = np.array(found, np.int64).T
        return piece, end + 1 - self.length[piece]

    def likely(self, piece: np.ndarray) -> np.ndarray:
        """Items of which the pieces that occur cover enough own words, wherever they stand."""
        piece = np.unique(piece)
        place = self.flat[ranges(self.start[piece], self.start[piece + 1])]
        pairs = np.unique(place[:, 0] << 32 | place[:, 1])
        item, at = pairs >> 32, pairs & 0xFFFFFFFF
        begin, end = np.maximum(at, self.opening[item]), at + self.piece[item]
        last = np.r_[item[1:] != item[:-1], True]
        end = np.where(last, end, np.minimum(end, np.r_[at[1:], 0]))
        covered = np.bincount(item, np.maximum(end - begin, 0), minlength=len(self.need))
        return np.flatnonzero(covered >= self.need)

    def hits(self, items: np.ndarray, piece: np.ndarray, at_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, word of the item and word of the document where a piece of one of the items begins in both."""
        of = np.isin(self.flat[:, 0], items)
        before = np.r_[0, np.cumsum(of)]
        start, end = before[self.start[piece]], before[self.start[piece + 1]]
        place = self.flat[of][ranges(start, end)]
        return place[:, 0], place[:, 1], np.repeat(at_doc, end - start)


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The whole numbers from each start up to its end, one range after the other."""
    n = end - start
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def few(words: list[int]) -> tuple[list[int], np.ndarray | None]:
    """Words without what goes on after PIECE repeats of the same PERIOD words or fewer, and the places of those kept (None if it is all)."""
    number = np.array(words, np.int64)
    over = np.zeros(len(words), bool)
    for period in range(1, PERIOD + 1):
        same = (number[period:] == number[:-period]) & (number[period:] > 0)
        if same.sum() < period * PIECE:
            continue
        place = np.arange(len(same))
        over[period:] |= place - np.maximum.accumulate(np.where(same, -1, place)) >= period * PIECE
    if not over.any():
        return words, None
    kept = np.flatnonzero(~over)
    return number[kept].tolist(), kept


def passages(words: np.ndarray, item: np.ndarray, rare: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, piece: int) -> list[tuple[int, int, int, int, list[tuple[int, int]]]]:
    """Passages of worth: first and end word in the document and in the item, and the item's words found, as ranges."""
    # runs of equal words
    shift = at_doc - at_item
    order = np.lexsort((at_item, shift))
    s, i = shift[order], at_item[order]
    begins = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (i[1:] != i[:-1] + 1)])
    ends = np.r_[begins[1:], len(i)] - 1
    low, high, by = i[begins], i[ends] + piece, s[begins]
    order = np.lexsort((low, low + by))
    low, high, by = low[order], high[order], by[order].tolist()
    says = ((high - low >= LONG) | (rare[high - piece + 1] > rare[low])).tolist()
    low, high = low.tolist(), high.tolist()
    best, before, active = [], [], []
    for b, (b0, b1, bs) in enumerate(zip(low, high, by)):
        active = [a for a in active if high[a] + by[a] >= b0 + bs - GAP]
        value, link = (b1 - b0 if says[b] else 0), -1
        for a in active:
            lost = max(0, high[a] - b0, high[a] + by[a] - b0 - bs)
            gap_item, gap_doc = b0 + lost - high[a], b0 + bs + lost - high[a] - by[a]
            gap = max(gap_item, gap_doc)
            if b1 - b0 <= lost or gap > GAP or low[a] >= b0:
                continue
            equal = int((item[high[a] : b0] == words[high[a] + bs : b0 + bs]).sum()) if by[a] == bs else 0
            worth = best[a] + (b1 - b0 - lost if says[b] else 0) - DIFFERENT * (gap - equal)
            if worth > value:
                value, link = worth, a
        best.append(value)
        before.append(link)
        active.append(b)
    # the best chains, each run in one of them
    out, used, least = [], set(), min(LEAST_VALUE, -(-len(item) // 2))
    for b in sorted(range(len(best)), key=lambda k: -best[k]):
        if best[b] < least:
            break
        chain, k = [], b
        while k >= 0 and k not in used:
            chain.append(k)
            used.add(k)
            k = before[k]
        if best[b] - (best[k] if k >= 0 else 0) < least or not chain:
            continue
        chain.reverse()
        found = [(low[k], high[k]) for k in chain]
        for x, y in zip(chain, chain[1:]):
            if by[x] == by[y]:
                found += [(j, j + 1) for j in range(high[x], low[y]) if item[j] == words[j + by[y]]]
        first, last = chain[0], chain[-1]
        # single equal words beyond the ends
        a, z = low[first], high[last]
        for step, edge, diagonal in ((-1, a - 1, by[first]), (1, z, by[last])):
            worth = 0
            for j in range(edge, edge + step * (GAP + PIECE), step):
                if not (0 <= j < len(item) and 0 <= j + diagonal < len(words)):
                    break
                equal = item[j] == words[j + diagonal]
                worth += 1 if equal else -DIFFERENT
                if equal:
                    found.append((j, j + 1))
                    a, z = min(a, j), max(z, j + 1)
                if worth < -2 * DIFFERENT:
                    break
        out.append((a + by[first], z + by[last], a, z, found))
    return out


def leak(words: np.ndarray, item: np.ndarray, rare: np.ndarray, opening: int, at_item: np.ndarray, at_doc: np.ndarray, piece: int) -> tuple[int, int, int]:
    """Number of the item's own words found in running order in passages, and the first and end word in the document."""
    parts = sorted(passages(words, item, rare, at_item, at_doc, piece), key=lambda p: p[:4])
    if not parts:
        return 0, 0, 0
    d0, d1, i0, i1 = (np.array([p[k] for p in parts]) for k in range(4))
    worth = np.zeros(len(parts), np.int64)
    for k, part in enumerate(parts):
        have = np.zeros(part[3] - part[2], bool)
        for a, b in part[4]:
            have[max(a, opening) - part[2] : max(b, opening) - part[2]] = True
        worth[k] = have.sum()
    total, before = worth.copy(), np.full(len(parts), -1)
    for k in range(1, len(parts)):
        fits = np.where((d1[:k] <= d0[k] + 2) & (i1[:k] <= i0[k] + 2), total[:k], 0)
        j = int(fits.argmax())
        if fits[j] > 0:
            total[k] += fits[j]
            before[k] = j
    k = int(total.argmax())
    n, end = int(total[k]), int(d1[k])
    while before[k] >= 0:
        k = before[k]
    return n, int(d0[k]), end


def scan(batches: Iterator[pa.RecordBatch], shared, share: float) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (doc_id, text). The automaton is built once per worker process and kept with the broadcast items."""
    ready = shared.value.get("ready")
    if ready is None:
        ready = shared.value["ready"] = Items(shared.value["items"], share)
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    number = ready.number.get
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            low = folded(text)
            words, kept = few([number(w, 0) for w in words_of(low)])
            piece, at = ready.pieces(words)
            likely, spans = ready.likely(piece), None
            if not len(likely):
                continue
            item, at_item, at_doc = ready.hits(likely, piece, at)
            words = np.array(words)
            for k in likely.tolist():
                mine = item == k
                n, first, end = leak(words, ready.words[k], ready.rare[k], int(ready.opening[k]), at_item[mine], at_doc[mine], int(ready.piece[k]))
                if n >= ready.need[k]:
                    spans = spans or offsets(text, low)
                    a, z = (first, end - 1) if kept is None else (kept[first], kept[end - 1])
                    rows += [(doc, i, n / int(ready.own[k]), n, spans[a][0], spans[z][1]) for i in ready.ids[k]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that hold at least `share` of an item's words in running order.

    docs (doc_id bigint, text string), items (item_id bigint, item_text string). Columns: doc_id, item_id, share
    (of the item's own words), n_words, char_start and char_end (offsets in the original text around all passages found).
    Leading sentences that several different items share count neither as found nor as to be found, unless an item would have fewer than PIECE words left.
    Words of any script count; in scripts without spaces each sign is a word. Up to PERIOD words said over and over count PIECE + 1 times at most
    (a single word PIECE times).
    NULL and empty texts and items have no row; items of up to PIECE words must occur whole. Repeated documents and
    items each have their rows. Items are a stated query set: beyond block_words words in all they are taken in blocks, one after the other.
    """
    spark = docs.sparkSession
    ready = checkpointed(compared(items))
    blocks = max(1, -(-(ready.agg(F.sum(F.size("words"))).first()[0] or 0) // block_words))
    result = spark.createDataFrame([], OUTPUT)
    for k in range(blocks):
        block = [tuple(r) for r in ready.where(F.pmod(F.xxhash64("whole"), F.lit(blocks)) == k).select("item_id", "words", "opening", "common").collect()]
        if not block:
            continue
        shared = spark.sparkContext.broadcast({"items": block})
        found = docs.select("doc_id", "text").mapInArrow(lambda it, b=shared: scan(it, b, share), OUTPUT)
        if blocks > 1:  # only one block is held at a time
            found = checkpointed(found)
            shared.unpersist()
        result = result.unionByName(found)
    return result
