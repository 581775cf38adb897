"""Reading level: the smallest frequency-ranked vocabularies that cover fixed shares of a document's words.

The letter patterns of all samples of known band, counted and scored in the tasks, tell English from other languages. One pass counts the words of all English
prose (combined per Arrow batch, then in SQL). The most frequent words, a bounded table, go to the second pass, which finds for
every document the ranks that cover the SHARES of its words, with measures of sentence complexity. Documents whose covering rank
lies beyond the table get it from a join with all counts. Samples, measured alike, calibrate the
bands in SQL: all measures jointly, by one covariance within bands.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import checkpointed

#: Shares of a document's words that the vocabulary has to cover, and words of the table sent to the tasks.
SHARES, TABLE_WORDS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 65_536
#: Words of a line, at least, for prose; words of a main text.
LINE_WORDS, LEAST_WORDS = 6, 80
#: Added to the variance of every measure, in squared natural logarithms.
RIDGE = 0.02
#: Bands that samples may have; parts of the samples, of which each is scored by the letters of the others.
BANDS, FOLDS = 100, 4
#: A text is English if its letters are more likely than this part of the way from the least likely sample to samples with words written backwards.
FAR = 0.3
#: Word scores kept by a worker, at most.
KEPT_WORDS = 1 << 20

COVERAGE = tuple(f"coverage_{round(100 * s)}" for s in SHARES)
MEASURES = (*COVERAGE, "sentence", "long_sentence", "marks")
RANKS = tuple(f"rank_{round(100 * s)}" for s in SHARES)
OUTPUT = ", ".join(["doc_id bigint", "n_words bigint", "english boolean", *(f"{r} bigint" for r in RANKS), "sentence double", "long_sentence double", "marks double", "open_key string"])

_PROSE = re.compile(r"[.?!…]")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.?!…]+[\"”“')]*(?:\s|$)")
_MARK = re.compile(r"[,;:—–]")


def prose(text: str) -> str:
    """Lines that hold sentences: enough words and the end of a sentence. Menus, titles and lists drop out."""
    return "\n".join(line for line in text.split("\n") if line.count(" ") >= LINE_WORDS - 1 and len(line.split()) >= LINE_WORDS and _PROSE.search(line))


def split_words(text: str) -> list[str]:
    """Words of a text in lower case, without those that begin with a capital (names, mostly), but where capitals are the rule."""
    written = _WORD.findall(text)
    low = list(map(str.lower, written))
    plain = [b for a, b in zip(written, low) if a[0] == b[0]]
    return plain if 2 * len(plain) >= len(low) else low


class Letters(dict):
    """Mean logarithm of the likelihood of a word's letters after the two before them; word: score."""

    def __init__(self, three: dict[str, int], two: dict[str, int], kept: int = KEPT_WORDS):
        super().__init__()
        self.three, self.two, self.kept = three, two, kept

    @classmethod
    def learnt(cls, texts: list[list[str]]) -> Letters:
        return cls.counted(triples(Counter(word for words in texts for word in words)))

    @classmethod
    def counted(cls, three: dict[str, int], kept: int = KEPT_WORDS) -> Letters:
        two: Counter[str] = Counter()
        for written, n in three.items():
            two[written[:2]] += n
        return cls(three, dict(two), kept)

    def __missing__(self, word: str) -> float:
        if len(self) >= self.kept:
            self.clear()
        written = f"  {word} "
        likely = [(self.three.get(written[i : i + 3], 0) + 0.1) / (self.two.get(written[i : i + 2], 0) + 3.0) for i in range(len(written) - 2)]
        self[word] = score = sum(map(math.log, likely)) / len(likely)
        return score

    def of(self, words: list[str]) -> float:
        return sum(map(self.__getitem__, words)) / len(words) if words else -math.inf


def triples(words: dict[str, int]) -> dict[str, int]:
    """Each three letters in a row of the words, which begin with two blanks and end with one, with their number."""
    three: Counter[str] = Counter()
    for word, n in words.items():
        written = f"  {word} "
        for i in range(len(written) - 2):
            three[written[i : i + 3]] += n
    return dict(three)


def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: words of the prose of each sample that has any, in order, blanks between."""
    for batch in batches:
        rows = [" ".join(words) for text in batch.column("sample_text").to_pylist() if (words := split_words(prose(text)))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["words"])


def folded(batch: pa.RecordBatch, starts: dict[int, int]) -> Iterator[tuple[int, list[str]]]:
    """Fold and words of each sample: the fold follows from its place, where its partition starts and its row there (id)."""
    for i, words in zip(batch.column("id").to_pylist(), batch.column("words").to_pylist()):
        yield (starts[i >> 33] + (i & ((1 << 33) - 1))) % FOLDS, words.split(" ")


def lettered(batches: Iterator[pa.RecordBatch], starts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (words, id): the triples of a batch by fold with their number."""
    for batch in batches:
        counts: dict[int, Counter[str]] = defaultdict(Counter)
        for fold, words in folded(batch, starts):
            counts[fold].update(words)
        rows = [(fold, three, n) for fold, own in counts.items() for three, n in triples(own).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64()))], names=["fold", "three", "n"])


def scored(batches: Iterator[pa.RecordBatch], starts: dict[int, int], shared) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (words, id): scores of each sample by the letters of the other folds, as written and word by word
    backwards."""
    others = [Letters.counted(three, KEPT_WORDS // FOLDS) for three in shared.value]
    for batch in batches:
        rows = [(others[fold].of(words), others[fold].of([w[::-1] for w in words])) for fold, words in folded(batch, starts)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows)], names=["score", "backwards"])


def language(samples: DataFrame) -> tuple[dict[str, int], dict[str, int], float]:
    """Letters of all samples, and the least score of English: each fold of the samples, as written and word by word backwards,
    is scored by the letters of the others. Samples with words go to the folds in turn, in order of the hashes of their texts. The
    driver holds the different triples of letters and a number for each partition, however many samples there are."""
    # row spreads a text repeated often over tasks; which of its copies comes first is all one
    known = samples.where(F.col("sample_text").isNotNull()).select(F.xxhash64("sample_text").alias("hash"), F.hash("sample_text").alias("more"), F.monotonically_increasing_id().alias("row"), "sample_text")
    texts = checkpointed(known.orderBy("hash", "more", "row").mapInArrow(worded, "words string").withColumn("id", F.monotonically_increasing_id()))
    starts, at = {}, 0
    for part, n in texts.groupBy(F.shiftright("id", 33).alias("part")).agg(F.count("*")).orderBy("part").collect():
        starts[part], at = at, at + n
    if not starts:
        return {}, {}, math.inf  # nothing tells English
    each = texts.mapInArrow(lambda it: lettered(it, starts), "fold int, three string, n bigint").groupBy("three")
    counts = each.agg(*(F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)) for k in range(FOLDS))).collect()
    letters = Letters.counted({three: sum(own) for three, *own in counts})
    others = [{three: n for three, *own in counts if (n := sum(own) - own[k])} or letters.three for k in range(FOLDS)]
    shared = samples.sparkSession.sparkContext.broadcast(others)
    # a sum of decimals is the same in any order
    exact = F.sum(F.col("backwards").cast("decimal(38,15)")).alias("backwards")
    found = texts.mapInArrow(lambda it: scored(it, starts, shared), "score double, backwards double").agg(F.min("score").alias("least"), exact).first()
    return letters.three, letters.two, found["least"] - FAR * max(0.0, found["least"] - float(found["backwards"]) / at)


def told(shared) -> tuple[Letters, float]:
    """Letters and least score of English, as broadcast."""
    three, two, least = shared.value["language"]
    return Letters(three, two), least


def counted(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: words of the English prose of a batch with their number."""
    letters, least = told(shared)
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            words = split_words(prose(text)) if text else []
            if words and letters.of(words) >= least:
                counts.update(words)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])


def needed(n: int) -> list[int]:
    """Of n words, how many make each of the shares."""
    return [math.ceil(share * n) for share in SHARES]


def measured(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over (doc_id, text): one row of measures per document; a rank beyond the table is NULL, and open_key then
    the digest of the text."""
    far = 1 << 60
    letters, least = told(shared)
    ranks = shared.value["ranks"]
    names = [x.split()[0] for x in OUTPUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * len(RANKS), pa.float64(), pa.float64(), pa.float64(), pa.string()]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            main = prose(text) if text else ""
            words = split_words(main)
            n = len(words)
            if not n:
                rows.append((doc, 0, False, *[None] * len(RANKS), 0.0, 0.0, 0.0, None))
                continue
            in_order = sorted([ranks.get(w, far) for w in words])
            covering = [in_order[k - 1] for k in needed(n)]
            english = letters.of(words) >= least
            lengths = sorted(filter(None, [sum(map(_has_sign, s.split())) for s in _END.split(main)])) or [n]
            rows.append(
                (
                    doc, sum(lengths), english, *[None if r == far else r for r in covering], math.log(n / len(lengths)),
                    math.log(lengths[math.ceil(0.9 * len(lengths)) - 1]), math.log((len(_MARK.findall(main)) + 0.5) / len(lengths)),
                    hashlib.md5(text.encode("utf-8", "replace")).hexdigest() if english and covering[-1] == far else None,
                )
            )
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _has_sign(word: str) -> bool:
    return word[0].isalnum() or any(map(str.isalnum, word))


def word_counts(docs: DataFrame, shared) -> DataFrame:
    """(word, n) over the English prose of all documents."""
    return docs.select("text").mapInArrow(lambda it: counted(it, shared), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def rank_table(counts: DataFrame, table_words: int) -> dict[str, int]:
    """Rank of each of the most frequent words: the number of words at least as frequent. Of a tie that the bound of
    the table would cut, no word is kept, so a rank never depends on the bound."""
    top = counts.orderBy(F.desc("n"), "word").limit(table_words + 1).collect()
    if len(top) > table_words:
        top = [r for r in top if r["n"] > top[-1]["n"]]
    ranks, at = {}, 0
    while at < len(top):
        end = at
        while end < len(top) and top[end]["n"] == top[at]["n"]:
            end += 1
        ranks |= {r["word"]: end for r in top[at:end]}
        at = end
    return ranks


def beyond_table(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(open_key, exact ranks) of texts (open_key, text) by a join of their words with all counts; unknown words rank last."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("words"))
    ranked = sizes.select("n", F.sum("words").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)).alias("rank"))
    words = counts.join(ranked, "n").select("word", "rank")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, times = [], [], []
            for key, text in zip(batch.column("open_key").to_pylist(), batch.column("text").to_pylist()):
                own = Counter(split_words(prose(text or "")))
                keys += [key] * len(own)
                found += own.keys()
                times += own.values()
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=["open_key", "word", "k"])

    each = docs.mapInArrow(split, "open_key string, word string, k bigint").join(words, "word", "left")
    each = each.select("open_key", "k", F.coalesce("rank", F.lit(1 << 60)).alias("rank"))
    of = Window.partitionBy("open_key")
    each = each.select("*", F.sum("k").over(of).alias("whole"), F.sum("k").over(of.orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)).alias("upto"))
    return each.groupBy("open_key").agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.lit(share) * F.col("whole")), F.col("rank"))).alias(f"exact_{name}") for share, name in zip(SHARES, RANKS)))


def measures(docs: DataFrame, counts: DataFrame, shared) -> DataFrame:
    rows = checkpointed(docs.select("doc_id", "text").mapInArrow(lambda it: measured(it, shared), OUTPUT))
    open_ = rows.where(F.col("open_key").isNotNull()).select("open_key").distinct()
    if not open_.isEmpty():
        rest = docs.select(F.md5("text").alias("open_key"), "text").join(open_, "open_key", "left_semi").dropDuplicates(["open_key"])
        rows = rows.join(beyond_table(rest, counts), "open_key", "left").select("*", *(F.coalesce(r, f"exact_{r}").alias(f"whole_{r}") for r in RANKS))
        rows = rows.drop(*RANKS, *(f"exact_{r}" for r in RANKS)).withColumnsRenamed({f"whole_{r}": r for r in RANKS})
    return rows.drop("open_key").select("*", *(F.log(F.col(r).cast("double")).alias(c) for r, c in zip(RANKS, COVERAGE)))


def calibrated(samples: DataFrame) -> list[tuple[int, list[float], float]]:
    """Of each band its weights of the measures and its constant: the linear discriminant of the samples, whose means by band and
    whose covariance within bands are found in SQL. ValueError for more than BANDS bands."""
    known = samples.where(F.col("band").isNotNull() & reduce(lambda a, b: a & b, (F.col(m).isNotNull() for m in MEASURES))).select("band", *MEASURES)
    means = known.groupBy("band").agg(F.count("*").alias("n"), *(F.avg(m).alias(f"{m}_mean") for m in MEASURES))
    rows = means.orderBy("band").limit(BANDS + 1).collect()
    if len(rows) > BANDS:
        raise ValueError(f"the samples have more than {BANDS} bands")
    if not rows:
        return []
    away = {m: F.col(m) - F.col(f"{m}_mean") for m in MEASURES}
    sums = known.join(F.broadcast(means), "band").agg(*(F.sum(away[x] * away[y]) for x in MEASURES for y in MEASURES)).first()
    free = max(1, sum(r["n"] for r in rows) - len(rows))
    within = np.array(sums, float).reshape(len(MEASURES), -1) / free + RIDGE * np.eye(len(MEASURES))
    out = []
    for r in rows:
        mean = np.array([r[f"{m}_mean"] for m in MEASURES])
        weights = np.linalg.solve(within, mean)
        out.append((r["band"], weights.tolist(), float(-0.5 * mean @ weights)))
    return out


def likelihood(weights: list[float], constant: float) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(w) * F.col(m) for w, m in zip(weights, MEASURES)), F.lit(constant))


def reading_levels(docs: DataFrame, samples: DataFrame, table_words: int = TABLE_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Measures and band of every document.

    docs (doc_id bigint, text string), samples (sample_id, band, sample_text). Columns: doc_id, n_words (of the main text), english,
    rank_40 to rank_90 (size of the smallest frequency-ranked vocabulary that covers 40 to 90 % of the words; NULL without words, or for other languages beyond the table), natural logarithms: coverage_40 to
    coverage_90 of the ranks, sentence of words per sentence, long_sentence of the length that nine in ten sentences don't exceed, marks of commas and the like
    per sentence; and band: the likeliest by all measures jointly, NULL where the main text isn't English prose of at least least_words words or
    no samples are given. NULL, empty and list-only documents have zero words. A repeated document has its row as often; documents
    with one id or none, but different texts, are measured each for itself.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    context = docs.sparkSession.sparkContext
    known = {"language": language(samples), "ranks": {}}
    first = context.broadcast(known)
    counts = checkpointed(word_counts(docs, first))
    shared = context.broadcast(known | {"ranks": rank_table(counts, table_words)})
    number = F.col("sample_id").cast("bigint").alias("doc_id")
    graded = measures(samples.select(number, F.col("sample_text").alias("text")), counts, shared)
    bands = calibrated(graded.join(samples.select(number, "band"), "doc_id"))
    rows = measures(docs, counts, shared)
    if not bands:
        return rows.withColumn("band", F.lit(None).cast("bigint"))
    rows = rows.withColumns({f"_{k}": likelihood(w, c) for k, (_, w, c) in enumerate(bands)})
    best = F.greatest(*(F.col(f"_{k}") for k in range(len(bands)))) if len(bands) > 1 else F.col("_0")
    band = F.coalesce(*(F.when(F.col(f"_{k}") == best, F.lit(b)) for k, (b, _, _) in enumerate(bands)))
    fits = F.col("english") & (F.col("n_words") >= least_words)
    return rows.withColumn("band", F.when(fits, band).cast("bigint")).drop(*(f"_{k}" for k in range(len(bands))))
