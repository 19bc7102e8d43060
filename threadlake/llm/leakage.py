"""Evaluation texts that leaked into a corpus: seeded n-gram scan, exact verification, removal of spans."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.llm.text import fold, words
from threadlake.sources.tables import table

#: Words of the n-grams in the broadcast set. A stretch of m >= 14 words with at most m / 7 edits has its intact words in so
#: few runs that one of them holds four, and it always holds three n-grams.
SEED = 4
SEEDS_NEEDED = 3
LEAST_WORDS = 14
#: One word in so many may be altered, left out or added.
ONE_IN = 7
#: Any leak with more edits holds a shorter one with at most this many (the intact runs of one that does not would be too long).
MOST_EDITS = 4
#: Edits that need no long run. A leak with more that holds no shorter one begins with ``LONG_RUN`` intact words: its first
#: runs but one, with the edits between them, must fall short of the words that one edit less would need.
FEW_EDITS, LONG_RUN = 2, 7
#: An alone run of at most so many words needs an intact word right after a single edit: two edits and SEED - 1 words are too few.
SHORT_RUN = LEAST_WORDS - FEW_EDITS - SEED
#: Characters of evaluation texts per broadcast (some 350 000 n-grams); a larger collection is scanned in several passes.
BLOCK_CHARS = 2_000_000

#: A word with the invisible and control characters inside it.
_TOKEN = regex.compile(r"[\p{L}\p{N}\p{M}\p{Cf}\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]+")


def _parts(text: str) -> list[tuple[str, int, int]]:
    """Folded words with the places of the token that holds them."""
    return [(w, *m.span()) for m in _TOKEN.finditer(text) for w in words(fold(m.group()))]


class _Numbers(dict):
    """Stretch without white space -> numbers of its words; -1 for a word that no item holds. Made when first met."""

    def __init__(self, number: dict[str, int]):
        self.number = number

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        found = self[stretch] = tuple([self.number.get(w, -1) for w, _, _ in _parts(stretch)])
        return found


class LeakIndex:
    """Seeds of evaluation items and the check of their surroundings."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        self.texts: list[list[int]] = []
        seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            w = [self.number.setdefault(x, len(self.number)) for x, _, _ in _parts(text)]
            self.texts.append(w)
            if len(w) >= LEAST_WORDS:
                for p in range(len(w) - SEED + 1):
                    seeds[tuple(w[p : p + SEED])].append((k, p))
        self.seeds = dict(seeds)
        self.numbers = _Numbers(self.number)

    @staticmethod
    def _goes_on(item: list[int], doc: list[int], i: int, j: int, step: int) -> bool:
        """Whether an intact word follows one word altered, left out or added at places i, j."""
        for a, b in ((i + step, j + step), (i + step, j), (i, j + step)):
            if 0 <= a < len(item) and 0 <= b < len(doc) and item[a] == doc[b]:
                return True
        return False

    @staticmethod
    def _reach(item: list[int], doc: list[int], i: int, j: int, step: int, edits: int) -> list[tuple[int, int]]:
        """By number of edits: the furthest (item words, document words) from places i, j on in direction ``step`` that end
        with an intact word."""
        n, m = (len(item) - i, len(doc) - j) if step > 0 else (i + 1, j + 1)
        best = [(0, 0)]
        front = {0: 0}  # by surplus of document words: item words used up
        for _ in range(edits):
            longer: dict[int, int] = {}
            for d, a in front.items():
                for d2, a2 in ((d, a + 1), (d - 1, a + 1), (d + 1, a)):  # altered, left out, added
                    if a2 <= n and 0 <= a2 + d2 <= m and a2 > longer.get(d2, -1):
                        longer[d2] = a2
            top = best[-1]
            for d, a in longer.items():
                b = a
                while b < n and b + d < m and item[i + step * b] == doc[j + step * (b + d)]:
                    b += 1
                longer[d] = b
                if b > a and b > top[0]:
                    top = (b, b + d)
            best.append(top)
            front = longer
        return best

    def _check(self, item: list[int], doc: list[int], hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Word spans of the document that hold a leak; hits: (item place, doc place) of seeds, by doc place.

        Seeds that follow each other on a diagonal are one run of intact words. Every leak holds such a run, and what can be
        added before and after it are independent: the furthest reaches by number of edits are found once per run, so the
        work is in proportion to the hits.
        """
        runs: list[list[int]] = []  # item place, doc place, words
        last: dict[int, list[int]] = {}
        for p, j in hits:
            run = last.get(j - p)
            if run is not None and run[1] + run[2] - SEED + 1 == j:
                run[2] += 1
            else:
                last[j - p] = run = [p, j, SEED]
                runs.append(run)
        crowd = Counter([r[1] - r[0] for r in runs])
        spans: list[tuple[int, int]] = []
        for p, j, n in runs:
            # Without another run on a neighbouring diagonal an edit wins at most SEED - 1 intact words: a short run stays short.
            if n <= SHORT_RUN and sum([crowd.get(j - p + d, 0) for d in range(-MOST_EDITS, MOST_EDITS + 1)]) == 1:
                if n + FEW_EDITS * SEED < LEAST_WORDS or not (self._goes_on(item, doc, p + n, j + n, 1) or self._goes_on(item, doc, p - 1, j - 1, -1)):
                    continue
            edits = MOST_EDITS if n >= LONG_RUN else FEW_EDITS
            after = self._reach(item, doc, p + n, j + n, 1, edits)
            before = self._reach(item, doc, p - 1, j - 1, -1, edits)
            found = None
            for x in range(edits + 1):
                for y in range(edits + 1 - x):
                    m = before[x][0] + n + after[y][0]
                    if m >= LEAST_WORDS and ONE_IN * (x + y) <= m:
                        a, z = j - before[x][1], j + n + after[y][1]
                        if found is None or z - a > found[1] - found[0]:
                            found = (a, z)
            if found:
                spans.append(found)
        merged: list[tuple[int, int]] = []
        for a, z in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(merged[-1][1], z))
            else:
                merged.append((a, z))
        return merged

    def scan(self, text: str | None) -> dict[int, list[tuple[int, int]]]:
        """Item id -> code point spans of the text that leaked from it."""
        if not text:
            return {}
        doc = list(chain.from_iterable(map(self.numbers.__getitem__, text.split())))
        if len(doc) < LEAST_WORDS - LEAST_WORDS // ONE_IN:
            return {}
        hits = defaultdict(list)
        seen = self.seeds.get
        for j, found in enumerate(map(seen, zip(doc, doc[1:], doc[2:], doc[3:]))):
            if found is not None:
                for k, p in found:
                    hits[k].append((p, j))
        out, places = {}, None
        for k, h in hits.items():
            if len(h) >= SEEDS_NEEDED and (spans := self._check(self.texts[k], doc, h)):
                places = places or _parts(text)  # only documents with a leak need the places of their words
                out[self.ids[k]] = [(places[a][1], places[z - 1][2]) for a, z in spans]
        return out


_INDEX: dict[int, LeakIndex] = {}


def _index(shared) -> LeakIndex:
    """The worker's index of a broadcast block; blocks of earlier queries are let go."""
    items = shared.value
    key = hash(tuple(items))
    if key not in _INDEX:
        while len(_INDEX) > 1:
            _INDEX.pop(next(iter(_INDEX)))
        _INDEX[key] = LeakIndex(items)
    return _INDEX[key]


def _spans(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _index(shared).scan
        for b in batches:
            doc, item, start, end = [], [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for k, spans in scan(t).items():
                    for a, z in spans:
                        doc.append(d)
                        item.append(k)
                        start.append(a)
                        end.append(z)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "item_id", "leak_start", "leak_end"]
            )

    return run


def leak_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, leak_start, leak_end (code points of text): the stretches that an item leaked to, overlapping ones joined.

    At least 14 consecutive words of the item stand in the document in order, from a word to a word that are intact, with
    at most one in seven altered, left out or added. Words are compared in folded form: case, accents, punctuation,
    symbols, spacing, Unicode form, invisible and control characters do not matter.

    The items' four-word sequences are broadcast as a hash set and every document's windows are scanned for them where the
    document lies, without a shuffle; runs of them lead to an exact alignment with what stands before and after. Items larger than
    one broadcast block are scanned block by block. Null, empty and short texts and items give no rows; a repeated document
    row gives its rows again; empty tables give an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    given = items.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    chars = given.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        rows = given.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])
        part = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_spans(shared), "doc_id long, item_id long, leak_start int, leak_end int")
        out = part if out is None else out.unionByName(part)
    return out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every leak, once. Spans of one pair come from one task, so this distinct combines map-side."""
    return leak_spans(documents, items).select("doc_id", "item_id").distinct()


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, n_documents, n_spans of the items that leaked."""
    return leak_spans(documents, items).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.count("*").alias("n_spans"))


def cleaned(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text of every document that leaks were found in, with the leaked spans cut out.

    Overlapping spans are merged per document before the cut; the number of spans is bounded by the document's own words.
    """
    spans = leak_spans(documents, items).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("leak_start", "leak_end"))).alias("spans"))
    hit = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(spans, "doc_id")
    step = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda s, x: F.struct(
            F.concat(s["kept"], F.col("text").substr(s["at"] + 1, F.greatest(x["leak_start"] - s["at"], F.lit(0)))).alias("kept"),
            F.greatest(s["at"], x["leak_end"]).alias("at"),
        ),
    )
    return hit.withColumn("s", step).select("doc_id", F.concat(F.col("s.kept"), F.col("text").substr(F.col("s.at") + 1, F.char_length("text"))).alias("text"))


def queries() -> dict:
    def both(f):
        return lambda s, d: f(table(s, d, "documents"), table(s, d, "eval_items"))

    return {"p8_found": both(found), "p8_report": both(report), "p8_cleaned": both(cleaned)}


def oracle_sql() -> dict[str, str]:
    return {}
