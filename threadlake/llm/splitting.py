"""Splitting oversized items at natural boundaries by pointer doubling over successor tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.sources.tables import latest_units, merged_posts, table

LIMIT = 500
OVERLAP = 60
LEVELS = ("post", "line", "sentence", "word")
MARKS = frozenset(".!?…")
#: Code points of text that one vectorised chunk holds (a longer text makes a chunk of its own).
CHUNK = 4_000_000
_WORD = re.compile(r"\S+")


def _words(text: str, post_starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the level of the boundary before each: 0 post, 1 line, 2 sentence, 3 word."""
    spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    start, end = spans[:, 0], spans[:, 1]
    level = np.full(len(start), 3, np.int8)
    if len(start):
        before = end[:-1].tolist()
        gaps = [1 if "\n" in text[a:b] else 2 if text[a - 1] in MARKS else 3 for a, b in zip(before, start[1:].tolist())]
        level[1:] = gaps
        at = np.searchsorted(start, np.asarray(post_starts, np.int64))
        level[at[at < len(start)]] = 0
        level[0] = 0
    return start, end, level


def _blocks(start: np.ndarray, end: np.ndarray, level: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words longer than ``size`` cut into blocks; the boundaries inside a word have level 4."""
    if not len(start) or (end - start).max() <= size:
        return start, end, level
    parts = -(-(end - start) // size)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    s = np.repeat(start, parts) + k * size
    return s, np.minimum(s + size, np.repeat(end, parts)), np.where(k > 0, 4, np.repeat(level, parts)).astype(np.int8)


def _reach(successor: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks what the chains from ``first`` visit: the successor table is squared until every chain stands still, then
    the tables are applied from the longest jump to the shortest, each doubling the marked set."""
    tables, at = [successor], successor[first]
    while True:
        last = tables[-1]
        square = last[last]
        if np.array_equal(square[first], at):
            break
        tables.append(square)
        at = square[first]
    marked = np.zeros(len(successor), bool)
    marked[first] = True
    for t in reversed(tables):
        marked[t[np.flatnonzero(marked)]] = True
    return marked


def _last_at_or_before(flag: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))


def split_texts(texts: list[str], post_starts: list[list[int]], limit: int = LIMIT, overlap: int = OVERLAP):
    """For each text its cut level and its pieces as ``(start, end, repeated, level)`` in code points."""
    block = limit - overlap
    words = [_words(t, p) for t, p in zip(texts, post_starts)]
    # One number line for all texts: every text gets its own far apart stretch of positions, so one search serves all.
    offset = np.concatenate([[0], np.cumsum([len(t) + 2 * limit for t in texts])]).astype(np.int64)
    raw = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*[(s + o, e + o, v) for (s, e, v), o in zip(words, offset)])]
    count = np.array([len(w[0]) for w in words])
    cut = np.full(len(texts), len(LEVELS))
    for lv in range(len(LEVELS) - 1, -1, -1):
        # Stretches of this level; the farthest successor of a stretch is found by one search over all ends.
        heads = np.flatnonzero(raw[2] <= lv)
        tails = np.append(heads[1:], len(raw[0])) - 1
        doc = np.searchsorted(np.cumsum(count), heads, "right")
        s, e = raw[0][heads], raw[1][tails]
        own = np.flatnonzero(count > 0)
        n = len(heads)
        far = np.searchsorted(e, s + limit, "right")
        stop = np.searchsorted(doc, doc, "right")
        far = np.minimum(far, stop)  # the end of a text is the head of the next one: chains stop there
        first = np.searchsorted(doc, own)
        # a text's end state is n + its number; a stretch over the limit keeps its own place
        target = np.where(far >= stop, n + doc, np.maximum(far, np.arange(n)))
        target = np.concatenate([target, n + np.arange(len(texts))])
        jump = target
        while True:
            square = jump[jump]
            if np.array_equal(square[first], jump[first]):
                break
            jump = square
        cut[own[jump[first] >= n]] = lv
    # Pieces: mixed levels, the coarsest boundary in reach wins.
    parts = [_blocks(*w, block) for w in words]
    start, end, level = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*[(s + o, e + o, v) for (s, e, v), o in zip(parts, offset)])]
    count = np.array([len(p[0]) for p in parts])
    n = len(start)
    out: list[list[tuple[int, int, int, str]]] = [[] for _ in texts]
    if n:
        doc = np.repeat(np.arange(len(texts)), count)
        first = (np.cumsum(count) - count)[count > 0]
        stop = np.cumsum(count)[doc]
        begin = start.copy()
        inner = np.ones(n, bool)
        inner[first] = False
        i = np.flatnonzero(inner)
        back = end[i - 1] - overlap
        is_word = level < 4
        word_start = start[is_word]
        w = np.searchsorted(word_start, back)
        candidate = word_start[np.minimum(w, len(word_start) - 1)]
        at_word = (w < len(word_start)) & (candidate < end[i - 1])
        from_ = np.where(at_word, candidate, np.maximum(back, start[(np.cumsum(count) - count)[doc[i]]]))
        from_ = np.where(end[i] - from_ > limit, start[i], from_)  # a long stretch of white space between the words
        begin[i] = from_
        far = np.minimum(np.searchsorted(end, begin + limit, "right"), stop)
        boundary = np.append(level, 0)
        boundary[np.cumsum(count)[count > 0]] = 0
        successor, why = np.full(n, -1), np.full(n, 4)
        for lv in range(5):
            c = _last_at_or_before(boundary <= lv)[far]
            use = (successor < 0) & (c > np.arange(n))
            successor[use], why[use] = c[use], lv
        target = np.where(successor >= stop, n + doc, successor)
        target = np.concatenate([target, n + np.arange(len(texts))])
        marked = np.flatnonzero(_reach(target, first)[:n])
        names = [*LEVELS, "inside_word"]
        o = offset[doc[marked]]
        repeated = np.where(inner[marked], np.maximum(end[marked - 1] - begin[marked], 0), 0)
        for d, a, b, r, y in zip(doc[marked].tolist(), (begin[marked] - o).tolist(), (end[successor[marked] - 1] - o).tolist(), repeated.tolist(), why[marked].tolist()):
            out[d].append((a, b, r, names[y]))
    return [([*LEVELS, "none"][c], p) for c, p in zip(cut, out)]


def _hash(text: str) -> int:
    """Spark's ``xxhash64`` of a string."""
    return int.from_bytes(xxhash.xxh64(text.encode(), seed=42).digest(), "big", signed=True)


def _true_starts(text: str, members: list[dict], stored: list[dict]) -> list[int]:
    """Where the true post stretches of a text begin.

    ``members``: length and hash of the posts' texts in order. Where they add up to the text and every stretch hashes to its
    post, they settle it. Else a stored span counts if the stretch that it names hashes to its post's text.
    """
    lengths = [m["n"] for m in members]
    starts = [0, *accumulate(n + 1 for n in lengths)]
    if members and starts[-1] == len(text) + 1 and all(_hash(text[a : a + m["n"]]) == m["h"] for a, m in zip(starts, members)):
        return starts[:-1]
    return sorted({0, *(s["a"] for s in stored if _hash(text[s["a"] : s["b"]]) == s["h"])})


def _kernel(limit: int, overlap: int, with_text: bool):
    piece = pa.struct([("piece_start", pa.int32()), ("piece_end", pa.int32()), ("repeated", pa.int32()), ("cut_at", pa.string()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, members, stored = (b.column(c).to_pylist() for c in ("id", "full_text", "members", "stored"))
            i = 0
            while i < len(texts):
                j, size = i + 1, len(texts[i])
                while j < len(texts) and size + len(texts[j]) <= CHUNK:
                    size += len(texts[j])
                    j += 1
                starts = [_true_starts(t, m or [], s or []) for t, m, s in zip(texts[i:j], members[i:j], stored[i:j])]
                found = split_texts(texts[i:j], starts, limit, overlap)
                pieces = [[(a, z, r, y, t[a:z] if with_text else None) for a, z, r, y in p] for t, (_, p) in zip(texts[i:j], found)]
                columns = list(zip(*chain.from_iterable(pieces))) or [()] * 5
                offsets = np.cumsum([0, *map(len, pieces)]).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, piece)], fields=list(piece))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], pa.string()), pa.array([c for c, _ in found], pa.string()), pa.ListArray.from_arrays(offsets, flat)], names=["unit_id", "cut_level", "pieces"])
                i = j

    return run


_MEMBERS = "array<string>"


def _post_texts(posts: DataFrame) -> DataFrame:
    """post_id, n, h: length and hash of the text of every post that has one; texts themselves are not shuffled."""
    sized = posts.select("id", F.when(F.col("text") != "", F.struct(F.char_length("text").alias("n"), F.xxhash64("text").alias("h"))).alias("x"))
    return merged_posts(sized, "id", "x").filter("x is not null").select(F.col("id").alias("post_id"), "x.n", "x.h")


def _members(units: DataFrame) -> DataFrame:
    """id, k, post_id: the posts of a unit in order, its root first."""
    return units.select("id", F.posexplode(F.concat(F.array("id"), F.coalesce(F.from_json("continuation_ids_json", _MEMBERS), F.array().cast(_MEMBERS)))).alias("k", "post_id"))


def _stored(spans: DataFrame) -> DataFrame:
    """Stored spans that name a stretch, once each."""
    named = spans.select("unit_id", "post_id", F.col("span_start").alias("a"), F.col("span_end").alias("b"))
    return named.filter("unit_id is not null and post_id is not null and a >= 0 and b > a").distinct()


def split_units(units: DataFrame, posts: DataFrame, spans: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = False) -> DataFrame:
    """unit_id, cut_level, pieces of every unit whose text is longer than ``limit`` code points.

    Per id the row with the latest ``built_at`` counts (see ``latest_units``). The stretches of its posts follow from lengths and
    hashes of ``posts.text`` in the order of ``continuation_ids_json``; where they do not make up the text (an unknown post, a
    malformed list), those stored spans count whose stretch is the text of their post, so wrong, null or repeated spans play no
    part. Lengths and hashes are shuffled, never post texts. Without any true stretch the whole text counts as one.

    A piece runs to the farthest boundary of the coarsest kind within its ``limit``: post, line, sentence, word, else
    inside an overlong word. Each piece after the first begins ``overlap`` code points before its predecessor's end, or
    later if only so it begins at a word. Per batch of texts every boundary gets its farthest legal successor by one sorted
    search; squaring the successor tables yields all greedy cuts at once. ``with_text`` adds each piece's text.

    Null, empty and short texts give no row; a text of white space alone gives no pieces (cut_level ``post``); ties and
    repeated rows count once; empty tables give an empty result; other columns are ignored. A text is one row and is cut
    where it lies, so a hot source or unit causes no large task.
    """
    latest = latest_units(units, "id", "continuation_ids_json", "full_text").filter(F.char_length("full_text") > limit)
    texts = _post_texts(posts)
    listed = _members(latest).select("id", "post_id", F.struct("k", F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b")).alias("x"))
    long_ = latest.select("id")
    named = _stored(spans).withColumnRenamed("unit_id", "id").join(long_, "id", "left_semi").select("id", "post_id", F.struct(F.lit(None).cast("int").alias("k"), "a", "b").alias("x"))
    both = listed.unionByName(named).join(texts, "post_id").groupBy("id").agg(F.collect_list(F.struct("x.k", "n", "h", "x.a", "x.b")).alias("s"))
    member = F.transform(F.array_sort(F.filter("s", lambda x: x["k"].isNotNull())), lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h")))
    span = F.transform(F.filter("s", lambda x: x["a"].isNotNull()), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["h"].alias("h")))
    stretches = both.select("id", member.alias("members"), span.alias("stored"))
    rows = latest.select("id", "full_text").join(stretches, "id", "left")
    return rows.mapInArrow(
        _kernel(limit, overlap, with_text),
        "unit_id string, cut_level string, pieces array<struct<piece_start:int,piece_end:int,repeated:int,cut_at:string,piece:string>>",
    )


def pieces(units: DataFrame, posts: DataFrame, spans: DataFrame, **options) -> DataFrame:
    """unit_id, piece_no, piece_start, piece_end, repeated, cut_at, piece: the pieces with their texts."""
    return split_units(units, posts, spans, with_text=True, **options).select("unit_id", F.posexplode("pieces").alias("piece_no", "p")).select("unit_id", "piece_no", "p.*")


def span_findings(units: DataFrame, posts: DataFrame, spans: DataFrame) -> DataFrame:
    """unit_id, post_id, finding of the posts with text in units whose texts make it up: ``wrong`` if a stored span of the post
    names another stretch, ``missing`` if none names any, ``right`` else. Repeated rows count once."""
    latest = latest_units(units, "id", "continuation_ids_json", "full_text").select("id", "continuation_ids_json", F.char_length("full_text").alias("length"))
    known = _members(latest).join(_post_texts(posts), "post_id").select("id", "k", "post_id", "n")
    order = Window.partitionBy("id").orderBy("k")
    placed = known.withColumn("start", F.sum(F.col("n") + 1).over(order) - F.col("n") - 1)
    whole = placed.groupBy("id").agg(F.max(F.col("start") + F.col("n")).alias("end")).join(latest.select("id", "length"), "id").filter("end = length").select("id")
    true = placed.join(whole, "id", "left_semi").select(F.col("id").alias("unit_id"), "post_id", "start", (F.col("start") + F.col("n")).alias("end"))
    j = true.join(_stored(spans), ["unit_id", "post_id"], "left")
    off = F.count_if(F.col("a").isNotNull() & ((F.col("a") != F.col("start")) | (F.col("b") != F.col("end"))))
    finding = F.when(off > 0, "wrong").when(F.count("a") == 0, "missing").otherwise("right")
    return j.groupBy("unit_id", "post_id").agg(finding.alias("finding"))


def _on(f, **options):
    return lambda s, d: f(table(s, d, "content_units"), table(s, d, "posts"), table(s, d, "post_spans"), **options)


def _found(spark, d):
    return _on(split_units)(spark, d).select("unit_id", "cut_level")


def queries() -> dict:
    return {"p1_found": _found, "p1_pieces": _on(pieces), "p1_spans": _on(span_findings)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": r"""
WITH u AS (SELECT id, arg_max(full_text, built_at) AS t, arg_max(continuation_ids_json, built_at) AS c FROM content_units GROUP BY id),
l AS (SELECT * FROM u WHERE length(t) > 500),
p AS (SELECT id, max(text) AS text FROM posts GROUP BY id HAVING max(text) <> ''),
m AS (SELECT id, id AS post_id FROM l UNION ALL SELECT id, unnest(from_json(c, '["VARCHAR"]')) FROM l),
s0 AS (SELECT m.id, p.text AS x FROM m JOIN p ON p.id = m.post_id),
s1 AS (SELECT id, unnest(string_split(x, chr(10))) AS x FROM s0),
s2 AS (SELECT id, unnest(string_split(regexp_replace(x, '([.!?…])\s', '\1' || chr(10), 'g'), chr(10))) AS x FROM s1),
s3 AS (SELECT id, unnest(regexp_split_to_array(x, '\s')) AS x FROM s2),
n AS (SELECT id, 0 AS lv, x FROM s0 UNION ALL SELECT id, 1, x FROM s1 UNION ALL SELECT id, 2, x FROM s2 UNION ALL SELECT id, 3, x FROM s3),
g AS (SELECT id, lv, max(length(regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS longest FROM n GROUP BY id, lv)
SELECT l.id AS unit_id, coalesce(list_extract(['post', 'line', 'sentence', 'word'], (min(lv) FILTER (longest <= 500) + 1)::INT), 'none') AS cut_level
FROM l LEFT JOIN g ON l.id = g.id GROUP BY l.id""",
        "p1_spans": """
WITH u AS (SELECT id, length(arg_max(full_text, built_at)) AS len, arg_max(continuation_ids_json, built_at) AS c FROM content_units GROUP BY id),
p AS (SELECT id, length(max(text)) AS n FROM posts GROUP BY id HAVING max(text) <> ''),
m AS (SELECT id, 0 AS k, id AS post_id FROM u UNION ALL SELECT id, unnest(range(1, len(l) + 1)), unnest(l) FROM (SELECT id, from_json(c, '["VARCHAR"]') AS l FROM u WHERE c IS NOT NULL) q),
s AS (SELECT m.id, post_id, (sum(n + 1) OVER (PARTITION BY m.id ORDER BY k) - n - 1)::BIGINT AS a, n FROM m JOIN p ON p.id = m.post_id),
w AS (SELECT s.id FROM s JOIN u ON u.id = s.id GROUP BY s.id, len HAVING max(a + n) = len),
g AS (SELECT DISTINCT unit_id, post_id, span_start AS x, span_end AS y FROM post_spans WHERE span_start >= 0 AND span_end > span_start)
SELECT s.id AS unit_id, s.post_id, CASE WHEN count(*) FILTER (x <> a OR y <> a + n) > 0 THEN 'wrong' WHEN count(x) = 0 THEN 'missing' ELSE 'right' END AS finding
FROM s LEFT JOIN g ON g.unit_id = s.id AND g.post_id = s.post_id WHERE s.id IN (SELECT id FROM w) GROUP BY s.id, s.post_id""",
    }
