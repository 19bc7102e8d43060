"""Languages of documents and of their mixed-in segments, by compression against per-language dictionaries."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlake.llm.text import fold, sentences, without_links, words
from threadlake.plans.lineage import Stages
from threadlake.sources.tables import latest_units, table

LANGUAGES = ("en", "fr", "vi")
#: Spellings of the languages and of "unknown" in labels, compared in lower case before any region.
SPELLINGS = {"en": ("en", "eng", "english"), "fr": ("fr", "fra", "fre", "french", "francais"), "vi": ("vi", "vie", "vietnamese", "tieng viet")}
PLACEHOLDERS = ("", "?", "-", "und", "unk", "unknown", "undefined", "undetermined", "none", "null", "n/a", "na", "nan", "mul", "zxx", "xx", "other", "mixed")
#: Every dictionary starts from a little running text, so that no language is ever without one.
SEEDS = {
    "en": "this is what we have been doing with the others since then and it was not easy for them but they would like to know how you are and where you will be when it is over",
    "fr": "voila ce que nous avons fait avec les autres depuis ce temps et ce n'etait pas facile pour eux mais ils voudraient savoir comment vous allez et ou vous serez quand ce sera fini dans la ville",
    "vi": "day la nhung gi chung toi da lam voi moi nguoi tu do den nay va khong de dang cho ho nhung ho muon biet ban the nao va ban se o dau khi moi chuyen ket thuc trong thanh pho nay cua minh",
}
#: Labelled units per language that dictionaries are fitted on (chosen by hash), and characters a dictionary holds.
SAMPLE = 1500
SAMPLE_CHARS = 20_000
DICTIONARY_CHARS = 110_000
LEVEL = 9
#: Words of a whole sentence from which another language counts as a segment.
SEGMENT_WORDS = 8
#: Bytes that a change of language must save before it is believed.
SWITCH_BYTES = 5.0
#: The runner-up must need so many times the best size, else the language is rejected.
MARGIN = 1.04
#: Words per unit of decision where a stretch has no punctuation.
WINDOW = 6

_DIGIT = regex.compile(r"\p{N}")
_CLAUSE = regex.compile(r"[,;:()\"«»“”]+\s*")


@lru_cache(100_000)
def label_language(label: str | None) -> str | None:
    """The language a label names: a code of ``LANGUAGES``, ``other``, or None for a placeholder."""
    plain = fold(label or "").strip()
    if plain in PLACEHOLDERS:
        return None
    head = regex.split(r"[-_\s]", plain)[0]
    for code, names in SPELLINGS.items():
        if plain in names or head in names:
            return code
    return None if head in PLACEHOLDERS else "other"


class _Folded(dict):
    """Stretch without white space -> its folded words, None where a clause ends. Made when first met."""

    def __missing__(self, stretch: str) -> tuple[str | None, ...]:
        if len(self) > 400_000:
            self.clear()
        clauses = [words(c) for c in _CLAUSE.split(fold(stretch))]
        found = self[stretch] = tuple([w for k, c in enumerate(clauses) for w in ((None,) if k else ()) + tuple(c)])
        return found


_FOLDED = _Folded()


def chunks(text: str) -> list[tuple[int, str, int]]:
    """(sentence number, folded words with a letter, number of words) of the clauses of a text; long ones in windows."""
    out = []
    for k, sentence in enumerate(sentences(without_links(text))):
        w = list(chain.from_iterable(map(_FOLDED.__getitem__, sentence.split())))
        start = 0
        for end in [i for i, x in enumerate(w) if x is None] + [len(w)] if None in w else [len(w)]:
            n = end - start
            parts = max(1, round(n / (1.5 * WINDOW))) if n > 2 * WINDOW else 1
            for i in range(parts if n else 0):
                piece = w[start + n * i // parts : start + n * (i + 1) // parts]
                said = " ".join(piece)
                if _DIGIT.search(said):
                    said = " ".join([y for y in piece if not y.isnumeric()])
                if said:
                    out.append((k, said, len(piece)))
                elif out and out[-1][0] == k:  # numbers alone count with the clause before them
                    out[-1] = (k, out[-1][1], out[-1][2] + len(piece))
            start = end + 1
    return out


class CompressionClassifier:
    """Bytes that text needs when zstandard may refer to a raw-content dictionary of each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        self.compress = []
        for code in self.languages:
            d = zstandard.ZstdCompressionDict(dictionaries[code], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        self.empty = len(self.compress[0](b""))
        self.known: dict[str, tuple[int, ...]] = {}

    def sizes(self, chunk: str) -> tuple[int, ...]:
        found = self.known.get(chunk)
        if found is None:
            raw = (" " + chunk + " ").encode()
            found = tuple(len(c(raw)) - self.empty for c in self.compress)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[chunk] = found
        return found

    def label(self, parts: list[tuple[int, str, int]]) -> list[int]:
        """The cheapest sequence of languages over the chunks, a change costing ``SWITCH_BYTES``."""
        n = len(self.languages)
        cost, back = [0.0] * n, []
        for _, chunk, _ in parts:
            size = self.sizes(chunk)
            best = min(range(n), key=cost.__getitem__)
            step, frm = [], []
            for k in range(n):
                stay, change = cost[k], cost[best] + SWITCH_BYTES
                frm.append(k if stay <= change else best)
                step.append(min(stay, change) + size[k])
            cost = step
            back.append(frm)
        path, k = [], min(range(n), key=cost.__getitem__)
        for frm in reversed(back):
            path.append(k)
            k = frm[k]
        return path[::-1]

    def classify(self, text: str | None) -> dict:
        """main language, confidence, segments (lang, words, confidence) of other languages, rejected."""
        parts = chunks(text or "")
        if not parts:
            return {"lang": "und", "confidence": 1.0, "rejected": False, "segments": []}
        path = self.label(parts)
        count: dict[int, int] = defaultdict(int)
        for (_, _, n), k in zip(parts, path):
            count[k] += n
        main = max(sorted(count), key=lambda k: count[k])

        def sure(members, lang):
            total = [sum(self.sizes(c)[k] for _, c, _ in members) for k in range(len(self.languages))]
            other = min(t for k, t in enumerate(total) if k != lang)
            return other / max(total[lang], 1)

        ratio = sure([p for p, k in zip(parts, path) if k == main], main)
        segments, i = [], 0
        while i < len(parts):
            j = i
            while j < len(parts) and path[j] == path[i]:
                j += 1
            if path[i] != main:
                n = sum(p[2] for p in parts[i:j])
                r = sure(parts[i:j], path[i])
                whole: dict[int, int] = defaultdict(int)
                for k, _, m in parts[i:j]:
                    whole[k] += m
                if max(whole.values()) >= SEGMENT_WORDS and r >= MARGIN:
                    segments.append({"lang": self.languages[path[i]], "words": n, "confidence": 1 - 1 / (1 + math.exp(min(30.0, 6 * (r - 1))))})
            i = j
        return {"lang": self.languages[main], "confidence": 1 - 1 / (1 + math.exp(min(30.0, 6 * (ratio - 1)))), "rejected": ratio < MARGIN, "segments": segments}


def _dictionary(code: str, texts: list[str]) -> bytes:
    # zstandard finds the nearest text cheapest, so the seed goes to the far end
    return (" " + SEEDS[code] + " " + " ".join(texts) + " ").encode()


def _fold_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        folded = [" ".join(c for _, c, _ in chunks(t or "")) for t in b.column("full_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(folded, pa.string())], names=[*b.schema.names, "folded"])


def _agreeing(shared):
    """Rows whose text the other half's dictionaries find to be in the labelled language, whole and beyond doubt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = [_classifier(d) for d in shared.value]
        for b in batches:
            ok = []
            for code, half, text in zip(b.column("code").to_pylist(), b.column("half").to_pylist(), b.column("full_text").to_pylist()):
                found = judges[1 - half].classify(text)
                ok.append(found["lang"] == code and not found["segments"] and not found["rejected"])
            yield b.filter(pa.array(ok, pa.bool_()))

    return run


def fit(units: DataFrame, *, sample: int = SAMPLE) -> dict[str, bytes]:
    """Dictionaries per language from at most ``sample`` labelled units of each (chosen by the hash of their ids), of texts
    of 30 to ``SAMPLE_CHARS`` code points; the texts that fill ``DICTIONARY_CHARS`` in that order make the dictionary.

    Labels may be wrong: each half of the sample is judged with dictionaries of the other half, and only texts whose
    language agrees with their label and that hold no segment of another language go into the final dictionaries. Texts are
    folded and judged by the executors; the driver gets what fills the dictionaries.
    """
    spark = units.sparkSession
    sized = units.select("id", "built_at", "language_primary", F.char_length("full_text").alias("n"))
    # texts stay where they are until the sample is known
    narrow = latest_units(sized, "id", "language_primary", "n").filter(F.col("n").between(30, SAMPLE_CHARS) & F.col("language_primary").isNotNull())
    head = F.split(F.lower(F.trim("language_primary")), r"[-_\s]")[0]
    code = F.coalesce(*[F.when(head.isin(*names), F.lit(c)) for c, names in SPELLINGS.items()])
    spelled = narrow.select("id", code.alias("code"), F.xxhash64("id").alias("h")).filter("code is not null")
    with Stages(spark, "languages") as stages:
        spelled = stages.keep(spelled)
        # every task keeps its first ``sample`` rows of a language before any are brought together
        firsts = [spelled.filter(F.col("code") == c).orderBy("h", "id").limit(sample) for c in LANGUAGES]
        first = F.row_number().over(Window.partitionBy("code").orderBy("h", "id"))
        chosen = stages.keep(reduce(DataFrame.unionByName, firsts).withColumn("k", first))
        texts = latest_units(units.join(F.broadcast(chosen.select("id")), "id", "left_semi"), "id", "full_text")  # at most 3 * sample ids
        rows = texts.join(F.broadcast(chosen), "id").select("code", (F.col("k") % 2).cast("int").alias("half"), "k", "full_text")
        schema = "code string, half int, k int, full_text string"
        rows = stages.keep(rows.mapInArrow(_fold_texts, schema + ", folded string"))

        def dictionaries(rows: DataFrame, *by: str) -> dict:
            upto = F.sum(F.char_length("folded") + 1).over(Window.partitionBy("code", *by).orderBy("k"))
            got: dict = defaultdict(list)
            for r in rows.withColumn("upto", upto).filter(F.col("upto") <= DICTIONARY_CHARS).select("code", "half", "k", "folded").orderBy("k").collect():
                got[(r["code"], r["half"]) if by else r["code"]].append(r["folded"])
            return got

        for _ in range(2):
            halves = dictionaries(rows, "half")
            shared = spark.sparkContext.broadcast([{c: _dictionary(c, halves[c, k]) for c in LANGUAGES} for k in (0, 1)])
            spread = rows.repartition(max(2, spark.sparkContext.defaultParallelism), "k")
            rows = stages.keep(spread.mapInArrow(_agreeing(shared), schema + ", folded string"))
        whole = dictionaries(rows)
    return {c: _dictionary(c, whole[c]) for c in LANGUAGES}


_READY: dict[int, CompressionClassifier] = {}


def _classifier(dictionaries: dict[str, bytes]) -> CompressionClassifier:
    """The worker's classifier for these dictionaries; the oldest of more than three is let go."""
    key = hash(tuple(sorted(dictionaries.items())))
    if key not in _READY:
        while len(_READY) > 2:
            _READY.pop(next(iter(_READY)))
        _READY[key] = CompressionClassifier(dictionaries)
    return _READY[key]


_SEGMENT = pa.struct([("lang", pa.string()), ("words", pa.int32()), ("confidence", pa.float64())])


def _kernel(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _classifier(shared.value).classify
        for b in batches:
            texts = b.column("full_text").to_pylist()
            found = [judge(t) for t in texts]
            named = [label_language(x) for x in b.column("language_primary").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array([not t for t in texts], pa.bool_()),
                    pa.array(named, pa.string()),
                    pa.array([f["lang"] for f in found], pa.string()),
                    pa.array([f["confidence"] for f in found], pa.float64()),
                    pa.array([f["rejected"] for f in found], pa.bool_()),
                    pa.array([f["segments"] for f in found], pa.list_(_SEGMENT)),
                ],
                names=["unit_id", "no_text", "named", "lang", "confidence", "rejected", "segments"],
            )

    return run


def identify(units: DataFrame) -> DataFrame:
    """unit_id, no_text, named (language of the stored label), lang, confidence, rejected, segments of every unit.

    ``lang`` is that of most of the text's words: ``en``, ``fr``, ``vi``, or ``und`` for a text without letters (also null
    and empty texts). Segments are runs of at least eight words in another language, each with its own confidence. Texts
    are judged in folded form, so lost accents, letter case, Unicode form and invisible characters do not matter.
    ``rejected`` marks texts whose runner-up language compresses almost as well.

    Per id the latest row counts; whole texts of any length are read; an empty table gives an empty result; other columns
    are ignored. Fitting reads a bounded sample (``fit``); scoring shuffles only for the latest row per id.
    """
    shared = units.sparkSession.sparkContext.broadcast(fit(units))
    latest = latest_units(units, "id", "full_text", "language_primary")
    return latest.mapInArrow(
        _kernel(shared),
        "unit_id string, no_text boolean, named string, lang string, confidence double, rejected boolean, segments array<struct<lang:string,words:int,confidence:double>>",
    )


def found(units: DataFrame) -> DataFrame:
    """unit_id, kind (label, segment), lang. A rejected text is no case: its label is left as it is."""
    seen = identify(units)
    label = F.when(
        ~F.col("no_text") & ~F.col("rejected") & F.when(F.col("lang") == "und", F.col("named").isNotNull()).otherwise(F.col("named").isNull() | (F.col("named") != F.col("lang"))),
        F.array(F.struct(F.lit("label").alias("kind"), F.col("lang").alias("lang"))),
    )
    segment = F.transform(F.array_distinct("segments.lang"), lambda x: F.struct(F.lit("segment").alias("kind"), x.alias("lang")))
    empty = F.array().cast("array<struct<kind:string,lang:string>>")
    return seen.select("unit_id", F.explode(F.concat(F.coalesce(label, empty), segment)).alias("c")).select("unit_id", "c.kind", "c.lang")


def queries() -> dict:
    return {
        "p3_found": lambda s, d: found(table(s, d, "content_units")),
        "p3_languages": lambda s, d: identify(table(s, d, "content_units")).select("unit_id", "lang", F.round("confidence", 6).alias("confidence"), "rejected", F.to_json("segments").alias("segments")),
    }


def oracle_sql() -> dict[str, str]:
    return {}
