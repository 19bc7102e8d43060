import random
import unicodedata

import pytest

from tests.conftest import rows
from tests.oracle import compare
from threadlake.llm import languages, leakage, registry, splitting, subjects, text

EN = "the two of us cooked the rice noodles near the river and honestly it was worth it"
FR = "mon voisin a visité le studio meublé sous la pluie parce que les règles ont encore changé"
VI = "cả nhóm nhỏ nướng nồi nước dùng bò dưới chân cầu nhưng bước tiếp theo vẫn chưa rõ"
UNIT = "id string, full_text string, language_primary string, built_at int, lang string, named string"


def test_fold():
    assert text.fold("ĐẶNG Ｆｕｌｌ ab\u2060c\u00ad") == "dang full abc" == text.fold(unicodedata.normalize("NFD", "Đặng full abc"))
    assert text.sentences("One two.☕ Three :) Four\nfive - six…") == ["One two", "Three ", "Four", "five", "six"]


def test_label_spellings():
    assert [languages.label_language(x) for x in ("vi-VN", "Vietnamese", "FRA", "en_us", " English ", "?", None, "", "unknown", "de")] == ["vi", "vi", "fr", "en", "en", None, None, None, None, "other"]


@pytest.fixture(scope="module")
def units(spark):
    rng = random.Random(9)
    base = {"en": EN, "fr": FR, "vi": VI}
    rows_ = []
    for k in range(60):
        code = rng.choice(sorted(base))
        w = base[code].split()
        cut = [" ".join(w[a : a + rng.randint(9, 14)]) for a in (0, 1, 2, 3)]
        rows_.append((f"{k:03d}", ". ".join(cut) + ".", {"en": "en", "fr": "fr", "vi": "vi"}[code] if k % 11 else rng.choice(["en", "fr", "vi"]), 1, "x", "x"))
    return rows_


def test_languages(spark, units):
    mixed = f"{VI}. {VI}. {FR}."
    special = [
        ("a", f"{VI}. {VI}", "fr", 1, "x", "x"), ("b", f"{FR}. {FR}", None, 1, "x", "x"), ("c", mixed, "vi-VN", 1, "x", "x"), ("d", "😀 123 !!", "en", 1, "x", "x"), ("e", "😀 123", "?", 1, "x", "x"),
        ("f", "", None, 1, "x", "x"), ("g", None, None, 1, "x", "x"), ("h", f"{VI} meeting. {VI}", "VI", 1, "x", "x"), ("i", text.fold(f"{VI}. {VI}"), "vie", 1, "x", "x"), ("i", EN, "vie", 0, "x", "x"),
        ("j", f"{EN} {EN} {EN} {EN} {EN} {EN} {EN} {EN}" * 40, "en", 1, "x", "x"), (None, EN, "fr", 1, "x", "x"),
    ]
    df = spark.createDataFrame(units + special, UNIT)
    got = [r for r in rows(languages.found(df)) if not r[0].isdigit()]
    assert got == [("a", "label", "vi"), ("b", "label", "fr"), ("c", "segment", "fr"), ("d", "label", "und")]
    seen = {r.unit_id: r for r in languages.identify(df).collect()}
    assert seen["c"].lang == "vi" and seen["c"].segments[0].words >= 8 and 0.5 < seen["c"].confidence <= 1
    assert languages.found(df.limit(0)).count() == 0


def test_numbers_count_as_words_of_a_sentence():
    assert languages.chunks("Nous avons vu 12 films, en 2024. 7") == [(0, "nous avons vu films", 5), (0, "en", 2)]
    assert languages.chunks("») « 12, !") == [] and languages.chunks("") == []


ITEMS = [(1, " ".join(f"eval{chr(97 + k % 26)}{k}" for k in range(60)), "en"), (2, None, "en"), (3, "too short to leak", "en"), (4, "", "vi")]


def edits(words, where, rng):
    out = list(words)
    for p in sorted(where, reverse=True):
        kind = rng.choice("sdi")
        out[p : p + (kind != "i")] = [] if kind == "d" else ["noise"]
    return out


def strict(item, doc):
    """A stretch of at least 14 item words from an intact word to an intact word, at most one edit in seven, by edit distance."""
    for i0 in range(len(item) - 13):
        for j0 in [j for j, w in enumerate(doc) if w == item[i0]]:
            prev = list(range(len(doc) - j0 + 1))
            for m in range(1, min(42, len(item) - i0) + 1):
                cur = [m]
                for j in range(1, len(prev)):
                    same = item[i0 + m - 1] == doc[j0 + j - 1]
                    cur.append(min(prev[j - 1] + (not same), prev[j] + 1, cur[j - 1] + 1))
                    if m >= 14 and same and 7 * prev[j - 1] <= m:
                        return True
                prev = cur
    return False


def test_leaks_equal_edit_distance():
    rng = random.Random(10)
    index = leakage.LeakIndex([(1, ITEMS[0][1])])
    words = ITEMS[0][1].split()
    hits = 0
    for trial in range(500):
        n = rng.randint(9, 42)
        a = rng.randint(0, 60 - n)
        inner = rng.sample(range(1, n - 1), min(n - 2, rng.randint(0, 6)))
        if trial % 2:  # neighbouring edits leave long runs at the ends
            at = rng.randint(1, n - 2)
            inner = sorted({min(n - 2, max(1, at + rng.randint(-3, 3))) for _ in inner})
        doc = ["before"] * 3 + edits(words[a : a + n], inner, rng) + ["after"] * 3
        wanted = strict(words, doc)
        assert bool(index.scan(" ".join(doc))) == wanted, (words[a : a + n], doc)
        hits += wanted
    assert 200 < hits < 480
    shuffled = words[:20]
    rng.shuffle(shuffled)
    assert not index.scan(" ".join(shuffled))


def test_four_edits_in_a_row_are_one_leak():
    words = ITEMS[0][1].split()
    index = leakage.LeakIndex([(1, ITEMS[0][1])])
    for n in (12, 13):
        doc = " ".join([*words[:n], *["noise"] * 4, *words[n + 4 : 2 * n + 4]])
        assert index.scan(doc) == {1: [(0, len(doc))]}


def test_repeated_item_costs_in_proportion():
    index = leakage.LeakIndex([(1, ITEMS[0][1])])

    def calls(times):
        n = 0
        reach = leakage.LeakIndex._reach

        def counted(*a):
            nonlocal n
            n += 1
            return reach(*a)

        index._reach = counted
        assert index.scan(" and ".join([ITEMS[0][1]] * times))
        return n

    assert calls(80) <= 8 * calls(10)


def test_leak_query_edge_cases(spark):
    w = ITEMS[0][1].split()
    hidden = " ".join(f"{x[:2]}\u200b{x[2:]}".upper() for x in w[5:25])
    docs = [(1, "start " + " ".join(w[10:30]) + " end", "x"), (2, hidden, "x"), (3, " ".join(w[:13]), "x"), (4, None, "x"), (5, "", "x"), (6, ("filler " * 3000) + " ".join(w[:20]), "x"), (1, "start " + " ".join(w[10:30]) + " end", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(ITEMS, "item_id long, text string, lang string")
    assert rows(leakage.found(d, i)) == [(1, 1), (2, 1), (6, 1)]
    assert {r.doc_id: r.text for r in leakage.cleaned(d, i).collect()}[1] == "start  end"
    assert leakage.report(d, i).first().n_documents == 3
    assert leakage.found(d.limit(0), i).count() == leakage.found(d, i.limit(0)).count() == 0


def test_leak_blocks_give_the_same(spark, monkeypatch, data):
    d, i = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    one = rows(leakage.found(d, i))
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 40_000)
    assert rows(leakage.found(d, i)) == one and one


def test_subjects_on_held_out_documents(spark):
    """Accuracy on documents the model has not seen, with a tenth of the labels wrong."""
    rng = random.Random(11)
    nouns = {"food": "noodles broth tart dumplings marinade oven", "law": "permit contract court appeal lawyer visa", "sport": "match goalkeeper training relay racket swim"}
    chat = ["hello to everyone here today", "see you very soon my friends", "thank you all for kind words"]
    docs, labels, truth = [], [], {}
    for k in range(360):
        s = rng.choice(sorted(nouns))
        body = [f"my friend talked about the {rng.choice(nouns[s].split())} and the {rng.choice(nouns[s].split())} again" for _ in range(rng.randint(2, 5))]
        body += rng.sample(chat, rng.randint(0, 2))
        if rng.random() < 0.3 and len(body) > 3:
            other = rng.choice(sorted(set(nouns) - {s}))
            body.append(f"somebody mentioned a {rng.choice(nouns[other].split())} in passing only once")
        rng.shuffle(body)
        docs.append((k, ". ".join(body) + ".", "x"))
        truth[k] = s
        if k < 240:
            labels.append((k, s if rng.random() > 0.1 else rng.choice(sorted(nouns))))
    docs += [(900, None, "x"), (901, "", "x"), (902, "😀 12", "x"), (903, ". ".join(chat), "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels + labels[:5] + [(999, "food"), (1, "unheard"), (None, "law"), (2, None)], "doc_id long, subject string")
    sub = spark.createDataFrame([(s, "") for s in nouns], "subject string, about_en string")
    found = {}
    for r in subjects.found(d, lab, sub).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(found.get(k) == {truth[k]} for k in range(240, 360))
    assert right >= 110 and not {900, 901, 902} & set(found)
    assert subjects.found(d.limit(0), lab, sub).count() == subjects.found(d, lab.limit(0), sub).count() == subjects.found(d, lab, sub.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["p1_found", "p1_spans"])
def test_split_query_equals_sql(spark, data, name):
    compare(splitting.queries()[name](spark, data), splitting.oracle_sql()[name], data)


@pytest.mark.parametrize("name", ["p3_found", "p3_languages", "p8_found", "p9_found", "p9_composition", "p1_pieces", "p4_clusters", "p6_percentiles"])
def test_queries_run_whole(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0
