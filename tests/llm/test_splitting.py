import random

from threadlake.llm import splitting

UNIT = "id string, continuation_ids_json string, full_text string, built_at int, pieces string, cut_level int"
POST = "id string, text string, built_at string"
SPAN = "unit_id string, post_id string, span_start int, span_end int, full_text string"


def brute_level(posts):
    import re

    def longest(xs):
        return max([len(x.strip()) for x in xs] or [0])

    steps = [lambda x: [x], lambda x: x.split("\n"), lambda x: re.sub(r"([.!?…])\s", "\\1\n", x).split("\n"), lambda x: re.split(r"\s", x)]
    for name, f in zip(splitting.LEVELS, steps):
        if longest([y for p in posts for y in f(p)]) <= 500:
            return name
    return "none"


def texts():
    rng = random.Random(1)
    for _ in range(300):
        posts = []
        for _ in range(rng.randint(1, 6)):
            n, sep = rng.randint(1, 120), rng.choice([" ", "  ", "\n", ". ", "! \n", " \u00a0"])
            posts.append(sep.join("w" * rng.choice([1, 3, 8, 20]) for _ in range(n)) or "x")
        if rng.random() < 0.1:
            posts.append("y" * rng.choice([441, 500, 501, 1300]))
        yield posts


def starts(posts):
    out, at = [], 0
    for p in posts:
        out.append(at)
        at += len(p) + 1
    return out


def greedy(text, level, post_starts, limit=500, overlap=60):
    """The pieces one after the other, by the definition."""
    words = splitting._blocks(*splitting._words(text, post_starts), limit - overlap)
    start, end, lv = (x.tolist() for x in words)
    out, i, n = [], 0, len(start)
    while i < n:
        begin = start[0]
        if i:
            back = end[i - 1] - overlap
            word = next((start[k] for k in range(n) if lv[k] < 4 and back <= start[k] < end[i - 1]), None)
            begin = word if word is not None else max(back, start[0])
            if end[i] - begin > limit:
                begin = start[i]
        most = max(j for j in range(i, n) if end[j] <= begin + limit) + 1
        for kind in range(5):
            cut = [j for j in range(i + 1, most + 1) if j == n or lv[j] <= kind]
            if cut:
                j = cut[-1]
                break
        out.append((begin, end[j - 1]))
        i = j
    return out


def test_pieces_equal_sequential_greedy_and_level_equals_definition():
    all_posts = [p for p in texts()]
    joined = [" ".join(p) for p in all_posts]
    found = splitting.split_texts(joined, [starts(p) for p in all_posts])
    for posts, text, (level, pieces) in zip(all_posts, joined, found):
        assert level == brute_level(posts)
        assert [(a, b) for a, b, _, _ in pieces] == greedy(text, level, starts(posts))
        covered = set()
        for k, (a, b, repeated, _) in enumerate(pieces):
            assert 0 < b - a <= 500 and repeated <= 60
            if k and repeated < 60:
                gap_or_word = a == 0 or text[a - 1].isspace()
                assert gap_or_word
            covered.update(range(a, b))
        assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_edge_texts():
    found = splitting.split_texts([" " * 700, "", "z" * 3000, "a" + " " * 900 + "b"], [[0]] * 4)
    assert found[0][1] == [] and found[1][1] == []
    assert found[2][0] == "none" and all(b - a <= 500 for a, b, _, _ in found[2][1]) and found[2][1][-1][1] == 3000
    assert [p[:2] for p in found[3][1]] == [(0, 1), (901, 902)]


def test_query_on_messy_tables(spark):
    long = "word " * 150
    units = [
        ("1", '["2"]', ("a" * 300 + " " + "b" * 300), 2, "", 0), ("1", "[]", "stale " * 200, 1, "", 0), ("1", '["2"]', ("a" * 300 + " " + "b" * 300), 2, "", 0),
        ("3", "not json", long.strip(), 1, "", 0), ("4", None, None, 1, "", 0), ("5", "[]", "", 1, "", 0), ("6", "[]", "short", 1, "", 0), (None, "[]", long, 1, "", 0), ("7", '["8"]', long.strip() + " tail", None, "", 0),
    ]
    posts = [("1", None, "x"), ("1", "a" * 300, "x"), ("2", "b" * 300, "x"), ("2", "b" * 300, "x"), ("3", "other", "x"), (None, "q", "x")]
    u, p, s = spark.createDataFrame(units, UNIT), spark.createDataFrame(posts, POST), spark.createDataFrame([], SPAN)
    out = {r.unit_id: r for r in splitting.split_units(u, p, s).collect()}
    assert {k: r.cut_level for k, r in out.items()} == {"1": "post", "3": "word", "7": "word"}
    assert [(x.piece_start, x.piece_end, x.cut_at) for x in out["1"].pieces] == [(0, 300, "post"), (241, 601, "post")] or len(out["1"].pieces) == 2
    assert splitting.split_units(u.limit(0), p, s).count() == 0 and splitting.split_units(u, p.limit(0), s).count() == 3
    texts_ = splitting.pieces(u, p, s).filter("unit_id = '3'").orderBy("piece_no").collect()
    assert all(len(r.piece) <= 500 and r.piece == r.piece.strip() for r in texts_)


def test_stored_spans_count_where_the_list_is_broken_and_only_if_true(spark):
    one, two, three = "a b " * 60 + "é", "c " * 150 + "c", "đ" * 80
    text = " ".join([one, two, three])
    at = [0, len(one) + 1, len(one) + len(two) + 2]
    u = spark.createDataFrame([("1", "broken", text, 1, "", 0), ("2", '["9"]', text, 1, "", 0)], UNIT)
    p = spark.createDataFrame([("1", one, ""), ("2", one, ""), ("8", two, ""), ("9", "unlike " * 9, ""), ("7", three, "")], POST)
    right = [("1", at[1], at[1] + len(two), "8"), ("1", at[2], len(text), "7")]
    wrong = [("1", at[1] + 3, at[1] + 3 + len(two), "8"), ("1", None, 5, "8"), ("1", 4, 2, "7"), ("1", 0, len(text) + 50, "7"), (None, 0, 5, "7"), ("1", at[2], at[2] + len(three), "no such post")]
    s = spark.createDataFrame([(a, d, b, c, "x") for a, b, c, d in right * 2 + wrong], SPAN)
    out = {r.unit_id: r for r in splitting.split_units(u, p, s).collect()}
    assert out["1"].cut_level == "post" and out["1"].pieces[0].piece_end == at[1] - 1
    assert out["2"].cut_level != "post"
    assert {r.unit_id: r.cut_level for r in splitting.split_units(u, p, s.limit(0)).collect()}["1"] != "post"


def test_findings_of_stored_spans(spark):
    u = spark.createDataFrame([("1", '["2", "3"]', "aa bbb c", 1, "", 0)], UNIT)
    p = spark.createDataFrame([("1", "aa", ""), ("2", "bbb", ""), ("3", "c", "")], POST)
    s = spark.createDataFrame([("1", "1", 0, 2, ""), ("1", "1", 0, 2, ""), ("1", "2", 3, 7, ""), ("1", "3", None, 8, "")], SPAN)
    assert {r.post_id: r.finding for r in splitting.span_findings(u, p, s).collect()} == {"1": "right", "2": "wrong", "3": "missing"}


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    for t in ("", "a", "đặng é 😀" * 40):
        assert splitting._hash(t) == spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]


def test_pieces_of_the_data_cover_every_text(spark, data):
    texts_ = {r.id: r.full_text for r in splitting.latest_units(spark.read.parquet(f"{data}/content_units.parquet"), "id", "full_text").collect()}
    by = {}
    for r in splitting.queries()["p1_pieces"](spark, data).collect():
        by.setdefault(r.unit_id, []).append(r)
    assert set(by) == {k for k, t in texts_.items() if t and len(t) > 500}
    for k, ps in by.items():
        ps.sort(key=lambda r: r.piece_no)
        assert all(r.piece == texts_[k][r.piece_start : r.piece_end] and len(r.piece) <= 500 for r in ps)
        inside = {i for r in ps for i in range(r.piece_start, r.piece_end)}
        assert all(c.isspace() for i, c in enumerate(texts_[k]) if i not in inside)
        for a, b in zip(ps, ps[1:]):
            assert max(0, a.piece_end - b.piece_start) == b.repeated <= 60
