"""The operators that look at rows together: near duplicates, lines, decontamination, top-k, packing, the pipeline."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontam, linededup, neardup, packing, queries, topk

SF = "/root/testdata/sf0.01"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# near duplicates


def word_shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))}


def brute_components(docs, k, percent=80):
    sets = [(d, word_shingles(t, k)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            held[x].append(i)
    shared = Counter(p for group in held.values() for p in itertools.combinations(group, 2))
    for (i, j), both in shared.items():
        a, b = sets[i], sets[j]
        if 100 * both >= percent * (len(a[1]) + len(b[1]) - both):
            x, y = sorted((root(a[0]), root(b[0])))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets}


def check_near(docs, got, k):
    want = brute_components(docs, k)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_near(docs, queries.op4_near_duplicates(spark, SF).collect(), 4)


def test_near_duplicates_groups_at_the_threshold(spark):
    """Groups of edited copies whose pairs lie on both sides of the threshold, chains, short texts."""
    rng = random.Random(5)
    docs, n = [], 0
    for size in (6, 12, 60, 150):
        for _ in range(4):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(12):
                text = list(base)
                for _ in range(rng.randrange(1 + size // 12)):
                    text[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
                if rng.random() < 0.3:
                    base = text
                docs.append((n, " ".join(text)))
                n += 1
    rng.shuffle(docs)
    check_near(docs, neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), neardup.Params(shingle=4)).collect(), 4)


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t", "a"), (9, "One  two", "a"), (4, "one two", "a"), (4, "one two", "a"), (None, "one two", "a"), (7, long, "a"), (5, long + " end", "a"), (6, "two one", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(rows_of(neardup.near_duplicates(docs)), key=str)
    said = {r[0]: r[1:] for r in got}
    assert len(got) == 10 and got.count((4, 1, 4, True)) == 2
    assert said[1] == (0, 1, True) and said[2] == (0, 2, True) and said[3] == (0, 3, True) and said[9] == (1, 4, False)
    assert said[None] == (1, None, True) and said[7][1:] == (5, False) and said[6] == (1, 6, True)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (5, a), (5, b), (8, b)], "doc_id long, text string")
    assert {(r[0], r[2]) for r in rows_of(neardup.near_duplicates(docs))} == {(1, 1), (5, 1), (8, 1)}


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.9):
        found = []
        for _ in range(200):
            pool = np.unique(rng.integers(0, 2**64, 2000, dtype=np.uint64))
            both = int(len(pool) * j)
            mid = (len(pool) + both) // 2
            a, b = np.sort(pool[rng.permutation(len(pool))[:mid]]), None
            order = rng.permutation(len(pool))
            common, rest = pool[order[:both]], pool[order[both:]]
            half = len(rest) // 2
            a, b = np.sort(np.r_[common, rest[:half]]), np.sort(np.r_[common, rest[half:]])
            e, _ = neardup.estimate(neardup.registers(a, 128)[None], neardup.registers(b, 128)[None])
            found.append(e[0])
        assert abs(np.mean(found) - j) < 0.02


def test_small_sets_at_the_threshold_share_a_band():
    """4 of 5 elements in common: a similarity of exactly 0.8, and few registers in use."""
    rng = np.random.default_rng(4)
    p = neardup.Params(shingle=4)
    for _ in range(4000):
        whole = np.unique(rng.integers(0, 2**64, 5, np.uint64))
        part = np.delete(whole, rng.integers(0, len(whole)))
        a, b = (neardup.registers(x, p.registers) for x in (whole, part))
        assert set(neardup.band_keys(a, p.rows)) & set(neardup.band_keys(b, p.rows))
        assert neardup.may_link(a[None], b[None], p)[1][0]


def test_an_element_of_very_many_components(spark):
    """Texts that share most of their words with all others but link with their own group alone, one key for all of
    them: the rows of that key are dealt out, and no link is lost."""
    shared = " ".join(f"s{i}" for i in range(75))
    docs = []
    for g in range(60):
        own = [f"g{g}x{i}" for i in range(25)]
        for m in range(3):
            docs.append((g * 10 + m, " ".join([shared, *own, *([f"m{g}{m}"] * m)])))
    # chains: neighbours link, those further apart do not
    words = [f"c{i}" for i in range(120)]
    docs += [(5000 + i, " ".join(words[4 * i : 4 * i + 60])) for i in range(15)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    check_near(docs, neardup.near_duplicates(table, neardup.Params(shingle=4)).collect(), 4)


def test_components_of_a_long_chain(spark):
    ids = list(range(60))
    random.Random(3).shuffle(ids)
    edges = [*zip(ids, ids[1:]), (100, 101), (5, 5)]
    got = dict(rows_of(neardup.components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 0 for i in range(1, 60)) and got[101] == 100


# lines


def brute_lines(docs, least=6):
    """(doc, n_lines, n_dropped, text): each line is held against all earlier ones."""

    def close(a, b):
        if a == b:
            return True
        x, y = a.split(" "), b.split(" ")
        if min(len(x), len(y)) < least or abs(len(x) - len(y)) > 1:
            return False
        if len(x) == len(y):
            return sum(p != q for p, q in zip(x, y)) <= 1
        if len(x) < len(y):
            x, y = y, x
        return any(x[:i] + x[i + 1 :] == y for i in range(len(x)))

    places = sorted((d, p, raw.strip(" \t\r")) for d, t in docs if t is not None for p, raw in enumerate(t.split("\n")))
    gone = {(d, p) for i, (d, p, x) in enumerate(places) if x and any(close(x, y) for _, _, y in places[:i] if y)}
    out = []
    for d, t in docs:
        lines = [] if t is None else t.split("\n")
        out.append((d, len(lines), sum((d, p) in gone for p in range(len(lines))), None if t is None else "\n".join(x for p, x in enumerate(lines) if (d, p) not in gone)))
    return sorted(out)


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(8)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 6, 7, 8, 9, 12]))) for _ in range(40)]

    def edited(x):
        x = x.split(" ")
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(x) + 1)
            x = rng.choice([x[:i] + ["new"] + x[i:], x[:i] + x[i + 1 :], x[:i] + ["other"] + x[i + 1 :]])
        return rng.choice(["", " ", "\t"]) + " ".join(x) + rng.choice(["", "\r", "  "])

    docs = [(i, "\n".join(edited(rng.choice(lines)) for _ in range(rng.randrange(7)))) for i in rng.sample(range(1000), 60)]
    docs += [(2000, ""), (2001, "\n\n"), (2002, "a  b c d e f"), (2003, "a  b c d e g")]
    got = sorted(rows_of(linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", "text")))
    assert got == brute_lines(docs)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_lines_of_every_length(spark, least):
    rng = random.Random(least)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.randrange(least, 7))) for _ in range(60)]
    docs = [(d, "\n".join(rng.choices(lines, k=4))) for d in range(40)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = linededup.dedup_lines(table, linededup.Params(min_words=least)).select("doc_id", "n_lines", "n_dropped", "text")
    assert sorted(rows_of(got)) == brute_lines(docs, least)


def test_one_line_with_a_number_in_it(spark):
    """A key with as many lines as documents: page 1 of the book, page 2 of the book, and so on."""
    docs = [(d, f"own words of number {d} and {d * 7} and {d * 11} here\nthis is page {d} of the same old book") for d in range(1500)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(table).collect()}
    assert got[0]["n_dropped"] == 0 and all(got[d]["n_dropped"] == 1 and "page" not in got[d]["text"] for d in range(1, 1500))


def test_rows_without_ids_keep_their_own_lines(spark):
    docs = [(None, f"first line of text {i} x{i} y{i} z{i}\nsecond line") for i in range(30)]
    got = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 30 and {r["text"].split("\n")[0] for r in got} == {t.split("\n")[0] for _, t in docs}


def test_lines_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(None, "x y", 1), (1, None, 1), (2, "x y\nz", 1), (2, "x y\nz", 1), (3, long, 1), (4, long + " more", 1), (5, "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    got = Counter(rows_of(linededup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped")))
    assert got == Counter([(None, "x y", 1, 0), (1, None, 0, 0), (2, "z", 2, 1), (2, "z", 2, 1), (3, long, 1, 0), (4, "", 1, 1), (5, "", 1, 1)])
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_run_no_python_on_executors(spark):
    plan = linededup.dedup_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# decontamination

ITEM = "Alice bought 12 apples and 3 pears at the market for 4 dollars. How many fruits does Alice carry home?"


def test_templates_find_other_numbers_and_names(spark):
    docs = [
        (1, "Some text before. " + ITEM + " And more after it."),
        (2, "Bob bought 17 apples and 5 pears at the market for 9 euros. How many fruits does Bob carry home?"),
        (3, "Bob bought 17 apples and 5 pears at the market for 9 euros. How many fruits does Carol carry home?"),  # inconsistent
        (4, "Nothing of the kind is said in this text, which is long enough for some windows of its own."),
        (5, "as he said " + ITEM[0].lower() + ITEM[1:]),
        (6, None),
        (7, ""),
        (None, ITEM),
        (8, "Short template item here today. " * 3),
        (9, "some other words " * 100_000 + ITEM + " and others" * 1000),
    ]
    bench = [(10, ITEM), (11, None), (12, ""), (13, "Short template item here today."), (None, ITEM), (10, ITEM)]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, 0) for x in bench], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(d, b).collect()}
    assert set(got) == {(1, 10), (2, 10), (5, 10), (8, 13), (9, 10)}
    assert got[1, 10]["changed"] == 0 and got[2, 10]["changed"] > 0
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_passages_against_plain_search(spark):
    """Every document that holds an item word for word is found, and no other."""
    docs = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r["item_id"]: " ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, SF).collect()}
    assert want and want <= got
    for d, i in got - want:  # near copies of items: most of their words in order
        words = items[i].split()
        runs = [" ".join(words[a : a + 6]) for a in range(len(words) - 5)]
        assert sum(r in docs[d] for r in runs) >= 0.25 * len(runs)


def test_classify():
    assert [decontam.classify(x)[:2] for x in ("12,5", "km.", "Alice,", "Paris", "NASA", "(3.5kg)", "--", "word!", "in", "a")] == [("<num>", 1), ("km", 0), ("<name>", 2), ("<name>", 2), ("nasa", 0), ("<num>", 1), ("", 0), ("word", 0), ("in", 0), ("a", 0)]
    assert [decontam.classify(x, True)[:2] for x in ("km.", "in", "apples", "%")] == [("<unit>", 3), ("<unit>", 3), ("apples", 0), ("<unit>", 3)]


def test_canonical_words():
    said = decontam.Canon().of("In Paris, Anna Maria Smith paid 5 m for 3. In a box - 7 % of it, Tom says")
    words = ["<name>", "<name>", "paid", "<num>", "<unit>", "for", "<num>", "<name>", "a", "box", "<num>", "<unit>", "of", "it", "<name>", "says"]
    assert said.h.tolist() == [decontam._digest(w) for w in words]
    assert [said.value(i) for i in np.flatnonzero(said.k)] == ["2=In Paris", "2=Anna Maria Smith", "1=5", "3=m", "1=3", "2=In", "1=7", "3=%", "2=Tom"]


PEOPLE = "Alice Bob Carol Dilan Esra Farid Gwen Hyun Ines Jamal Katya Liam".split()
FRAMES = [
    "{p} drives {a} {u} on Monday and {b} {u} on Tuesday. How far does {p} drive on both days together?",
    "A shop sells {a} red pens and {b} blue pens. {p} buys {c} of them. How many pens are left in the shop?",
    "If {p} reads {a} pages an hour, how many pages will {p} have read after {b} hours of steady reading?",
    "{p} {q} and {r} share {a} sweets equally among friends. What is the number of sweets that each friend gets?",
    "The tank holds {a} {u} of water and loses {b} {u} through a leak, says {p}. What remains inside the tank?",
    "What is {a} plus {b} times {c} minus one, if the brackets are left out of the sum entirely?",
]


def fill(frame, rng):
    p, q, r = rng.sample(PEOPLE, 3)
    a, b, c = (str(x) for x in rng.sample(range(2, 900), 3))
    return frame.format(p=p, q=q, r=r, a=a, b=b, c=c, u=rng.choice(["km", "miles", "liters", "gallons"]))


def brute_contaminated(docs, items, p=decontam.Params()):
    """Pairs whose windows, canonical word by canonical word, cover enough of the item on one diagonal with one value
    for each value of the item: plain loops over the longer windows and single diagonals."""
    canon, found = decontam.Canon(), set()
    for i, x in items:
        item = canon.of(x)
        starts = [s for s in range(len(item.h) - p.window + 1) if (item.k[s : s + p.window] == 0).sum() >= p.least_plain]
        for d, t in docs:
            doc = canon.of(t)
            for shift in range(-len(item.h), len(doc.h)):
                hits = [s for s in starts if 0 <= s + shift <= len(doc.h) - p.window and (item.h[s : s + p.window] == doc.h[s + shift : s + shift + p.window]).all()]
                pairs = {(item.value(j), doc.value(j + shift)) for s in hits for j in range(s, s + p.window) if item.k[j]}
                if starts and len(hits) >= p.cover * len(starts) and len(dict(pairs)) == len(pairs):
                    found.add((d, i))
    return found


def test_reparameterised_items_are_found(spark):
    """Recall on items with other numbers, names and units: 1; and all that plain loops over the windows find."""
    rng = random.Random(11)
    items = [(n, fill(f, rng)) for n, f in enumerate(FRAMES)]
    docs, want = [], set()
    for n, frame in enumerate(FRAMES):
        for m in range(10):
            docs.append((100 * n + m, "Some words before it. " + fill(frame, rng) + " And some after that."))
            want.add((100 * n + m, n))
    docs += [(900 + m, " ".join(rng.choice("red blue tank shop reads drives on and the of water".split()) for _ in range(60))) for m in range(10)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in got}
    assert got == want and brute_contaminated(docs, items) <= got
    assert len(brute_contaminated(docs, items)) >= 0.9 * len(want)


# top-k


def brute_top(vectors, k=20):
    q = {i: [math.floor(64 * Fraction(x)) for x in v] for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i in sorted(q):
        if i % 20 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q[i], q[j])))), j) for j in q if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return out


def test_top_k_against_brute_force(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(rows_of(queries.op9_top_k(spark, sf))) == brute_top(vectors)


def test_top_k_odd_rows(spark):
    rng = random.Random(1)
    vectors = [(i, [float(rng.randrange(-2, 3)) if rng.random() < 0.5 else 0.0 for _ in range(4)]) for i in range(100)]
    vectors += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [float("inf")] * 4), (None, [9.0] * 4), (120, []), (121, [1.5, 2.5]), (140, [1e15, 0.0, 0.0, 0.0]), (160, [1e308, -1e308, 0.5, 0.0]), (161, [-1e308, 0.0, 0.0, 1.0])]
    table = spark.createDataFrame([(*v, 1) for v in vectors] + [(20, vectors[20][1], 1)], "vec_id long, embedding array<double>, score int")
    found = topk.search(table, lambda v: v % 20 == 0, topk.Params(per_group=40))
    assert sorted(rows_of(found)) == brute_top(vectors)
    assert topk.search(table.limit(0), lambda v: v % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert rows_of(topk.search(few, lambda v: v % 20 == 0)) == [(0, 1, 1, 64 * 128)]


def test_rare_and_common_terms(spark):
    rng = random.Random(7)
    vectors = [(i, [float(rng.randrange(-3, 4)) if rng.random() < (0.9 if t < 3 else 0.05) else 0.0 for t in range(40)]) for i in range(300)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert sorted(rows_of(topk.search(table, lambda v: v % 20 == 0))) == brute_top(vectors)


def test_every_score_comes_from_postings():
    """Terms are added one by one, common ones too: without a term's postings its part of all scores is missing."""
    import ast
    import inspect

    tree = ast.parse(inspect.getsource(topk))
    assert not any(isinstance(x, ast.BinOp) and isinstance(x.op, ast.MatMult) for x in ast.walk(tree))
    assert not {x.attr for x in ast.walk(tree) if isinstance(x, ast.Attribute)} & {"dot", "matmul", "einsum", "inner", "tensordot"}
    rng = np.random.default_rng(2)
    vectors = [rng.integers(-3, 4, 6).astype(float) for _ in range(50)]
    docs, asked = topk.Rows(np.arange(50), vectors, 1), topk.Rows(np.arange(9), vectors[:9], 1)
    whole = np.array([[sum(a * b for a, b in zip(q, d)) for d in vectors] for q in vectors[:9]])
    assert (topk.scores(asked, docs) == whole).all()
    for t in range(6):
        docs = topk.Rows(np.arange(50), vectors, 1)
        del docs.postings[t]
        part = np.array([[sum(a * b for j, (a, b) in enumerate(zip(q, d)) if j != t) for d in vectors] for q in vectors[:9]])
        assert (topk.scores(asked, docs) == part).all()


def test_hot_keys_are_split(spark):
    from gridloom.llm.common import join_counted

    data = [(1, n) for n in range(900)] + [(k, k) for k in range(2, 102)]
    rows = spark.createDataFrame(data, "k int, v int")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("m"))
    got = join_counted(rows, table, ["k"], "c", 1000, share=10)
    assert sorted(rows_of(got)) == sorted(rows_of(rows.join(table, "k")))


@pytest.mark.parametrize("left, right", [(1, 1), (1, 2), (3000, 1), (1, 3000)])
def test_hot_keys_of_either_side_are_dealt_out(spark, left, right):
    from gridloom.llm.common import hot_keys, join_hot

    a = spark.createDataFrame([(left, n) for n in range(1500)] + [(k, k) for k in range(2, 102)], "k int, v int")
    b = spark.createDataFrame([(right, n) for n in range(1200)] + [(k, k) for k in range(2, 102)], "k int, x int")
    assert len(hot_keys(a, ["k"])) == 1
    got = join_hot(a, b, ["k"], salts=3)
    assert got.columns == ["k", "v", "x"]
    sums = lambda df: df.agg(F.count("*"), F.sum("v"), F.sum("x"), F.sum(F.xxhash64("k", "v", "x") % 1000)).first()
    assert sums(got) == sums(a.join(b, "k"))


def test_what_cut_writes_goes_with_its_block(spark, tmp_path, monkeypatch):
    from gridloom.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    monkeypatch.setattr(common, "_written", [[]])
    with common.scratch():
        held = common.cut(spark.range(9))
        assert held.count() == 9 and len(list(tmp_path.iterdir())) == 1
    assert not list(tmp_path.iterdir())
    common.cut(spark.range(3))
    assert len(list(tmp_path.iterdir())) == 1
    common._at_exit()
    assert not list(tmp_path.iterdir())


def test_a_cluster_without_a_shared_folder_is_an_error():
    from gridloom.llm import common

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


# packing


def check_packed(docs, rows, params, encode):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == dict(docs).keys()
    for d, t in docs:
        ids = np.array([*encode([t or ""])[0], 0], "<u4")
        pieces = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(pieces) == 1 or all(r["length"] == params.capacity for r in pieces[1:]))
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= params.capacity
    return len(by_sequence), sum(r["length"] for r in rows)


def test_packing_places_every_token_once(spark, sf):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.public_params().tokenizer)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n, tokens = check_packed(docs, queries.op10_packing(spark, SF).collect(), packing.public_params(), lambda ts: [whole.encode(t, add_special_tokens=False).ids for t in ts])
    assert n <= 1.01 * tokens / 2048 + 1


def contract_ids(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.public_params().tokenizer)
    return [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


ALPHABET = [chr(c) for c in range(0x250)] + list("  \n\n\t'sdltmrev ") * 20 + ["<|endoftext|>", "don't", "'ll", "的", "é", "  ", "\u2003", "ﬁ"]


def test_ids_are_those_of_the_contracts_call():
    rng = random.Random(3)
    texts = ["", " ", "it's  a\n\n test\t", "naïve Straße", "x <|endoftext|> y", "数学 и русский", "a" * 5000, " " * 3000, "\x00\x7f", "12345 1e9", "ẞ ﬁ ①", "²³½ª_\x1c\x85\xa0 x"]
    texts += ["".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(1500)]
    encode = packing.encoder(packing.public_params())
    assert [encode(t) for t in texts] == contract_ids(texts)
    assert np.frombuffer(encode("x <|endoftext|> y"), "<u4").tolist() == [87, 220, 50256, 331]
    few = packing.encoder(packing.Params(tokenizer=packing.public_params().tokenizer, memory=3))  # forgets all the time
    assert [few(t) for t in texts[:200]] == contract_ids(texts[:200])


def least_sequences(pieces, capacity):
    """The fewest sequences, by trying all ways."""
    best = len(pieces)

    def place(i, held):
        nonlocal best
        if len(held) >= best:
            return
        if i == len(pieces):
            best = len(held)
            return
        for j in {h: j for j, h in enumerate(held)}.values():
            if held[j] + pieces[i] <= capacity:
                place(i + 1, [*held[:j], held[j] + pieces[i], *held[j + 1 :]])
        place(i + 1, [*held, pieces[i]])

    place(0, [])
    return best


def test_plans_against_the_optimum():
    rng, gone, optimal = random.Random(5), 0, 0
    for _ in range(200):
        capacity = rng.choice([8, 12, 20])
        pieces = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))), reverse=True)
        least, n = least_sequences(pieces, capacity), sum(t for _, t in packing.plan(Counter(pieces), capacity))
        assert least <= n <= least + 1
        gone, optimal = gone + n, optimal + least
    assert gone <= 1.02 * optimal


def test_the_index_of_sums_holds_every_combination():
    rng = random.Random(9)
    for _ in range(60):
        counts = np.array([0, *(rng.choice([0, 0, 1, 2]) for _ in range(14))], np.int64)
        for total in range(1, 15):
            there = [n for n in range(15) for _ in range(counts[n])]
            want = {k: any(sum(c) == total for c in itertools.combinations(there, k)) for k in (1, 2, 3)}
            index = packing.Sums(counts)
            for k, found in ((1, index.single(total)), (2, index.pair(total)), (3, index.triple(total))):
                assert (found is not None) == want[k]
                assert found is None or (sum(found) == total and len(found) == k and not Counter(found) - Counter(there))


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 200])
    counts = {n: rng.randrange(1, 60) for n in rng.sample(range(1, capacity + 1), min(capacity, rng.randrange(1, 60)))}
    patterns = packing.plan(counts, capacity)
    used = Counter()
    for lengths, times in patterns:
        assert sum(lengths) <= capacity
        for n in lengths:
            used[n] += times
    assert used == Counter(counts)
    total = sum(n * c for n, c in counts.items())
    assert sum(t for _, t in patterns) <= 1.25 * total / capacity + 1 + sum(c for n, c in counts.items() if 2 * n > capacity)


def test_exact_complements():
    assert packing.plan({7: 2, 3: 2}, 10) == [((7, 3), 2)]
    assert packing.plan({6: 1, 3: 1, 1: 1}, 10) == [((6, 3, 1), 1)]
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)] or sum(t for _, t in packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10)) == 1


def test_packing_odd_rows(spark):
    long = "word " * 9000
    docs = [(1, None), (2, ""), (3, long), (None, "x"), (5, "same"), (5, "same")]
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, piece int")
    got = packing.pack(table, packing.public_params()).collect()
    assert sorted(Counter(r["doc_id"] for r in got).items(), key=str) == sorted({1: 1, 2: 1, 3: 5, None: 1, 5: 2}.items(), key=str)
    spots = {(r["sequence_id"], r["offset"]) for r in got}
    assert len(spots) == len(got)
    assert packing.pack(table.limit(0), packing.public_params()).count() == 0


# the pipeline


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = []
    for i, (name, stage) in enumerate(c.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        found = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert found.schema == docs.schema, name
        held.append((docs, found))
        docs = found
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    before, after = map(texts, held[1])
    want = [(d, x) for d, _, gone, x in brute_lines(before) if not gone or x.strip()]
    assert sorted(after) == want
    before, after = map(texts, held[2])
    assert {d for d, _ in after} == {d for d, (_, c) in brute_components(before, 5).items() if d == c}
    before, after = map(texts, held[3])
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(x in " ".join(t.split()) for _, t in after for x in items)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.public_params().tokenizer)
    check_packed(texts(held[4][0]), held[4][1].collect(), packing.public_params(), lambda ts: [whole.encode(t, add_special_tokens=False).ids for t in ts])


def test_pipeline_of_odd_documents(spark, sf, tmp_path):
    import corpus_pipeline as c

    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the cat and the dog", "en", "s", 19), (3, "the cat and the dog", "en", "s", 19), (None, "the dog and the cat", "en", "s", 19)]
    extra = {"score": F.lit(1), "lang_pred": F.array(F.lit("x")), "n_lines": F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(1.5))), "piece": F.current_timestamp(), "mark": F.struct(F.lit(1).alias("doc")), "kept": F.lit(None).cast("decimal(9,2)"), "_gone": F.lit(True), "item_id": F.lit(b"z")}
    for k, some in enumerate((rows, [])):
        docs = spark.createDataFrame(some, spark.read.parquet(f"{sf}/documents.parquet").schema).withColumns(extra)
        for i, (_, stage) in enumerate(c.STAGES):
            out = stage(spark, docs, sf)
            assert i == 4 or out.dtypes == docs.dtypes
            out.write.parquet(f"{tmp_path}/{k}-{i}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{i}")
        assert docs.count() == (3 if some else 0)
