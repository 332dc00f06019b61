"""Search, near duplicates, passages, mixing and the pipeline: against brute force and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import jaccard, mixing, passages, shingles, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_frame(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "n", "sid", "removed", "again", "u", "component"):
        made = made.withColumn(c, F.lit("x"))
    return made


# 2: search


def brute_top(rows, k=5):
    out = []
    for i, (q, x) in enumerate(rows):
        if q % 50 == 0:
            ranked = sorted((-int(np.dot(x, y)), v) for j, (v, y) in enumerate(rows) if j != i and len(y) == len(x))[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("cells", [topk.CELLS, 60])
def test_search(spark, cells):
    r = np.random.default_rng(1)
    rows = [(int(v), [float(x) for x in r.integers(-3, 4, 6) / 256]) for v in r.permutation(160)]
    rows[3] = (rows[3][0], rows[4][1])
    rows += [rows[0], rows[0], (50, rows[5][1]), (50, rows[5][1]), (50, [9 / 256] * 6), (7, rows[6][1])]  # repeated rows, and rows of one vec_id
    rows += [(k, [float(x) for x in r.integers(-3, 4, 40) / 256]) for k in (2000, 2001, 2050)]
    frame = spark.createDataFrame([*rows, (1000, None), (1001, [1.0, None]), (1050, [float("nan")] * 6), (1100, [float("inf")] * 6), (None, [1.0] * 6), (1150, []), (1200, [1.0, 2.0])], "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("row", F.lit(3))
    found = topk.search(topk.quantise(frame), F.col("vec_id") % 50 == 0, cells=cells).collect()
    ints = [(v, np.floor(np.array(x) * 256).astype(int)) for v, x in rows]
    assert sorted(tuple(f) for f in found) == brute_top(ints)
    assert topk.search(topk.quantise(frame.where("vec_id < 0")), F.col("vec_id") % 50 == 0).count() == 0


def test_long_vectors(spark):
    r = np.random.default_rng(6)
    rows = [(int(k), [float(x) for x in r.integers(-2, 3, 20000) / 256]) for k in range(0, 30)]
    found = topk.search(topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("vec_id") % 10 == 0, cells=100_000).collect()
    want = brute_top([(5 * k, np.floor(np.array(x) * 256).astype(int)) for k, x in rows])
    assert sorted((5 * f["query_id"], f["rank"], 5 * f["vec_id"], f["score"]) for f in found) == want


def test_search_stops_early_and_handles_zero_queries():
    r = np.random.default_rng(2)
    rows = r.normal(0, 1, (4000, 3))
    ints = np.floor(rows * 256).astype(np.int64)
    ids = np.arange(4000)
    for number, best, score, scored in topk.threshold_search(ids, ints, np.array([[500, -3, 2], [0, 0, 0]]), np.array([-1, 0]), 5):
        if number == 0:
            want = np.lexsort((ids, -(ints @ [500, -3, 2])))[:5]
            assert best.tolist() == want.tolist() and scored < 1000
        else:
            assert best.tolist() == [1, 2, 3, 4, 5] and set(score.tolist()) == {0}


def test_large_components_are_exact():
    rows = np.array([[2**40, 1], [2**40, 2], [-(2**40), 0]])
    _, best, score, _ = next(topk.threshold_search(np.arange(3), rows, np.array([[2, 3]]), np.array([-1]), 2))
    assert best.tolist() == [1, 0] and score.tolist() == [2**41 + 6, 2**41 + 3]


# 7: near duplicates


def brute_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append(frozenset() if not w else frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))
    return out


def brute_classes(rows):
    sets = brute_sets([t for _, t in rows])
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    least: dict = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def near_copies(seed, n=260):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([6, 12, 40, 90]))] for _ in range(12)]
    common = [r.choice(vocabulary) for _ in range(9)]
    rows = []
    for k in range(n):
        words = list(r.choice(bases[: 3 if k % 3 else 12]))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        if r.random() < 0.2:
            words += common
        if r.random() < 0.2:
            words = words[: r.randint(1, len(words))]
        rows.append((k * 3 + 1, " ".join(w.upper() if r.random() < 0.05 else w for w in words)))
    return rows


def test_shingle_sets():
    r = random.Random(0)
    texts = [" ".join(r.choices(["a", "A", "b", "É", "é", "c\n", "\t"], k=r.randint(0, 14))) for _ in range(800)]
    brute = brute_sets(texts)
    made = [tuple(s.tolist()) for s in shingles.sets([t.encode() for t in texts])]
    assert [len(s) for s in made] == [len(b) for b in brute]
    assert len({(a, b) for a, b in zip(made, brute)}) == len(set(made)) == len(set(brute))


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 5), (3, 20)])
def test_classes_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies(seed)
    assert sorted(tuple(r) for r in jaccard.classes(docs_frame(spark, rows)).collect()) == brute_classes(rows)


def test_lists_cut_into_parts_lose_no_link(spark, monkeypatch):
    """Every list, and the hot ones most of all, is read in pairs of parts; blocks by size and position are skipped."""
    monkeypatch.setattr(jaccard, "LIST", 2)
    r = random.Random(9)
    common = [f"c{k}" for k in range(14)]
    rows = near_copies(5, 120)
    for k in range(60):  # texts of many sizes that share one passage, and copies of each with a word changed
        words = [f"u{k}x{i}" for i in range(r.choice([3, 8, 30, 55, 56, 57]))] + common
        rows.append((2000 + k, " ".join(words)))
        words[r.randrange(3)] = "other"
        rows.append((3000 + k, " ".join(words)))
    assert sorted(tuple(r) for r in jaccard.classes(docs_frame(spark, rows)).collect()) == brute_classes(rows)


def test_large_ids_and_one_id_of_several_texts(spark):
    most = 2**63 - 1
    text, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(most - k, text + (f" x{k}" if k % 2 else "")) for k in range(12)]
    assert {tuple(r) for r in jaccard.classes(docs_frame(spark, rows)).collect()} == {(most - k, 36 + k % 2, most - 11) for k in range(12)}
    rows = [(5, text), (5, other), (5, other.upper()), (6, text + " x"), (7, other + " y"), (8, "c d e f g h"), (9, ""), (9, ""), (9, "  ")]
    found = Counter(tuple(r) for r in jaccard.classes(docs_frame(spark, rows)).collect())
    assert found == Counter({(5, 36, 5): 3, (6, 37, 5): 1, (7, 37, 5): 1, (8, 2, 8): 1, (9, 0, 9): 3})
    kept = jaccard.keep_first(docs_frame(spark, rows))
    assert sorted((r["doc_id"], r["text"].lower()) for r in kept.collect()) == sorted([(5, text), (5, other), (8, "c d e f g h"), (9, ""), (9, ""), (9, "  ")])
    assert kept.columns == docs_frame(spark, []).columns


def test_full_filters_change_nothing(spark, monkeypatch):
    """With so few cells that most shingles seem frequent, the order is another one and the classes are the same."""
    monkeypatch.setattr(jaccard, "LEVELS", {2: 11, 16: 12, 256: 11})
    rows = near_copies(4, 150)
    assert sorted(tuple(r) for r in jaccard.classes(docs_frame(spark, rows)).collect()) == brute_classes(rows)


def test_wide_cells_of_frequent_shingles_keep_the_unshared_ones_first(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(64)) for k in range(40)]
    rows = docs_frame(spark, list(enumerate(texts)))
    own = [s for s in shingles.sets([t.encode() for t in texts]) if len(s)]
    two = np.zeros(1 << 17, np.uint8)
    higher = [np.full(1 << 6, 0x55, np.uint8), np.full(1 << 5, 0x33, np.uint8)]  # half of the wide cells hold a frequent shingle
    kept = {int(x) for s in own for k, x in enumerate(s) if k % 10}
    for x in kept:
        cell = x >> 42
        two[cell >> 3] |= 1 << (cell & 7)
    found = jaccard.active_sets(rows.select("doc_id", "text"), [two, *higher]).collect()
    assert len(found) == len({shingles.set_id(s) for s in own})
    for r in found:
        tokens = np.frombuffer(r["tokens"], "<u8")
        shared = jaccard._in(tokens, two)
        assert not shared[: r["n0"]].any() and shared[r["n0"] :].all()


def test_classes_of_edge_cases(spark):
    long = " ".join(f"x{k}" for k in range(30000))
    rows = [(5, None), (4, ""), (3, " \n"), (9, "a b"), (8, "A  b"), (7, "a b c"), (11, long), (10, long + " y"), (12, long), (12, long), (None, "q r s t u v"), (13, "q r s t u v")]
    found = Counter(tuple(r) for r in jaccard.classes(docs_frame(spark, rows)).collect())
    assert found == Counter({(5, 0, 5): 1, (4, 0, 4): 1, (3, 0, 3): 1, (9, 1, 8): 1, (8, 1, 8): 1, (7, 1, 7): 1, (11, 29996, 10): 1, (10, 29997, 10): 1, (12, 29996, 10): 2, (None, 2, 13): 1, (13, 2, 13): 1})
    kept = jaccard.keep_first(docs_frame(spark, rows))
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 3, 4, 5, 7, 8, 10, 13] and kept.columns == docs_frame(spark, []).columns
    assert jaccard.classes(docs_frame(spark, [])).count() == 0
    assert jaccard.keep_first(docs_frame(spark, [(None, "a b c d e f"), (None, "g h"), (1, "x")])).count() == 3


def test_connected_without_edges(spark):
    assert jaccard.connected(spark.createDataFrame([], "u binary, v binary")).count() == 0
    assert jaccard.connected(spark.createDataFrame([(4, 4)], "u long, v long")).count() == 0


def test_connected(spark):
    r = random.Random(5)
    chain = [(k, k + 1) for k in range(60)]
    other = [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)]
    found = {r["node"]: r["component"] for r in jaccard.connected(spark.createDataFrame(chain + other, "u long, v long")).collect()}
    assert all(found[k] == 0 for k in range(1, 61))
    up = {x: x for e in other for x in e}
    for _ in up:
        for a, b in other:
            up[a] = up[b] = min(up[a], up[b])
    assert all(found.get(x, x) == up[x] for x in up)


# 4: passages


def brute_dedup(rows, least):
    """Texts by row: units found by scanning characters; a run of repeats ends at a unit with words that is none."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), {}
    for i in order:
        each: list[str] = []
        for c in rows[i][1] or "":
            ended = each and each[-1][-1] in ".!?;:,\n"
            if not each or (ended and c not in ".!?;:,\n"):
                each.append(c)
            else:
                each[-1] += c
        words = [" ".join("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(u)) for u in each]
        kinds = ""
        for w in words:
            kinds += "0" if not w else "r" if w in seen else "n"
            seen.add(w)
        gone = set()
        for m in re.finditer("r[r0]*", kinds):
            run = range(m.start(), m.start() + len(m[0].rstrip("0")))
            if sum(len(words[k].split(" ")) for k in run if words[k]) >= least:
                gone |= set(run)
        out[i] = "".join(u for k, u in enumerate(each) if k not in gone)
    return out


CLASHING = ("row", "ROW_", "n_units", "removed", "again", "done", "of_row", "place", "part", "at", "spans", "turn", "size", "sid", "class", "stay", "words")


def clashing(made):
    """made with further columns whose names operators use for their own."""
    for c in CLASHING:
        if c not in made.columns:
            made = made.withColumn(c, F.lit("x"))
    return made


@pytest.mark.parametrize("least", [1, 8, passages.LEAST])
def test_passages_equal_brute_force(spark, least):
    r = random.Random(6)
    pool = [" ".join(r.choices("abcdefghij", k=r.choice([1, 2, 9, 12]))) + r.choice([". ", "!\n", "\n", ", ", "... ? "]) for _ in range(60)] + ["\n\n", "!? "]
    rows = [(k, "".join(r.choices(pool, k=r.randint(0, 12)))) for k in range(80)]
    frame = clashing(docs_frame(spark, rows))
    done = passages.dedup(frame, least=least)
    count, spans = passages.own_names(frame.columns)
    assert done.columns == [*frame.columns, count, spans]
    want = brute_dedup(rows, least)
    for row in done.collect():
        assert row["text"] == want[row["doc_id"]] and row["removed"] == row["row"] == "x"
        text = rows[row["doc_id"]][1]
        left, at = "", 0
        for s in row[spans]:
            left, at = left + text[at : s["start"]], s["stop"]
        assert left + text[at:] == row["text"]


def test_passages_of_edge_cases(spark):
    passage = "one two three four five six seven eight nine ten eleven, twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. "
    most = 2**63 - 1
    rows = [(2, passage), (1, passage), (2, "x. " + passage), (None, None), (7, ""), (8, "Yes. " + passage + "No. " + passage.upper()), (9, "z " * 40000), (9, "z " * 40000), (most, passage + "w."), (most - 1, "y."), (None, "first. ")]
    done = sorted(((r["doc_id"] or 0), r["text"] or "") for r in passages.dedup(docs_frame(spark, rows)).collect())
    assert done == sorted(((rows[i][0] or 0), t) for i, t in brute_dedup(rows, passages.LEAST).items())
    assert {t.strip() for k, t in done if k == 2} == {"", "x."} and [t.strip() for k, t in done if k in (1, 8, most)] == [passage.strip(), "Yes. No.", "w."]
    assert passages.dedup(docs_frame(spark, [])).count() == 0


def test_passages_keep_what_occurs_once(spark):
    first, second = (" ".join(f"{x}{k}" for k in range(25)) + ". " for x in "pq")
    rows = [(1, first + second), (2, first + "Price is 42 dollars. " + second), (3, first + "Yes. " + second), (4, "Yes. No. " + second + "\n \n" + first), (5, "A line of a few words that many share. New."), (6, "A line of a few words that many share. Other.")]
    found = {r["doc_id"]: r["text"].strip() for r in passages.dedup(docs_frame(spark, rows)).collect()}
    assert found == {1: (first + second).strip(), 2: "Price is 42 dollars.", 3: "Yes.", 4: "Yes. No.", 5: rows[4][1], 6: rows[5][1]}


# 8: mixing


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 166.6666667, 83.3333333])
    many = mixing.targets([10, 1000, 30, 5, 0, 400])
    assert sum(many) == pytest.approx(1.5 * 1445) and all(t <= 2 * s + 1e-9 for t, s in zip(many, [10, 1000, 30, 5, 0, 400]))


def test_permutations():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, n * 77).tolist()) == list(range(n))


def test_draws_of_any_size_are_draws():
    counts = np.array([5 * 10**10, 3 * 10**9, 0, 40])
    n = int(counts.sum()) // 2
    made = np.array([mixing._draw(counts, n, [7, k]) for k in range(20)])
    assert (made.sum(axis=1) == n).all() and (made >= 0).all() and (made <= counts).all() and len({tuple(m) for m in made}) == 20
    small = np.array([30, 20, 10])
    want = np.random.default_rng(3).multivariate_hypergeometric(small, 24, 3000)
    found = np.array([mixing._draw(small, 24, [1, k]) for k in range(3000)])
    assert (found.sum(axis=1) == 24).all()
    assert np.abs(found.mean(axis=0) - want.mean(axis=0)).max() < 0.25 and np.abs(found.var(axis=0) / want.var(axis=0) - 1).max() < 0.2
    assert mixing._draw(small, 60, [1]).tolist() == [30, 20, 10] and mixing._draw(small, 0, [1]).tolist() == [0, 0, 0] and mixing._draw(np.zeros(2, np.int64), 0, [1]).tolist() == [0, 0]


def test_shards_add_up():
    plan = mixing.Plan(["a", "b", None], [1000, 70, 5], [1700.0, 140.0, 3.0], {}, block=4, shard=16)
    shards = [mixing.shard_slots(plan, k) for k in range(plan.shards)]
    total = np.zeros(3, int)
    for k, s in enumerate(shards):
        _, before = mixing.shard_counts(plan, k)
        assert before.tolist() == total.tolist() and sorted(s["slot"]) == list(range(len(s)))
        total += np.bincount(s["source_no"], minlength=3)
    assert total.tolist() == plan.slots.tolist()
    taken = Counter((r.source_no, r.block) for s in shards for r in s.itertuples())
    assert max(taken.values()) <= 2


SOURCES = [(k, f"word{k} " * (k * 7 % 300), ["a", "b", None, "ä"][k % 4 if k % 9 else 0]) for k in range(200)] + [(500, None, "a"), (501, "", "z"), (3, "one two", "b"), (3, "one two", "b"), (None, "x y z", "c")]


def test_mixing(spark):
    docs = spark.createDataFrame(SOURCES, "doc_id long, text string, source string").withColumn("row", F.lit(1)).withColumn("size", F.lit(2))
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(SOURCES)
    size: Counter = Counter()
    for _, t, s in SOURCES:
        size[s] += len(WORD.findall(t or ""))
    names = sorted(n for n in size if n is not None) + [None]
    target = dict(zip(names, mixing.targets([size[n] for n in names])))
    got: Counter = Counter()
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        got[round(r["target"], 6)] += r["taken"]
    for t in {round(t, 6) for t in target.values()}:
        alike = [x for x in target.values() if round(x, 6) == t]
        assert abs(got[t] - sum(alike)) <= mixing.BLOCK * len(alike)
    again = mixing.taken(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_documents_hold_what_is_taken(spark):
    docs = spark.createDataFrame([r for r in SOURCES if r[0] not in (3, None)], "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(docs).collect()}
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    words: Counter = Counter()
    for r in made.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(words)


def brute_mix(rows, block, shard, seed):
    """Words taken of each row (doc_id, text, source), slot by slot, and the texts by (row, pass); rows in packed order."""
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    packed = {s: [(i, w) for i, (_, t, x) in enumerate(rows) if x == s for w in WORD.findall(t or "")] for s in names}
    plan = mixing.Plan(names, [len(packed[s]) for s in names], brute_targets([len(packed[s]) for s in names]), {}, block, shard, seed)
    taken: Counter = Counter()
    words: dict = {}
    for k in range(plan.shards):
        for r in mixing.shard_slots(plan, k).itertuples():
            for at in range(r.block * block, min((r.block + 1) * block, len(packed[names[r.source_no]]))):
                i, w = packed[names[r.source_no]][at]
                taken[i] += 1
                words.setdefault((i, r.turn), []).append((at, w))
    return taken, {k: [w for _, w in sorted(v)] for k, v in words.items()}


def brute_targets(sizes):
    """Shares by weight, found by raising a common level until 150 % of the words are given out."""
    weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 1e12
    for _ in range(300):
        level = (low + high) / 2
        given = sum(min(level * w, 2 * n) for w, n in zip(weight, sizes))
        low, high = (level, high) if given < 1.5 * sum(sizes) else (low, level)
    return [min(high * w, 2 * n) for w, n in zip(weight, sizes)]


def test_targets_equal_brute_force():
    r = random.Random(4)
    for _ in range(100):
        sizes = [r.choice([0, 1, 10, 1000, r.randrange(10**6)]) for _ in range(r.randint(1, 9))]
        assert mixing.targets(sizes) == pytest.approx(brute_targets(sizes), rel=1e-6, abs=1e-6)


def test_mix_equals_brute_force(spark):
    r = random.Random(11)
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(r.choice([0, 1, 3, 70, 200, 3000 if k == 30 else 9]))), r.choice(["a", "b", "ä", None])) for k in range(60)]
    frame = clashing(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("n_chars", F.lit(None).cast("long")).withColumn("times", F.lit(1)).withColumn("text_", F.lit(2))
    taken, texts = brute_mix(rows, mixing.BLOCK, mixing.SHARD, mixing.SEED)
    found = mixing.taken(frame).collect()
    assert {r["doc_id"]: r["taken"] for r in found} == {k: taken[k] for k in range(60)}
    made = mixing.mixed_documents(frame)
    assert made.columns == frame.columns and made.schema["n_chars"] == frame.schema["n_chars"]
    got = sorted((r["doc_id"], WORD.findall(r["text"])) for r in made.collect())
    assert got == sorted((k, w) for (k, _), w in texts.items())


def test_mixing_keeps_large_ids_beside_null_ones(spark):
    most = 2**63 - 1
    docs = spark.createDataFrame([(most, "a b", "s", most), (most - 1, "c " * 500, "s", None), (None, "d e f", None, 5)], "doc_id long, text string, source string, row long")
    assert {r["doc_id"] for r in mixing.taken(docs).collect()} == {most, most - 1, None}
    assert {(r["doc_id"], r["row"]) for r in mixing.mixed_documents(docs).collect()} <= {(most, most), (most - 1, None), (None, 5)}


def test_no_sources(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(60):
        body = ". ".join(" ".join(r.choices(words, k=12)) for _ in range(6))
        rows.append((k, body if k % 4 else body.replace(" ", "*** "), "en", f"s{k % 3}", len(body)))
    passage = " ".join(r.choices(words, k=60)) + "."
    rows += [(100, rows[1][1], "en", "s0", 5), (101, rows[1][1] + " extra", "en", "s1", 5), (102, rows[2][1] + "\n" + passage, "en", "s2", 9), (103, rows[3][1] + "\n" + passage, "en", "s0", 9), (104, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [f.__name__ for _, f in pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mixture", "encoded"]
    folder, frames = f"file://{tmp_path}", []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        frames.append(docs)
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r["doc_id"] for r in frames[0].collect()}
    assert sum((k in kept) == (k % 4 > 0) for k in range(60)) >= 57
    unique = {r["doc_id"]: r["text"] for r in frames[1].collect()}
    assert not {100, 101} & set(unique) and set(unique) <= kept
    cut = {r["doc_id"]: r["text"] for r in frames[2].collect()}
    assert sum(passage in (t or "") for t in cut.values()) == 1
    assert {r["doc_id"] for r in frames[4].collect()} == {r["doc_id"] for r in frames[3].collect()}
    assert frames[4].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


PIPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage against a brute-force version of it, on what the stage before has left, with clashing columns."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from tokenizers import Tokenizer

    from codestrata.llm import bpe, bytecnn

    r = random.Random(17)
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(r.choices(words, k=60)) + "."
    rows = []
    for k in range(70):
        body = ". ".join(" ".join(r.choices(words, k=r.choice([3, 12, 25]))) for _ in range(r.randint(1, 8)))
        rows.append([k, body if k % 5 else body.replace(" ", "*** "), "en", r.choice(["a", "b", None]), len(body)])
    for k in range(70, 90):
        base = rows[r.randrange(70)][1]
        rows.append([k, r.choice([base, base + " more", base + "\n" + passage, passage + " " + base]), "en", "a", None])
    rows += [[200, None, None, None, None], [201, "", "en", "b", 0], [None, "some words of no document " * 9, "en", "b", 5], [202, "long " * 30000, "en", "a", 9], rows[3], rows[3]]
    docs = clashing(spark.createDataFrame(rows, PIPE))
    columns = docs.columns
    spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(70)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    folder, frames = f"file://{tmp_path}", []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        made = stage(spark, docs, folder)
        assert k == 4 or (made.columns == columns and made.schema["doc_id"].dataType == docs.schema["doc_id"].dataType)
        made.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        frames.append([x.asDict() for x in docs.collect()])
    held = sorted((x["doc_id"] is not None, x["doc_id"] or 0, x["text"] or "", x["source"] or "", x["n_chars"] or -1) for x in frames[0])
    # 1: the network's score decides, row by row
    model = bytecnn.fit(spark.createDataFrame(rows, PIPE), spark.read.parquet(f"{tmp_path}/labels.parquet").where(~bytecnn.held_out()))
    score = bytecnn.predict(model, [(x[1] or "").encode() for x in rows])
    want = sorted((x[0] is not None, x[0] or 0, x[1] or "", x[3] or "", x[4] or -1) for x, p in zip(rows, score) if p >= bytecnn.THRESHOLD)
    assert held == want and 0 < len(held) < len(rows)
    # 2: one of each class
    known = [(x["doc_id"], x["text"]) for x in frames[0] if x["doc_id"] is not None]
    least = {k: c for k, _, c in brute_classes(known)}
    stay = Counter(k for k in {k for k, c in least.items() if k == c})
    assert Counter(x["doc_id"] for x in frames[1] if x["doc_id"] is not None) == stay and sum(x["doc_id"] is None for x in frames[1]) == 1
    # 3: passages
    left = brute_dedup([(x["doc_id"], x["text"]) for x in frames[1]], passages.LEAST)
    want = Counter((x["doc_id"], t or "") for x, t in zip(frames[1], [left[i] for i in range(len(frames[1]))]) if t == (x["text"] or "") or WORD.search(t))
    assert Counter((x["doc_id"], x["text"] or "") for x in frames[2]) == want
    assert sum(passage in (x["text"] or "") for x in frames[2]) <= 1
    # 4: the mix, slot by slot
    order = sorted(frames[2], key=lambda x: (x["doc_id"] is not None, x["doc_id"] or 0, len(WORD.findall(x["text"] or "")), x["text"] or ""))
    _, texts = brute_mix([(x["doc_id"], x["text"], x["source"]) for x in order], mixing.BLOCK, mixing.SHARD, mixing.SEED)
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((x["doc_id"], WORD.findall(x["text"])) for x in frames[3]), key=key) == sorted(((order[i]["doc_id"], w) for (i, _), w in texts.items()), key=key)
    # 5: the public library's ids
    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    ids = [library.encode(x["text"], add_special_tokens=False).ids for x in frames[3]]
    assert Counter((x["doc_id"], x["n_tokens"]) for x in frames[4]) == Counter((x["doc_id"], len(i)) for x, i in zip(frames[3], ids))


def test_pipeline_of_nothing(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    clashing(spark.createDataFrame([], PIPE)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").count() == 0
