"""Encoding, token files, rules, classifier, chat and pages: against libraries, brute force and edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import bpe, bytecnn, chat, pages, pfor, rules

ALPHABET = ["a", "B", "é", "ß", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "'", "1", "23", "!", "$$", " ", "　", "😀", "中", "<|endoftext|>", "\r\n", "\x85", "\x00", "\x1c", "ǅ", "٣", "é", "'É", "the", " of", "ing"]


def some_texts(n, most=30, seed=1):
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randint(0, most))) for _ in range(n)]


def docs_frame(spark, rows, extra=True):
    """Documents with further columns whose names operators use for their own."""
    made = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        for c in ("ids", "row", "n_units", "removed", "again", "m", "n_words", "kept", "score"):
            made = made.withColumn(c, F.lit("x"))
    return made


EDGES = [(3, None), (1, ""), (None, "one two"), (2, "word " * 30000), (2, "word " * 30000), (4, "퟿ \x00 é<|im_end|>"), (5, "a")]


# 1: encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_encoding_equals_the_library(library):
    own = bpe.encoder(bpe.VOCABULARY)
    for text in some_texts(4000, 14) + ["x" * 5000, " " * 3000, "ab" * 2000, ""]:
        ids = own.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_own_merges_equal_the_compiled_ones():
    own = bpe.encoder(bpe.VOCABULARY)
    for piece in ["internationalisation", "zzzzqqqq", "naïveté", " " * 40, "x" * 300]:
        assert own.merge(piece.encode()) == own._ranked.encode_ordinary(piece)


def test_windows_cut_only_where_it_is_certain(monkeypatch, library):
    monkeypatch.setattr(bpe, "WINDOW", 7)
    own = bpe.ForcedBoundaryBPE(bpe.vocabulary_path())
    for text in some_texts(300, 40, 2):
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_a_full_table_changes_no_ids(monkeypatch, library):
    monkeypatch.setattr(bpe, "SLOTS", 11)  # so that it is full again and again, and places collide
    monkeypatch.setattr(bpe, "GROUP", 300)
    own = bpe.ForcedBoundaryBPE(bpe.vocabulary_path())
    r = random.Random(22)
    texts = some_texts(500, 30, 3) + ["".join(r.choices("abcdefghijklmnop \x00", k=r.randint(0, 90))) for _ in range(1500)] + [None, "", "a\x00", "a\x00\x00", "a"]
    for _ in range(2):
        found = own.encode_all(texts)
        assert [f.tolist() for f in found] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own._held <= 0.6 * 2048 + 300


def test_fragments_join_to_the_text():
    own = bpe.encoder(bpe.VOCABULARY)
    for text in some_texts(200):
        raw = text.encode()
        assert b"".join(own.fragments(raw)) == raw


def test_encoding_frames(spark, library):
    made = bpe.encode(docs_frame(spark, EDGES))
    assert "ids_" in made.columns and made.columns[:3] == ["doc_id", "text", "ids"]
    back = bpe.decode(made.select("doc_id", "ids_"), "ids_").collect()
    assert sorted(r["text"] for r in back) == sorted((t or "") for _, t in EDGES)
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs_frame(spark, EDGES)).collect()}
    for k, t in EDGES:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) in found
    assert bpe.digests(docs_frame(spark, [])).count() == 0


# 5: token files


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("most", [1, 2, 50000, 2**32 - 1])
def test_blocks_round_trip(n, most):
    r = np.random.default_rng(n)
    ids = r.integers(0, most, n, endpoint=True).astype(np.uint32)
    ids[::41] = most
    ends = np.array([0, n // 3, n])
    shard = pfor.Shard(pfor.pack(ids, np.array([7, 8, 9]), ends))
    assert (shard.all() == ids).all() and shard.doc_ids.tolist() == [7, 8, 9]
    assert (shard.document(1) == ids[: n // 3]).all() and (shard.document(2) == ids[n // 3 :]).all() and len(shard.document(0)) == 0


def test_outliers_are_few_and_blocks_small():
    ids = np.full(128 * 50, 1000, np.uint32) + np.arange(128 * 50, dtype=np.uint32) % 16
    ids[::128] = 50000
    image = pfor.pack(ids, np.array([1]), np.array([len(ids)]))
    assert len(pfor.Shard(image).high) == 50 and len(image) < len(ids)


@pytest.mark.parametrize("shard_ids", [50, 1 << 18])
def test_token_files(spark, tmp_path, monkeypatch, shard_ids):
    monkeypatch.setattr(pfor, "SHARD_IDS", shard_ids)
    path = f"file://{tmp_path}/t"
    pfor.write(docs_frame(spark, EDGES), path)
    found = pfor.index(pfor.read(spark, path)).orderBy("start").collect()
    own, start = bpe.encoder(bpe.VOCABULARY), 0
    for row, (k, t) in zip(found, sorted(EDGES, key=lambda e: (e[0] is not None, e[0] or 0, e[1] or ""))):
        ids = np.array([*own.encode(t), 0], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(found) == len(EDGES)
    (tmp_path / "x").mkdir()
    n = pfor.export(pfor.read(spark, path), str(tmp_path / "x"))
    assert n == len(list((tmp_path / "x").iterdir())) > 0


def test_least_id_beside_null(spark, tmp_path):
    least, most = -(2**63), 2**63 - 1
    rows = [(least, "a"), (None, "b"), (most, "c"), (most - 1, None)]
    pfor.write(docs_frame(spark, rows), f"file://{tmp_path}/t")
    found = pfor.index(pfor.read(spark, f"file://{tmp_path}/t")).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, least, most - 1, most]
    assert {r["doc_id"] for r in bpe.digests(docs_frame(spark, rows)).collect()} == {None, least, most - 1, most}
    assert {r["doc_id"] for r in bytecnn.score(docs_frame(spark, rows), 0.5).collect()} == {None, least, most - 1, most}


def test_no_token_files(spark, tmp_path):
    pfor.write(docs_frame(spark, []), f"file://{tmp_path}/t")
    assert pfor.index(pfor.read(spark, f"file://{tmp_path}/t")).count() == 0


# 3: rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark):
    r = random.Random(3)
    texts = ["", " \n\t", "a b c d e f g h " * 3, "x\nx\n\n \n x\nx"] + [" ".join(r.choices(["a", "b", "the", "#é", "c\n", " ", "\x0b"], k=r.randint(0, 60))) for _ in range(150)]
    rows = rules.judge(docs_frame(spark, [(k, t) for k, t in enumerate(texts)] + [(None, None)])).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        text = texts[row["doc_id"]] if row["doc_id"] is not None else ""
        counts = brute_counts(text)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == counts, text
        assert row["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (row["base_failed"] and row["kept"])


def test_rules_keep_good_documents(spark):
    good = "The men of the town had gone to the river and they were not back by the time that it was dark, as ever.\nNo one was to say for how long."
    bad = good.replace(" ", "*** ")
    made = rules.keep(docs_frame(spark, [(1, good), (2, bad), (3, good), (3, good), (4, None), (5, "word " * 30000)]))
    assert sorted(r["doc_id"] for r in made.collect()) == [1, 3, 3] and made.columns == docs_frame(spark, []).columns
    assert rules.keep(docs_frame(spark, [])).count() == 0
    plan = rules.judge(docs_frame(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# 6: classifier


def noisy(n, seed=0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        words = [r.choice(["the", "river", "town", "men", "of", "dark", "long", "time"]) for _ in range(r.randint(5, 80))]
        label = k % 2
        out.append((" ".join(w if label else w + r.choice(["***", "%%%"]) for w in words).encode(), label))
    return out


def test_classifier_learns_and_covers_whole_texts():
    rows = noisy(200)
    model = bytecnn.train([t for t, _ in rows], np.array([y for _, y in rows]), epochs=4, least_steps=60)
    other = noisy(200, 1)
    p = bytecnn.predict(model, [t for t, _ in other])
    assert ((p >= 0.5) == np.array([y for _, y in other])).mean() > 0.97
    clean = b"the river of the town " * 4000
    late = bytecnn.predict(model, [clean, clean + b" dark*** men*** long%%% time*** " * 40, b"", b"a", clean])
    assert late[1] < late[0] and late[0] == late[4] and ((0 <= late) & (late <= 1)).all()


def test_batches_do_not_change_scores(monkeypatch):
    rows = noisy(60)
    model = bytecnn.train([t for t, _ in rows], np.array([y for _, y in rows]), epochs=1, least_steps=5)
    texts = [t for t, _ in rows] + [b"", b"x"]
    whole = bytecnn.predict(model, texts)
    assert np.allclose(whole, np.concatenate([bytecnn.predict(model, [t]) for t in texts]))


def brute_score(model, text):
    """The network window by window: zero bytes stand before the text, a chunk has CHUNK windows."""
    if not text:
        features = [-1.0] * (2 * bytecnn.FILTERS)
    else:
        padded = bytes(bytecnn.WIDTH - 1) + text
        z = np.array([sum(model.embed[padded[k + w]] @ model.filters[w] for w in range(bytecnn.WIDTH)) for k in range(len(text))])
        chunks = np.array([np.tanh(z[a : a + bytecnn.CHUNK].max(axis=0) + model.bias) for a in range(0, len(text), bytecnn.CHUNK)])
        features = [*chunks.max(axis=0), *chunks.mean(axis=0)]
    return 1 / (1 + np.exp(-(np.array(features) @ model.weight + model.offset)))


def test_scores_equal_brute_force(monkeypatch):
    r = random.Random(13)
    model = bytecnn.Model.fresh(3)
    texts = [bytes(r.choices(range(256), k=n)) for n in (0, 1, 5, 6, 127, 128, 129, 1000, 5000)]
    want = [brute_score(model, t) for t in texts]
    assert bytecnn.predict(model, texts) == pytest.approx(want, rel=1e-4)
    whole = bytecnn.predict(model, texts)
    for slices in (1, 2, 3, 7):  # the texts are longer than these slices
        monkeypatch.setattr(bytecnn, "SLICE", slices * bytecnn.CHUNK)
        assert (bytecnn.predict(model, texts) == whole).all()


def test_long_texts_score_alike_in_one_and_in_many_slices(monkeypatch):
    model = bytecnn.Model.fresh(4)
    text = bytes(random.Random(14).choices(range(32, 127), k=310_001))
    assert len(text) > 2 * bytecnn.SLICE
    whole = bytecnn.predict(model, [text, b"x", text])
    monkeypatch.setattr(bytecnn, "SLICE", 1 << 22)
    assert (bytecnn.predict(model, [text, b"x", text]) == whole).all()


def test_gradients_equal_differences():
    r = random.Random(15)
    texts = [bytes(r.choices(b"abcdef ", k=n)) for n in (0, 3, 140, 700)]
    labels, model = np.array([1.0, 0.0, 1.0, 0.0]), bytecnn.Model.fresh(5)

    def loss(m):
        p = np.array([brute_score(m, t) for t in texts])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p)) + 0.5e-4 * (m.weight**2).sum()

    grads = bytecnn._gradients(model, texts, labels)
    for name, at in (("embed", (97, 2)), ("filters", (3, 1, 4)), ("bias", (7,)), ("weight", (5,)), ("weight", (20,))):
        step = 1e-5
        value = getattr(model, name)
        sides = []
        for sign in (1, -1):
            moved = value.copy()
            moved[at] += sign * step
            setattr(model, name, moved)
            sides.append(loss(model))
        setattr(model, name, value)
        assert grads[name][at] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=2e-2, abs=1e-6)


def test_classifier_without_both_labels(spark):
    assert bytecnn.train([], np.array([])) == 0.5 and bytecnn.train([b"x"], np.array([1])) == 1.0
    docs, labels = docs_frame(spark, EDGES), spark.createDataFrame([(1, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = bytecnn.fit(docs, labels)
    assert model == 1.0
    assert [r["score"] for r in bytecnn.score(docs, model).collect()] == [1.0] * len(EDGES)
    assert bytecnn.keep(docs, model).count() == len(EDGES) and bytecnn.keep(docs, 0.0).count() == 0
    assert bytecnn.fit(docs_frame(spark, []), labels) == 0.5


def test_classifier_frames(spark):
    rows = noisy(120)
    docs = docs_frame(spark, [(k, t.decode()) for k, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(rows)], "doc_id long, quality int")
    model = bytecnn.fit(docs, labels.where(~bytecnn.held_out()))
    kept = {r["doc_id"] for r in bytecnn.keep(docs, model).collect()}
    assert sum((k in kept) == bool(y) for k, (_, y) in enumerate(rows)) > 110


# 9: chat


def brute_chat(rows):
    by: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    return by


CHATS = [
    (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 0, "user", "hé <\\|x <|\\<| \\"), (1, 2, None, None), (2, 0, "assistant", ""), (2, 1, "assistant", "ü\n"), (2, 1, "assistant", "ü\n"),
    (3, None, "us\\er\n<|", "late"), (3, 0, "us\\ner", "😀<\\\\|"), (None, 0, "user", "x"), (4, 0, "system", "y" * 50000),
]


@pytest.mark.parametrize("batch", [10000, 1, 3])
def test_chat_round_trip(spark, batch):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("part", F.lit(2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = chat.read_back(chat.format_conversations(turns)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = brute_chat(CHATS)
    assert len(rows) == len(by)
    for r in rows:
        turns_ = by[r["conv_id"]]
        loss = "".join(t for role, t in turns_ if role == "assistant")
        assert r["n_turns"] == len(turns_) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns_).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_escapes():
    for text in ["<|", "<\\|", "<\\\\|", "|<", "a<|b|<|", "\\", "<", "<<||"]:
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    empty = chat.assemble(np.zeros(0, np.int64), __import__("pyarrow").array([], "string"), __import__("pyarrow").array([], "string"))
    assert len(empty[1]) == 0


def test_no_chats(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# 10: pages

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x='<p>no</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
    "<div id='cookie-notice'>We use</div><main><article class=post><header><h1>T&eacute; &amp;am</h1></header><p>a <b>b</b>c<br>d<p>e&nbsp;f<div class='share-buttons'>x</div><pre>q\n r</pre>"
    "<ul><li>1<li>2</ul><table><tr><td>x<td>y</table><form>f</form></article><section id=comments><article class=comment>no</article></section></main><aside>z</aside><footer>&copy;</footer>"
)


def test_main_text():
    assert pages.main_text(pages.parse(PAGE)) == "Té &am a bc d e f q r 1 2 x y"
    assert pages.main_text(pages.parse("")) == "" and pages.main_text(pages.parse("<nav>a</nav>")) == ""
    assert pages.main_text(pages.parse("plain &lt;b&gt; text")) == "plain <b> text"
    assert pages.main_text(pages.parse("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>")) == "deep"
    assert pages.main_text(pages.parse("<article><p>cut off <b>here")) == "cut off here"
    assert pages.main_text(pages.parse("<body><div class='ad'>x</div><p>kept</p><!-- c --><textarea>t</textarea>")) == "kept"


def test_names_do_not_condemn_the_whole_page():
    for page in (
        "<body class=has-sidebar><article>a</article><aside>z</aside></body>", "<body><div id=page class=with-nav><nav>n</nav><article>a</article></div></body>", "<main class=no-sidebar><p>a</p></main>",
        "<body><article class='related-to-x share-price'><p>a</p><div class=share>s</div></article></body>", "<body><form><div><article>a</article></div><input></form></body>",
        "<body>x<main><div class=with-nav><article>a</article></div></main></body>", "<body class=has-sidebar><p>a</p></body>",
        "<div class=with-nav><article>a</article><section id=comments><article class=comment>c</article></section></div>",
    ):
        assert pages.main_text(pages.parse(page)) == "a"
    assert pages.main_text(pages.parse("<main><p>a</p><section id=comments><article class=comment>c</article></section></main>")) == "a"


def test_style_trees(spark):
    def page(k):
        return f"<body><div class=brand><p>Our house</p><ul><li>same</li></ul></div><div class=text><p>story {k} of many</p></div><div class=tail>by us</div></body>"

    rows = [(k, f"http://one.test/{k}", page(k)) for k in range(30)] + [(100, "http://two.test/", page(1)), (101, None, None), (102, "x", ""), (7, "http://one.test/7", page(7))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("noise", F.lit(1)).withColumn("host", F.lit(2))
    made = pages.extract(frame).collect()
    assert len(made) == len(rows)
    found = {r["page_id"]: r["text"] for r in made}
    assert found[3] == "story 3 of many" and found[100] == "Our house same story 1 of many by us" and found[101] == found[102] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in made)
    assert pages.extract(frame.where("page_id < 0")).count() == 0


def test_style_trees_inside_marked_articles(spark):
    page = lambda k: f"<body><article class=post><h1>Same head</h1><p>story {k}</p><div class=bio>By our house</div></article></body>"
    rows = [(k, f"http://one.test/{k}", page(k)) for k in range(30)] + [(100 + k, f"http://two.test/{k}", page(1)) for k in range(30)]
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[3] == "Same head story 3" and found[100] == "Same head story 1 By our house"


def brute_tree(hosts):
    """The unimportant nodes of each host's style tree, from the pages as nested lists [tag, name, doubtful, children]."""
    import math

    out = set()
    for host, roots in hosts.items():
        nodes: dict = {}
        for k, root in enumerate(roots):
            todo = [((), root, False)]
            while todo:
                above, (tag, name, doubtful, children), inherited = todo.pop()
                path = (*above, f"{tag}.{name}" if name else tag)
                node = nodes.setdefault(path, {"shapes": [], "texts": [], "pages": set(), "doubts": 0})
                node["shapes"].append(tuple(f"{c[0]}.{c[1]}" for c in children if not isinstance(c, str)))
                node["texts"] += [" ".join(c.split()) for c in ["".join(c for c in children if isinstance(c, str))] if c.split()]
                node["pages"].add(k)
                node["doubts"] += doubtful or inherited
                todo += [(path, c, doubtful or inherited) for c in children if not isinstance(c, str)]
        for path, node in nodes.items():
            n, m = len(node["shapes"]), len(node["pages"])
            share = lambda xs: [xs.count(x) for x in dict.fromkeys(xs)]
            shape = 1.0 if n < 2 else -sum(c / n * math.log(c / n) for c in share(node["shapes"])) / math.log(n)
            said = share(node["texts"])
            content = 0.0 if not said else 1.0 if n < 2 else 1 - sum(math.log(c) for c in said) / len(said) / math.log(n)
            doubt = 2 * node["doubts"] > n
            low = m * shape / (m + pages.DOUBT) < pages.SURE if doubt else (m * max(shape, content) + pages.ONE) / (m + pages.ONE) < pages.LEAST
            if low:
                out.add((host, path, doubt))
    return out


def random_page(r, host):
    """A page as nested lists: names ad and nav are doubtful; some hosts have deep or repeated branches."""
    words = lambda n: " ".join(r.choice(["x", "y", f"u{r.randrange(10**6)}"]) for _ in range(n))
    blocks = [["div", "brand", False, ["Our house"]], ["div", "ad", True, [words(3), ["div", "", False, [words(1)]]]], ["section", "tail", False, [r.choice(["by us", "by them"])]]]
    story = ["div", "text", False, [["p", "", False, [words(r.randint(1, 6))]] for _ in range(r.randint(1, 4))]]
    for _ in range(30 if host == "deep.test" else 1):
        story = ["div", "", False, [story]]
    blocks.insert(r.randrange(4), story)
    return ["body", "", False, blocks if r.random() < 0.8 else blocks[::-1]]


def markup(node):
    tag, name, _, children = node
    return f"<{tag}{f' class={name}' if name else ''}>{''.join(c if isinstance(c, str) else markup(c) for c in children)}</{tag}>"


def test_style_trees_equal_brute_force(spark):
    r = random.Random(21)
    hosts = {f"h{n}.test": [random_page(r, "") for _ in range(n)] for n in (1, 2, 3, 5, 7, 40)} | {"deep.test": [random_page(r, "deep.test") for _ in range(6)]}
    rows = [(k, f"http://{host}/{k}", markup(p)) for host, made in hosts.items() for k, p in enumerate(made)]
    digest = lambda path: digest_of(path[:-1], path[-1])
    digest_of = lambda above, label: pages._digest(f"{digest(above) if above else 0}/{label}")
    found = {(x["host"], x["path"], x["doubt"]) for x in pages.noisy_nodes(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_tree(hosts)
    assert found == {(h, digest(path), d) for h, path, d in want}
    assert any(h == "h2.test" and not d for h, _, d in want) and any(h == "deep.test" and len(path) > 25 for h, path, _ in want)


def texts_of(spark, htmls, noise=None, host="one.test"):
    frame = spark.createDataFrame([(k, f"http://{host}/{k}", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    made = pages.extract(frame, noise if noise is None else noise(frame))
    return [x["text"] for x in sorted(made.collect(), key=lambda x: x["page_id"])]


def test_the_tree_decides_and_names_only_bias(spark):
    page = lambda k, body: f"<body><nav><a href=/{k}>menu {k}</a></nav><article><h1>head {k}</h1><p>story {k}</p><div class=box>buy {k % 2}</div></article><div class=ad>offer {k}</div>{body}</body>"
    made = [page(k, "") for k in range(40)]
    assert texts_of(spark, made) == [f"head {k} story {k}" for k in range(40)]  # changing adverts and menus, and an advert that no name tells
    empty = texts_of(spark, made, lambda frame: pages.noisy_nodes(frame).where("false"))
    assert empty == [f"menu {k} head {k} story {k} buy {k % 2} offer {k}" for k in range(40)]  # without the tree all stays
    # a branch of such a name whose shapes differ from page to page as an article's do
    shapes = lambda k: "".join("<p>a</p>" if (k >> i) & 1 else "<h3>b</h3>" for i in range(7))
    made = [f"<body><nav>n</nav><div class=promo-story>{shapes(k)}<h2>c {k}</h2></div></body>" for k in range(100)]
    assert all(f"c {k}" in t and "n" not in t for k, t in enumerate(texts_of(spark, made)))


def test_small_hosts_lose_what_they_repeat(spark):
    page = lambda k: f"<body><div class=brand>Our house</div><div class=text><p>story {k}</p></div></body>"
    assert texts_of(spark, [page(k) for k in range(2)]) == ["story 0", "story 1"] and texts_of(spark, [page(1)]) == ["Our house story 1"]
    assert texts_of(spark, [page(1)] * 4) == ["Our house story 1"] * 4  # nothing tells them apart
    assert texts_of(spark, [page(1), None, "", "<p>" + "long text " * 60000 + "</p>"])[1:] == ["", "", ("long text " * 60000).strip()]


def test_entropy():
    assert pages.entropy([1]) == 1.0 and pages.entropy([5]) == 0.0 and pages.entropy([1] * 9) == pytest.approx(1.0)
