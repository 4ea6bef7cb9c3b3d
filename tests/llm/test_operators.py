"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing column names; brute force where SQL has no words for it."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import chat_format, common, embedding_dedup, exact_dedup, line_dedup, minhash_dedup, packing, pii, sentencepiece_viterbi, tokens, toxicity
from veilframe.llm.queries import tokenizer

LONG = " ".join(f"word{i} and more" for i in range(4000))
ROWS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, LONG), (5, LONG + " end"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (6, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (7, "one"), (None, "one"), (8, "  \n\t "), (9, "Ünï “quoted” — текст 漢字 ▁ <|turn|>"), (10, "ends <|endoftext|> here <|STARTOFTEXT|> and <|startoftext|>")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("key", "id", "row", "comp", "n_lines", "ids", "toxicity", "pii_count", "_text")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact(docs, empty):
    got = [tuple(r)[:4] for r in exact_dedup.exact_dedup(docs, keep="largest").orderBy("doc_id").collect()]
    assert sorted(got, key=str) == sorted([(None, 7, 2, False), (1, 6, 3, False), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 3, True), (6, 6, 3, True), (7, 7, 2, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True)], key=str)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_copies_that_span_ranges(spark):
    rows = [(i, "the same text" if i % 3 else f"text {i % 50}") for i in range(3000)] + [(None, "the same text")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    want = [(i, min(x for x in groups[t] if x is not None), len(groups[t])) for i, t in rows]
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)


def test_minhash(docs, empty):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_classes(docs, words=2).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (6, 1, False), (7, 7, True), (None, None, True), (8, 8, True), (9, 9, True), (10, 10, True)}
    assert minhash_dedup.near_classes(empty).count() == 0


def test_minhash_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "TILE", 5)  # so that buckets are cut into tiles
    r = np.random.default_rng(5)
    base = [[f"w{x}" for x in r.integers(0, 300, 60)] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            for k in r.integers(0, 60, r.integers(0, 7)):
                w[k] = f"v{r.integers(0, 50)}"
            texts.append(" ".join(w))
    sets = [set(zip(t.split(), t.split()[1:], strict=False)) for t in texts]
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if comp[i] != comp[j] and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_classes(df, words=2).collect()} == dict(enumerate(comp))


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    vecs = np.concatenate([base, base + r.normal(size=(30, 16)) * 0.2, base[:5]]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vecs)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, vecs[0].tolist(), None), (904, [], 0), (None, vecs[0].tolist(), 0)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = vecs.astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(links, False)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min([comp[i], *comp[links[i]]]) for i in range(len(x))])
    assert links.any() and all(got[i] == (links[i].sum(), comp[i]) for i in range(len(x)))
    assert all(got[i] == (0, i) for i in (900, 901, 902, 903, 904))


def test_embeddings_in_double_precision(spark):
    """A cosine a little below the bound, which single precision lifts above it; values beyond single precision; a cosine at the bound; clashing columns; no rows."""
    near = [0.93, 0.3675595189897821]
    rows = [(1, [1.0, 0.0], 0), (2, [0.93 - 1.4e-11, 0.36755951898978216], 0), (3, [1e39, 2e39], 1), (4, [1e39, 2e39], 1), (5, [1e300, 2e300], 1), (6, [1.0, 0.0], 2), (7, near, 2), (7, near, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("id", "vec", "comp", "rep", "a")})
    got = sorted(tuple(r)[:3] for r in embedding_dedup.embedding_dedup(df).collect())
    x, y = np.array(rows[1][1]), np.array(near)
    assert x[0] / np.sqrt(x @ x) < 0.93
    linked = 2 if y[0] / np.sqrt(y @ y) >= 0.93 else 0
    assert got[:5] == [(1, 0, 1), (2, 0, 2), (3, 2, 3), (4, 2, 3), (5, 2, 3)]
    assert got[5] == (6, linked, 6) and len(got) == 8
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_edit_distance():
    r = np.random.default_rng(1)

    def lev(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j + 1] + 1, q[j] + 1, p[j] + (x != y)))
            p = q
        return p[-1]

    for _ in range(2000):
        a, b = ("".join(r.choice(list("ab"), r.integers(0, 30))) for _ in "ab")
        assert all(line_dedup.within(a, b, k) == (lev(a, b) <= k) for k in (1, 2, 5))


def test_lines(spark, docs, empty):
    line = "a line of some length that stands twice"
    rows = [(1, f"{line}\nshort\nother line of sufficient length"), (2, f"short\n{line}!\n{line}"), (3, None), (4, ""), (5, "short")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 3), 3: (None, 0), 4: ("", 0), 5: ("", 1)}
    out = line_dedup.line_dedup(docs)
    assert out.count() == len(ROWS) and out.where("doc_id = 4").first().text == LONG
    assert line_dedup.line_dedup(empty).count() == 0


def test_lines_against_brute_force(spark):
    """All lines of the smallest table: pairs by plain comparison, classes by repeated passes, the first line of each stays."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = {r.doc_id: (r.text or "").split("\n") for r in df.collect()}
    known = sorted({x for ls in docs.values() for x in ls if len(x) >= 24 or any(c.isalnum() for c in x)}, key=len)
    comp = dict(zip(known, known, strict=True))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if len(b) - len(a) > 2:
                break
            if len(a) >= 24 and line_dedup.within(a, b, 2):
                comp[root(a)] = root(b)
    seen, want = set(), {}
    for d in sorted(docs):
        left = []
        for x in docs[d]:
            c = root(x) if x in comp else None
            if c is None or c not in seen:
                left.append(x)
                seen.add(c)
        want[d] = "\n".join(left)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert {d: t or "" for d, t in got.items()} == want


def test_short_lines(spark):
    rows = [(1, "All rights reserved.\n\n---\nx\nsome words"), (2, "All rights reserved.\n\n---\nx\nsome word"), (3, "All rights reserved."), (4, "---\n漢\n\n漢")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n---\nsome word", 2), 3: ("", 1), 4: ("---\n漢\n", 1)}


def test_short_lines_go_in_the_query(spark):
    from collections import Counter

    from veilframe.llm.queries import op4

    lines = Counter(x for r in op4(spark, "/root/testdata/sf0.001").collect() for x in (r.text or "").split("\n") if any(c.isalnum() for c in x))
    assert not [x for x, n in lines.items() if n > 1]


def test_chat(spark):
    rows = [(1, 1, None, "user", "hi <|turn|> <\\|", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good <|end|>\n", 2.0), (1, 4, 3, "us\ner", None, 0.0), (2, 1, 99, "assistant", "", 0.0)]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, s double")
    got = {r.conv_id: r for r in chat_format.format_threads(df, score=F.col("s")).select("*", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].t] == [("user", "hi <|turn|> <\\|"), ("assistant", "good <|end|>\n"), ("us\ner", "")]
    assert got[1].loss == "good <|end|>\n" and [tuple(t) for t in got[2].t] == [("assistant", "")]
    assert chat_format.format_threads(df, score=F.col("s"), keep=2).count() == 3
    assert chat_format.format_threads(df.limit(0)).count() == 0


def test_chat_repeated_and_null_nodes(spark):
    """Repeated rows, two rows for one node, no node, a null tree, a long text, clashing columns."""
    long = "x <|y " * 20000
    rows = [(1, 1, None, "user", "q"), (1, 1, None, "user", "q"), (1, 2, 1, "assistant", long), (1, 2, 1, "assistant", "a"), (1, None, 1, "assistant", "lost"), (None, 1, None, "user", long), (3, None, None, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string").withColumns({c: F.lit("y") for c in ("tree", "path", "formatted", "t", "n", "depth", "row")})
    done = chat_format.format_threads(df)
    got = {r.conv_id: (r.path, [tuple(x) for x in r.turns], r.loss) for r in done.select("*", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got == {1: (2, [("user", "q"), ("assistant", "a")], "a"), None: (1, [("user", long)], "")}


def test_pii(spark, docs, empty):
    rows = [(1, "Mail Ann.Lee@mail.example.com, +1 (556) 555-9070, 4111 1111 1111 1111, 10.1.2.3. Mrs. Anna Smith"), (2, "ann.lee@mail.example.com 10.1.2.3 10.1.2.4"), (3, "nothing here")]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    a, b = got[1].text.split(), got[2].text.split()
    assert got[3].text == rows[2][1] and got[1].pii_count == 6 and got[2].pii_count == 3
    assert a[1].rstrip(",") == b[0] and a[9].rstrip(".") == b[1] and b[1] != b[2] and "555-9070" not in got[1].text
    digits = [int(c) for c in "".join(a[5:9]) if c.isdigit()]
    assert sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert a[-2].endswith("a") and a[-2] != "Anna"
    assert pii.replace_pii(docs, "k").count() == len(ROWS) and pii.replace_pii(empty, "k").count() == 0


def test_pii_secrets_and_further_mentions(spark):
    hexed = "9233A8EC" * 5
    rows = [(1, f'token = "{hexed}"!!'), (2, hexed), (3, "password: hunterx\nAPI_KEY='ab, cd'"), (4, '{"secret": "qwertyuiop"}'), (5, "Mr Smith met Prof. Jones. Smith's dog saw Jones, not Smithson.")]
    got = {r.doc_id: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert [got[i].pii_count for i in range(1, 6)] == [1, 1, 2, 1, 4]
    assert got[1].text.startswith('token = "') and got[1].text.endswith('"!!') and got[1].text[9:49] == got[2].text != hexed and set(got[2].text) <= set("0123456789ABCDEF")
    assert "hunterx" not in got[3].text and "ab, cd" not in got[3].text and "qwertyuiop" not in got[4].text
    w = got[5].text.split()
    assert w[1] != "Smith" and w[5].split("'")[0] == w[1] and w[4].rstrip(".") == w[8].rstrip(",") != "Jones" and w[10] == "Smithson."


def test_pii_names_across_titles_and_numbers_that_are_no_cards(spark):
    rows = [(1, "Mrs. Anna Smith met Mr. Smith. Anna and Smith left."), (2, "Dr. Smith, number 4111 1111 1111 1112 or 4111 1111 1111 1111"), (3, "call 030 1234567, my name is Jane Doe"), (4, "9807915762804490"), (4, "9807915762804490"), (None, None)]
    got = [(r.doc_id, r.text, r.pii_count) for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()]
    by = {i: (t, n) for i, t, n in got}
    w = by[1][0].replace(".", "").split()
    assert w[2] == w[5] == w[8] != "Smith" and w[1] == w[6] != "Anna" and by[1][1] == 5 and w[1].endswith("a")
    assert by[2][0].split()[1].rstrip(",") == w[2] and "1111 1112" in by[2][0] and "1111 1111 1111 1111" not in by[2][0] and by[2][1] == 2
    assert not {"1234567", "Jane", "Doe"} & set(by[3][0].replace(",", "").split()) and by[3][1] == 3
    assert sorted(got, key=str)[-3:] == sorted([(4, rows[3][1], 0), (4, rows[3][1], 0), (None, None, 0)], key=str)[-3:]


def test_pii_against_a_plain_search(spark):
    """On the smallest table: everything that a plain search finds is gone, one value has one surrogate, two values have two, and nothing else has changed."""
    import re

    def luhn(x):
        d = [int(c) for c in x][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * y, 10)) for y in d[1::2])) % 10 == 0

    found = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)|(?<!\w)[0-9a-f]{40}(?!\w)|(?<!\d)\d{16}(?!\d)")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    new = {r.doc_id: r.text for r in pii.replace_pii(df, "k").select("doc_id", "text").collect()}
    to, n = {}, 0
    for r in df.select("doc_id", "text").collect():
        a, b = r.text or "", new[r.doc_id] or ""
        old, now = found.findall(a), found.findall(b)
        if not re.search(r"\+\d|\(\d{3}\)", a) and len(old) == len(now):
            assert found.split(a) == found.split(b)
        for x, y in zip(old, now, strict=True):
            n += 1
            if x.isdigit() and len(x) == 16 and not luhn(x):
                assert x == y
            else:
                assert to.setdefault(x.lower(), y) == y != x
    assert n > 20 and len(set(to.values())) == len(to) and not set(to) & set(to.values())


def _plain(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files(docs, empty):
    got = tokens.read_token_files(tokens.write_token_files(docs, tokenizer("byte_bpe_50k.json"))).orderBy("start").collect()
    want = dict(zip([r for r in ROWS], _plain("byte_bpe_50k.json", [r[1] for r in ROWS]), strict=True))
    assert sorted((str(r.id), r.ids) for r in got) == sorted((str(k[0]), np.array(want[k], "<u4").tobytes()) for k in ROWS)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.id for r in got] == sorted((r[0] for r in ROWS), key=lambda x: -1 if x is None else x)
    assert tokens.read_token_files(tokens.write_token_files(empty, tokenizer("byte_bpe_50k.json"))).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs.dropDuplicates(["doc_id", "text"]).where("doc_id is not null"), tokenizer("word_bpe_49k.json"), window=256).collect()
    want = {k: v for (k, _), v in zip(ROWS, _plain("word_bpe_49k.json", [r[1] for r in ROWS]), strict=True) if k}
    back: dict = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(back.setdefault(r.doc_id, [])) and r.length == len(r.ids) // 4
        back[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert back == want
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert all(n & (n - 1) == 0 and n <= 256 for n in by.values())
    assert packing.pack(empty, tokenizer("word_bpe_49k.json")).count() == 0


def test_packing_null_ids_and_repeated_rows(docs):
    """Each row is a document of its own, a repeated one and one without an id too."""
    got = packing.pack(docs, tokenizer("word_bpe_49k.json"), window=256).collect()
    sizes = [len(x) for x in _plain("word_bpe_49k.json", [r[1] for r in ROWS])]
    for key in {r[0] for r in ROWS}:
        want = [n for (k, _), n in zip(ROWS, sizes, strict=True) if k == key]
        of = [r for r in got if r.doc_id == key]
        assert sum(r.length for r in of) == sum(want) and sorted(r.doc_tokens for r in of if r.start == 0) == sorted(want)


def test_packing_brings_related_documents_together(spark):
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"{w}" for w in r.choice([f"topic{i % 8}{c}" for c in "abcdefghijklmnop"] + ["the", "of", "and"], 40))) for i in range(800)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("word_bpe_49k.json"), window=4096, shard_docs=100).collect()
    assert {x.doc_id for x in got} == set(range(800))
    by: dict = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append(x.doc_id % 8)
    alike = sum(max(v.count(k) for k in range(8)) for v in by.values())
    assert alike > 0.7 * len(got)


def test_packing_cuts_copies_apart():
    x = np.ones((1000, 64), np.float32) / 8
    moved = packing._moved(np.arange(1000))
    at = packing.shard_of(packing.cuts(x[:160], moved[:160], 10), x, moved)
    assert len(set(at.tolist())) == 10 and np.bincount(at).max() < 300


def test_sentencepiece(docs):
    model = tokenizer("piece_bpe_32k.model")
    got = sentencepiece_viterbi.decode(sentencepiece_viterbi.encode(docs, model), model).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((str(k), t or "") for k, t in ROWS)
    own = sentencepiece_viterbi.pieces(model)
    score = dict(zip(own.ids.tolist(), own.scores.tolist(), strict=True))
    names = {own.raw[i].decode(): i for i in own.ids.tolist()}
    for word in (" hello", " unbelievable", " ", "   x", " quantisation"):
        best = [0.0] + [-1e18] * len(word)
        for e in range(1, len(word) + 1):
            best[e] = max((best[s] + score[names[word[s:e]]] for s in range(e) if word[s:e] in names), default=-1e18)
        assert sum(score[i] for i in own._plain([word])[0].tolist()) == pytest.approx(best[-1])


def test_toxicity(spark, docs, empty):
    r = np.random.default_rng(2)
    usual = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        w = list(r.choice(usual, 30))
        if i % 6 == 0:
            w[r.integers(0, 30)] = r.choice(["blockhead", "nincompoop", "dunderling"])
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    ask = [(0, "you are a blockhead word1"), (1, "word1 word2 word3"), (2, "a nincompop word2 word5"), (3, 'he said "blockhead" and word4 word5'), (4, None)]
    got = {x.doc_id: x.toxicity for x in toxicity.score(spark.createDataFrame(ask, "doc_id long, text string"), model).collect()}
    assert got[0] > 0.5 and got[2] > 0.3 and got[1] < 0.1 and got[3] < got[0] and got[4] < 0.1
    assert toxicity.score(docs, model).count() == len(ROWS)
    assert toxicity.score(empty, toxicity.fit(empty, df.select("doc_id", "toxic").limit(0))).count() == 0


def test_quotations():
    matcher = toxicity.Matcher(toxicity.Lexicon({"blockhead": 1.0}, said=frozenset({"said"})))
    plain = ["I’m sure a blockhead like him don’t", "l’eau a blockhead j’ai", '"hello" blockhead says "bye"', "a blockhead”"]
    quoted = ["they said blockhead to him", "a “blockhead” it was", "« a blockhead »", 'so " a blockhead " there', 'a "great blockhead" there', "„blockhead“"]
    assert all(toxicity.features(t, matcher)[0] > 0 == toxicity.features(t, matcher)[2] for t in plain)
    assert all(toxicity.features(t, matcher)[2] > 0 == toxicity.features(t, matcher)[0] for t in quoted)


def test_terms_inside_tokens_and_long_words():
    matcher = toxicity.Matcher(toxicity.Lexicon({"blockhead": 1.0}))
    assert all(toxicity.features(t, matcher)[0] > 0 for t in ["a/blockhead,b", "blockhead&&&", "%%blockhead99", "x" * 500 + "blockhead" + "y" * 500])
    assert toxicity.features("blockheaf&&&", matcher)[1] > 0 == toxicity.features("x" * 1000, matcher)[0]


def test_reporting_words_are_learned(spark):
    rows = [(i, f"they muttered blockhead to w{i % 7} a{i}" if i % 2 else f"thou blockhead w{i % 7} b{i}", (i + 1) % 2) for i in range(60)]
    df = spark.createDataFrame([r[1:] for r in rows], "_text string, _y int")
    said, you = toxicity._contexts(df, toxicity.Lexicon({"blockhead": 1.0}))
    assert "muttered" in said and "thou" in you and not said & you


def test_crc(spark):
    assert spark.sql("select crc32(cast('abc' as binary)) c").first().c == zlib.crc32(b"abc")
