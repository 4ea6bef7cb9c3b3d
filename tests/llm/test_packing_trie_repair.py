"""Best-fit packing, prefix trie and conversation repair: edge cases and brute force."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import bestfit_packing, conversation_repair, line_dedup, minhash_dedup, prefix_trie, queries
from veilframe.llm.queries import tokenizer

LONG = " ".join(f"word{i} and more" for i in range(4000))
DOCS = [(1, "alpha beta gamma delta"), (2, None), (3, ""), (4, LONG), (5, LONG + " end"), (6, "twice"), (6, "twice"), (None, "one"), (8, " \n\t "), (9, "ends <|endoftext|> here 漢字")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "item", "piece", "bin", "length", "ids", "n", "key")})


def first_fit(sizes, window):
    """Bins of best-fit decreasing, one item after the other."""
    gaps: list[int] = []
    for s in sorted(sizes, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits)[1]] -= s
        else:
            gaps.append(window - s)
    return len(gaps)


def test_best_fit_pieces(docs, spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    got = bestfit_packing.pack_best_fit(docs, tokenizer("byte_bpe_50k.json")).collect()
    want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids) + (2,) for _, t in DOCS)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    whole = []
    for key, rows in by_doc.items():
        rows.sort(key=lambda r: (r.piece, r.start))
        copies = 2 if key == 6 else 1
        for c in range(copies):
            own = rows[c::copies]
            assert [r.piece for r in own] == list(range(len(own)))
            assert all(r.length == 1024 for r in own[1:]) and 0 < own[0].length <= 1024
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()
            ids = b"".join(bytes(r.ids) for r in own)
            whole.append(tuple(np.frombuffer(ids, "<u4").tolist()))
    assert sorted(whole) == want
    check_bins([(r.sequence_id, r.offset, r.length) for r in got], 1024)
    assert bestfit_packing.pack_best_fit(docs.limit(0), tokenizer("byte_bpe_50k.json")).count() == 0


def check_bins(rows, window):
    bins = defaultdict(list)
    for b, at, n in rows:
        bins[b].append((at, n))
    for inside in bins.values():
        end = 0
        for at, n in sorted(inside):
            assert at == end
            end += n
        assert end <= window
    return len(bins)


@pytest.mark.parametrize("kind", ["remainders", "short", "same", "mixed", "one"])
def test_best_fit_bins(spark, kind):
    r = np.random.default_rng(3)
    sizes = {"remainders": r.integers(1, 64, 700), "short": r.integers(1, 4, 900), "same": np.full(300, 22), "mixed": np.concatenate([r.integers(25, 40, 60), r.integers(1, 3, 800)]), "one": np.array([1])}[kind].tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length int").repartition(5)
    got = bestfit_packing.best_fit(items, 64).join(items, "item").collect()
    assert sorted((x.item, x.length) for x in got) == list(enumerate(sizes))
    assert check_bins([(x.bin, x.offset, x.length) for x in got], 64) <= first_fit(sizes, 64) * 1.02 + 1


def test_match_against_brackets(spark):
    r = np.random.default_rng(4)
    items, gaps = r.integers(1, 30, 300).tolist(), r.integers(1, 40, 250).tolist()
    told = bestfit_packing.match(spark.createDataFrame(list(enumerate(items)), "item long, length int"), spark.createDataFrame([(i, 0, g) for i, g in enumerate(gaps)], "bin long, slot int, gap int")).collect()
    stack, want = [], []
    for size, kind in sorted([(s, 0) for s in items] + [(g, 1) for g in gaps]):
        if not kind:
            stack.append(size)
        elif stack:
            want.append((stack.pop(), size))
    assert sorted((x.length, gaps[x.bin]) for x in told if x.bin is not None) == sorted(want)
    assert len(told) == len(items) and len({x.bin for x in told if x.bin is not None}) == len(want)


TALK = [
    (0, 0, "system", "be kind"), (0, 1, "user", "hello"), (0, 2, "assistant", "hi"), (0, 3, "user", "bye"),
    (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (1, 2, "assistant", "hi"),
    (2, None, "user", None), (2, 0, None, "x"), (2, 5, "user", "…😀"), (3, 0, "user", ""), (7, 0, "u", "serhello"), (8, 0, "us", "erhello"),
    (None, 0, "user", "lost"), (101, 0, "user", "other"), (102, 0, "user", "other"), (150, 3, "user", "x" * 5000),
]


@pytest.fixture(scope="module")
def talk(spark):
    more = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if t < c % 7 * 3 else c * t}") for c in range(200, 230) for t in range(c % 23)]
    rows = spark.createDataFrame(TALK + more, "conv_id long, turn long, role string, text string")
    return rows.repartition(7).withColumns({c: F.lit("x") for c in ("conv", "i", "node", "parent", "n", "key", "depth", "chars", "symbol", "o")})


def trie(rows, shared, base):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    whole = {c: own.get(base(c), [])[: shared(c)] + v[shared(c) :] for c, v in own.items()}
    members, kids = defaultdict(list), defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    sums: dict = {}
    for n in sorted(members, key=len, reverse=True):
        sums[n] = (sum(sums[k][0] for k in kids[n]) or 1, sum(sums[k][1] for k in kids[n]) + (len(members[n]) - 1) * (len(n[-1][1]) if n else 0))
    ends = {n: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n)) for n, m in members.items()}
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), *sums[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()}


@pytest.mark.parametrize("step", [64, 2])
def test_trie_against_brute_force(talk, monkeypatch, step):
    monkeypatch.setattr(prefix_trie, "STEP", step)
    rows = [tuple(r) for r in talk.select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in prefix_trie.prefix_trie(talk).collect()]
    assert len(got) == len(set(got)) and set(got) == trie(rows, lambda c: 0, lambda c: c)
    conv = F.col("conv")
    got = {tuple(r) for r in prefix_trie.prefix_trie(talk, F.crc32(conv.cast("string")) % 6, conv - conv % 100).collect()}
    assert got == trie(rows, lambda c: zlib.crc32(str(c).encode()) % 6, lambda c: c - c % 100)
    assert prefix_trie.prefix_trie(talk.limit(0)).count() == 0


def test_prefix_sums_and_ranks(spark):
    r = np.random.default_rng(2)
    x = r.integers(-5, 9, 3000)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x)], "place long, x long").repartition(6)
    got = {p: v for p, v in prefix_trie.prefix_sums(df, "place", ["x"], block=16).select("place", "x").collect()}
    assert got == dict(enumerate(np.cumsum(x).tolist()))
    order = r.permutation(300).tolist()
    arcs = spark.createDataFrame(list(zip(order, [*order[1:], None], strict=True)), "arc long, next long")
    assert {a: p for a, p in prefix_trie.ranked(arcs).collect()} == {a: p for p, a in enumerate(order)}


NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {"u": "user", "a": "assistant"}


def repaired(rows):
    """Row by row over the automaton's states: cost, audit and lines."""

    def put(d, q, v):
        if q not in d or v[:2] < d[q][:2]:
            d[q] = v

    def close(d):
        for _ in range(4):
            for p, (c, a, o) in list(d.items()):
                for x in "ua":
                    if (p, x) in NEXT:
                        put(d, NEXT[p, x], (c + 2, a + "I", (*o, ROLE[x] + ":")))
        return d

    now = close({0: (0, "", ())})
    for role, text, fault in rows:
        new: dict = {}
        for p, (c, a, o) in now.items():
            put(new, p, (c + 3, a + "D", o))
            late = fault == "truncated"
            if fault in ("none", "truncated"):
                if (p, role[:1]) in NEXT:
                    put(new, NEXT[p, role[:1]], (c + late, a + "K", (*o, f"{role}:{text}")))
                for x in "ua":
                    if (p, x) in NEXT:
                        put(new, NEXT[p, x], (c + 2 + late, a + "R", (*o, f"{ROLE[x]}:{text}")))
        now = close(new)
    return min((v for q, v in now.items() if q in (0, 3)), key=lambda v: v[:2])


def report(rows, ids, damage):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            convs[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = set()
    for c in ids:
        v = sorted(convs[c], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in v:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "none")
            seen.add((role, text))
        turns = [x[0] for x in v if x[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:], strict=False))
        cost, audit, lines = repaired([(r, t, f) for (_, r, t), f in zip(v, faults, strict=True)])
        out.add((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def broken(spark):
    r = np.random.default_rng(6)
    words = ["Yes.", "No!", "and", "", " \t\x0b", "Why?\n", "a. b", "…😀"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(c, int(t), roles[r.integers(0, 8)], words[r.integers(0, 8)] + (f"{t}." if r.random() < 0.5 else "")) for c in range(60) for t in range(r.integers(1, 30))]
    rows += [(60, None, "user", "Hi."), (60, None, None, None), (None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (61, 4, "system", "x" * 9000), (61, 4, "user", "Same."), (61, 4, "user", "Same."), (61, 9, "assistant", "End.")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({c: F.lit("x") for c in ("key", "i", "symbol", "audit", "fault", "o", "_hit", "_copy", "shape")})


@pytest.mark.parametrize("block", [8, 2])
def test_repair_against_states(broken, monkeypatch, block, tmp_path):
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows = [tuple(r) for r in broken.select("conv_id", "turn", "role", "text").collect()]
    broken.write.parquet(f"{tmp_path}/conversations.parquet")
    got = [tuple(r) for r in queries.op13(broken.sparkSession, str(tmp_path)).collect()]
    assert len(got) == 63 and set(got) == report(rows, {r[0] for r in rows}, True)


def test_repair_of_nothing(broken):
    told, turns = conversation_repair.repair(broken.limit(0))
    assert told.count() == turns.count() == 0
    gone = broken.where("conv_id = 60").withColumn("text", F.lit(""))
    (told,) = conversation_repair.repair(gone)[0].collect()
    assert (told.blank, told.cost, told.audit) == (2, 6, "DD")


def test_cells_against_all_edits():
    """All edits of short spans with up to two insertions at each place: the least cost, and of these the least audit."""
    single = conversation_repair.terminals()
    for symbols in ("u", "ux", "aS", "sau", "Aou"):
        cells = single[symbols[0]]
        for s in symbols[1:]:
            cells = conversation_repair.times(cells, single[s])
        ways = []
        puts = ["", "u", "a", "ua", "au"]
        for edits in product(*[["D"] if s == "x" else [e for e in ("K", "Ru", "Ra", "D") if e != "K" or s in "suaSUA"] for s in symbols]):
            for ins in product(puts, repeat=len(symbols) + 1):
                text, cost, audit = ins[0], 2 * sum(map(len, ins)), "I" * len(ins[0])
                for s, e, after in zip(symbols, edits, ins[1:], strict=True):
                    text += ("" if e == "D" else s.lower() if e == "K" else e[1]) + after
                    cost += (3 if e == "D" else (0 if e == "K" else 2) + s.isupper())
                    audit += e[0] + "I" * len(after)
                if re.fullmatch("(s?(ua)+)?", text):
                    ways.append((cost, audit))
        assert min(cells[k] for k in ((0, 0), (0, 3)) if k in cells) == min(ways)


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_conversation_repair"])
def test_against_duckdb(spark, name):
    import duckdb

    path = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{path}/conversations.parquet'")
    want = c.execute(queries.ORACLE[name])
    names = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, path).select(*names)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def regular(n):
    """A word of ``a`` and ``b`` in which each doubling repeats the word with both changed, and its complement: sums of powers of two do not tell them apart."""
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_regular_words_and_lines_stay_apart(spark):
    a, b = regular(2048)
    rows = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x {b} x"), (4, f"{b} x {a} x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_classes(rows, words=2).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (3, 3), 4: (3, 4)}
    kept = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(rows).collect()}
    assert kept == {r.doc_id: (r.text, 0) for r in rows.collect()}


def test_sets_that_only_look_equal_are_split(spark):
    """Where sizes and fingerprints agree, the full sets decide."""
    rows = spark.createDataFrame([(1, "one two three four"), (2, "one two three four"), (3, "five six seven eight"), (4, "five six  seven eight"), (5, "nine")], "doc_id long, text string")
    able = rows.selectExpr("doc_id id", "xxhash64(text) hash", "1L n", "7L p0", "9L p1").where("id < 5")
    odd = minhash_dedup._unlike(rows.selectExpr("doc_id id", "xxhash64(text) hash", "text"), able, 2)
    want = {r.hash for r in able.where("id > 2").collect()}
    assert {r.hash for r in odd.collect()} == want and len(want) == 2


def test_index_scores_of_common_and_rare_terms():
    """Scores by rows of common terms and lists of rare ones are those of a plain sum; the table of signs is made once."""
    from veilframe.llm import packing

    rng = np.random.default_rng(5)
    docs = [rng.zipf(1.3, n).clip(0, 499).astype(np.uint16) for n in rng.integers(1, 300, 60)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=500)
    idf, mean = packing.idf_of(df, 60), float(np.mean([len(d) for d in docs]))
    index = packing.Index(docs, idf, mean)
    assert 0 < len(index.rows) < len(index.first)
    for k in range(60):
        plain = [sum(idf[t] * (tf := np.count_nonzero(d == t)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[k].tolist())) for d in docs]
        assert np.allclose(index.scores(k), plain, rtol=1e-4)
    assert packing._signs(500) is packing._signs(500)
