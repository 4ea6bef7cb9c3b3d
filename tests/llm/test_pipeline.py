"""The pipeline's stages, each against a plain check of its own input; the term search against plain dynamic programming."""

import random

import corpus_pipeline
import numpy as np
import pytest

from veilframe.llm import toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "docs")
        out.append(docs.collect())
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs.collect()]


def test_stages_return_documents(spark, kept):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for rows in kept[:5]:
        assert [*rows[0].asDict()] == columns and len({r.doc_id for r in rows}) == len(rows)
        assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)


def test_toxic_documents_go(spark, kept):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    matcher, w = toxicity.Matcher(model.lexicon), np.array(model.weights)
    clean = {r.doc_id for r in kept[0] if 1 / (1 + np.exp(-np.array(toxicity.features(r.text or "", matcher)) @ w)) < 0.3}
    assert {r.doc_id for r in kept[1]} == clean and len(clean) < len(kept[0])


def test_lines_only_go(kept):
    before = {r.doc_id: r.text for r in kept[1]}
    for r in kept[2]:
        lines = iter((before[r.doc_id] or "").split("\n"))
        assert all(any(line == x for x in lines) for line in (r.text or "").split("\n")) or not r.text
    long = [line for r in kept[2] for line in (r.text or "").split("\n") if len(line) >= 24]
    assert len(long) == len(set(long))


def test_one_of_each_group_stays(kept):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {r.doc_id: shingles(r.text) for r in kept[2]}
    comp = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and comp[a] != comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    assert {r.doc_id for r in kept[3]} == {d for d in sets if comp[d] == d}


def test_pieces_fill_sequences(kept):
    assert {r.doc_id for r in kept[4]} == {r.doc_id for r in kept[3]} == {r.doc_id for r in kept[5]}
    docs, sequences = {}, {}
    for r in kept[5]:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for groups, full in ((docs, None), (sequences, 4096)):
        for key, pieces in groups.items():
            at = 0
            for start, length in sorted(pieces):
                assert start == at and length > 0
                at += length
            assert at == key[1] if full is None else at <= full


def _row(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            q, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, q + (x != y))
    return d


@pytest.mark.parametrize("errors", [1, 2])
def test_terms_within_reach_are_found(errors):
    r = random.Random(errors)
    lex = toxicity.Lexicon(dict.fromkeys("loser scum idiot moron trash worthless".split(), 1.0), dict.fromkeys("lowei vequ laarra".split(), 1.0), errors=errors)
    matcher = toxicity.Matcher(lex)
    for _ in range(5000):
        t = list(r.choice([*lex.closed, *lex.open]))
        for _ in range(r.randint(0, 3)):
            k, c, o = r.randrange(len(t) + 1), r.choice("aeolsrtm"), r.random()
            if o < 0.35:
                t.insert(k, c)
            elif o < 0.7 and k < len(t):
                t[k] = c
            elif k < len(t) and len(t) > 3:
                del t[k]
        word = "".join(t) + r.choice(["", "", "xy"])
        all_ = [_row(x, word)[-1] for x in lex.closed if len(x) >= lex.least or x == word]
        all_ += [min(_row(x, word)) for x in lex.open if len(x) >= lex.least or word.startswith(x)]
        got = matcher.match(word)
        assert (got[1] if got else None) == min((e for e in all_ if e <= errors), default=None)
