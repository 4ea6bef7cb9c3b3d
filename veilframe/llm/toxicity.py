"""Toxicity: Levenshtein automata over a lexicon trie, with context windows, under a fitted logistic score."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import drop_encoder

_QUOTES = "\"“”„«»‹›‘’`"
#: Opening marks with the marks that close them.
_CLOSE = {'"': '"', "“": "”", "”": "”", "„": "“”", "«": "»", "»": "«»", "‹": "›", "›": "‹", "‘": "’", "`": "`'"}
#: Words are runs of letters, apostrophes between letters included, both where terms are learned and where they are looked for.
_WORD, _JAVA_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*"), r"\p{L}+(?:['’]\p{L}+)*"
#: In longer words, as of scripts without spaces, terms are looked for at every place.
_LONG = 40


@dataclass
class Lexicon:
    """Terms with their weights. Open terms stand for every word that begins with them."""

    closed: dict[str, float] = field(default_factory=dict)
    open: dict[str, float] = field(default_factory=dict)
    #: Words near a term that clean documents use.
    except_: frozenset = frozenset()
    #: Words before a hit that speak for a report, and next to a hit that speak for somebody being addressed.
    said: frozenset = frozenset()
    you: frozenset = frozenset()
    errors: int = 1
    #: Terms shorter than this must match exactly.
    least: int = 5


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]


class Matcher:
    """A word's Levenshtein automaton, run down the lexicon's trie.

    The automaton's states are, for each number of errors, a bit mask of how many of the word's
    characters have been read; branches of the trie on which no state is left are not followed.
    """

    def __init__(self, lexicon: Lexicon):
        self.lex, self.root = lexicon, {}
        #: Segments by the lengths of the words they are looked for in, then by side, place and length: a term within reach has
        #: one of its own intact, moved by the edits before and after it. Places count from the word's start, or from its end
        #: where that is nearer and the term must end there. Length 0: words of any length, for open terms.
        self.parts: dict[int, dict[tuple[bool, int, int], set[str]]] = {}
        for terms, mark in ((lexicon.closed, "\0c"), (lexicon.open, "\0o")):
            for t, w in terms.items():
                node = self.root
                for c in t:
                    node = node.setdefault(c, {})
                node[mark] = (w, len(t))
                cuts = lexicon.errors + 1 if len(t) >= lexicon.least else 1
                for i in range(cuts):
                    lo, hi = i * len(t) // cuts, (i + 1) * len(t) // cuts
                    after, tail, closed = cuts - 1 - i, len(t) - hi, mark == "\0c"
                    back = closed and after < i
                    at, most = (tail, after) if back else (lo, i)
                    for n in range(len(t) - cuts + 1, len(t) + cuts) if closed else (0,):
                        for shift in range(-min(most, at), most + 1):
                            self.parts.setdefault(n, {}).setdefault((back, at + shift, hi - lo), set()).add(t[lo:hi])
        self.probes: dict[int, list[tuple[slice, set[str]]]] = {}
        self.seen: set[str] = set()
        self.found: dict[str, tuple[float, int]] = {}

    def _probes(self, n: int) -> list[tuple[slice, set[str]]]:
        """Where words of length ``n`` are cut, with the segments that can stand there."""
        at: dict[tuple[int, int], set[str]] = {}
        for size in (0, n):
            for (back, lo, m), known in self.parts.get(size, {}).items():
                if lo + m <= n:
                    at.setdefault((n - lo - m if back else lo, m), set()).update(known)
        self.probes[n] = [(slice(lo, lo + m), known) for (lo, m), known in at.items()]
        return self.probes[n]

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, errors) of the best term, or none: fewest errors, then the largest weight."""
        n, k = len(word), self.lex.errors
        for cut, known in self.probes.get(n) or self._probes(n):
            if word[cut] in known:
                break
        else:
            return None
        full, at = (1 << n + 1) - 1, {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << i
        start = tuple((1 << e + 1) - 1 & full for e in range(k + 1))
        best, todo = None, [(self.root, start)]
        while todo:
            node, masks = todo.pop()
            for c, child in node.items():
                if c == "\0c" or c == "\0o":
                    for e, m in enumerate(masks):
                        if (m >> n & 1 if c == "\0c" else m) and (not e or child[1] >= self.lex.least):
                            if best is None or (e, -child[0]) < (best[1], -best[0]):
                                best = (child[0], e)
                            break
                    continue
                p, now = at.get(c, 0), []
                for e, m in enumerate(masks):
                    x = (m & p) << 1
                    if e:
                        x |= masks[e - 1] << 1 | masks[e - 1] | now[-1] << 1
                    now.append(x & full)
                if any(now):
                    todo.append((child, tuple(now)))
        return None if best and best[1] and word in self.lex.except_ else best

    def best(self, token: str) -> tuple[float, int] | None:
        """As ``match``, over all words of what stands between two spaces; in a very long word, closed terms at any place."""
        found = None
        for word in _WORD.findall(token):
            hit = self.match(word)
            if not hit and len(word) > _LONG:
                hit = max(((w, 0) for t, w in self.lex.closed.items() if t in word), default=None)
            if hit and (found is None or (hit[1], -hit[0]) < (found[1], -found[0])):
                found = hit
        return found

    def hits(self, words: list[str]) -> list[tuple[int, float, int]]:
        if len(self.seen) > 100_000:
            self.seen.clear()
            self.found.clear()
        there = set(words)
        for w in there - self.seen:
            if hit := self.best(w):
                self.found[w] = hit
        self.seen |= there
        if there.isdisjoint(self.found):
            return []
        return [(i, *self.found[w]) for i, w in enumerate(words) if w in self.found]


def _edges(word: str) -> tuple[str, str]:
    """What stands before a word's first letter or digit, and after its last; a mark between two letters is an apostrophe and in neither."""
    inner = [k for k, c in enumerate(word) if c.isalnum()]
    return (word[: inner[0]], word[inner[-1] + 1 :]) if inner else (word, word)


def _marked(before: list[str], after: list[str]) -> bool:
    """Does a quotation that opens in ``before`` (whose last word is the hit, the first of ``after``) still stand open there, and close in ``after``?"""
    opened = ""
    for k, w in enumerate(before):
        lead, tail = _edges(w)
        fresh = not opened
        opened = opened or next((c for c in lead if c in _CLOSE), "")
        if opened and not (fresh and lead == w) and k < len(before) - 1 and any(c in _CLOSE[opened] for c in tail):
            opened = ""
    if not opened:
        return False
    for k, w in enumerate(after):
        lead, tail = _edges(w)
        if k and opened in lead and lead != w:
            return False
        if any(c in _CLOSE[opened] for c in tail):
            return True
    return False


def features(text: str, matcher: Matcher, window: int = 6) -> list[float]:
    """Weights of the lexicon's hits: exact, misspelled, quoted, and next to somebody addressed; share of hits; bias.

    A hit counts as quoted if the words around it, up to ``window`` to either side, hold a quotation
    that is open at the hit and closed after it, or a word of reporting before it.
    """
    words = text.lower().split()
    exact = fuzzy = quoted = aimed = 0.0
    found, said, you = matcher.hits(words), matcher.lex.said, matcher.lex.you
    for i, weight, errors in found:
        before, after = words[max(0, i - window) : i + 1], words[i : i + window + 1]
        if _marked(before, after) or not said.isdisjoint(_WORD.findall(" ".join(before[:-1]))):
            quoted += weight
        elif errors:
            fuzzy += weight
        else:
            exact += weight
            aimed += weight * (not you.isdisjoint(_WORD.findall(" ".join((*before[-3:-1], *after[1:3])))))
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(aimed), math.log1p(100 * len(found) / (len(words) + 10)), 1.0]


#: Where the fit starts and what it is held to: plain hits count, quoted ones hardly.
_PRIOR = np.array([2.0, 1.0, 0.2, 0.2, 0.1, -3.0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, terms: int = 2_000, support: int = 6, share: float = 0.01, longest: int = 24) -> Model:
    """Learn lexicon, context words and weights from labelled documents.

    labels: ``<id_col>, <label_col>`` (0 or 1; others are ignored). At most ``sample`` labelled
    documents are used (the bound), chosen by a hash of the id; the rest of their columns is not
    read. Of documents of one label whose two smallest-word hashes agree, as those of copies and
    most near copies do, one is used for the lexicon, so that the words of a much copied text do not become terms.
    Terms are words of any length up to ``longest`` letters, and word beginnings of 4 letters to that, that at least ``support`` toxic documents and a ``share``
    of them hold and that are at least 20 times as common there; at most ``terms``, the commonest.
    Words that stand before hits in clean documents far more often than in toxic ones count as
    reporting, words next to hits for which the opposite holds as addressing somebody.
    Without labels of both kinds the lexicon is empty or the weights stay at their starting values.
    """
    some = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(some), id_col).select("_text", "_y")
    least = [F.array_min(F.transform(F.split(F.lower("_text"), r"\s+"), lambda w, k=k: F.xxhash64(w, F.lit(k)))) for k in range(2)]
    rows = written(rows, "labelled")
    apart = rows.groupBy("_y", *(h.alias(f"_h{k}") for k, h in enumerate(least))).agg(F.min("_text").alias("_text"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(_JAVA_WORD), F.lit(0)))
    listed = written(apart.select("_y", words.alias("words")), "words")
    sums = {r["_y"]: r["n"] for r in listed.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sums.get(1, 0), sums.get(0, 0)
    lex = Lexicon()
    if toxic:
        count = written(listed.select("_y", F.explode("words").alias("w")).groupBy("w").agg(F.sum("_y").alias("t"), F.sum(1 - F.col("_y")).alias("c")), "counts")
        ratio = (F.col("t") + 0.1) / (toxic + 1) / ((F.col("c") + 0.1) / (clean + 1))
        size = F.length("w")
        cut = F.sequence(F.least(F.lit(4), size), F.least(F.lit(longest), size))
        heads = count.where(size > 1).select(F.explode(F.transform(cut, lambda n: F.substring("w", F.lit(1), n))).alias("p"), "t", "c")
        found = heads.groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= max(support, share * toxic)).where(ratio > 20).orderBy(F.desc("t"), "p").limit(terms * 8).collect()
        lex = _lexicon({r["p"]: r["t"] for r in found}, count, terms)
        lex.except_ = _exceptions(lex, count, toxic, clean)
        lex.said, lex.you = _contexts(rows, lex)
    return Model(lex, _weights(_sampled(rows, lex)))


def _contexts(rows: DataFrame, lex: Lexicon, window: int = 6, support: int = 5, most: int = 200) -> tuple[frozenset, frozenset]:
    """Reporting and addressing words, from how many documents of either label have them near a hit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_encoder()
        matcher = Matcher(lex)
        for b in batches:
            out = []
            for text, y in zip(b["_text"], b["_y"], strict=True):
                words = text.lower().split()
                found = matcher.hits(words)
                near = {(0, w) for i, _, _ in found for w in _WORD.findall(" ".join(words[max(0, i - window) : i]))}
                near |= {(1, w) for i, _, _ in found for w in _WORD.findall(" ".join((*words[max(0, i - 2) : i], *words[i + 1 : i + 3])))}
                out += [(side, w, int(y)) for side, w in near | ({(2, "")} if found else set())]
            yield pd.DataFrame(out, columns=["side", "w", "y"])

    found = written(rows.mapInPandas(run, "side int, w string, y int").groupBy("side", "w").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")), "contexts")
    toxic, clean = found.where("side = 2").select("t", "c").first() or (0, 0)
    if not toxic or not clean:
        return frozenset(), frozenset()
    clean_rate, toxic_rate = (F.col("c") + 0.5) / (clean + 1), (F.col("t") + 0.5) / (toxic + 1)
    pick = lambda side, n, ratio: frozenset(r["w"] for r in found.where((F.col("side") == side) & (F.col(n) >= support) & (ratio > 4)).orderBy(F.desc(n), "w").limit(most).collect())
    return pick(0, "c", clean_rate / toxic_rate), pick(1, "t", toxic_rate / clean_rate)


def _lexicon(heads: dict[str, int], count: DataFrame, terms: int) -> Lexicon:
    """Of nested beginnings the longest that still has nearly all documents of the shortest."""
    kept: dict[str, int] = {}
    longer: dict[str, list[str]] = {}
    for p in heads:
        longer.setdefault(p[:-1], []).append(p)
    for p in sorted(heads, key=lambda p: (len(p), p)):
        if any(p[:k] in heads for k in range(4, len(p))):
            continue
        now = p
        while some := [q for q in longer.get(now, []) if heads[q] >= 0.9 * heads[p]]:
            now = max(some, key=heads.get)
        kept[now] = heads[now]
    kept = dict(sorted(kept.items(), key=lambda x: (-x[1], x[0]))[:terms])
    alone = {r["w"]: r["t"] for r in count.where(F.col("w").isin(list(kept))).collect()} if kept else {}
    closed = {p: 1.0 for p, n in kept.items() if alone.get(p, 0) >= 0.5 * n}
    return Lexicon(closed, {p: 1.0 for p in kept if p not in closed})


def _exceptions(lex: Lexicon, count: DataFrame, toxic: int, clean: int, most: int = 20_000) -> frozenset:
    """Words of the sample that match a term only with errors and that clean documents use about as often."""
    usual = count.where((F.col("c") > 0) & (F.col("t") * clean < 5 * F.col("c") * toxic)).select("w")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_encoder()
        matcher = Matcher(lex)
        for b in batches:
            yield b[[bool((m := matcher.match(w)) and m[1]) for w in b["w"]]]

    return frozenset(r["w"] for r in usual.mapInPandas(near, "w string").orderBy("w").limit(most).collect())


def _sampled(rows: DataFrame, lex: Lexicon) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop_encoder()
        matcher = Matcher(lex)
        for b in batches:
            x = np.array([features(t, matcher) for t in b["_text"]]).reshape(len(b), -1)
            yield pd.DataFrame({**{f"x{k}": x[:, k] for k in range(len(_PRIOR))}, "y": b["_y"].astype(float)})

    found = rows.mapInPandas(run, ", ".join([*(f"x{k} double" for k in range(len(_PRIOR))), "y double"]))
    return np.array([tuple(r) for r in found.collect()], float).reshape(-1, len(_PRIOR) + 1)


def _weights(xy: np.ndarray, held: float = 0.5) -> list[float]:
    """Logistic regression by Newton steps, held to the prior weights; misspelled and plain hits never speak for a clean text."""
    w = _PRIOR.copy()
    x, y = xy[:, :-1], xy[:, -1]
    if len({*y.tolist()}) == 2:
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + held * np.eye(len(w)), x.T @ (y - p) - held * (w - _PRIOR))
            w += np.clip(step, -2, 2)
    w[:2] = np.maximum(w[:2], 0.5)
    w[2:5] = np.maximum(w[2:5], 0)
    return w.tolist()


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``toxicity`` from 0 to 1 (it replaces one of that name).

    Whole texts and words of any length are read. Empty and null texts get the score of a text without hits. Only the text
    is looked at; all rows, repeated ones too, and all other columns stay.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drop_encoder()
        matcher, w = Matcher(model.lexicon), np.array(model.weights)
        for texts in parts:
            x = np.array([features(t or "", matcher) for t in texts]).reshape(len(texts), -1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    scored = F.pandas_udf(run, "double")
    return docs.withColumn("toxicity", scored(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
