"""SentencePiece encoding and decoding by a Viterbi search over batches of equally long words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Hashed, slices, text_slices, tidy
from .tokens import WordCache, encoded

SPACE = "▁"
#: Places of a table of the search: words times their length.
CELLS = 1 << 18


class Pieces(WordCache):
    """The pieces of a model, as sorted substring hashes, and the search over them.

    Words are cut before each run of spaces; as no piece holds a space after another character,
    the best segmentation of a text is that of its words. Whether a space goes in front of a text
    is the model's setting; models that change characters or spaces otherwise are refused.
    """

    def __init__(self, path: str):
        super().__init__(128 << 20)
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lead = sp.normalize("x") == SPACE + "x"
        probe = "  ﬁ  Ａ b\t "
        if sp.normalize(probe) != SPACE * self.lead + probe.replace(" ", SPACE):
            raise ValueError("the model changes texts before it cuts them")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        names = [sp.id_to_piece(i) for i in plain]
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("a piece holds a space after another character")
        points, start, end = _joined(names)
        hashes = Hashed(points).of(start, end)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain, np.int32)[order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.scores = np.array([sp.get_score(i) for i in plain], np.float64)[order]
        self.longest = max(map(len, names))
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.penalty = float(self.scores.min()) - 10
        self.raw = [b""] * n
        for i, p in zip(plain, names, strict=True):
            self.raw[i] = p.replace(SPACE, " ").encode("utf-8", "surrogatepass")
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.named: dict[str, tuple[float, int]] = {}

    def _words(self, text: str) -> list[str]:
        """The text, with the space that the model puts in front, cut before each run of spaces."""
        first, *parts = (" " * self.lead + text).split(" ")
        out, run = [first] if first else [], 1
        for p in parts[:-1] if parts and not parts[-1] else parts:
            if p:
                out.append(" " * run + p)
                run = 1
            else:
                run += 1
        if parts and not parts[-1]:
            out.append(" " * run)
        return out

    def _plain(self, words: list[str]) -> list[np.ndarray]:
        """Ids of the best segmentation of each word, by groups of equal length."""
        out: list = [None] * len(words)
        for first, last in slices(np.fromiter(map(len, words), np.int64, len(words)), CELLS):
            points, start, end = _joined(words[first:last])
            points = np.where(points == ord(SPACE), 0x110000, points)  # no piece has it: it is spelt in bytes
            points = np.where(points == 32, ord(SPACE), points).astype(np.uint32)
            table, size = self._table(points, start, end), end - start
            for n in np.unique(size).tolist():
                group = np.flatnonzero(size == n)
                step = max(1, CELLS // (n + 1))
                for lo in range(0, len(group), step):
                    own = group[lo : lo + step]
                    for w, ids in zip((own + first).tolist(), self._search(points, table, start[own], n), strict=True):
                        #: Pieces are found by hash; the characters of those that stand in the result are compared here.
                        whole = self.unknown in ids or b"".join([self.raw[i] for i in ids]) == words[w].encode("utf-8", "surrogatepass")
                        out[w] = np.array(ids if whole else self._spelt(words[w]), np.int32)
        return out

    def _table(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which piece stands at each place, for each length; the number of pieces where there is none."""
        hashed, rest = Hashed(points), np.repeat(end, end - start) - np.arange(len(points))
        table = np.full((self.longest + 1, len(points)), len(self.hashes), np.int32)
        for k in range(1, self.longest + 1):
            at = np.flatnonzero(rest >= k)
            h = hashed.of(at, at + k)
            found = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            table[k, at] = np.where(self.hashes[found] == h, found, len(self.hashes))
        return table

    def _spelt(self, word: str) -> list[int]:
        """The same search for one word, by the characters of the pieces."""
        if not self.named:
            self.named = {self.raw[i].decode("utf-8", "surrogatepass"): (s, i) for s, i in zip(self.scores.tolist(), self.ids.tolist(), strict=True)}
        best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])]
        for e in range(1, len(word) + 1):
            now = (best[e - 1][0] + self.penalty, 1, [self.bytes.get(b, self.unknown) for b in word[e - 1].encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown])
            for k in range(1, min(e, self.longest) + 1):
                part = word[e - k : e]
                if SPACE not in part and (hit := self.named.get(part)) and best[e - k][0] + hit[0] >= now[0]:
                    now = (best[e - k][0] + hit[0], k, [hit[1]])
            best.append(now)
        out, e = [], len(word)
        while e:
            out.append(best[e][2])
            e -= best[e][1]
        return [i for ids in reversed(out) for i in ids]

    def _search(self, points: np.ndarray, table: np.ndarray, start: np.ndarray, n: int) -> list[list[int]]:
        """Ids of words of length ``n``, all of them advancing together by one character."""
        rows = len(start)
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        back, piece = np.zeros((n + 1, rows), np.int32), np.full((n + 1, rows), -1, np.int32)
        scores, ids, column = np.append(self.scores, -np.inf), np.append(self.ids, -1), np.arange(rows)
        for e in range(1, n + 1):
            #: The last piece's length, the longest first: at equal scores it stands.
            k = np.arange(min(e, self.longest), 0, -1)[:, None]
            at = table[k, start + e - k]
            total = best[e - len(k) : e] + scores[at]
            top = total.argmax(0)
            spelt = best[e - 1] + self.penalty
            better = total[top, column] >= spelt
            best[e] = np.where(better, total[top, column], spelt)
            back[e] = np.where(better, len(k) - top, 1)
            piece[e] = np.where(better, ids[at[top, column]], -1)
        steps, at = [], np.full(rows, n)
        while at.any():
            live = at > 0
            got, k = np.where(live, piece[at, column], -2), np.where(live, back[at, column], 0)
            at = at - k
            steps.append(np.where(got == -1, -3 - at, got))
        out = []
        for r, row in enumerate(np.array(steps[::-1]).T.tolist() if steps else [[]] * rows):
            ids: list[int] = []
            for p in row:
                if p >= 0:
                    ids.append(p)
                elif p < -2:
                    c = int(points[start[r] - 3 - p])
                    raw = chr(ord(SPACE) if c == 0x110000 else c).encode("utf-8", "surrogatepass")
                    ids += [self.bytes.get(b, self.unknown) for b in raw] if self.bytes else [self.unknown]
            out.append(ids)
        return out

    def text(self, ids: np.ndarray) -> str:
        joined = b"".join([self.raw[i] for i in ids.tolist()])
        return (joined[1:] if self.lead and joined[:1] == b" " else joined).decode("utf-8", "replace")


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    end = np.cumsum([len(w) for w in words])
    return points, np.concatenate([[0], end[:-1]]).astype(np.int64), end.astype(np.int64)


_PIECES: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One for each Python worker, kept from task to task while the model is the same."""
    if model not in _PIECES:
        _PIECES.clear()
        _PIECES[model] = Pieces(model)
    return _PIECES[model]


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (little-endian unsigned 32-bit piece ids) and ``n_tokens`` (columns of these names are replaced).

    A text's ids are its segmentation into pieces of the greatest summed score, a space put in
    front if the model says so, at equal scores with the longest pieces at the end; characters that
    no piece has are spelt in byte pieces, at a score below all others. Empty and null texts have
    no ids. Whole texts of any length are read; all rows and other columns stay. User-defined
    pieces are taken by their score like all others.
    """
    names = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for lo, hi, ids, offsets in encoded(batch, own, None, at):
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(raw, pa.binary()), pa.array(np.diff(offsets))], names=[*names, "ids", "n_tokens"])

    return docs.mapInArrow(lambda it: tidy(run(it)), T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]))


def decode(coded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded`` (it replaces a column of that name): the text of ``ids_col`` (null: empty), without the space that encoding put in front."""
    names = [c for c in coded.columns if c != "decoded"]
    coded = coded.select(*(F.col(f"`{c}`") for c in names))
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        for batch in batches:
            for lo, hi, raw in text_slices(batch.column(at), 1 << 20):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array([own.text(np.frombuffer(b, "<u4")) for b in raw], pa.string())], names=[*names, "decoded"])

    return coded.mapInArrow(lambda it: tidy(run(it)), T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())]))
