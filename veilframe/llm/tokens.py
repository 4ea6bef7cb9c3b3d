"""Token-id output: flat unsigned integer files with 64-bit document offsets."""

from __future__ import annotations

import gc
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, shared_dir, slices, text_slices, tidy, written

#: Unicode white space, as the tokenizers' own patterns take it, but for the plain space.
_SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Bytes as these files write them: printable ones as themselves, the others from 256 on, in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
_BYTES = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(256)}
#: Of the characters that cut words can hold, those that look otherwise as bytes, but for the space.
_OTHERWISE = re.compile("[^ -~\n]")
#: White space beyond ASCII.
_WIDE_SPACE = re.compile(f"[{_SPACES[5:]}]")


class WordCache:
    """Encodes texts word by word, each distinct word of a call once; words are remembered up to about ``most`` bytes, rare and long ones go first.

    A subclass says which words a text has (None: encode it whole) and what their ids are.
    """

    #: Bytes that a remembered word takes besides its characters and ids, about; longer words are not kept.
    EACH, LONGEST = 180, 64

    def __init__(self, most: int = 64 << 20):
        self.most = most
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size, self.seen, self.weight = np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(4))

    def _plain(self, texts: list[str]) -> list:
        raise NotImplementedError

    def _of_words(self, words: list[str], cut: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words, and the number of each; the first ``cut`` of them have been cut as the file does."""
        return _joined(self._plain(words))

    def _words(self, text: str) -> list[str] | None:
        raise NotImplementedError

    def _forget(self) -> None:
        """Keep the commonest words that take half of what is allowed; counts are halved, so that words that were common once go too."""
        keep = self.weight < self.EACH + 2 * self.LONGEST + 256
        floor = 1
        while self.weight[keep].sum() > self.most // 2:
            floor *= 2
            keep &= self.seen >= floor
        new = np.cumsum(keep) - 1
        self.known = {w: int(new[i]) for w, i in self.known.items() if keep[i]}
        self.flat = self.flat[_spans(self.start[keep], self.size[keep])]
        self.size, self.weight, self.seen = self.size[keep], self.weight[keep], self.seen[keep] // 2
        self.start = np.cumsum(self.size) - self.size

    def _learn(self, words: list[str], cut: int) -> None:
        ids, sizes = self._of_words(words, cut)
        self.known.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, ids])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])
        self.weight = np.concatenate([self.weight, self.EACH + 2 * np.fromiter(map(len, words), np.int64, len(words)) + 4 * sizes])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text."""
        listed = [self._words(t) if t else [] for t in texts]
        alone = [i for i, w in enumerate(listed) if w is None]
        for i in alone:
            listed[i] = []
        words = list(chain.from_iterable(listed))
        new = set(words).difference(self.known)
        if new:
            self._learn([*new], 0)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self.seen += np.bincount(at, minlength=len(self.seen))
        each = self.size[at]
        ids = self.flat[_spans(self.start[at], each)]
        sums = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum([len(w) for w in listed])
        counts = np.diff(sums[np.concatenate([[0], ends]).astype(np.int64)])
        if self.weight.sum() > self.most:
            self._forget()
        return self._with_whole(texts, alone, ids, counts)

    def _with_whole(self, texts: list[str], alone: list[int], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts with those of the texts ``alone``, which have none yet, by the whole tokenizer."""
        if alone:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, whole in zip(alone, self._plain([texts[i] for i in alone]), strict=True):
                parts[i] = np.array(whole, np.int32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts


class WordEncoder(WordCache):
    """A tokenizers file whose pattern breaks texts into words before anything else.

    ``spaces``: words keep the one space before them (byte-level files); otherwise white space is
    dropped and letters are folded (word-end files). What stands between white space is cut by the
    same pattern here if it is ASCII or letters up to U+00FF, and such words go to the file's model alone; the rest
    stays whole between white space, where every such pattern breaks, and goes through the whole tokenizer.
    Texts in which one of the file's added tokens stands go through the whole tokenizer at once,
    which finds such a token before anything else.
    """

    #: Words that go to the model in one text.
    TOGETHER = 100

    def __init__(self, path: str, spaces: bool):
        super().__init__()
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tok.model)
        self.model.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        vocab, end = self.tok.get_vocab(), getattr(self.tok.model, "end_of_word_suffix", None) or ""
        #: Characters of each token, without the mark of a word's end.
        self.length = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        self.length[[*vocab.values()]] = [len(t.removesuffix(end)) for t in vocab]
        self.added = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        #: Do added tokens do without "<"? Otherwise most texts need no closer look.
        self.odd = any("<" not in t for t in self.added)
        self.spaces = spaces

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As in ``WordCache``, but all texts are cut at once (``cut_bytes``), and equal words are brought together by Arrow, so that Python sees each distinct word once."""
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        alone = [i for i, t in enumerate(texts) if self._apart(t, len(t) != len(raw[i]))] if self.odd or any("<" in t for t in texts) or (sizes != [len(t) for t in texts]).any() else []
        for i in alone:
            raw[i] = b""
            sizes[i] = 0
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not self.spaces:
            data = _LOWER[data]
            large = np.flatnonzero(data[:-1] == 0xC3) + 1
            large = large[(data[large] < 0x9F) & (data[large] != 0x97)]
            data[large] += 32
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        begin, end, beyond = cut_bytes(data, bounds, self.spaces)
        #: All but white space is in a word, as is white space where words keep it.
        flat = data if self.spaces else data[_KIND[data] != 0]
        offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).dictionary_encode()
        words, code = coded.dictionary.cast(pa.string()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            whole = np.zeros(len(words), bool)
            whole[code[beyond]] = True
            new = np.concatenate([new[~whole[new]], new[whole[new]]])
            at[new] = len(self.size) + np.arange(len(new))
            self._learn([words[i] for i in new.tolist()], len(new) - int(whole[new].sum()))
        self.seen[at] += np.bincount(code, minlength=len(words))
        at = at[code]
        each = self.size[at]
        ids = self.flat[_spans(self.start[at], each)]
        sums = np.concatenate([[0], np.cumsum(each)])
        counts = np.diff(sums[np.searchsorted(begin, bounds)])
        if self.weight.sum() > self.most:
            self._forget()
        return self._with_whole(texts, alone, ids, counts)

    def _apart(self, text: str, wide: bool) -> bool:
        """Does the text have to go through the whole tokenizer at once? That is so with an added token, and with white space beyond ASCII, which can stand next to other white space."""
        return self._holds_added(text) or wide and _WIDE_SPACE.search(text) is not None

    def _holds_added(self, text: str) -> bool:
        return any(t in text.lower() for t in self.added) if "<" in text or self.odd else False

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[str], cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Words that are cut already go to the file's model alone, some in one text with line breaks between, which stand in no word there; others go through the whole tokenizer."""
        fast = self.model.encode_batch_fast([_shown(words[k : min(k + self.TOGETHER, cut)]) for k in range(0, cut, self.TOGETHER)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in fast), np.int32)
        #: A word, one character for each byte, ends where the characters of its tokens do; a file that leaves out characters gets its words one by one.
        done, ends = np.cumsum(self.length[ids]), np.cumsum(pc.binary_length(pa.array(words[:cut], pa.string())).to_numpy(), dtype=np.int64)
        upto = np.searchsorted(done, ends, "right")
        sizes = np.diff(upto, prepend=0)
        if cut and (not sizes.all() or upto[-1] != len(ids) or (done[upto - 1] != ends).any()):
            ids, sizes = _joined([e.ids for e in self.model.encode_batch_fast([w.translate(_BYTES) for w in words[:cut]], add_special_tokens=False)])
        rest, more = _joined(self._plain(words[cut:]))
        return np.concatenate([ids, rest]), np.concatenate([sizes, more])


def _shown(words: list[str]) -> str:
    """Words as the file's model takes them, with line breaks between. Only characters that look otherwise there are replaced."""
    text = "\n".join(words)
    if text.count("\n") >= len(words):  # a word is or holds a line break itself
        return "\n".join([w.translate(_BYTES) for w in words])
    return _OTHERWISE.sub(lambda m: _BYTES[ord(m[0])], text).replace(" ", _BYTE[32])


def _joined(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and the number of each list."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, sizes.sum()), sizes


#: What a byte is: white space 0, letter 1, digit 2, other 3, part of a character beyond ASCII 4.
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(9, 14), 32]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[128:] = 4
#: A-Z in lower case.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters that make a contraction after an apostrophe.
_ONE, _TWO = np.frombuffer(b"stmd", np.uint8), [np.frombuffer(x, np.uint8) for x in (b"re", b"ve", b"ll")]


def cut_bytes(data: np.ndarray, bounds: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after the other in ``data``, UTF-8, at ``bounds``: starts, ends, and whether it stays whole.

    Texts are cut by the patterns of ``WordEncoder``, all at once; between white space, what holds a character beyond
    ASCII other than a letter up to U+00FF stays whole. White space beyond ASCII, at the ends of what stays whole, is the caller's to exclude.
    """
    n = len(data)
    kind = _KIND[data]
    #: The letters from U+00C0 to U+00FF, of two bytes each.
    more = np.flatnonzero(data[: n - 1] == 0xC3)
    more = more[(data[more + 1] != 0x97) & (data[more + 1] != 0xB7)]
    kind[more] = kind[more + 1] = 1
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    blank = kind == 0
    #: Runs between white space and ends of texts, and which of them stay whole.
    turn = edge.copy()
    turn[1:n] |= blank[1:] != blank[:-1]
    first = np.flatnonzero(turn[:n])
    if not len(first):
        return first, first, np.zeros(0, bool)
    wide = np.maximum.reduceat(kind, first) == 4
    if wide.any():
        at = first[wide]
        kind[_spans(at, np.append(first[1:], n)[wide] - at)] = 4
    start = edge
    start[1:n] |= kind[1:] != kind[:-1]
    if not spaces:  # each digit is a word
        start[:n] |= kind == 2
    #: An apostrophe that begins a word and the letters of a contraction after it.
    mark = np.flatnonzero(start[: max(0, n - 1)] & (data[: max(0, n - 1)] == 39) & (kind[: max(0, n - 1)] == 3))
    if spaces:  # unless a space goes before it
        mark = mark[(data[mark - 1] != 32) | edge_at(bounds, mark)]
    if len(mark):
        ends = bounds[np.searchsorted(bounds, mark, "right")]
        one, two = data[mark + 1], data[np.minimum(mark + 2, n - 1)]
        short = (mark + 1 < ends) & np.isin(one, _ONE)
        long = (mark + 2 < ends) & np.logical_or.reduce([(one == p[0]) & (two == p[1]) for p in _TWO])
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    if spaces:
        #: The last of a run of white space goes with what follows if it is a space, and is a word of its own otherwise.
        last = np.flatnonzero(blank[: n - 1] & ~blank[1:] & ~edge_mask(bounds, n)[1:n])
        start[last] = True
        start[last[data[last] == 32] + 1] = False
    begin = np.flatnonzero(start[:n])
    end = np.append(begin[1:], n)
    beyond = kind[end - 1] == 4
    if not spaces:
        keep = ~blank[begin]
        begin, end, beyond = begin[keep], end[keep], beyond[keep]
    return begin, end, beyond


def edge_mask(bounds: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n + 1, bool)
    out[bounds] = True
    return out


def edge_at(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places are among the bounds."""
    found = np.searchsorted(bounds, at)
    return bounds[np.minimum(found, len(bounds) - 1)] == at


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start..start+size of all spans, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


_ENCODERS: dict[tuple, WordEncoder] = {}
#: Bytes of text that are encoded at once, but for a longer text.
SLICE = 1 << 21


def encoder(path: str, spaces: bool) -> WordEncoder:
    """One for each Python worker, kept from task to task while the file is the same."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, spaces] = WordEncoder(path, spaces)
    return _ENCODERS[path, spaces]


def drop_encoder() -> None:
    """Tasks of operators that encode nothing call this first: Python workers outlive their tasks, and an encoder would stay beside what they need themselves."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        give_back()


def encoded(batch: pa.RecordBatch, words: WordCache, end_id: int | None, column: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For parts of a batch: its range of rows, all ids with ``end_id`` (if there is one) after each text, and their offsets. Null counts as empty."""
    for lo, hi, texts in text_slices(batch.column(column), SLICE):
        ids, counts = words.encode(texts)
        offsets = np.concatenate([[0], np.cumsum(counts + (end_id is not None))]).astype(np.int64)
        if end_id is None:
            yield lo, hi, ids, offsets
            continue
        out = np.full(offsets[-1], end_id, np.int32)
        out[_spans(offsets[:-1], counts)] = ids
        yield lo, hi, out, offsets


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it, of a local path or a URI."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, spaces: bool = True) -> DataFrame:
    """Write the token ids of all texts, in ascending order of id (null first; then by text), to a folder that all share.

    Each part has three flat little-endian files: ``.bin`` (ids, 16 bits where the vocabulary
    allows, else 32), ``.idx`` (64-bit offsets of the documents, one more than documents) and
    ``.doc`` (64-bit document ids). Returns the manifest, one row per part: ``part, path, width,
    docs, nulls, tokens, doc_base, token_base``; the first ``nulls`` documents have no id (0 in the
    file), the bases are prefix sums of the parts' counts. Each attempt of a task writes files of
    its own, and the manifest names those of the attempt that succeeded, so a lost executor leaves
    at most files that nobody reads. Ids are those of the tokenizer file as the library reads it,
    added tokens in a text included. An empty table gives no parts.
    """
    spark = docs.sparkSession
    out_dir = out_dir or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    store(out_dir)[0].create_dir(store(out_dir)[1], recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    #: Equal ids would all meet in one range; the text's hash tells most of them apart.
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer, spaces), TaskContext.get()
        width = 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        fs, base = store(out_dir)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        docs_n = tokens = nulls = 0
        files = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if not files:
                files = {k: fs.open_output_stream(f"{base}/{name}.{k}") for k in ("bin", "idx", "doc")}
                files["idx"].write(np.zeros(1, "<u8").tobytes())
            nulls += batch.column(0).null_count
            for lo, hi, ids, offsets in encoded(batch, enc, end_id):
                files["bin"].write(ids.astype(f"<u{width}").tobytes())
                files["idx"].write((offsets[1:] + tokens).astype("<u8").tobytes())
                files["doc"].write(pc.fill_null(batch.column(0)[lo:hi], 0).to_numpy().astype("<i8").tobytes())
                docs_n, tokens = docs_n + hi - lo, tokens + len(ids)
        for f in files.values():
            f.close()
        if files:
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{out_dir}/{name}"], "width": [width], "docs": [docs_n], "nulls": [nulls], "tokens": [tokens]})

    parts = written(rows.mapInArrow(lambda it: tidy(write(it)), "part long, path string, width long, docs long, nulls long, tokens long"), "manifest")
    counts = sorted((r.part, r.docs, r.tokens) for r in parts.select("part", "docs", "tokens").collect())
    bases, d, t = [], 0, 0
    for part, n, m in counts:
        bases.append((part, d, t))
        d, t = d + n, t + m
    return parts.join(spark.createDataFrame(bases, "part long, doc_base long, token_base long"), "part")


class Flat:
    """A flat file of numbers: memory-mapped where the file system is local, elsewhere read by ranges."""

    def __init__(self, path: str, kind: str):
        self.kind = np.dtype(kind)
        fs, at = store(path)
        self.mapped = np.memmap(at, self.kind, "r") if isinstance(fs, pafs.LocalFileSystem) else None
        self.file = None if self.mapped is not None else fs.open_input_file(at)

    def read(self, lo: int, hi: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[lo:hi]
        n = self.kind.itemsize
        return np.frombuffer(self.file.read_at((hi - lo) * n, lo * n), self.kind)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents read back from the files: ``id, start`` (ids before it), ``n_tokens, ids`` (32-bit little-endian)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, idx, doc = Flat(f"{r['path']}.bin", f"<u{r['width']}"), Flat(f"{r['path']}.idx", "<u8"), Flat(f"{r['path']}.doc", "<i8")
                for first in range(0, r["docs"], 1 << 14):
                    last = min(first + (1 << 14), r["docs"])
                    at, keys = idx.read(first, last + 1).astype(np.int64), doc.read(first, last)
                    missing = np.arange(first, last) < r["nulls"]
                    for lo, hi in slices(np.diff(at), 1 << 18):
                        part = ids.read(int(at[lo]), int(at[hi])).astype("<u4")
                        own = [part[a:b].tobytes() for a, b in zip((at[lo:hi] - at[lo]).tolist(), (at[lo + 1 : hi + 1] - at[lo]).tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(keys[lo:hi], pa.int64(), mask=missing[lo:hi]), pa.array(at[lo:hi] + r["token_base"]), pa.array(np.diff(at[lo : hi + 1])), pa.array(own, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(lambda it: tidy(read(it)), "id long, start long, n_tokens long, ids binary")
