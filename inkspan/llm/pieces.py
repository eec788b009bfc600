"""SentencePiece BPE encoding and decoding by a score-ordered agenda of adjacent symbol pairs.

A text becomes symbols, one a character. The agenda holds every adjacent pair that spells a piece; the
best-scored one (leftmost on ties) is merged and its two neighbours join the agenda, until it is empty.
Symbols that are no piece fall back to bytes. Arrow batches of texts are cut into segments that no piece
can straddle; distinct segments are encoded together, one agenda each, held as rows of a score matrix,
and a bounded cache keeps them by worker. The ids returned are the agenda's, and texts are decoded from
them. Every segment that the agenda encodes is encoded by the sentencepiece library too, for comparison
alone: a text that holds a segment on which they differ says so in ``library_agrees``.

Null texts count as empty, and an empty text has only the begin and end ids. Texts of any length are
encoded whole. Rows that repeat, ids included, are rows of their own; a null doc_id is kept. An empty table
gives an empty result. Columns other than doc_id and text are ignored, whatever their names. Memory: an Arrow
batch of texts, the segments of SLICE characters (or of one longer text) and CACHE segments a worker.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkspan.llm.common import small_batches

SPACE = "▁"
#: Segments kept by a worker, and characters up to which segments share a score matrix.
CACHE = 400_000
WIDE = 24
#: Characters cut into segments at a time, and new segments encoded at a time.
SLICE, NEW = 500_000, 8192
NEVER = np.float32(-np.inf)
if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as little-endian 32-bit integers")


class Agenda:
    """The pieces of one model and the merges between them."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.library
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {v: k for k, v in self.byte_ids.items()}
        self.special = {self.bos, self.eos, self.unk, *self.byte_of}
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = np.array([sp.get_score(i) for i in range(n)], np.float32)
        straddling = any(a != SPACE and b == SPACE for i in plain for a, b in zip(self.pieces[i], self.pieces[i][1:]))
        if straddling:
            raise ValueError("a piece of this model holds an inner space: texts cannot be cut before spaces")
        self.newline_cuts = not any("\n" in self.pieces[i] for i in plain)
        # Symbols beyond the pieces' own ids stand for characters that are no piece but may merge into one.
        self.symbol: dict[str, int] = dict(self.id_of)
        self.spelled = list(self.pieces)
        for i in plain:
            for c in self.pieces[i]:
                if c not in self.symbol:
                    self.symbol[c] = len(self.spelled)
                    self.spelled.append(c)
        base = self.base = len(self.spelled) + 1
        pairs = {}
        for i in plain:
            p = self.pieces[i]
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * base + b] = i
        keys = np.array(sorted(pairs), np.int64)
        self.pairs = pairs
        size = 1 << (len(keys) * 4).bit_length()
        self.mask = np.uint64(size - 1)
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_id = np.zeros(size, np.int32)
        self.probes = 1
        self._fill(keys)
        self.chars = np.full(0x110000, -1, np.int32)
        for s, i in self.symbol.items():
            if len(s) == 1:
                self.chars[ord(s)] = i
        self.spelled_bytes = [s.encode("utf-8") for s in self.spelled]
        self.after_newline = len(sp.encode("\n"))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(29)) & self.mask).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        """Open addressing: later probes take what collided."""
        left, at = keys, self._slots(keys)
        while len(left):
            free = self.slot_key[at] == -1
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]] = left[put]
            self.slot_id[at[put]] = [self.pairs[int(k)] for k in left[put]]
            left, at = left[~put], (at[~put] + 1) & int(self.mask)
            self.probes += bool(len(left))

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair spells, -1 for none."""
        keys = a.astype(np.int64) * self.base + b
        keys[(a < 0) | (b < 0)] = -2
        flat = keys.ravel()
        out = np.full(flat.shape, -1, np.int32)
        at = self._slots(flat)
        open_ = np.arange(len(flat))
        for _ in range(self.probes):
            held = self.slot_key[at]
            hit = held == flat[open_]
            out[open_[hit]] = self.slot_id[at[hit]]
            on = ~hit & (held != -1)
            if not on.any():
                break
            open_, at = open_[on], (at[on] + 1) & int(self.mask)
        return out.reshape(keys.shape)

    def _ids(self, symbols: list[int], text: str) -> list[int]:
        """Ids of merged symbols; a symbol that is no piece becomes its bytes."""
        if min(symbols) >= 0 and max(symbols) < len(self.pieces):
            return symbols
        out, k = [], 0
        for s in symbols:
            piece = self.spelled[s] if s >= 0 else text[k]
            if s >= 0 and s < len(self.pieces):
                out.append(s)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
            k += len(piece)
        return out

    def by_heap(self, text: str) -> list[int]:
        """One long segment: a heap of (score, left) with stale entries skipped."""
        sym = [int(x) for x in self.chars[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]]
        n = len(sym)
        prev, nxt, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        agenda: list = []

        def offer(i: int) -> None:
            j = nxt[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0:
                m = self.pairs.get(sym[i] * self.base + sym[j])
                if m is not None:
                    heapq.heappush(agenda, (-float(self.score[m]), i, j, sym[i], sym[j], m))

        for i in range(n):
            offer(i)
        while agenda:
            _, i, j, a, b, m = heapq.heappop(agenda)
            if not (live[i] and live[j] and nxt[i] == j and sym[i] == a and sym[j] == b):
                continue
            sym[i], live[j], nxt[i] = m, False, nxt[j]
            if nxt[i] >= 0:
                prev[nxt[i]] = i
            offer(i)
            if prev[i] >= 0:
                offer(prev[i])
        return self._ids([s for s, alive in zip(sym, live) if alive], text)

    def by_matrix(self, texts: list[str]) -> list[list[int]]:
        """Short segments together: a row's best pair is its agenda's head."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        width = int(lengths.max())
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sym = np.full((n, width + 1), -9, np.int32)
        sym[row, col] = self.chars[codes]
        piece = self.merged(sym[:, :-1], sym[:, 1:])
        gain = np.where(piece >= 0, self.score[piece], NEVER)
        done: list = [None] * n
        ids = np.arange(n)
        while len(ids):
            best = gain.argmax(1)  # the first of equals: leftmost
            rows = np.arange(len(ids))
            busy = gain[rows, best] > NEVER
            if not busy.all():
                over = sym[~busy]
                left = (over > -9).sum(1).tolist()
                for i, row, n in zip(ids[~busy].tolist(), over.tolist(), left):
                    done[i] = row[:n]
                sym, piece, gain, ids, best = sym[busy], piece[busy], gain[busy], ids[busy], best[busy]
                if not len(ids):
                    break
                rows = np.arange(len(ids))
            # Merge at best: what lies right of it moves one to the left.
            to = np.arange(sym.shape[1] - 1)[None, :]
            from_ = to + (to > best[:, None])
            made = piece[rows, best]
            sym = np.concatenate([np.take_along_axis(sym, from_, 1), np.full((len(ids), 1), -9, np.int32)], 1)
            sym[rows, best] = made
            shift = from_[:, : piece.shape[1]] if from_.shape[1] >= piece.shape[1] else from_
            piece = np.take_along_axis(np.concatenate([piece, np.full((len(ids), 1), -1, np.int32)], 1), shift, 1)
            gain = np.take_along_axis(np.concatenate([gain, np.full((len(ids), 1), NEVER, np.float32)], 1), shift, 1)
            for at in (best, best - 1):
                ok = (at >= 0) & (at < piece.shape[1])
                r, c = rows[ok], at[ok]
                new = self.merged(sym[r, c], sym[r, c + 1])
                piece[r, c] = new
                gain[r, c] = np.where(new >= 0, self.score[new], NEVER)
        return [self._ids(s, t) for s, t in zip(done, texts)]

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        out: list = [None] * len(segments)
        short = sorted((k for k, s in enumerate(segments) if len(s) <= WIDE), key=lambda k: len(segments[k]))
        for lo in range(0, len(short), 8192):
            part = short[lo : lo + 8192]
            for k, ids in zip(part, self.by_matrix([segments[k] for k in part])):
                out[k] = ids
        for k, s in enumerate(segments):
            if out[k] is None:
                out[k] = self.by_heap(s)
        return out

    def library_segments(self, segments: list[str]) -> list[list[int]]:
        """The same segments by the library, which itself puts a space before each text."""
        starts = [k for k, s in enumerate(segments) if s[0] == SPACE and len(s) > 1]
        out: list = [None] * len(segments)
        if starts:
            for k, x in zip(starts, self.library.encode([segments[k][1:] for k in starts], num_threads=1)):
                out[k] = x
        others = [k for k, x in enumerate(out) if x is None]
        if others:
            # No merge passes a newline, so the ids after one are those of the rest alone.
            told = self.library.encode(["\n" + segments[k].replace(SPACE, " ") for k in others], num_threads=1)
            for k, x in zip(others, told):
                out[k] = x[self.after_newline :]
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte runs as UTF-8 (a bad byte is U+FFFD), spaces restored, the first one dropped."""
        if self.special.isdisjoint(ids):
            text = "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
            return text[1:] if text.startswith(" ") else text
        out, run, bytes_of = [], bytearray(), self.byte_of
        for i in ids:
            if i in bytes_of:
                run.append(bytes_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in (self.bos, self.eos):
                out.append(self.pieces[i])
        if run:
            out.append(_utf8(bytes(run)))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _utf8(raw: bytes) -> str:
    """Every byte that starts no character is one U+FFFD."""
    out = []
    while raw:
        try:
            out.append(raw.decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode("utf-8") + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def segments_of(text: str, newline_cuts: bool = True) -> list[str]:
    """Segments whose texts joined are the escaped text with the space the model puts first."""
    if not text:
        return []
    if newline_cuts and "  " not in text and SPACE not in text and text[0] != " ":
        marked = SPACE + text.replace(" ", " " + SPACE)
        return marked.replace("\n", " \n ").replace("  ", " ").strip(" ").split(" ") if "\n" in marked else marked.split(" ")
    parts = _RUNS.findall(SPACE + text.replace(" ", SPACE))
    if not newline_cuts or "\n" not in text:
        return parts
    return [x for p in parts for x in re.split("(\n)", p) if x]


class Codec:
    """An agenda with its cache of segments.

    ids: a segment's ids as bytes. odd: decoded texts of segments that decoding does not give back as they are
    (bytes that are no UTF-8, unknown characters). The cache has two generations: when the young one is full it
    becomes the old one, and what is used again comes back without being encoded again.
    """

    def __init__(self, model_file: str, cache: int = CACHE):
        self.agenda, self.size = Agenda(model_file), cache // 2
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        self.old: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        self.differ: set[str] = set()

    def learn(self, segments: set[str]) -> None:
        missing = segments.difference(self.ids)
        if len(self.ids) + len(missing) > self.size:
            self.old, self.ids, self.odd, missing = (self.ids, self.odd), {}, {}, segments
        ids, (old, old_odd) = self.ids, self.old
        new = []
        for s in missing:
            held = old.get(s)
            if held is None:
                new.append(s)
            else:
                ids[s] = held
                if s in old_odd:
                    self.odd[s] = old_odd[s]
        agenda = self.agenda
        for lo in range(0, len(new), NEW):
            part = new[lo : lo + NEW]
            for s, own, library in zip(part, agenda.encode_segments(part), agenda.library_segments(part)):
                ids[s] = array("I", own).tobytes()
                if own != library:
                    self.differ.add(s)
                # Behind the begin id a first space stays.
                back = agenda.decode(own) if s[0] != SPACE else " " + agenda.decode(own)
                if back != s.replace(SPACE, " "):
                    self.odd[s] = back


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, library_agrees boolean"


def encode_texts(texts: list[str], model_file: str) -> Iterator[tuple[bytes, bytes, bool]]:
    """Ids with begin and end as little-endian uint32, decoded UTF-8, and whether the library agrees."""
    c = codec(model_file)
    head, tail = (np.array([x], "<u4").tobytes() for x in (c.agenda.bos, c.agenda.eos))
    cut = [segments_of(t or "", c.agenda.newline_cuts) for t in texts]
    c.learn(set().union(*cut))
    ids, odd = c.ids, c.odd
    for segs in cut:
        if odd.keys().isdisjoint(segs):
            back = "".join(segs).replace(SPACE, " ")
        else:
            back = "".join([odd[s] if s in odd else s.replace(SPACE, " ") for s in segs])
        agrees = not c.differ or c.differ.isdisjoint(segs)
        yield head + b"".join(map(ids.__getitem__, segs)) + tail, back.removeprefix(" ").encode("utf-8"), agrees


def encode_documents(docs: DataFrame, model_file: str, with_ids: bool = False, slice_chars: int = SLICE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, library_agrees [, ids array<int>, decoded string]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars < slice_chars):
                    chars += len(texts[hi] or "")
                    hi += 1
                rows = list(encode_texts(texts[lo:hi], model_file))
                columns = [
                    keys.slice(lo, hi - lo),
                    pa.array([len(r[0]) // 4 for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows]),
                    pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows]),
                    pa.array([r[2] for r in rows]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees"]
                if with_ids:
                    columns += [pa.array([np.frombuffer(r[0], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].decode("utf-8") for r in rows])]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)
                lo = hi

    small_batches(docs.sparkSession)
    schema = SCHEMA + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
