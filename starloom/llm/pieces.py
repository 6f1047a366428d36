"""SentencePiece encoding and decoding by suffix-array matching.

A model's pieces never hold a word boundary mark behind another character, so no token crosses
from one word into the next, and each distinct word is encoded once. The distinct words of a batch
are one text: its suffixes are sorted by as many characters as the longest piece has, every piece
is binary-searched for the range of suffixes that begin with it, and each occurrence is an edge
from its first to its last place. The edges are sorted by where they end and relaxed in that order.

The models are of the BPE kind, whose result is not a cheapest path of piece scores: the merge
order decides. What makes a path the right one is local, though: a sequence of pieces is the
encoding of its text exactly if each piece is that of its own characters and each neighbouring
pair that of the two's. So exactly one edge into a place extends the encoding of the text before it,
and relaxing keeps that edge. Pairs are tried by merging once and remembered.

Runs of spaces merge last, all at one score, from the left; they are encoded apart. Characters
without a piece become their UTF-8 bytes.

Defined cases: null and empty texts have no ids; the mark itself in a text counts as a space, as
in the library, and comes back as one; rows that repeat get a row each; an empty table gives no
row; further columns are ignored. Models that are no BPE, that normalise, or that do not fit
the above raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordTable, by_bytes, numbered, spread

MARK = "▁"
_SPACE = np.zeros(256, bool)
_SPACE[0x20] = True
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in plain}
        self.score = {p: sp.get_score(i) for p, i in self.pieces.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.size = n
        self.spaces = {len(p): i for p, i in self.pieces.items() if not p.strip(MARK)}
        runs = {self.score[MARK * k] for k in self.spaces if k > 1}
        words = [p for p in self.pieces if p.strip(MARK)]
        known = set("".join(words))
        if sp.encode(" a  b") != sp.encode(MARK + "a" + MARK * 2 + "b") or any(MARK in p[1:] for p in words) or not known <= self.pieces.keys() or len(runs) > 1 or min(self.score[p] for p in words if len(p) > 1) <= max(runs, default=-1e30) or any(not sp.is_byte(i) for i in self.bytes):
            raise ValueError("the model is not of the kind that can be encoded word by word")
        self.code = {c: k for k, c in enumerate(sorted(known | {MARK}), 1)}
        self.longest = max(map(len, words))
        self.words = sorted((p for p in words), key=lambda p: [self.code[c] for c in p])
        self.word_ids = np.array([self.pieces[p] for p in self.words] + [self.pieces[MARK]], np.int64)
        self.words.append(MARK)
        self.length = np.array([len(p) for p in self.words])
        text = np.zeros((len(self.words), self.width), np.uint64)
        for k, p in enumerate(self.words):
            text[k, : len(p)] = [self.code[c] for c in p]
        top = np.where(np.arange(self.width) < self.length[:, None], text, U64(0xFFFF))
        self.low, self.high = self.keys(text), self.keys(top)
        lut = np.zeros(max(map(ord, self.code)) + 1, np.uint16)
        for c, k in self.code.items():
            lut[ord(c)] = k
        self.lut = lut
        # text of each id, for decoding and for trying pairs
        self.text = [""] * (n + 1)
        for p, i in self.pieces.items():
            self.text[i] = p
        self.alone = np.zeros(n + 1, bool)
        for p, i in self.pieces.items():
            self.alone[i] = self.merges(p) == [p]
        raw = [self.text[i].replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes):
            raw[i] = bytes([b])
        self.out = np.frombuffer(b"".join(raw), np.uint8)
        self.out_count = np.array([len(x) for x in raw], np.int64)
        self.out_start = np.cumsum(self.out_count) - self.out_count
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.table = WordTable(self.learn)
        self.run_ids: dict[int, list[int]] = {}

    @classmethod
    def kept(cls, path: str) -> "Encoder":
        """The one of this worker process."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    @property
    def width(self) -> int:
        return -(-self.longest // 4) * 4

    def keys(self, codes: np.ndarray) -> list[np.ndarray]:
        """Codes (item, place) as 64-bit words of four, most significant first."""
        c = codes.astype(U64)
        return [(c[:, k] << U64(48)) | (c[:, k + 1] << U64(32)) | (c[:, k + 2] << U64(16)) | c[:, k + 3] for k in range(0, self.width, 4)]

    def merges(self, text: str, apart: int = -1) -> list[str] | None:
        """The pieces of a text by merging the best neighbours first, the leftmost of equals; None if a merge crosses `apart`."""
        parts, at = list(text), list(range(len(text)))
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, k
            if best is None:
                return parts
            if at[where + 1] == apart:
                return None
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
            del at[where + 1]

    def fits(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each pair of ids stays apart when its text is encoded; id `size` stands for a start or unknown character."""
        key = before * (self.size + 1) + after
        out = self.alone[after].copy()
        ask = np.flatnonzero(out & (before < self.size))
        for again in (False, True):
            slot = np.minimum(np.searchsorted(self.pair_keys, key[ask]), max(0, len(self.pair_keys) - 1))
            known = self.pair_keys[slot] == key[ask] if len(self.pair_keys) else np.zeros(len(ask), bool)
            if again or known.all():
                break
            new = np.unique(key[ask[~known]])
            verdict = []
            for k in new.tolist():
                a, b = divmod(k, self.size + 1)
                verdict.append(self.merges(self.text[a] + self.text[b], len(self.text[a])) is not None)
            at = np.searchsorted(self.pair_keys, new)
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, at, new), np.insert(self.pair_fits, at, verdict)
        if len(ask):
            out[ask] = self.pair_fits[slot]
        return out

    def suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix array of the text by its first `width` codes, and the sorted keys."""
        wide = np.concatenate([codes, np.zeros(self.width, np.uint16)]).astype(U64)
        quad = (wide[:-3] << U64(48)) | (wide[1:-2] << U64(32)) | (wide[2:-1] << U64(16)) | wide[3:]
        keys = [quad[k : k + len(codes)] for k in range(0, self.width, 4)]
        order = np.argsort(keys[0], kind="stable")
        head = keys[0][order]
        tied = np.zeros(len(order), bool)
        tied[1:] = head[1:] == head[:-1]
        group = np.cumsum(~tied)
        tied[:-1] |= tied[1:].copy()
        i = np.flatnonzero(tied)  # only suffixes that share four characters need the rest
        order[i] = order[i][np.lexsort((*(k[order[i]] for k in keys[:0:-1]), group[i]))]
        return order, [k[order] for k in keys]

    def ranges(self, ranked: list[np.ndarray], bound: list[np.ndarray]) -> np.ndarray:
        """First suffix not below each bound."""
        low, high = np.searchsorted(ranked[0], bound[0], "left"), np.searchsorted(ranked[0], bound[0], "right")
        while (low < high).any():
            at = np.flatnonzero(low < high)
            mid = (low[at] + high[at]) >> 1
            below = np.zeros(len(at), bool)
            even = np.ones(len(at), bool)
            for k in range(1, len(ranked)):
                x, y = ranked[k][mid], bound[k][at]
                below |= even & (x < y)
                even &= x == y
            low[at] = np.where(below, mid + 1, low[at])
            high[at] = np.where(below, high[at], mid)
        return low

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of mark + word for distinct words, packed."""
        texts = [MARK + w.decode() for w in words]
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        codes = np.where(points < len(self.lut), self.lut[np.minimum(points, len(self.lut) - 1)], 0).astype(np.uint16)
        size = np.array([len(x) for x in texts], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        order, ranked = self.suffixes(codes)
        first, stop = self.ranges(ranked, self.low), self.ranges(ranked, self.high)
        count = stop - first
        start = order[spread(first, count)]
        piece = np.repeat(self.word_ids, count)
        end = start + np.repeat(self.length, count)
        odd = np.flatnonzero(codes == 0)  # characters that no piece has, and the ends of words
        odd = np.setdiff1d(odd, begin + size, assume_unique=True)
        start, piece, end = np.concatenate([start, odd]), np.concatenate([piece, np.full(len(odd), self.size)]), np.concatenate([end, odd + 1])
        word = np.repeat(np.arange(len(texts)), size + 1)
        reach = end - begin[word[start]]
        order = np.argsort(reach, kind="stable")
        start, piece, end, reach = start[order], piece[order], end[order], reach[order]
        last = np.full(len(codes) + 1, -1, np.int64)  # id of the last token of the encoding up to a place
        back = np.zeros(len(codes) + 1, np.int64)
        last[begin] = self.size
        edge = np.append(np.flatnonzero(np.diff(reach, prepend=-1)), len(reach))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            s, p, e = start[a:b], piece[a:b], end[a:b]
            before = last[s]
            ok = before >= 0
            ok[ok] = (p[ok] == self.size) | self.fits(before[ok], p[ok])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]
        # from each word's end to its start
        at, owner, depth, tokens, owners, places = begin + size, np.arange(len(texts)), 0, [], [], []
        live = at > begin
        at, owner = at[live], owner[live]
        while len(at):
            tokens.append(last[at])
            owners.append(owner)
            places.append(back[at])
            at = back[at]
            on = at > begin[owner]
            at, owner = at[on], owner[on]
            depth += 1
        token, owner, place = np.concatenate(tokens), np.concatenate(owners), np.concatenate(places)
        order = np.lexsort((place, owner))
        token, owner, place = token[order], owner[order], place[order]
        if (token < 0).any():
            raise ValueError("a word has no encoding")
        if (token == self.size).any():
            return self.with_bytes(token, owner, place, points, len(texts))
        raw = token.astype(np.uint32).tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(texts))) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def with_bytes(self, token, owner, place, points, n: int) -> list[bytes]:
        out: list[list[int]] = [[] for _ in range(n)]
        for t, o, p in zip(token.tolist(), owner.tolist(), place.tolist(), strict=True):
            out[o].extend([t] if t < self.size else (self.bytes[b] for b in chr(points[p]).encode()))
        return [np.array(x, np.uint32).tobytes() for x in out]

    def spaces_of(self, n: int) -> list[int]:
        """Ids of n marks: equal scores merge from the left."""
        if n not in self.run_ids:
            stack: list[int] = []
            for _ in range(n):
                stack.append(1)
                while len(stack) > 1 and stack[-2] + stack[-1] in self.spaces:
                    stack[-2:] = [stack[-2] + stack[-1]]
            self.run_ids[n] = [self.spaces[k] for k in stack]
        return self.run_ids[n]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        texts = [x.replace(MARK.encode(), b" ") for x in texts]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts], out=at[1:])
        data = np.frombuffer(b"".join(b" " + x for x in texts) + b" ", np.uint8)
        edge = np.flatnonzero(np.diff(_SPACE[data].view(np.int8), prepend=1))
        starts, ends = edge[0::2], edge[1::2]
        start, count = self.table.lookup(data, starts, ends) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        first = np.searchsorted(starts, at)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        gap = starts - np.maximum(np.concatenate([[0], ends[:-1]]) if len(ends) else ends, at[owner])
        tail = at[1:] - np.maximum(at[:-1], np.where(first[1:] > first[:-1], ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, 0))
        tail[np.diff(at) == 1] = 0  # an empty text gets no mark
        # segments: before each word its further marks, then the word; behind each text its last spaces
        lone = np.zeros(len(starts), bool)
        wide = np.flatnonzero(gap > 1)
        lone[wide] = self.table.ids[start[wide]] == self.spaces[1]
        marks = np.where(gap > 1, gap - 1 + lone, 0)
        lengths = sorted(set(marks.tolist()) | set(tail.tolist()) - {0})
        runs = [np.array(self.spaces_of(k), np.uint32) for k in lengths]
        base = len(self.table.ids) + np.cumsum([0, *map(len, runs)])
        store = np.concatenate([self.table.ids, *runs])
        slots = 2 * len(starts) + len(texts)
        seg_start, seg_count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        run_start = dict(zip(lengths, base.tolist(), strict=False))
        run_count = dict(zip(lengths, map(len, runs), strict=True))
        slot = 2 * np.arange(len(starts)) + owner
        i = np.flatnonzero(marks)
        seg_start[slot[i]], seg_count[slot[i]] = [run_start[k] for k in marks[i].tolist()], [run_count[k] for k in marks[i].tolist()]
        seg_start[slot + 1], seg_count[slot + 1] = start + lone, count - lone
        behind = 2 * first[1:] + np.arange(len(texts))
        i = np.flatnonzero(tail)
        seg_start[behind[i]], seg_count[behind[i]] = [run_start[k] for k in tail[i].tolist()], [run_count[k] for k in tail[i].tolist()]
        ids = store[spread(seg_start, seg_count)]
        total = np.zeros(slots + 1, np.int64)
        np.cumsum(seg_count, out=total[1:])
        cut = total[behind + 1].tolist()
        return [ids[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Texts of id sequences, as bytes; the first mark is dropped."""
        flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64)
        count = self.out_count[flat]
        raw = self.out[spread(self.out_start[flat], count)].tobytes()
        total = np.zeros(len(flat) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        cut = total[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a + (raw[a : a + 1] == b" ") : b] if b > a else b"" for a, b in zip(cut[:-1], cut[1:], strict=True)]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """The documents with `ids` array<int> and n_ids, in place of `text` (and of columns of these two names, if there are any); scans in place, no shuffle."""
    kept = [c for c in docs.columns if c not in ("text", "ids", "n_ids")]
    source, names = numbered(docs.withColumn("text", F.col("text").cast("string")))
    columns, text = [names[c] for c in kept], names["text"]

    def work(batches):
        encoder = Encoder.kept(path)
        for batch, texts in by_bytes(batches, text):
            ids = encoder.encode(texts)
            count = np.array([len(x) for x in ids], np.int64)
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))), pa.array(count)], names=[*columns, "ids", "n_ids"])

    schema = source.select(*columns, F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("long").alias("n_ids")).schema
    return source.mapInArrow(work, schema).toDF(*kept, "ids", "n_ids")


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The rows with `text` decoded from a column of ids."""
    columns = [c for c in rows.columns if c != "text"]

    def work(batches):
        encoder = Encoder.kept(path)
        for batch in batches:
            texts = encoder.decode([np.array(x or [], np.uint32) for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*columns, "text"])

    schema = rows.select(*columns, F.lit(None).cast("string").alias("text")).schema
    return rows.mapInArrow(work, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32 (ids as little-endian 32-bit words), decoded_sha256, same (the text came back)."""

    def work(batches):
        encoder = Encoder.kept(path)
        for batch, texts in by_bytes(batches):
            ids = encoder.encode(texts)
            back = encoder.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), pa.array([x == y for x, y in zip(texts, back, strict=True)], pa.bool_())],
                names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "same"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, same boolean")
