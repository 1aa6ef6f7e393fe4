"""Encoding and decoding with a SentencePiece BPE model, by vectorised merge rounds.

A text is cut wherever no piece of the vocabulary holds the two characters next to each other: no merge can cross such
a place, so each cut-out word is encoded on its own and each different word once. All new words of a batch are merged
together: their symbols lie in one flat array, a round finds the best rank of each word's pairs, merges that
pair's places from the left in all words at once, and closes the gaps; words without a pair left drop out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import Words, hashes, pieces

SPACE = 0x2581
_NEVER = np.iinfo(np.int64).max
#: Different words that a process keeps; beyond it, it starts anew.
KEPT_WORDS = 1 << 17


class Codec:
    """The vocabulary of a model file (BPE, byte fallback, identity normalisation, a space put before the text)."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as format

        model = format.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trained = model.normalizer_spec, model.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (
            spec.add_dummy_prefix and spec.escape_whitespaces and trained.byte_fallback and trained.model_type == 2
        ):
            raise ValueError(f"{path}: not a byte-fallback BPE model with identity normalisation")
        kinds = format.ModelProto.SentencePiece
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        score = {p.piece: p.score for p in model.pieces}
        self.eos = next(i for i, p in enumerate(model.pieces) if p.piece == (trained.eos_piece or "</s>"))
        self.byte_ids = np.zeros(256, np.int32)
        texts: list[bytes] = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                texts.append(bytes([value]))
            elif p.type == kinds.UNKNOWN:
                texts.append(" ⁇ ".encode())
            else:
                texts.append(b"" if p.type == kinds.CONTROL else p.piece.replace("▁", " ").encode())
        self.piece_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

        chars = sorted({c for p in normal for c in p})
        symbols = chars + [p for p in normal if len(p) > 1]
        number = {s: i for i, s in enumerate(symbols)}
        self.n_symbols = len(symbols)
        self.n_chars = len(chars)
        #: The id of a symbol, or -1 for a character that is only part of pieces.
        self.symbol_id = np.array([normal.get(s, -1) for s in symbols], np.int64)
        self.class_of = np.full(0x110000, self.n_chars, np.int32)
        for c in chars:
            self.class_of[ord(c)] = number[c]
        self.joined = np.zeros((self.n_chars + 1, self.n_chars + 1), bool)
        ranks = {s: r for r, s in enumerate(sorted({score[p] for p in normal}, reverse=True))}
        keys, rank, merged = [], [], []
        for p in normal:
            for x, y in zip(p, p[1:], strict=False):
                self.joined[number[x], number[y]] = True
            for cut in range(1, len(p)):
                x, y = number.get(p[:cut]), number.get(p[cut:])
                if x is not None and y is not None:
                    keys.append(x * self.n_symbols + y)
                    rank.append(ranks[score[p]])
                    merged.append(number[p])
        order = np.argsort(keys)
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_rank = np.array(rank, np.int64)[order]
        self.pair_symbol = np.array(merged, np.int64)[order]
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_at = np.zeros(1, np.int64)
        self.known_ids = np.zeros(0, np.int32)
        self.known_row = np.zeros(0, np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``_NEVER`` if they make no piece) and the symbol they make."""
        known = (left < self.n_symbols) & (right < self.n_symbols) & (left >= 0) & (right >= 0)
        key = np.where(known, left * self.n_symbols + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = known & (self.pair_keys[at] == key)
        return np.where(hit, self.pair_rank[at], _NEVER), self.pair_symbol[at]

    def merge(self, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of words whose symbols lie one after another in sym; word i from at[i] to at[i + 1]."""
        word = np.repeat(np.arange(len(at) - 1), np.diff(at))
        done_sym, done_word = [], []
        while len(sym):
            inner = np.zeros(len(sym), bool)
            inner[:-1] = word[1:] == word[:-1]
            rank, made = self._look(sym, np.concatenate([sym[1:], [-1]]))
            rank[~inner] = _NEVER
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.concatenate([first, [len(sym)]])))
            live = best != _NEVER
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, made, best = sym[live], word[live], rank[live], made[live], best[live]
                if not len(sym):
                    break
            place = np.flatnonzero(rank == best)
            # of places that overlap, the first, third and so on
            run = np.flatnonzero(np.concatenate([[True], np.diff(place) != 1]))
            step = np.arange(len(place)) - np.repeat(run, np.diff(np.concatenate([run, [len(place)]])))
            place = place[step % 2 == 0]
            new, own = made[place], word[place]
            # a merge after which a pair as good or better begins or ends here is the word's last of this round
            right = np.where(
                (place + 2 < len(sym)) & (word[np.minimum(place + 2, len(sym) - 1)] == own),
                sym[np.minimum(place + 2, len(sym) - 1)],
                -1,
            )
            left = np.where((place > 0) & (word[place - 1] == own), sym[place - 1], -1)
            follows = np.concatenate([[False], (np.diff(place) == 2) & (own[1:] == own[:-1])])
            left = np.where(follows, np.concatenate([[-1], new[:-1]]), left)
            stop = (self._look(new, right)[0] <= best[place]) | (self._look(left, new)[0] <= best[place])
            before = np.cumsum(stop) - stop
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            before -= np.repeat(before[head], np.diff(np.concatenate([head, [len(own)]])))
            place, new = place[before == 0], new[before == 0]
            sym[place] = new
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            sym, word = sym[keep], word[keep]
        sym = np.concatenate([*done_sym, np.zeros(0, np.int64)])
        word = np.concatenate([*done_word, np.zeros(0, np.int64)])
        order = np.argsort(word, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(at) - 1))])

    def _ids(self, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols; characters without a piece become the ids of their UTF-8 bytes."""
        ids = np.where(sym < self.n_symbols, self.symbol_id[np.minimum(sym, self.n_symbols - 1)], -1)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype(np.int32), at
        char_of = {int(c): i for i, c in enumerate(self.class_of) if c < self.n_chars} if (sym[odd] < self.n_symbols).any() else {}
        raw = [chr(char_of[s] if s < self.n_symbols else s - self.n_symbols).encode("utf-8", "replace") for s in sym[odd].tolist()]
        width = np.ones(len(sym), np.int64)
        width[odd] = [len(r) for r in raw]
        place = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(ids, width)
        spread = np.repeat(np.isin(np.arange(len(sym)), odd), width)
        out[spread] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out.astype(np.int32), place[at]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with an end id, and where each text's ids begin."""
        codes = [np.frombuffer(f"▁{t}".encode("utf-32-le", "replace") if t else b"", np.uint32) for t in texts]
        lengths = np.array([len(c) for c in codes], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        code = np.concatenate([*codes, np.zeros(0, np.uint32)])
        code = np.where(code == 0x20, np.uint32(SPACE), code)
        n = len(code)
        kind = self.class_of[code]
        cut = np.ones(n + 1, bool)
        if n:
            cut[1:-1] = ~self.joined[kind[:-1], kind[1:]]
        cut[begin] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        word_first = np.searchsorted(start, begin)
        if not n:
            return np.full(len(texts), self.eos, np.int32), np.arange(len(texts) + 1)
        unique, sample, inverse = np.unique(hashes(Words(code, start, end, word_first)), return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > KEPT_WORDS:
            self._forget()
        at = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != unique[inside]
        if new.any():
            s, e = start[sample[new]], end[sample[new]]
            size = e - s
            word_at = np.concatenate([[0], np.cumsum(size)])
            flat = np.repeat(s - word_at[:-1], size) + np.arange(word_at[-1])
            sym = kind[flat].astype(np.int64)
            sym = np.where(sym == self.n_chars, self.n_symbols + code[flat].astype(np.int64), sym)
            ids, ids_at = self._ids(*self.merge(sym, word_at))
            row = len(self.known_at) - 1 + np.arange(new.sum())
            self.known_at = np.concatenate([self.known_at, self.known_at[-1] + ids_at[1:]])
            self.known_ids = np.concatenate([self.known_ids, ids])
            keys, rows = np.concatenate([self.known, unique[new]]), np.concatenate([self.known_row, row])
            order = np.argsort(keys, kind="stable")
            self.known, self.known_row = keys[order], rows[order]
            at = np.searchsorted(self.known, unique)
        row = self.known_row[at][inverse]
        size = self.known_at[row + 1] - self.known_at[row]
        text_at = np.concatenate([[0], np.cumsum(size)])[word_first] + np.arange(len(texts) + 1)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.known_ids[np.repeat(self.known_at[row] - total[:-1], size) + np.arange(total[-1])]
        out = np.full(text_at[-1], self.eos, np.int32)
        body = np.ones(len(out), bool)
        body[text_at[1:] - 1] = False
        out[body] = ids
        return out, text_at

    def decode_batch(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """Texts of ids: pieces side by side, bytes of byte pieces joined, the space put before the text taken off."""
        size = self.piece_at[ids + 1] - self.piece_at[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.piece_bytes[np.repeat(self.piece_at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        place = total[at].tolist()
        return [
            raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace")
            for a, b in zip(place[:-1], place[1:], strict=True)
        ]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: id, ids (array<int>, as the library's encode with an end id), decoded (its decode of them).

    ``model`` is the path of the model file on every executor. A null or empty text has the end id alone and decodes to an
    empty text. Rows are encoded one by one: ties, repeats, null ids and other columns don't matter. Memory follows the
    longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model or default_model())
        for batch in pieces(batches, text):
            ids, at = own.encode_batch(batch.column(text).fill_null("").to_pylist())
            decoded = own.decode_batch(ids, at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id).cast(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)),
                    pa.array(decoded, pa.string()),
                ],
                ["id", "ids", "decoded"],
            )

    return docs.select(id, text).mapInArrow(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id)
