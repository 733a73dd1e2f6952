"""Token ids of whole texts, with a bounded per-worker cache of pieces.

The tokenizer used here starts a new piece wherever letters end and wherever
white space begins, so the ids of a text are the ids of its pieces, one after
the other.  ``PieceEncoder`` cuts texts there, has the tokenizers library encode
each distinct piece once, and gathers the rest with numpy.  That is certain only
where every character is ASCII or a Latin letter and no added token can occur;
any other text goes to the library whole.  ``tests/llm/test_tokens.py`` holds
both ways against whole-text encoding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are gathered at once, and pieces that the cache holds at most.
SLICE_BYTES, CACHE_PIECES = 12 << 20, 1_000_000
#: Of a byte: 0 white space, 1 part of a letter (U+00C0 to U+017F are two bytes), 2 other ASCII.
KIND = np.full(256, 2, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Texts with other than ASCII and Latin letters, or with what may be an added token.
ODD = r"[^\x00-\x7F\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]|<\||[\x1c-\x1f]"
#: How a byte-level vocabulary writes each byte: printable ones as they are, the others from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LEVEL = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """encode(texts) gives the flat ids (uint16 or uint32) and where each text's ids begin.

    Null and empty texts have no ids.  The cache starts anew when it is full, so
    memory is bounded whatever the number of distinct pieces.
    """

    def __init__(self, path: str | None = None, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.model = self.tokenizer.model  # for pieces of letters only, which need neither normalizer nor pre-tokenizer
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cap = cache_pieces
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ends = np.zeros(1, np.int64)
        self.store = np.zeros(0, self.dtype)

    def _fill(self, fresh: list[str]) -> None:
        """Adds distinct pieces, lower-cased already."""
        ids: list[int] = []
        ends, start = [], int(self.ends[-1])
        tokenize = self.model.tokenize
        for w in fresh:
            w = w.strip()
            if w.isalpha():
                ids += [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LEVEL))]
            else:
                ids += self.tokenizer.encode(w, add_special_tokens=False).ids
            ends.append(start + len(ids))
        n = len(self.place)
        self.place.update(zip(fresh, range(n, n + len(fresh))))
        self.store = np.concatenate([self.store, np.array(ids, self.dtype)])
        self.ends = np.concatenate([self.ends, np.array(ends, np.int64)])

    def _places(self, pieces: list[str]) -> np.ndarray:
        if len(self.place) > self.cap:
            self.clear()
        get = self.place.get
        at = np.fromiter(map(get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = [pieces[i] for i in missing]
            self._fill(list(dict.fromkeys(fresh)))
            get = self.place.get
            at[missing] = np.fromiter(map(get, fresh), np.int64, len(fresh))
        return at

    def _cut(self, texts: pa.Array):
        """Null-free texts, nowhere odd: where pieces are cut, offsets of texts (both from the first byte on), each piece's place in the store and its ids."""
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        kind = KIND[np.frombuffer(data, np.uint8)[first:last]] if last > first else np.zeros(0, np.uint8)
        cut = np.zeros(last - first + 1, bool)
        cut[1:-1] = ((kind[1:] == 0) & (kind[:-1] != 0)) | ((kind[:-1] == 1) & (kind[1:] != 1))
        cut[offsets - first] = True
        cuts = np.flatnonzero(cut)
        if len(cuts) < 2:
            return cuts, offsets - first, np.zeros(0, np.int64), np.zeros(0, np.int32), kind
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64) + first), data)
        coded = pieces.dictionary_encode()
        at = self._places(pc.utf8_lower(coded.dictionary).to_pylist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        return cuts, offsets - first, self.ends[at][which], (self.ends[at + 1] - self.ends[at]).astype(np.int32)[which], kind

    def _take(self, begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the store of all ids, and how many there are up to each piece."""
        ends = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
        take = np.repeat(begin - ends[:-1], many)
        take += np.arange(len(take))
        return take, ends

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cuts, offsets, begin, many, _ = self._cut(texts)
        take, ends = self._take(begin, many)
        return self.store[take], ends[np.searchsorted(cuts, offsets)]

    def _plain_spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not hasattr(self, "widths"):
            of = self.tokenizer.get_vocab()
            self.widths = np.zeros(max(of.values()) + 1, np.int32)
            for token, i in of.items():
                self.widths[i] = len(token.removesuffix("</w>"))
        cuts, offsets, begin, many, kind = self._cut(texts)
        take, ends = self._take(begin, many)
        width = self.widths[self.store[take]]
        # A piece is white space, then its tokens without a gap (inside a piece white space only leads).
        blank = np.concatenate([[0], np.cumsum(kind == 0)])
        lead = cuts[:-1] + blank[cuts[1:]] - blank[cuts[:-1]] if len(cuts) > 1 else cuts[:0]
        stop = np.cumsum(width, dtype=np.int64)
        filled = np.concatenate([[0], stop])[ends[:-1]]
        start = np.repeat(lead - filled, many) + stop - width
        return start, start + width, ends[np.searchsorted(cuts, offsets)]

    def spans(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte spans [begin, end) of all tokens, counted from the first text's first byte, and where each text's tokens begin."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain_spans(texts)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        base = np.cumsum(sizes) - sizes
        begins, ends, many = [], [], []
        for i in range(len(texts)):
            if odd[i]:
                text = texts[i].as_py()
                at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
                got = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
                a, b = at[got[:, 0]], at[got[:, 1]]
            else:
                a, b, _ = self._plain_spans(texts.slice(i, 1))
            begins.append(a + base[i])
            ends.append(b + base[i])
            many.append(len(a))
        return np.concatenate(begins), np.concatenate(ends), np.concatenate([[0], np.cumsum(many)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._plain(texts)
        odd_at, plain_at = np.flatnonzero(odd), np.flatnonzero(~odd)
        whole = [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts.take(pa.array(odd_at)).to_pylist(), add_special_tokens=False)]
        ids, bounds = self._plain(texts.take(pa.array(plain_at)))
        parts: list = [None] * len(texts)
        for i, x in zip(odd_at, whole):
            parts[i] = x
        for k, i in enumerate(plain_at):
            parts[i] = ids[bounds[k] : bounds[k + 1]]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``most`` bytes each (a longer text is a run of its own), with the place of the first."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, texts.slice(a, b - a)


def as_strings(column: pa.Array) -> pa.Array:
    """A text column as one large_string array: no 2 GB limit on a batch."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string())
