"""Token ids of many texts: texts share their chunks.

A text falls apart before every space that a plain character follows, and no pattern that the tokenizers of this package split
by joins what stands on both sides of such a place; so the ids of a text are those of its chunks in order. The chunks of a slice
of texts are an Arrow array over the texts' own bytes. It is dictionary-encoded, each distinct chunk is encoded once, and the
ids of all texts are gathered by number. Texts that hold a special token's string, which the library looks for first, are one
chunk each. Chunks are remembered from slice to slice up to a number of bytes; the ids don't depend on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of the texts that are encoded at once, of the chunks that are handed to a tokenizer as one text, of remembered chunks.
SLICE, JOINED, KNOWN = 4 << 20, 1 << 18, 32 << 20
#: Bytes that may begin a character after the space before which a text is cut: neither white space nor a lead byte of any.
PLAIN = ~np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3])


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer by its file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts (or other things) of about so many bytes; one of the texts at least."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most)))
        yield lo, hi
        lo = hi


def byte_view(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary array without nulls, and where each value begins (and the last one ends)."""
    values = values.cast(pa.binary())
    _, offsets, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at starts, one after the other."""
    places = np.repeat((starts - np.cumsum(lengths) + lengths).astype(np.int32), lengths)
    places += np.arange(len(places), dtype=np.int32)
    return flat[places]


class ChunkEncoder:
    """Ids of texts, given encode(texts) of a tokenizer, the bytes of each of its tokens and its special tokens' strings."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], sizes: np.ndarray, special: Sequence[str] = ()) -> None:
        self.encode, self.sizes, self.special = encode, sizes, special
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat = pa.array([], pa.binary()), np.zeros(0, np.uint32)
        self.starts, self.counts = np.zeros((2, 0), np.int64)

    def _learn(self, chunks: pa.Array, cut: np.ndarray) -> None:
        """Remembers the ids of chunks."""
        flat, starts, counts = self._encoded(chunks, cut)
        self.known = pa.concat_arrays([self.known, chunks])
        self.starts, self.counts = np.concatenate((self.starts, starts + len(self.flat))), np.concatenate((self.counts, counts))
        self.flat = np.concatenate((self.flat, flat))

    def _encoded(self, chunks: pa.Array, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and start and number of those of each chunk; cut chunks begin with a space and a plain character.

        Cut chunks are encoded as one text, which is cut where the chunks end; where the tokens' bytes don't end with the
        chunks, the chunks are encoded one by one.
        """
        starts, counts = np.zeros((2, len(chunks)), np.int64)
        flat, at = [np.zeros(0, np.uint32)], 0

        def put(places: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
            nonlocal at
            counts[places], starts[places] = lengths, at + np.cumsum(lengths) - lengths
            flat.append(ids)
            at += len(ids)

        def put_each(places: np.ndarray) -> None:
            found = self.encode([x.decode("utf-8", "surrogatepass") for x in chunks.take(pa.array(places)).to_pylist()])
            put(places, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))

        if not cut.all():
            put_each(np.flatnonzero(~cut))
        places = np.flatnonzero(cut)
        data, offsets = byte_view(chunks.filter(pa.array(cut)))
        for lo, hi in slices(np.diff(offsets), JOINED):
            text = data[offsets[lo] : offsets[hi]].tobytes().decode("utf-8", "surrogatepass")
            ids = self.encode([text])[0]
            ends, stops = np.cumsum(self.sizes[ids]), offsets[lo + 1 : hi + 1] - offsets[lo]
            found = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
            if np.array_equal(ends[found], stops):
                put(places[lo:hi], ids, np.diff(found + 1, prepend=0))
            else:
                put_each(places[lo:hi])
        return np.concatenate(flat), starts, counts

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of the texts (strings or bytes, null for empty), and where those of each text begin (and the last one's end)."""
        texts = pc.fill_null(texts.cast(pa.binary()), b"")
        data, offsets = byte_view(texts)
        inner = np.zeros(len(data), bool)
        inner[:-1] = (data[:-1] == 0x20) & PLAIN[data[1:]]
        inner[offsets[1:][np.diff(offsets) > 0] - 1] = False  # what follows a text's last character is another text's
        for word in self.special:
            for k in pc.indices_nonzero(pc.match_substring(texts, word)).to_pylist():
                inner[offsets[k] : offsets[k + 1]] = False
        begins = np.append(inner, False)
        begins[offsets] = True
        bounds = np.flatnonzero(begins)
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        chunks = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        number = chunks.indices.to_numpy()
        cut = np.zeros(len(chunks.dictionary), bool)
        cut[number[inner[bounds[:-1]]]] = True
        if self.known.nbytes > KNOWN:
            self._forget()
        new = pc.is_null(pc.index_in(chunks.dictionary, self.known))
        self._learn(chunks.dictionary.filter(new), cut[new.to_numpy(zero_copy_only=False)])
        number = pc.index_in(chunks.dictionary, self.known).to_numpy()[number]
        lengths = self.counts[number]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return gathered(self.flat, self.starts[number], lengths), ends[np.searchsorted(bounds, offsets)]

    def each_slice(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The range of texts, the ids and their bounds for slices of SLICE bytes."""
        for lo, hi in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy()):
            yield lo, hi, *self(texts[lo:hi])


def library_encoder(path: str) -> ChunkEncoder:
    """Encoder of a byte-level file of the tokenizers library, without special tokens of its own."""
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    # bytes of each token: in a byte-level vocabulary every character of a token's name is one
    vocabulary = tokenizer.get_vocab()
    sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        sizes[i] = len(token)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return ChunkEncoder(encode, sizes, [t.content for t in tokenizer.get_added_tokens_decoder().values()])
