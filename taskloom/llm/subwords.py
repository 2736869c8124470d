"""Subword ids of texts by public tokenizers, with work done once per distinct chunk.

A byte-level BPE of this family cuts a text by a pattern whose pieces never run on from a non-space character into white space. A
text without two adjacent white-space characters one of which is a space can therefore be cut before every space, and the ids of
the chunks, encoded on their own, are the ids of the text. Other texts are encoded whole. Chunks of well-known characters are cut
further, into the pieces of the pattern: runs of letters, of digits or of punctuation, each with the space before it, and line feeds. A
worker remembers the ids of pieces it has met, up to a bounded number.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a worker remembers (some 150 bytes each); beyond that the memory starts anew. It changes nothing but time.
REMEMBERED = 600_000
#: Chunks, and pieces, in one string of the tokenizers library.
JOINED = 64
JOINED_PIECES = 256
#: A chunk that is not cut off from its neighbours.
RUNS_ON = r"^[^ ]|^ ?$|.[\s\p{Z}\x{85}\x1c-\x1f]"
#: A space beside other white space, in any order.
UNEVEN = r"[\s\p{Z}\x{85}\x1c-\x1f] | [\s\p{Z}\x{85}\x1c-\x1f]"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


LETTER, DIGIT, MARK, LINE, SPACE = 1, 2, 3, 4, 5


def _kinds() -> np.ndarray:
    """The kinds of code points whose class no version of Unicode disputes; 0 for all others, and for the apostrophe, which may begin a
    piece that goes on with letters."""
    kinds = np.zeros(1 << 16, np.uint8)
    letters = "AZ az \u00c0\u00d6 \u00d8\u00f6 \u00f8\u017f \u0391\u03a1 \u03a3\u03a9 \u03b1\u03c9 \u0410\u044f \u05d0\u05ea \u0621\u063a \u0641\u064a \u3041\u3096 \u30a1\u30fa \u4e00\u9fa5 \uac00\ud7a3"
    for low, high in letters.split():
        kinds[ord(low) : ord(high) + 1] = LETTER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\u00a1\u00bf\u2013\u2014\u201c\u201d\u2026\u3001\u3002\uff01\uff0c\uff1f":
        kinds[ord(c)] = MARK
    kinds[ord("\n")], kinds[ord(" ")] = LINE, SPACE
    return kinds


_KINDS = _kinds()


def pieces_of(chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pieces of all chunks one after the other, how many each chunk has, which pieces are whole chunks that could not be cut)."""
    offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1] if len(chunks) else np.zeros(1, np.int32)
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    letters = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each code point starts
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    ends = np.searchsorted(letters, offsets[1:] - offsets[0])
    sizes = np.diff(ends, prepend=0)
    kinds = _KINDS[np.minimum(points, 0xFFFF)]
    first, before, after = np.zeros(len(points), bool), np.roll(kinds, 1), np.roll(kinds, -1)
    first[(ends - sizes)[sizes > 0]] = True
    before[first], after[ends[sizes > 0] - 1] = 0, 0
    # White space is one space at the beginning, before a run, or one line feed beside no other.
    strange = (kinds == 0) | (kinds == SPACE) & (~first | (after == 0) | (after == LINE)) | (kinds == LINE) & (before == LINE)
    so_far = np.concatenate(([0], np.cumsum(strange)))
    odd = so_far[ends] > so_far[ends - sizes]
    cut = first | (kinds != before) & (before != SPACE) & ~np.repeat(odd, sizes)
    so_far = np.concatenate(([0], np.cumsum(cut)))
    counts = so_far[ends] - so_far[ends - sizes]
    cuts = letters[np.append(np.flatnonzero(cut), len(points))].astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
    return pieces, counts, np.repeat(odd, counts)


def gathered(pool: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretches of the pool by their numbers, one after the other; where each starts and the last ends)."""
    begins = np.cumsum(sizes) - sizes
    lengths = sizes[codes]
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return pool[np.arange(ends[-1]) + np.repeat(begins[codes] - ends[:-1], lengths)], ends


class ChunkEncoder:
    """Ids of whole texts; `encode` gives the ids of a list of short strings, `encode_pieces` those of pieces of the pattern."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], encode_pieces: Callable[[list[str]], Sequence[Sequence[int]]] | None = None):
        self.encode = encode
        self.encode_pieces = encode_pieces or encode
        self.known: dict[str, bytes] = {}

    def pooled(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after the other as uint16, how many each has)."""
        pieces, counts, odd = pieces_of(chunks)
        distinct = pieces.dictionary_encode()
        codes = distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        whole = np.zeros(len(distinct.dictionary), bool)
        whole[codes] = odd
        names = distinct.dictionary.to_pylist()
        encoded = list(map(self.known.get, names))
        fresh = [i for i, e in enumerate(encoded) if e is None]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, range(len(names))
        fresh = np.array(fresh, np.int64)
        for encode, some in ((self.encode, fresh[whole[fresh]]), (self.encode_pieces, fresh[~whole[fresh]])):
            lot = [names[i] for i in some.tolist()]
            for i, ids in zip(some.tolist(), encode(lot) if lot else ()):
                self.known[names[i]] = encoded[i] = ids if isinstance(ids, bytes) else np.asarray(ids, "<u2").tobytes()
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 2
        ids, ends = gathered(np.frombuffer(b"".join(encoded), "<u2"), sizes, codes)
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        ids, sizes = self.pooled(pa.array(chunks, pa.string()))
        ends, data = np.cumsum(sizes * 2), ids.tobytes()
        return [data[a:b] for a, b in zip((ends - sizes * 2).tolist(), ends.tolist())]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other as uint16, where each text starts and the last ends)."""
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        if pc.any(uneven).as_py():
            return self._mixed(texts, np.asarray(uneven.to_numpy(zero_copy_only=False)))
        lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.concatenate(([0], np.cumsum(counts)))
        flat = pc.dictionary_encode(lists.flatten())
        # Every chunk but the first of a text begins with the space it was cut at.
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        spaced = np.ones(len(codes), bool)
        spaced[firsts[:-1][counts > 0]] = False
        met = np.zeros(2 * len(flat.dictionary), bool)
        codes = codes * 2 + spaced
        met[codes] = True
        used = np.flatnonzero(met)
        spaces = pa.array(["", " "]).take(pa.array(used & 1))
        pool, sizes = self.pooled(pc.binary_join_element_wise(spaces, flat.dictionary.take(pa.array(used >> 1)), ""))
        codes = (np.cumsum(met) - 1)[codes]
        ids, ends = gathered(pool, sizes, codes)
        return ids, ends[firsts]

    def _mixed(self, texts: pa.Array, uneven: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = np.flatnonzero(~uneven)
        whole = np.flatnonzero(uneven)
        ids, starts = self.ids(texts.take(pa.array(plain)))
        parts: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        for i, n in zip(plain.tolist(), range(len(plain))):
            parts[i] = ids[starts[n] : starts[n + 1]]
        for i, own in zip(whole.tolist(), self.encode(texts.take(pa.array(whole)).to_pylist())):
            parts[i] = np.array(own, np.uint16)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def json_encoder(path: str) -> ChunkEncoder:
    """By the tokenizers library; strings of special tokens count as ordinary text.

    Pieces need none of the library's cutting: many, in the letters that stand for bytes, are one string with a blank between them,
    and the lengths of the tokens tell where each ends.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    own = tokenizer.get_vocab(with_added_tokens=False)
    lengths = np.zeros(max(own.values()) + 1, np.int64)
    for token, i in own.items():
        lengths[i] = len(token)  # one character a byte in a byte-level vocabulary
    whole = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    table = byte_letters() | {0: " "}  # no piece holds a byte of zero

    def pieces(lot: list[str]) -> list[bytes]:
        strings = ["\0".join(lot[low : low + JOINED_PIECES]).encode().decode("latin-1").translate(table) for low in range(0, len(lot), JOINED_PIECES)]
        ids = np.concatenate([np.array(e.ids, "<u2") for e in plain.encode_batch_fast(strings, add_special_tokens=False)])
        sizes = pc.binary_length(pa.array(lot, pa.string())).to_numpy(zero_copy_only=False)
        ends = 2 * (np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes, dtype=np.int64)) + 1)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    return ChunkEncoder(lambda chunks: joined_ids(chunks, whole, lengths, JOINED), pieces)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(own)))}


def joined_ids(chunks: list[str], whole: Callable[[list[str]], Sequence[Sequence[int]]], lengths: np.ndarray, lot: int) -> list:
    """Ids of every chunk, `lot` chunks to a string of `whole`, which costs less than a string each: a chunk that begins with a space and
    holds no other white space is cut off from its neighbours by the vocabulary's pattern, and the lengths of the tokens tell where it
    ends. Other chunks are strings of their own."""
    out: list = [None] * len(chunks)
    odd = pc.match_substring_regex(pa.array(chunks, pa.string()), RUNS_ON)
    odd = odd.to_numpy(zero_copy_only=False)
    alone = np.flatnonzero(odd).tolist()
    for i, ids in zip(alone, whole([chunks[i] for i in alone])):
        out[i] = ids
    even = np.flatnonzero(~odd)
    if len(even):
        kept = [chunks[i] for i in even.tolist()]
        found = whole(["".join(kept[low : low + lot]) for low in range(0, len(kept), lot)])
        ids = np.concatenate([np.array(i, np.uint16) for i in found])
        sizes = pc.binary_length(pa.array(kept, pa.string())).to_numpy(zero_copy_only=False)
        ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes, dtype=np.int64)) + 1
        for i, low, high in zip(even.tolist(), [0, *ends.tolist()], ends.tolist()):
            out[i] = ids[low:high]
    return out


def rank_table(path: str, size: int | None = None) -> dict[bytes, int]:
    """Byte strings of a vocabulary with their ranks; the first `size` ranks are a smaller vocabulary of the same kind."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return {k: v for k, v in ranks.items() if size is None or v < size}


def rank_encoding(path: str, size: int | None = None):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_table(path, size), special_tokens={})


class JoinedEncoder(ChunkEncoder):
    """All chunks in one string of the library, the lengths of whose tokens tell where each ends; nothing is remembered: with distinct
    chunks, encoding them again costs less than an object for every piece."""

    def __init__(self, whole: Callable[[list[str]], Sequence[Sequence[int]]], lengths: np.ndarray):
        super().__init__(lambda chunks: joined_ids(chunks, whole, lengths, max(1, len(chunks))))
        self.whole, self.lengths = whole, lengths

    def pooled(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(chunks, RUNS_ON).to_numpy(zero_copy_only=False).astype(bool)
        if odd.any():
            even, alone = np.flatnonzero(~odd), np.flatnonzero(odd)
            ids, sizes = self.pooled(chunks.take(pa.array(even)))
            own = [np.array(i, "<u2") for i in self.whole(chunks.take(pa.array(alone)).to_pylist())]
            codes = np.empty(len(chunks), np.int64)
            codes[np.concatenate([even, alone])] = np.arange(len(chunks))
            sizes = np.concatenate([sizes, np.array([len(i) for i in own], np.int64)])
            return gathered(np.concatenate([ids, *own]), sizes, codes)[0], sizes[codes]
        if not len(chunks):
            return np.zeros(0, "<u2"), np.zeros(0, np.int64)
        offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
        text = chunks.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes().decode()
        ids = np.array(self.whole([text])[0], "<u2")
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), offsets[1:] - offsets[0]) + 1
        return ids, np.diff(ends, prepend=0)


def rank_encoder(path: str, size: int | None = None) -> ChunkEncoder:
    """By the tiktoken library, many chunks in one call."""
    encoding = rank_encoding(path, size)
    lengths = np.zeros(encoding.max_token_value + 1, np.int64)
    for token in encoding.token_byte_values():
        lengths[encoding.encode_single_token(token)] = len(token)
    whole = lambda texts: [encoding.encode_ordinary(t) for t in texts]
    return JoinedEncoder(whole, lengths)
