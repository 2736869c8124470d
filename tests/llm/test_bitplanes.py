import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import ODD, make_docs  # noqa: F401
from tokenizers import Tokenizer

from taskloom.llm import bitplanes, subwords
from taskloom.session import scratch_path

PATH = subwords.vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


SPACED = ["", " ", "  ", "a  b", "a \n b", "x  y", "tab\t here", " lead", "trail ", "a   ", "it's we're I'll", "\n\nmore\n \n", "<|endoftext|> as text", "1 234 5,678!"]


def test_chunked_ids_are_those_of_whole_texts(tokenizer):
    rng = random.Random(1)
    texts = SPACED + [t or "" for _, t in ODD if t is None or len(t) < 5000]
    texts += ["".join(rng.choice(["ab", "c", "é", "東", " ", " ", "\n", "'s", "12", ".", " ", "\x1f"]) for _ in range(60)) for _ in range(200)]
    for lot in (texts, [t for t in texts if t.strip()], texts[:1], []):
        ids, starts = subwords.json_encoder(PATH).ids(pa.array(lot, pa.string()))
        found = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
        assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in lot]


def test_memory_of_chunks_changes_nothing(monkeypatch):
    monkeypatch.setattr(subwords, "REMEMBERED", 5)
    encoder = subwords.ChunkEncoder(lambda texts: [[len(t)] for t in texts])
    for words in (["a", "bb"], ["ccc", "a", "dddd", "eeeee"], ["bb", "a"], [str(i) for i in range(9)]):
        assert [np.frombuffer(b, "<u2").tolist() for b in encoder.chunk_ids(words)] == [[len(w)] for w in words]


def test_rank_encoder_cuts_where_single_calls_do():
    path = subwords.vocabulary_path("byte_bpe_50k.tiktoken")
    words = [" word", " é", "", " a b", "nospace", " x ", " 東京", " it's", " \x1f", " 12,5"]
    for size in (511, None):
        encoding = subwords.rank_encoding(path, size)
        assert [list(i) for i in subwords.rank_encoder(path, size).encode(words)] == [encoding.encode_ordinary(w) for w in words]


def test_joined_chunks_have_their_own_ids(tokenizer):
    rng = random.Random(2)
    words = SPACED + [" word", " é", " a b", "nospace", " x ", " 東京", " it's", " \x1f", " 12,5", " \u2003x", " <|endoftext|>", " a\nb", " '", " s"]
    words += [" " + "".join(rng.choice("abé東's1.,😀") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    calls = []

    def whole(texts):
        calls.extend(texts)
        return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    lengths = np.zeros(1 << 16, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        lengths[i] = len(token)
    alone = [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert [list(i) for i in subwords.joined_ids(words, whole, lengths, 64)] == alone and len(calls) < 50
    assert [list(i) for i in subwords.json_encoder(PATH).encode(words)] == alone and subwords.json_encoder(PATH).encode([]) == []


def test_a_word_is_encoded_once_whatever_mark_follows():
    met = []
    encoder = subwords.ChunkEncoder(lambda texts: met.extend(texts) or [[len(t)] for t in texts])
    ids, starts = encoder.ids(pa.array(["word word, word.\nword \"word\" word%%% a1b", "no word!", None]))
    assert sorted(met) == sorted(set(met)) and {" word", "word", ",", ".", "\n", ' "', '"', "%%%", " a", "1", "b", "!"} <= set(met)
    assert ids.tolist() == [4, 5, 1, 5, 1, 1, 4, 2, 4, 1, 5, 3, 2, 1, 1, 2, 5, 1] and starts.tolist() == [0, 15, 18, 18]


def test_pieces_have_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(3)
    marks = ["a", "Zé", "ß", "я", "東", "ガ", "한", "א", "1", "23", ".", ",%", "'", "'s", "’", "。", "…", "\n", "\n", "\r", "\t", "\0", "\u00a0", "ª", "²", "😀", "ı̇", "ǆ", "<|endoftext|>", " ", " ", " "]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000) for low in range(0, 1 << 16, 64)]
    ids, starts = subwords.json_encoder(PATH).ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    # Every undisputed character beside others of its kind, of other kinds and behind a space.
    known = [chr(c) for c in np.flatnonzero(subwords._KINDS).tolist() if chr(c) not in " \n"]
    chunks = [f"{a}{b}" for c in known for a, b in ((" ", c), (" a", c), ("1", c), (".", c), (c, "a1"), (c, ".\n"))]
    found = [np.frombuffer(b, "<u2").tolist() for b in subwords.json_encoder(PATH).chunk_ids(chunks)]
    assert found == [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("count", [0, 1, 7, 64, 65, 1000])
def test_planes_there_and_back(planes, count):
    rng = np.random.default_rng(count)
    ids = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype("<u4")
    sizes, payload = bitplanes.shuffled(ids, planes, 64)
    assert sum(sizes) == len(payload) and len(sizes) == -(-count // 64) * (4 if planes == "byte" else 32)
    assert bitplanes.restored(sizes, payload, count, planes, 64).tolist() == ids.tolist()


def test_planes_of_zeros_take_little():
    ids = np.random.default_rng(1).integers(0, 50_000, 1 << 14).astype("<u4")
    sizes, _ = bitplanes.shuffled(ids)
    assert sizes[2] < 40 and sizes[3] < 40 and sum(sizes) < 2.1 * len(ids)
    with pytest.raises(ValueError):
        bitplanes.shuffled(ids, "nibble")


def expected(docs, tokenizer):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    out, start = [], 0
    for doc_id, text in order:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_there_and_back(spark, make_docs, tokenizer, planes):  # noqa: F811
    docs = [(d, t if t is None or len(t) < 10_000 else t[:9000]) for d, t in ODD]
    docs += [(100 + i, " ".join(f"w{j * i}" for j in range(i))) for i in range(60)] + [(300 + i, s) for i, s in enumerate(SPACED)]
    path = scratch_path(spark, "ids")
    bitplanes.write_ids(make_docs(docs).repartition(5), path, planes=planes, block=64, segment=500)
    found = sorted((tuple(r) for r in bitplanes.document_digests(spark, path).collect()), key=lambda r: r[1])
    assert found == expected(docs, tokenizer)
    ids = {(r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in bitplanes.read_ids(spark, path).collect()}
    assert ids == {(r[0], r[3]) for r in found}
    rows = spark.read.parquet(path)
    assert rows.where("n_ids > 500 + 9000").count() == 0 and rows.count() > 10


def test_empty_table(spark, make_docs):  # noqa: F811
    path = scratch_path(spark, "ids")
    bitplanes.write_ids(make_docs([]), path)
    assert bitplanes.document_digests(spark, path).count() == 0 and bitplanes.read_ids(spark, path).count() == 0
