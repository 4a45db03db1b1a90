import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import token_codec as codec
from tests.llm.helpers import empty, odd_rows, transcripts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n, kinds", [(1, 1), (31, 3), (33, 1), (codec.BLOCK, 50), (codec.BLOCK + 1, 2000), (3 * codec.BLOCK - 7, 50_000)])
def test_blocks_decode_to_what_was_coded_in_any_selection(n, kinds):
    rng = np.random.default_rng(n)
    places = np.minimum(rng.zipf(1.3, n) - 1, kinds - 1)
    _, places = np.unique(places, return_inverse=True)
    freq = codec.frequencies(np.bincount(places))
    assert freq.sum() == 1 << codec.SCALE and freq.min() >= 1
    blocks = codec.encode_blocks(places, freq)
    assert np.array_equal(np.concatenate(codec.decode_blocks(blocks, freq)), places)
    for b in range(len(blocks)):
        assert np.array_equal(codec.decode_blocks(blocks[b:b + 1], freq)[0], places[b * codec.BLOCK:(b + 1) * codec.BLOCK])


def test_code_length_is_near_the_entropy():
    rng = np.random.default_rng(1)
    _, places = np.unique(np.minimum(rng.zipf(1.5, 200_000), 3000), return_inverse=True)
    counts = np.bincount(places)
    bits = 32 * sum(len(w) for _, _, w in codec.encode_blocks(places, codec.frequencies(counts)))
    entropy = -(counts * np.log2(counts / counts.sum())).sum()
    assert entropy < bits + 64 * 32 * 7 and bits < 1.01 * entropy


def test_damage_is_noticed():
    ids = np.arange(5000, dtype="<u4") % 700
    data = codec.pack_segment([b"1", None], [3000, 2000], [True, True], ids) + b"\n"
    names, sizes, starts, back = next(codec.read_segments(data))
    assert (names, sizes, starts) == ([b"1", None], [3000, 2000], [True, True]) and np.array_equal(back, ids)
    for at in (0, 9, 60, len(data) // 2, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(Exception):
            assert np.array_equal(next(codec.read_segments(bytes(broken)))[3], ids) and False


def test_chunks_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    parts = ["a", "Hola", "don't", "it's", "'ll", " ", "  ", "\n", " \n", "\t", " ", " ", "\x1c", "\x85", "12", "3.4", "!!", "ñandú", "漢字", "Straße,", "ǅ.", "ʰx", "ª", "ⅷ", "e\u0301", "\U0001F600", "<|endoftext|>", "é"]
    texts = ["", " ", "a ", " a", "a  b", "a\n b", "a \nb"] + ["".join(rng.choice(parts + [" "] * 12) for _ in range(rng.randrange(1, 40))) for _ in range(1500)]
    whole = Tokenizer.from_file(PATH)
    coder = codec.ChunkTokenizer(PATH)
    for text, raw in zip(texts, coder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_only_marks_of_words_go_to_the_whole_tokenizer(monkeypatch):
    texts = [" ".join(f"{w}{x}{marks}" for x in "abcdefgh" for marks in ("", ",", "...", "!?", "###", "'")) for w in ("ño", "casa", "Hola", "漢")]
    whole, coder, sent = Tokenizer.from_file(PATH), codec.ChunkTokenizer(PATH), []
    plain = coder._encode
    monkeypatch.setattr(coder, "_encode", lambda chunks: sent.extend(chunks) or plain(chunks))
    for text, raw in zip(texts, coder.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert {s for s in sent if not s.endswith("'")} == {",", "...", "!?", "###"}


@pytest.mark.parametrize("kept", [0, 40, 300])
def test_forgotten_chunks_are_learned_again(monkeypatch, kept):
    monkeypatch.setattr(codec.ChunkTokenizer, "KEPT", kept)
    rng = random.Random(5)
    whole, coder = Tokenizer.from_file(PATH), codec.ChunkTokenizer(PATH)
    for round in range(40):
        texts = [" ".join(rng.choice("aeiou") + rng.choice("nñr") + rng.choice(["", ".", "!!", "\n", "9"]) for _ in range(9)) for _ in range(rng.randrange(4))] + [""] * (round % 3)
        assert [np.frombuffer(raw, "<u4").tolist() for raw in coder.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
        if round == 20:
            coder.rest()


@pytest.mark.parametrize("segment,file_ids", [(codec.SEGMENT, codec.FILE_IDS), (1000, codec.FILE_IDS), (1000, 1500), (100, 1)])
def test_files_come_back_in_the_order_of_ids(spark, tmp_path, segment, file_ids):
    rows = odd_rows() + [(100 + i, f"nota {i} de la cuenta") for i in range(300)]
    path = str(tmp_path / "tokens")
    codec.write_token_files(transcripts(spark, rows), path, PATH, segment=segment, file_ids=file_ids)
    files = codec.read_files(spark, path).count()
    assert files >= {1: 200, 1500: 5}.get(file_ids, 1)
    got = codec.read_token_files(spark, path).orderBy("start").collect()
    tokenizer, start, expected = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        expected.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == expected


def test_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "tokens")
    codec.write_token_files(empty(spark), path, PATH)
    assert codec.read_token_files(spark, path).count() == 0
