"""Token files of call transcripts, coded by a static range asymmetric numeral system.

A file is a row of segments. A segment holds up to SEGMENT token ids of consecutive transcripts, one
frequency table that its blocks share, and blocks of BLOCK ids. A block is coded by LANES interleaved
states and can be decoded on its own: its header has the number of ids before it in the segment (a
checkpoint), its states, the length of its words and a checksum of its ids. Blocks of a segment are
coded and decoded together, one step for all lanes at a time.

Segment, little-endian, followed by a line feed:
    magic "RTS1", length of what follows, number of transcripts, of ids, of symbols, of blocks
    per transcript: length of its id as text, that text, number of ids, first flag
    per symbol: id, frequency (their sum is 2^SCALE)
    per block: ids before it, ids in it, words, crc32 of its ids, LANES states of 64 bits, the words
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import read_files, write_frames
from riskloom.llm.texts import arrow_rows, only
from riskloom.session import materialize

MAGIC = b"RTS1"
SCALE = 18
LANES = 32
BLOCK = 1 << 15
SEGMENT = 1 << 22
FILE_IDS = 8 * SEGMENT  # ids of a file, and one transcript more
LOW = np.uint64(1 << 31)
END_ID = 0


# ---------------------------------------------------------------- the coder

def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts of the used symbols scaled to a sum of 2^SCALE, each at least 1."""
    total = 1 << SCALE
    scaled = np.maximum(1, counts * (total - len(counts)) // counts.sum())
    scaled[np.argmax(scaled)] += total - scaled.sum()
    return scaled


def used_symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids in order, the place of each id among them, and their counts."""
    if int(ids.max(initial=0)) >= 1 << SCALE:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[ids], counts[symbols]


def encode_blocks(places: np.ndarray, freq: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(ids, states, words) of each block of the symbol places; blocks do not depend on each other."""
    n = len(places)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.int64)
    padded[:n] = places
    steps = padded.reshape(blocks, BLOCK // LANES, LANES)
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    freq = freq.astype(np.uint64)
    limit = freq << np.uint64(63 - SCALE)
    state = np.full((blocks, LANES), LOW, np.uint64)
    words = np.zeros(steps.shape, np.uint32)
    sent = np.zeros(steps.shape, bool)
    sizes = [min(BLOCK, n - b * BLOCK) for b in range(blocks)]
    for t in range(BLOCK // LANES - 1, -1, -1):
        used = blocks if sizes[-1] > t * LANES else blocks - 1          # only the last block may be shorter
        symbol, now = steps[:used, t], state[:used]
        f = freq[symbol]
        over = now >= limit[symbol]
        words[:used, t] = now & np.uint64(0xFFFFFFFF)
        sent[:used, t] = over
        now = np.where(over, now >> np.uint64(32), now)
        quotient = now // f
        state[:used] = (quotient << np.uint64(SCALE)) + (now - quotient * f) + start[symbol]
    return [(sizes[b], state[b], words[b][sent[b]]) for b in range(blocks)]


def decode_blocks(blocks: list[tuple[int, np.ndarray, np.ndarray]], freq: np.ndarray) -> list[np.ndarray]:
    """The symbol places of each block; any selection of blocks can be given."""
    if not blocks:
        return []
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    symbols = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
    freq = freq.astype(np.uint64)
    state = np.stack([s for _, s, _ in blocks])
    lengths = np.array([len(w) for _, _, w in blocks])
    words = np.concatenate([*[w for _, _, w in blocks], np.zeros(1, np.uint32)]).astype(np.uint64)
    ends = np.cumsum(lengths)
    at = ends - lengths
    out = np.empty((len(blocks), BLOCK // LANES, LANES), np.int32)
    sizes = np.array([n for n, _, _ in blocks])[:, None]
    for t in range(BLOCK // LANES):
        active = sizes > t * LANES
        slot = state & np.uint64((1 << SCALE) - 1)
        symbol = symbols[slot]
        out[:, t] = symbol
        state = np.where(active, freq[symbol] * (state >> np.uint64(SCALE)) + slot - start[symbol], state)
        need = (state < LOW) & active
        order = np.cumsum(need, axis=1)
        place = np.minimum(at[:, None] + order - 1, len(words) - 1)
        state = np.where(need, state << np.uint64(32) | words[np.maximum(place, 0)], state)
        at = at + order[:, -1]
    if (at != ends).any() or (state != LOW).any():
        raise ValueError("a block does not end where it should")
    flat = out.reshape(len(blocks), -1)
    return [flat[b, :n] for b, (n, _, _) in enumerate(blocks)]


# ---------------------------------------------------------------- segments

def pack_segment(names: list[bytes | None], sizes: list[int], starts: list[bool], ids: np.ndarray) -> bytes:
    """names and sizes of the transcripts (or parts of them, starts false for a further part)."""
    symbols, places, counts = used_symbols(ids)
    freq = frequencies(counts)
    blocks = encode_blocks(places, freq)
    parts = [struct.pack("<IIII", len(names), len(ids), len(symbols), len(blocks))]
    for name, size, first in zip(names, sizes, starts):
        text = name if name is not None else b""
        parts += [struct.pack("<I", len(text) + 1 if name is not None else 0), text, struct.pack("<IB", size, first)]
    parts += [symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes()]
    for b, (n, states, words) in enumerate(blocks):
        own = ids[b * BLOCK:b * BLOCK + n].astype("<u4").tobytes()
        parts += [struct.pack("<IIII", b * BLOCK, n, len(words), zlib.crc32(own)), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()]
    body = b"".join(parts)
    return MAGIC + struct.pack("<I", len(body)) + body


def read_segments(content: bytes) -> Iterator[tuple[list, list[int], list[bool], np.ndarray]]:
    """(names, sizes, starts, ids) of each segment of a file, with every checksum compared."""
    view, at = memoryview(content), 0
    while at < len(view):
        if bytes(view[at:at + 4]) != MAGIC:
            raise ValueError(f"no segment begins at byte {at}")
        (length,) = struct.unpack_from("<I", view, at + 4)
        here, end = at + 8, at + 8 + length
        if end + 1 > len(view) or view[end] != 0x0A:
            raise ValueError("a segment is cut off")
        n_names, n_ids, n_symbols, n_blocks = struct.unpack_from("<IIII", view, here)
        here += 16
        names, sizes, starts = [], [], []
        for _ in range(n_names):
            (size,) = struct.unpack_from("<I", view, here)
            here += 4
            names.append(bytes(view[here:here + size - 1]) if size else None)
            here += max(size - 1, 0)
            count, first = struct.unpack_from("<IB", view, here)
            here += 5
            sizes.append(count)
            starts.append(bool(first))
        symbols, freq = (np.frombuffer(view, "<u4", n_symbols, here + i * 4 * n_symbols) for i in (0, 1))
        here += 8 * n_symbols
        blocks, sums = [], []
        for b in range(n_blocks):
            before, n, n_words, crc = struct.unpack_from("<IIII", view, here)
            if before != b * BLOCK:
                raise ValueError("a checkpoint is wrong")
            blocks.append((n, np.frombuffer(view, "<u8", LANES, here + 16), np.frombuffer(view, "<u4", n_words, here + 16 + 8 * LANES)))
            sums.append(crc)
            here += 16 + 8 * LANES + 4 * n_words
        decoded = [symbols[p].astype("<u4") for p in decode_blocks(blocks, freq.astype(np.int64))]
        if here != end or any(zlib.crc32(d.tobytes()) != c for d, c in zip(decoded, sums)):
            raise ValueError("a checksum or a length is wrong")
        yield names, sizes, starts, np.concatenate(decoded) if decoded else np.empty(0, "<u4")
        at = end + 1


# ---------------------------------------------------------------- tokenizer

ADJACENT = re.compile(r"\s\s")
# After letters, a piece of its own to the tokenizer. An apostrophe is not: letters may follow it in one.
MARKS = string.punctuation.replace("'", "")
AT_ONCE = 1 << 22   # Characters of the texts whose chunks are looked up together, and one text more.
# The letters by which byte-level tokenizers name bytes: the visible ones by themselves, the others by
# the letters from U+0100 on, in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _VISIBLE)}
SPACE = chr(BYTE_LETTERS[0x20])


class _Rows:
    """Rows of ids, one behind the other."""

    def __init__(self):
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int64)])

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows at these places, and where each of them begins and the last one ends."""
        sizes = self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(self.ends[at] - ends[:-1], sizes)
        place += np.arange(ends[-1])
        return self.ids[place], ends


class ChunkTokenizer:
    """Ids of a text by a byte-level BPE tokenizer, with the ids of frequent chunks kept.

    The tokenizer splits a text where a word is followed by a blank and never looks across, so a text
    whose blanks stand alone can be cut before each space and around each line feed and the ids of the chunks joined; likewise
    punctuation marks behind letters are a piece of their own. All other texts (blanks in a row, special
    strings) go to the tokenizer as a whole. Texts given at once have each different chunk looked up once.
    Kept chunks that are not met again are forgotten.
    """

    KEPT = 400_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")        # Spark deals out the work
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] + ["\0"]
        self.known: dict[str, int] = {}         # chunk: its place among the rows
        self.rows = _Rows()
        self.rest()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.rows.add(ids, sizes)

    def _keep_words(self, words: list[str]) -> None:
        """Letters, with a space before them or not, are one piece to the tokenizer: its model alone gives the ids."""
        ids, sizes, tokenize = array("I"), [], self.model.tokenize
        for word in words:
            named = word.replace(" ", SPACE) if word.isascii() else word.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS)
            tokens = tokenize(named)
            ids.extend([t.id for t in tokens])
            sizes.append(len(tokens))
        self._keep(words, np.array(ids, "<u4"), np.array(sizes, np.int64))

    def _learn(self, missing: list[str]) -> None:
        """Keep chunks that are not known, none of them twice."""
        if self.older:
            at = np.fromiter(map(self.older.get, missing, repeat(-1)), np.int64, len(missing))
            ids, ends = self.older_rows.take(at[at >= 0])
            self._keep([c for c, i in zip(missing, at.tolist()) if i >= 0], ids, np.diff(ends))
            missing = [c for c, i in zip(missing, at.tolist()) if i < 0]
        known, words, listed, ended = self.known, [], [], []
        for chunk in missing:
            word = chunk if chunk[-1] not in MARKS else chunk.rstrip(MARKS)
            if not (word[1:] if word[:1] == " " else word).isalpha():
                listed.append(chunk)
            elif word is chunk:
                words.append(chunk)
            else:
                ended.append((chunk, word, chunk[len(word):]))
        self._keep_words([w for w in dict.fromkeys(words + [w for _, w, _ in ended]) if w not in known])
        listed = [c for c in dict.fromkeys(listed + [marks for _, _, marks in ended]) if c not in known]
        raw = self._encode(listed)
        self._keep(listed, np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4)
        ids, ends = self.rows.take(np.array([known[part] for _, *parts in ended for part in parts], np.int64))
        self._keep([chunk for chunk, _, _ in ended], ids, np.diff(ends[::2]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.KEPT:
            self.older, self.older_rows, self.known, self.rows = self.known, self.rows, {}, _Rows()
        if not self.known:
            self._keep([""], np.empty(0, "<u4"), np.zeros(1, np.int64))
        parted = [not (ADJACENT.search(text) or any(s in text for s in self.special)) for text in texts]
        marked = [text.replace(" ", "\0 ").replace("\n", "\0\n\0") for text, own in zip(texts, parted) if own]
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), "\0")
        chunks = lists.flatten().dictionary_encode()
        different = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [different[i] for i in missing.tolist()]
            self._learn(new)
            at[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        ids, ends = self.rows.take(at[chunks.indices.to_numpy()])
        ends = ends[lists.offsets.to_numpy()].tolist()
        cut = (ids[a:b].tobytes() for a, b in zip(ends, ends[1:]))
        whole = iter(self._encode([text for text, own in zip(texts, parted) if not own]))
        return [next(cut if own else whole) for own in parted]

    def rest(self) -> None:
        """Give back what the next task can do without."""
        self.older, self.older_rows = {}, _Rows()


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One per Python worker, so that its chunks serve the following tasks too."""
    return ChunkTokenizer(path)


# ---------------------------------------------------------------- tables

def _parts(rows: list[tuple]) -> Iterator[list[tuple]]:
    """(name, text) rows in parts of about AT_ONCE characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def write_token_files(transcripts: DataFrame, path: str, tokenizer: str, transcript_id: str = "transcript_id",
                      full_text: str = "full_text", segment: int = SEGMENT, file_ids: int = FILE_IDS) -> None:
    """The ids of all transcripts in ascending order of their id (nulls first), each closed by END_ID.

    Files hold ranges of ids, in the order of their names, and are closed behind a transcript once they have `file_ids` ids. A null text is empty. Rows that share an
    id follow each other in the order of their text. Other columns are ignored. A transcript longer than a
    segment goes on in the next one.
    """
    rows = only(transcripts, transcript_id=transcript_id, full_text=full_text)
    rows = rows.repartitionByRange("transcript_id", F.xxhash64("full_text")).sortWithinPartitions("transcript_id", "full_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size, segments, filed = _tokenizer(tokenizer), [], 0, [], 0

        def flush():
            nonlocal held, size
            names, data, first = zip(*held)
            segments.append(pack_segment(list(names), [len(d) for d in data], list(first), np.concatenate(data)))
            held, size = [], 0

        def file():
            nonlocal segments, filed
            if held:
                flush()
            whole = pa.RecordBatch.from_arrays([pa.array([b"\n".join(segments)], pa.binary())], ["piece"])
            segments, filed = [], 0
            return whole

        for b in batches:
            rows_of = [(None if name is None else str(name).encode(), text or "") for name, text in arrow_rows(b, "transcript_id", "full_text")]
            for part in _parts(rows_of):
                for (name, _), raw in zip(part, coder.encode([t for _, t in part])):
                    ids, first = np.append(np.frombuffer(raw, "<u4"), np.uint32(END_ID)), True
                    while len(ids):
                        take = ids[:segment - size]
                        held.append((name, take, first))
                        size, filed, ids, first = size + len(take), filed + len(take), ids[len(take):], False
                        if size >= segment:
                            flush()
                    if filed >= file_ids:
                        yield file()
        if held or segments:
            yield file()
        coder.rest()

    write_frames(rows.mapInArrow(run, "piece binary"), "piece", path, "\n", 1)


def read_token_files(spark, path: str, id_type: str = "bigint") -> DataFrame:
    """(transcript_id, start, n_tokens, ids_crc32) of every transcript, from the files alone.

    start is the number of ids of all transcripts before it: those before it in its file plus the
    totals of the files before that, which are as many numbers as there are files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in arrow_rows(b, "path", "content"):
                rows: list[list] = []
                at = 0
                for names, sizes, starts, ids in read_segments(content):
                    ends = np.cumsum(sizes)
                    for who, size, first, end in zip(names, sizes, starts, ends):
                        data = ids[end - size:end].tobytes()
                        if first:
                            if len(rows) >= 1 << 14:
                                yield _token_rows(name, rows)
                                rows = []
                            rows.append([who, at, size, zlib.crc32(data)])
                        else:
                            rows[-1][2] += size
                            rows[-1][3] = zlib.crc32(data, rows[-1][3])
                        at += size
                if rows:
                    yield _token_rows(name, rows)

    found = materialize(read_files(spark, path).mapInArrow(run, "file string, transcript_id string, within bigint, n_tokens bigint, ids_crc32 bigint"), "tokens")
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("file", before.alias("offset"))
    return found.join(offsets, "file").select(F.col("transcript_id").cast(id_type).alias("transcript_id"),
                                              (F.col("offset") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _token_rows(name: str, rows: list[list]) -> pa.RecordBatch:
    who, at, size, crc = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(rows)), pa.array([None if w is None else w.decode() for w in who], pa.string()), pa.array(at, pa.int64()),
         pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["file", "transcript_id", "within", "n_tokens", "ids_crc32"])
